"""Queries on rerooted and labelled trees, lineage functions, trimmed alignments and merged hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.functions import normalize as N
from arborframe.operators import alignment as A
from arborframe.operators import hits as H
from arborframe.operators import relate as J
from arborframe.operators import reroot as Z
from arborframe.operators import tree as R

from .hierarchy import _CLOSE, _RED, LINEAGE, NODES, lineage, nodes, read
from .tables import _MARK, _MSA, _markers, _msa, hit_table


def tree_outgroup(spark, sf_dir):
    encoded = R.encode(nodes(spark, sf_dir))
    out = read(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.lit(1).alias("tree_id"), F.concat(F.lit("c-"), "c_custkey").alias("node_id"))
    return Z.reroot(encoded, Z.outgroup_edges(encoded, out)).select("node_id", "parent_id", "edge_length")


def tree_midpoint(spark, sf_dir):
    return Z.midpoint_edges(R.encode(nodes(spark, sf_dir))).select("node_id", F.round("below", 6).alias("below"))


def tree_named(spark, sf_dir):
    encoded = R.encode(nodes(spark, sf_dir))
    return R.named_divergence(encoded, R.relative_divergence(encoded)).select("node_id", "taxon", F.round("red", 9).alias("red"))


def tree_phyla(spark, sf_dir):
    return R.first_taxa(R.encode(nodes(spark, sf_dir)), "p__").select("node_id", "lineage")


def tree_nearest(spark, sf_dir):
    encoded = R.encode(nodes(spark, sf_dir))
    leaves = read(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("tree_id"), F.concat(F.lit("c-"), "c_custkey").alias("node_id"))
    found = R.nearest_summary(encoded, leaves.where("c_custkey % 97 <> 0").drop("c_custkey"), leaves.where("c_custkey % 97 = 0").drop("c_custkey"))
    return found.select("node_id", "anc_id", "n_leaves", "first_leaf")


def lineage_functions(spark, sf_dir):
    cut = F.expr("slice(taxa, 1, cast(genome_id % 6 as int) + 1)")
    gap = F.filter("taxa", lambda t, i: (i + F.col("genome_id")) % 3 != 0)
    text = F.array_join(cut, "; ")
    return lineage(spark, sf_dir).select(
        "genome_id", F.array_join(N.fill_trailing(cut), ";").alias("trailing"), F.array_join(N.fill_missing(gap), ";").alias("missing"),
        F.get(N.species_with_genus(F.col("taxa")), F.lit(6)).alias("species"), N.taxa_at_ranks(text)["p__"].alias("phylum"), N.itol_label(text).alias("itol"),
    )


def trim_statistics(spark, sf_dir):
    return A.trim_statistics(_msa(spark, sf_dir), 75.0)


def columns_per_marker(spark, sf_dir):
    cols = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("col"))
    found = A.columns_per_marker(A.owner(cols, A.offsets(_markers(spark, sf_dir))))
    return found.select(F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


def merged_hits(spark, sf_dir):
    rows = hit_table(spark, sf_dir).select("gene_id", "hmm_id", "e_val", "bit_score")
    return H.merged_by_model(rows.where("hmm_id < 2"), rows.where("hmm_id = 2").withColumn("hmm_id", F.lit(0).cast("long")))


def class_taxa(spark, sf_dir):
    return J.taxa_of_classes(lineage(spark, sf_dir), ["c__FRANCE-BUILDING", "c__NATION_3-BUILDING", "c__NATION_3-MACHINERY"], 4)


def lost_genomes(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    return J.lost(c, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", step="ordering")


def subtree_batches(spark, sf_dir):
    routed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.when(F.col("c_nationkey") != 7, F.col("c_nationkey")).alias("tree_id"))
    return J.batches(routed)


QUERIES = {f.__name__: f for f in (
    tree_outgroup, tree_midpoint, tree_named, tree_phyla, tree_nearest, lineage_functions, trim_statistics, columns_per_marker, merged_hits, class_taxa, lost_genomes, subtree_batches,
)}

_P = "['d__', 'p__', 'c__', 'o__', 'f__', 'g__', 's__']"
SQL = {
    "tree_outgroup": f"""WITH RECURSIVE {NODES},
v AS (SELECT par AS region, e FROM nodes WHERE id = 'n-3')
SELECT id AS node_id, CASE WHEN id = 'n-3' OR id = region THEN 'root:n-3' WHEN id = 'root' THEN region ELSE par END AS parent_id,
  CASE WHEN id = 'n-3' OR id = region THEN v.e / 2 WHEN id = 'root' THEN (SELECT e FROM nodes WHERE id = (SELECT region FROM v)) ELSE nodes.e END AS edge_length
FROM nodes, v UNION ALL SELECT 'root:n-3', NULL, NULL""",
    "tree_midpoint": f"""WITH RECURSIVE {NODES},
up AS (SELECT path[i] AS anc, path[i + 1] AS kid, id AS leaf, dist FROM (SELECT id, path, dist, unnest(range(1, len(path))) AS i FROM walk WHERE id LIKE 'c-%')),
k AS (SELECT anc, kid, max(dist) AS m, arg_max(leaf, dist) AS leaf FROM up GROUP BY ALL),
two AS (SELECT anc, max(m) AS m1, arg_max(leaf, m) AS leaf, list_sort(list(m), 'DESC')[2] AS m2 FROM k GROUP BY anc HAVING count(*) > 1),
b AS (SELECT leaf, m1, m1 + m2 - 2 * dist AS d FROM two JOIN walk ON id = anc ORDER BY d DESC LIMIT 1)
SELECT w.id AS node_id, round(w.dist - (m1 - d / 2), 6) AS below
FROM b JOIN walk l ON l.id = b.leaf JOIN walk w ON list_contains(l.path, w.id) WHERE w.depth > 0 AND w.dist >= m1 - d / 2 ORDER BY w.depth LIMIT 1""",
    "tree_named": f"""WITH RECURSIVE {NODES}, {_CLOSE}, {_RED}
SELECT id AS node_id, taxon, round(red, 9) AS red
FROM red JOIN (SELECT 'r-' || r_regionkey AS id, 'd__' || r_name AS taxon FROM region UNION ALL SELECT 'n-' || n_nationkey, 'p__' || n_name FROM nation) USING (id)""",
    "tree_phyla": f"""WITH RECURSIVE {NODES}
SELECT id AS node_id, 'd__' || r_name || ';p__' || n_name AS lineage FROM walk JOIN nation ON id = 'n-' || n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tree_nearest": f"""WITH RECURSIVE {NODES}, {_CLOSE},
m AS (SELECT anc, count(*) AS n_leaves, min(leaf) AS first_leaf FROM c WHERE CAST(substr(leaf, 3) AS BIGINT) % 97 = 0 GROUP BY anc),
a AS (SELECT leaf, arg_max(anc, depth) AS anc FROM c JOIN m USING (anc) JOIN walk ON walk.id = anc WHERE CAST(substr(leaf, 3) AS BIGINT) % 97 <> 0 GROUP BY leaf)
SELECT leaf AS node_id, anc AS anc_id, n_leaves, first_leaf FROM a JOIN m USING (anc)""",
    "lineage_functions": f"""WITH {LINEAGE}
SELECT genome_id, array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN k <= genome_id % 6 + 1 THEN taxa[k] ELSE {_P}[k] END), ';') AS trailing,
  array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN (k - 1 + genome_id) % 3 <> 0 THEN taxa[k] ELSE {_P}[k] END), ';') AS missing,
  CASE WHEN taxa[7] = 's__' THEN 's__' ELSE 's__' || substr(taxa[6], 4) || ' ' || substr(taxa[7], 4) END AS species,
  CASE WHEN genome_id % 6 > 0 THEN taxa[2] END AS phylum, array_to_string(taxa[1:genome_id % 6 + 1], '|') AS itol FROM lineage""",
    "trim_statistics": f"""WITH {_MSA}, p AS (SELECT id, CAST(length(seq) AS INTEGER) AS length, length(regexp_replace(seq, '[^A-Za-z]', '', 'g')) * 100.0::DOUBLE / length(seq) AS percent FROM m)
SELECT *, percent >= 75 AS kept FROM p""",
    "columns_per_marker": f"""WITH {_MARK}, n AS (SELECT marker_id, count(*) AS n FROM orders JOIN off ON o_orderkey >= "end" - length AND o_orderkey < "end" GROUP BY marker_id)
SELECT round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS deviation FROM n""",
    "merged_hits": """SELECT CASE l_suppkey % 3 WHEN 2 THEN 0 ELSE l_suppkey % 3 END AS hmm_id, count(DISTINCT l_orderkey) AS n_genes, count(*) AS n_hits, max(l_extendedprice) AS best_bit FROM lineitem GROUP BY ALL""",
    "class_taxa": f"WITH {LINEAGE} SELECT DISTINCT taxa[5] AS taxon FROM lineage WHERE taxa[3] IN ('c__FRANCE-BUILDING', 'c__NATION_3-BUILDING', 'c__NATION_3-MACHINERY')",
    "lost_genomes": "SELECT c_custkey, 'ordering' AS step FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "subtree_batches": "SELECT c_nationkey AS tree_id, count(*) AS n_queries FROM customer WHERE c_nationkey <> 7 GROUP BY ALL",
}
