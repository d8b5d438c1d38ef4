"""Queries on the customer hierarchy: lineages, roll-ups, votes, trees and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.functions import normalize as N
from arborframe.operators import classify as C
from arborframe.operators import taxonomy as T
from arborframe.operators import tree as R


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as genomes: region, nation, segment and three finer groups as ranks; the species is left open for some."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k, seg = F.col("c_custkey"), F.concat_ws("-", "n_name", "c_mktsegment")
    taxa = F.array(
        F.concat(F.lit("d__"), "r_name"), F.concat(F.lit("p__"), "n_name"), F.concat(F.lit("c__"), seg), F.concat(F.lit("o__"), seg, (k % 3).cast("string")),
        F.concat(F.lit("f__"), seg, (k % 6).cast("string")), F.concat(F.lit("g__"), seg, (k % 12).cast("string")), F.when(k % 5 == 0, "s__").otherwise(F.concat(F.lit("s__"), "c_name")),
    )
    return rows.select(k.alias("genome_id"), taxa.alias("taxa"))


LINEAGE = """lineage AS (
  SELECT c_custkey AS genome_id, ['d__' || r_name, 'p__' || n_name, 'c__' || n_name || '-' || c_mktsegment,
    'o__' || n_name || '-' || c_mktsegment || (c_custkey % 3), 'f__' || n_name || '-' || c_mktsegment || (c_custkey % 6),
    'g__' || n_name || '-' || c_mktsegment || (c_custkey % 12), CASE WHEN c_custkey % 5 = 0 THEN 's__' ELSE 's__' || c_name END] AS taxa
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
long AS (
  SELECT genome_id, k - 1 AS rank_idx, taxa[k] AS taxon FROM (SELECT genome_id, taxa, unnest(range(1, 8)) AS k FROM lineage) WHERE length(taxa[k]) > 3
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root - region - nation - segment - customer as a tree, with account balances as edge lengths."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    null = F.lit(None).cast("string")
    part = lambda df, node, parent, edge, taxon: df.select(F.lit(1).alias("tree_id"), node.alias("node_id"), parent.alias("parent_id"), edge.cast("double").alias("edge_length"), taxon.alias("taxon"))
    key = lambda p, *cs: F.concat_ws("-", F.lit(p), *[F.col(x).cast("string") for x in cs])
    seg = c.select("c_nationkey", "c_mktsegment").distinct()
    used_n = n.join(c.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    used_r = r.join(used_n.select(F.col("n_regionkey").alias("r_regionkey")).distinct(), "r_regionkey", "left_semi")
    return (
        part(spark.range(1), F.lit("root"), null, F.lit(None), null)
        .unionAll(part(used_r, key("r", "r_regionkey"), F.lit("root"), F.lit(1) + F.col("r_regionkey"), F.concat(F.lit("d__"), "r_name")))
        .unionAll(part(used_n, key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit(2) + F.col("n_nationkey") % 3, F.concat(F.lit("p__"), "n_name")))
        .unionAll(part(seg, key("s", "c_nationkey", "c_mktsegment"), key("n", "c_nationkey"), F.length("c_mktsegment"), null))
        .unionAll(part(c, key("c", "c_custkey"), key("s", "c_nationkey", "c_mktsegment"), F.abs("c_acctbal"), null))
    )


NODES = """nodes AS (
  SELECT 'root' AS id, NULL AS par, 0.0::DOUBLE AS e
  UNION ALL SELECT 'r-' || r_regionkey, 'root', 1.0 + r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
  UNION ALL SELECT 'n-' || n_nationkey, 'r-' || n_regionkey, 2.0 + n_nationkey % 3 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
  UNION ALL SELECT DISTINCT 's-' || c_nationkey || '-' || c_mktsegment, 'n-' || c_nationkey, length(c_mktsegment)::DOUBLE FROM customer
  UNION ALL SELECT 'c-' || c_custkey, 's-' || c_nationkey || '-' || c_mktsegment, abs(c_acctbal) FROM customer
),
walk AS (
  SELECT id, par, e, e AS dist, 0 AS depth, [id] AS path FROM nodes WHERE par IS NULL
  UNION ALL SELECT n.id, n.par, n.e, w.dist + n.e, w.depth + 1, list_append(w.path, n.id) FROM nodes n JOIN walk w ON n.par = w.id
)"""


def standardise_lineage(spark, sf_dir):
    rows = lineage(spark, sf_dir)
    cut = F.expr("slice(taxa, 2, cast(genome_id % 6 as int) + 1)")
    return rows.select("genome_id", F.array_join(N.standardise(cut, F.get("taxa", F.lit(0))), ";").alias("lineage"), F.array_join(N.limit_rank(F.col("taxa"), 3), ";").alias("to_order"), N.is_full(F.when(F.col("genome_id") % 4 == 0, cut).otherwise(F.col("taxa"))).alias("is_full"))


def rollup_lineage(spark, sf_dir):
    return T.extant(lineage(spark, sf_dir))


def children_parents(spark, sf_dir):
    rows = lineage(spark, sf_dir)
    kids = T.children(rows).select("rank_idx", "taxon", F.size("children").alias("n_children"), F.get("children", F.lit(0)).alias("first_child"), F.md5(F.array_join("children", ",")).alias("all_children"))
    return kids.join(T.parents(rows), ["rank_idx", "taxon"])


def duplicate_names(spark, sf_dir):
    odd = lineage(spark, sf_dir).withColumn("taxa", F.transform("taxa", lambda t, i: F.when((i == 5) & (F.col("genome_id") % 4 == 0), "g__shared").otherwise(t)))
    return T.duplicate_names(odd).select("rank_idx", "taxon", "n_lineages")


def validate_taxonomy(spark, sf_dir):
    odd = lineage(spark, sf_dir).withColumn(
        "taxa", F.when(F.col("genome_id") % 10 == 1, F.expr("slice(taxa, 1, 6)")).when(F.col("genome_id") % 10 == 2, F.transform("taxa", lambda t, i: F.when(i == 2, F.concat(F.lit("x"), t)).otherwise(t))).otherwise(F.col("taxa"))
    )
    return T.problems(odd)


def majority_vote(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    taxon = F.when(F.col("o_orderkey") % 7 == 0, "g__").otherwise(F.concat(F.lit("g__"), F.substring("o_orderpriority", 1, 1)))
    coarse = F.when(F.col("o_orderkey") % 3 == 0, "p__").otherwise("p__x")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("cluster"), F.explode(F.array(F.struct(F.lit(5).alias("rank_idx"), taxon.alias("taxon")), F.struct(F.lit(1).alias("rank_idx"), coarse.alias("taxon")))).alias("m")).select("cluster", "m.*")
    return T.votes(rows)


def resolved_votes(spark, sf_dir):
    return T.resolved(majority_vote(spark, sf_dir))


def divergence(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 7).cast("int").alias("rank_idx"), F.col("o_custkey").alias("taxon"), ((F.col("o_custkey") % 7) * 0.12 + (F.col("o_orderkey") % 97) / 97.0 * 0.6).alias("red"))


def median_of_medians(spark, sf_dir):
    return T.rank_medians(divergence(spark, sf_dir))


def outlier_class(spark, sf_dir):
    return T.outliers(divergence(spark, sf_dir)).select("rank_idx", "taxon", "closest_rank", "class", F.round("delta", 9).alias("delta"))


def overlay_priority(spark, sf_dir):
    rows = lineage(spark, sf_dir)
    second = rows.where("genome_id % 3 = 0").select("genome_id", N.limit_rank(F.col("taxa"), 2).alias("taxa"))
    third = rows.where("genome_id % 5 = 1").select("genome_id", N.limit_rank(F.col("taxa"), 0).alias("taxa"))
    return T.overlay(rows, second, third).select("genome_id", F.array_join("taxa", ";").alias("lineage"))


def inference_taxa(spark, sf_dir):
    return T.inference_taxa(lineage(spark, sf_dir), 3)


def tree_closure(spark, sf_dir):
    return R.leaf_counts(R.encode(nodes(spark, sf_dir))).select("node_id", "n_leaves", F.round("mean_dist", 6).alias("mean_dist"))


def tree_mrca(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    members = c.select(F.lit(1).alias("tree_id"), (F.col("c_custkey") % 50).alias("set_id"), F.concat(F.lit("c-"), "c_custkey").alias("node_id")).unionAll(
        c.where("c_nationkey < 5").select(F.lit(1), F.lit(1000) + F.col("c_nationkey"), F.concat(F.lit("c-"), "c_custkey"))
    )
    return R.common_ancestor(R.encode(nodes(spark, sf_dir)), members).select("set_id", "mrca")


def tree_patristic(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    pairs = c.where("c_custkey > 1").select(F.lit(1).alias("tree_id"), F.concat(F.lit("c-"), "c_custkey").alias("a"), F.concat(F.lit("c-"), F.col("c_custkey") - 1).alias("b"))
    return R.patristic(R.encode(nodes(spark, sf_dir)), pairs).select("a", "b", "mrca", F.round("distance", 6).alias("distance"))


def tree_red(spark, sf_dir):
    return R.relative_divergence(R.encode(nodes(spark, sf_dir))).select("node_id", F.round("red", 9).alias("red"))


def tree_interpolate(spark, sf_dir):
    encoded = R.encode(nodes(spark, sf_dir))
    red = R.relative_divergence(encoded).select("tree_id", "node_id", "red")
    low = encoded.where("is_leaf").select("tree_id", F.col("node_id").alias("query"), F.col("parent_id").alias("upper"), F.col("node_id").alias("lower"), (F.col("dist_root") - F.col("edge_length") * 0.25).alias("dist_root"))
    return R.interpolated(low, encoded, red).select("query", F.round("red", 9).alias("red"))


def leaf_taxa(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    node = F.concat(F.lit("c-"), "c_custkey").alias("node_id")
    return c.select(F.lit(1).alias("tree_id"), node, F.lit(1).alias("rank_idx"), F.concat(F.lit("p__"), F.when(F.col("c_custkey") % 20 == 0, "stray").otherwise(F.col("c_nationkey").cast("string"))).alias("taxon"))


def clade_fmeasure(spark, sf_dir):
    stats = R.clade_statistics(R.encode(nodes(spark, sf_dir)), leaf_taxa(spark, sf_dir))
    return stats.select("taxon", "node_id", "n_taxon", "n_lineage", "expected", F.round("f", 9).alias("f"))


def clade_best(spark, sf_dir):
    encoded = R.encode(nodes(spark, sf_dir))
    best = R.best_nodes(R.clade_statistics(encoded, leaf_taxa(spark, sf_dir)), encoded)
    sides = R.rogues(encoded, leaf_taxa(spark, sf_dir), best)
    return best.join(sides, ["tree_id", "rank_idx", "taxon"], "left").select("taxon", "node_id", "n_best", F.coalesce(F.size("rogue_in"), F.lit(0)).alias("n_in"), F.coalesce(F.size("rogue_out"), F.lit(0)).alias("n_out"))


def tree_lineages(spark, sf_dir):
    return R.lineages(R.encode(nodes(spark, sf_dir))).select("node_id", F.array_join("taxa", ";").alias("lineage"))


def rules_merge(spark, sf_dir):
    rows = lineage(spark, sf_dir)
    k = F.col("genome_id")
    bare = lambda c, x: F.when(c, N.limit_rank(x, 1)).otherwise(x)
    other = F.transform("taxa", lambda t, i: F.when((i > 0) & (k % 4 == 0), F.concat(t, F.lit("x"))).otherwise(t))
    pairs = rows.select(k.alias("query"), bare(k % 3 == 0, F.col("taxa")).alias("backbone"), bare(k % 6 < 2, other).alias("subtree"))
    classes = [f"c__{n}-BUILDING" for n in ("FRANCE", "CHINA", "NATION_3")]
    phyla = ["p__FRANCE", "p__CHINA", "p__NATION_1", "p__NATION_3", "p__NATION_5x"]
    return C.merge_lineages(pairs, classes, phyla).select("query", "rule", F.array_join("taxa", ";").alias("lineage"))


def consensus_rank(spark, sf_dir):
    rows = lineage(spark, sf_dir).select((F.col("genome_id") % 40).alias("query"), F.lit(4).alias("rank_idx"), "taxa").unionAll(
        lineage(spark, sf_dir).where("genome_id % 9 = 0").select((F.col("genome_id") + 1000).alias("query"), F.lit(3), "taxa")
    )
    return C.consensus_lineage(rows).select("query", F.array_join("taxa", ";").alias("lineage"))


QUERIES = {f.__name__: f for f in (
    standardise_lineage, rollup_lineage, children_parents, duplicate_names, validate_taxonomy, majority_vote, resolved_votes, median_of_medians, outlier_class,
    overlay_priority, inference_taxa, tree_closure, tree_mrca, tree_patristic, tree_red, tree_interpolate, clade_fmeasure, clade_best, tree_lineages, rules_merge, consensus_rank,
)}

_P = "['d__', 'p__', 'c__', 'o__', 'f__', 'g__', 's__']"
_VOTES = """m AS (
  SELECT o_custkey AS cluster, 5 AS rank_idx, CASE WHEN o_orderkey % 7 = 0 THEN 'g__' ELSE 'g__' || substr(o_orderpriority, 1, 1) END AS taxon FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_custkey, 1, CASE WHEN o_orderkey % 3 = 0 THEN 'p__' ELSE 'p__x' END FROM orders JOIN customer ON o_custkey = c_custkey
),
n AS (SELECT cluster, rank_idx, taxon, count(*) AS n FROM m GROUP BY ALL),
t AS (SELECT cluster, rank_idx, sum(n) AS votes FROM n GROUP BY ALL),
w AS (
  SELECT cluster, rank_idx, count(*) AS k, min(taxon) AS winner, min(n.n) AS n_winner FROM n JOIN t USING (cluster, rank_idx)
  WHERE length(taxon) > 3 AND 2 * n.n >= votes GROUP BY ALL
),
v AS (
  SELECT cluster, rank_idx, CAST(votes AS BIGINT) AS votes, CASE WHEN k = 1 THEN winner END AS winner, CASE WHEN k = 1 THEN n_winner END AS n_winner
  FROM t LEFT JOIN w USING (cluster, rank_idx)
)"""
_DIV = "d AS (SELECT CAST(o_custkey % 7 AS INTEGER) AS rank_idx, o_custkey AS taxon, (o_custkey % 7) * 0.12::DOUBLE + (o_orderkey % 97) / 97.0::DOUBLE * 0.6::DOUBLE AS red FROM orders),\ntm AS (SELECT rank_idx, taxon, median(red) AS red FROM d GROUP BY ALL),\nrm AS (SELECT rank_idx, median(red) AS median_red FROM tm GROUP BY ALL)"
_CLOSE = "c AS (SELECT unnest(path) AS anc, id AS leaf, dist FROM walk WHERE id LIKE 'c-%')"
_RED = """st AS (SELECT anc AS id, count(*) AS n_leaves, avg(dist) AS m FROM c GROUP BY anc),
f AS (SELECT w.id, CASE WHEN depth = 0 OR e + (m - dist) = 0 THEN 1.0::DOUBLE WHEN w.id LIKE 'c-%' THEN 0.0 ELSE (m - dist) / (e + m - dist) END AS fac FROM walk w JOIN st USING (id)),
up AS (SELECT id, unnest(path) AS anc FROM walk),
red AS (SELECT up.id, CASE WHEN up.id LIKE 'c-%' THEN 1.0::DOUBLE ELSE 1 - product(fac) END AS red FROM up JOIN f ON f.id = up.anc GROUP BY up.id)"""
_CLADE = """x AS (SELECT 'c-' || c_custkey AS leaf, 'p__' || CASE WHEN c_custkey % 20 = 0 THEN 'stray' ELSE CAST(c_nationkey AS VARCHAR) END AS taxon FROM customer),
i AS (SELECT anc, taxon, count(*) AS n_taxon FROM c JOIN x USING (leaf) GROUP BY ALL),
al AS (SELECT anc, CAST(sum(n_taxon) AS BIGINT) AS n_lineage FROM i GROUP BY anc),
ex AS (SELECT taxon, count(*) AS expected FROM x GROUP BY taxon),
s AS (
  SELECT taxon, anc AS node_id, n_taxon, n_lineage, expected, n_taxon / n_lineage AS p, n_taxon / expected AS r, (2 * (n_taxon / n_lineage) * (n_taxon / expected)) / ((n_taxon / n_lineage) + (n_taxon / expected)) AS f
  FROM i JOIN al USING (anc) JOIN ex USING (taxon)
)"""

SQL = {
    "standardise_lineage": f"""WITH {LINEAGE}
SELECT genome_id, array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN k <= genome_id % 6 + 2 THEN taxa[k] ELSE {_P}[k] END), ';') AS lineage,
  array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN k <= 4 THEN taxa[k] ELSE {_P}[k] END), ';') AS to_order, genome_id % 4 <> 0 AS is_full FROM lineage""",
    "rollup_lineage": f"WITH {LINEAGE} SELECT CAST(rank_idx AS INTEGER) AS rank_idx, taxon, count(DISTINCT genome_id) AS n_genomes FROM long GROUP BY ALL",
    "children_parents": f"""WITH {LINEAGE},
k AS (SELECT rank_idx, taxon, coalesce(lead(taxon) OVER (PARTITION BY genome_id ORDER BY rank_idx), CAST(genome_id AS VARCHAR)) AS child FROM long),
kids AS (SELECT rank_idx, taxon, CAST(count(DISTINCT child) AS INTEGER) AS n_children, min(child) AS first_child, md5(string_agg(DISTINCT child, ',' ORDER BY child)) AS all_children FROM k GROUP BY ALL),
pa AS (SELECT rank_idx, taxon, array_to_string(taxa[1:rank_idx], ';') AS l FROM long JOIN lineage USING (genome_id))
SELECT CAST(rank_idx AS INTEGER) AS rank_idx, taxon, n_children, first_child, all_children, lineage, n_lineages
FROM kids JOIN (SELECT rank_idx, taxon, min(l) AS lineage, count(DISTINCT l) AS n_lineages FROM pa GROUP BY ALL) USING (rank_idx, taxon)""",
    "duplicate_names": f"""WITH {LINEAGE}
SELECT 5 AS rank_idx, 'g__shared' AS taxon, count(DISTINCT array_to_string(taxa[1:5], ';')) AS n_lineages FROM lineage WHERE genome_id % 4 = 0
UNION ALL SELECT 6, taxa[7], count(DISTINCT CASE WHEN genome_id % 4 = 0 THEN 'g__shared' ELSE taxa[6] END || array_to_string(taxa[1:5], ';')) FROM lineage WHERE length(taxa[7]) > 3 GROUP BY taxa[7] HAVING count(DISTINCT CASE WHEN genome_id % 4 = 0 THEN 'g__shared' ELSE taxa[6] END || array_to_string(taxa[1:5], ';')) > 1""",
    "validate_taxonomy": f"""WITH {LINEAGE}
SELECT 'rank count' AS kind, CAST(genome_id AS VARCHAR) AS subject, '6' AS detail FROM lineage WHERE genome_id % 10 = 1
UNION ALL SELECT 'prefix', CAST(genome_id AS VARCHAR), 'x' || taxa[3] FROM lineage WHERE genome_id % 10 = 2
UNION ALL SELECT DISTINCT 'species', taxa[7], 'no generic name' FROM lineage WHERE genome_id % 10 <> 1 AND length(taxa[7]) > 3
UNION ALL SELECT 'several parents', taxon, CAST(count(DISTINCT above) AS VARCHAR)
FROM (SELECT k, t[k] AS taxon, array_to_string(t[1:k - 1], ';') AS above FROM (
  SELECT unnest(range(1, len(t) + 1)) AS k, t FROM (SELECT CASE genome_id % 10 WHEN 1 THEN taxa[1:6] WHEN 2 THEN taxa[1:2] || ['x' || taxa[3]] || taxa[4:7] ELSE taxa END AS t FROM lineage)))
WHERE length(taxon) > 3 GROUP BY k, taxon HAVING count(DISTINCT above) > 1""",
    "majority_vote": f"WITH {_VOTES} SELECT * FROM v",
    "resolved_votes": f"WITH {_VOTES} SELECT cluster, arg_max(winner, rank_idx) AS taxon, max(rank_idx) AS rank_idx FROM v WHERE winner IS NOT NULL GROUP BY cluster",
    "median_of_medians": f"WITH {_DIV} SELECT * FROM rm",
    "outlier_class": f"""WITH {_DIV}
SELECT t.rank_idx, t.taxon, (SELECT arg_min(r.rank_idx, (abs(t.red - r.median_red), r.rank_idx)) FROM rm r) AS closest_rank,
  CASE WHEN t.red - m.median_red < -0.2 THEN 'very overclassified' WHEN t.red - m.median_red < -0.1 THEN 'overclassified'
       WHEN t.red - m.median_red > 0.2 THEN 'very underclassified' WHEN t.red - m.median_red > 0.1 THEN 'underclassified' ELSE 'OK' END AS class,
  round(t.red - m.median_red, 9) AS delta
FROM tm t JOIN rm m ON t.rank_idx = m.rank_idx""",
    "overlay_priority": f"""WITH {LINEAGE}
SELECT genome_id, array_to_string(list_transform(range(1, 8), lambda k: CASE WHEN genome_id % 5 = 1 AND k > 1 OR genome_id % 5 <> 1 AND genome_id % 3 = 0 AND k > 3 THEN {_P}[k] ELSE taxa[k] END), ';') AS lineage FROM lineage""",
    "inference_taxa": f"""WITH {LINEAGE},
k AS (SELECT rank_idx, taxon, coalesce(lead(taxon) OVER (PARTITION BY genome_id ORDER BY rank_idx), CAST(genome_id AS VARCHAR)) AS child FROM long)
SELECT CAST(rank_idx AS INTEGER) AS rank_idx, taxon FROM k GROUP BY ALL HAVING count(DISTINCT child) >= 3 OR rank_idx = 6""",
    "tree_closure": f"WITH RECURSIVE {NODES}, {_CLOSE} SELECT anc AS node_id, count(*) AS n_leaves, round(avg(c.dist) - any_value(w.dist), 6) AS mean_dist FROM c JOIN walk w ON w.id = c.anc GROUP BY anc",
    "tree_mrca": f"""WITH RECURSIVE {NODES},
m AS (SELECT c_custkey % 50 AS set_id, 'c-' || c_custkey AS id FROM customer UNION ALL SELECT 1000 + c_nationkey, 'c-' || c_custkey FROM customer WHERE c_nationkey < 5),
a AS (SELECT set_id, anc, count(*) AS n FROM (SELECT set_id, unnest(path) AS anc FROM m JOIN walk USING (id)) GROUP BY ALL),
z AS (SELECT set_id, count(*) AS n FROM m GROUP BY set_id)
SELECT a.set_id, arg_max(anc, depth) AS mrca FROM a JOIN z ON a.set_id = z.set_id AND a.n = z.n JOIN walk ON walk.id = anc GROUP BY a.set_id""",
    "tree_patristic": f"""WITH RECURSIVE {NODES},
p AS (SELECT x.id AS a, y.id AS b, x.dist AS da, y.dist AS db, list_filter(x.path, lambda n: list_contains(y.path, n))[-1] AS mrca
  FROM walk x JOIN walk y ON x.id LIKE 'c-%' AND y.id = 'c-' || (CAST(substr(x.id, 3) AS BIGINT) - 1) AND CAST(substr(x.id, 3) AS BIGINT) > 1)
SELECT a, b, mrca, round(da + db - 2 * dist, 6) AS distance FROM p JOIN walk ON walk.id = mrca""",
    "tree_red": f"WITH RECURSIVE {NODES}, {_CLOSE}, {_RED} SELECT id AS node_id, round(red, 9) AS red FROM red",
    "tree_interpolate": f"""WITH RECURSIVE {NODES}, {_CLOSE}, {_RED}
SELECT w.id AS query, round(p.red + (1 - p.red) * ((w.dist - w.e * 0.25::DOUBLE - pw.dist) / greatest(w.dist - pw.dist, 1e-9)), 9) AS red
FROM walk w JOIN red p ON p.id = w.par JOIN walk pw ON pw.id = w.par WHERE w.id LIKE 'c-%'""",
    "clade_fmeasure": f"WITH RECURSIVE {NODES}, {_CLOSE}, {_CLADE} SELECT taxon, node_id, n_taxon, n_lineage, expected, round(f, 9) AS f FROM s",
    "clade_best": f"""WITH RECURSIVE {NODES}, {_CLOSE}, {_CLADE},
b AS (SELECT taxon, max(f) AS f FROM s GROUP BY taxon),
t AS (SELECT s.taxon, arg_max(node_id, walk.path) AS node_id, count(*) AS n_best FROM s JOIN b ON s.taxon = b.taxon AND s.f = b.f JOIN walk ON walk.id = node_id GROUP BY s.taxon)
SELECT t.taxon, node_id, n_best, CAST((SELECT count(*) FROM c JOIN x USING (leaf) WHERE c.anc = t.node_id AND x.taxon <> t.taxon) AS INTEGER) AS n_in,
  CAST((SELECT count(*) FROM x WHERE x.taxon = t.taxon AND x.leaf NOT IN (SELECT leaf FROM c WHERE c.anc = t.node_id)) AS INTEGER) AS n_out
FROM t""",
    "tree_lineages": "SELECT 'c-' || c_custkey AS node_id, 'd__' || r_name || ';p__' || n_name AS lineage FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "rules_merge": f"""WITH {LINEAGE},
a AS (SELECT genome_id AS q, list_transform(range(1, 8), lambda k: CASE WHEN genome_id % 3 = 0 AND k > 2 THEN {_P}[k] ELSE taxa[k] END) AS b,
  list_transform(range(1, 8), lambda k: CASE WHEN genome_id % 6 < 2 AND k > 2 THEN {_P}[k] WHEN genome_id % 4 = 0 AND k > 1 THEN taxa[k] || 'x' ELSE taxa[k] END) AS c FROM lineage),
r AS (SELECT *, c[3] IN ('c__FRANCE-BUILDING', 'c__CHINA-BUILDING', 'c__NATION_3-BUILDING') AS vc, c[2] IN ('p__FRANCE', 'p__CHINA', 'p__NATION_1', 'p__NATION_3', 'p__NATION_5x') AS vp FROM a),
s AS (SELECT *, CASE WHEN b[3] = 'c__' AND c[3] = 'c__' THEN 1 WHEN vc AND b[3] = c[3] THEN 2 WHEN vc THEN 3 WHEN vp AND b[2] = c[2] THEN 4 WHEN vp THEN 5 ELSE 6 END AS rule FROM r)
SELECT q AS query, rule, array_to_string(CASE WHEN rule IN (2, 3) THEN c WHEN rule IN (4, 5) THEN list_transform(range(1, 8), lambda k: CASE WHEN k > 2 THEN {_P}[k] ELSE c[k] END)
  WHEN rule = 6 THEN list_transform(range(1, 8), lambda k: CASE WHEN b[k] = c[k] THEN b[k] ELSE {_P}[k] END) ELSE b END, ';') AS lineage FROM s""",
    "consensus_rank": f"""WITH {LINEAGE},
x AS (SELECT genome_id % 40 AS query, 4 AS r, taxa FROM lineage UNION ALL SELECT genome_id + 1000, 3, taxa FROM lineage WHERE genome_id % 9 = 0),
e AS (SELECT query, k, taxa[k] AS t FROM (SELECT query, r, taxa, unnest(range(1, 8)) AS k FROM x) WHERE k <= r + 1),
p AS (SELECT query, k, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE substr(min(t), 1, 3) || 'undefined' END AS t FROM e GROUP BY ALL)
SELECT query, string_agg(t, ';' ORDER BY k) AS lineage FROM p GROUP BY query""",
}
