"""Queries on trees by intervals: nested sets, subtree sums, divergence over all rootings, grafted queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.operators import graft as G
from arborframe.operators import nested as S
from arborframe.operators import rooting as M

from .hierarchy import NODES, nodes, read


def tree_nested_sets(spark, sf_dir):
    """Every node's interval, its depth and distance, and the leaves below it from one running sum."""
    placed = S.numbered(nodes(spark, sf_dir))
    counts = S.subtree_sums(placed, n_leaves=F.col("is_leaf").cast("long"))
    return placed.join(counts, S.KEY).select("node_id", "pre", "last", "depth", F.round("dist_root", 6).alias("dist_root"), "n_leaves")


def tree_red_rootings(spark, sf_dir):
    """Median divergence of every node over rootings at all phyla outside of which it lies."""
    rows = nodes(spark, sf_dir)
    found = M.median_divergence(rows, rows.where(F.col("taxon").startswith("p__")))
    return found.select("node_id", "n_rootings", F.round("red", 9).alias("red"))


def tree_grafted(spark, sf_dir):
    """Suppliers as queries on the edges of their nations, many on one edge and several at one point."""
    rows = nodes(spark, sf_dir)
    edge = rows.select("node_id", "edge_length")
    s = read(spark, sf_dir, "supplier").select(F.lit(1).alias("tree_id"), F.concat(F.lit("n-"), "s_nationkey").alias("node_id"), F.concat(F.lit("q-"), "s_suppkey").alias("query"), (F.col("s_suppkey") % 7).alias("k"), F.abs("s_acctbal").alias("pendant"))
    placed = s.join(edge, "node_id").select("tree_id", "node_id", "query", (F.col("k") / 8 * F.col("edge_length")).alias("distal"), "pendant")
    return G.graft(rows, placed).select("node_id", "parent_id", F.round("edge_length", 9).alias("edge_length"))


QUERIES = {f.__name__: f for f in (tree_nested_sets, tree_red_rootings, tree_grafted)}

SQL = {
    "tree_nested_sets": f"""WITH RECURSIVE {NODES},
o AS (SELECT id, depth, dist, path, row_number() OVER (ORDER BY path) - 1 AS pre FROM walk),
b AS (SELECT anc, count(*) AS n, count(*) FILTER (id LIKE 'c-%') AS n_leaves FROM (SELECT id, unnest(path) AS anc FROM walk) GROUP BY anc)
SELECT id AS node_id, pre, pre + n - 1 AS last, depth, round(dist, 6) AS dist_root, n_leaves FROM o JOIN b ON anc = id""",
    # every rooting is walked on its own, over edges in both directions
    "tree_red_rootings": f"""WITH RECURSIVE {NODES},
adj AS (SELECT id AS a, par AS b, e FROM nodes WHERE par IS NOT NULL UNION ALL SELECT par, id, e FROM nodes WHERE par IS NOT NULL),
turned AS (
  SELECT n.id AS rooting, n.par AS id, n.id AS came, n.e / 2 AS e, n.e / 2 AS d, [n.par] AS way FROM nodes n WHERE n.id LIKE 'n-%'
  UNION ALL SELECT t.rooting, adj.b, t.id, adj.e, t.d + adj.e, list_append(t.way, adj.b) FROM turned t JOIN adj ON adj.a = t.id AND adj.b <> t.came
),
mean AS (
  SELECT x.rooting, x.anc AS id, avg(x.d) AS d FROM (SELECT rooting, unnest(way) AS anc, d FROM turned WHERE id LIKE 'c-%') x GROUP BY ALL
),
f AS (
  SELECT t.rooting, t.id, CASE WHEN t.e + (mean.d - t.d) = 0 THEN 1.0::DOUBLE ELSE (mean.d - t.d) / (t.e + mean.d - t.d) END AS f
  FROM turned t JOIN mean ON mean.rooting = t.rooting AND mean.id = t.id
),
red AS (
  SELECT w.rooting, w.id, CASE WHEN w.id LIKE 'c-%' THEN 1.0::DOUBLE ELSE 1 - product(f.f) END AS red
  FROM (SELECT rooting, id, unnest(way) AS anc FROM turned) w JOIN f ON f.rooting = w.rooting AND f.id = w.anc GROUP BY w.rooting, w.id
)
SELECT id AS node_id, count(*) AS n_rootings, round(median(red), 9) AS red FROM red WHERE id <> 'root' GROUP BY id""",
    "tree_grafted": f"""WITH RECURSIVE {NODES},
q AS (SELECT id, par, 'q-' || s_suppkey AS query, e, (s_suppkey % 7) / 8::DOUBLE * e AS distal, abs(s_acctbal) AS pendant FROM supplier JOIN nodes ON id = 'n-' || s_nationkey),
o AS (SELECT *, lead(query) OVER w AS above, lead(distal) OVER w AS top, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY id ORDER BY distal, query))
SELECT query AS node_id, 'at:' || query AS parent_id, round(pendant, 9) AS edge_length FROM o
UNION ALL SELECT 'at:' || query, coalesce('at:' || above, par), round(coalesce(top, e) - distal, 9) FROM o
UNION ALL SELECT n.id, coalesce('at:' || o.query, n.par), CASE WHEN n.id <> 'root' THEN round(coalesce(o.distal, n.e), 9) END
FROM nodes n LEFT JOIN o ON o.id = n.id AND o.k = 1""",
}
