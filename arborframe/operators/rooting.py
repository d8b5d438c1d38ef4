"""Relative divergence under many roots at once, by messages along both directions of every edge.

A new root turns edges around but changes no distance. For every edge, the number of leaves and the sum of their
distances are known on the side below it and on the side above, so the divergence of a node under any root is a product
of factors of edges: upwards from the new root to where the ways part, then downwards to the node. Sums of the factors'
logarithms along paths from the old root give every such product as a difference; no tree is rerooted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nested
from .lineage import written
from .scan import running

KEY = nested.KEY


def messages(placed: DataFrame) -> DataFrame:
    """For every node of ``nested.numbered``: leaves and their summed distances below it, and on the other side of its edge.

    ``n_below``, ``sum_below`` from the node itself; ``n_above``, ``sum_above`` from its parent, null at a root.
    """
    leaf = F.col("is_leaf").cast("long")
    below = nested.subtree_sums(placed, n_below=leaf, deep=F.when(F.col("is_leaf"), F.col("dist_root")).otherwise(0.0))
    rows = written(placed.select(*KEY, "parent_id", "edge_length", "dist_root").join(below, KEY).withColumn("sum_below", F.col("deep") - F.col("n_below") * F.col("dist_root")))
    edge = F.when(F.col("parent_id").isNull(), 0.0).otherwise(F.coalesce("edge_length", F.lit(0.0)))
    roots = rows.where("parent_id IS NULL").select("tree_id", F.col("n_below").alias("n_all"), F.col("sum_below").alias("sum_root"))
    joined = rows.withColumn("edge", edge).join(roots, "tree_id")
    # from one end of an edge to the other, the leaves below come nearer and all others move away
    step = F.when(F.col("parent_id").isNull(), F.col("sum_root")).otherwise((F.col("n_all") - 2 * F.col("n_below")) * F.col("edge"))
    every = nested.path_sums(joined, sum_all=step)
    over = every.select("tree_id", F.col("node_id").alias("parent_id"), F.col("sum_all").alias("sum_parent"))
    above = F.col("sum_parent") - F.col("sum_below") - F.col("n_below") * F.col("edge")
    return joined.join(over, ["tree_id", "parent_id"], "left").select(*KEY, "parent_id", "edge", "n_below", "sum_below", F.when(F.col("parent_id").isNotNull(), F.col("n_all") - F.col("n_below")).alias("n_above"), above.alias("sum_above"))


def _factor(a, total, n):
    """What is left of 1 - red after an edge of length a before leaves at a mean distance; an edge of no length before none changes nothing."""
    b = F.try_divide(total, n)
    return F.when(a + b == 0, 1.0).otherwise(F.try_divide(b, a + b))


def _log(x):
    return F.when(x > 0, F.log(x)).otherwise(0.0)


def _zero(x):
    return F.when(x <= 0, 1).otherwise(0)


def _spans(nodes: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered nodes, nodes with their sums of factors, and the ways of every rooting: (tree_id, rooting, lo, hi) are
    nodes by ``pre`` that it sees through one turn, ``way_log`` and ``way_zero`` what all of them have in common."""
    placed = nested.numbered(nodes)
    said = written(messages(placed).join(placed.select(*KEY, "pre", "last", "is_leaf"), KEY))
    down = _factor(F.col("edge"), F.col("sum_below"), F.col("n_below"))
    up, half = _factor(F.col("edge"), F.col("sum_above"), F.col("n_above")), _factor(F.col("edge") / 2, F.col("sum_above"), F.col("n_above"))
    inner = F.col("parent_id").isNotNull()
    one = lambda x: F.when(inner, F.coalesce(x, F.lit(1.0))).otherwise(1.0)
    sums = nested.path_sums(said, down_log=_log(one(down)), down_zero=_zero(one(down)), up_log=_log(one(up)), up_zero=_zero(one(up)))
    full = written(said.join(sums, KEY).withColumns({"own_log": _log(one(up)), "own_zero": _zero(one(up)), "half_log": _log(one(half)), "half_zero": _zero(one(half))}))
    start = full.join(roots.select(*KEY).distinct(), KEY, "left_semi").where("n_above > 0")
    # from the rooting up to its ancestor c, whose parent m is where the way to a node may turn down
    climbs = nested.ancestors(placed, start.select(*KEY)).select("tree_id", F.col("node_id").alias("rooting"), F.col("anc_id").alias("c"))
    turn = full.select("tree_id", F.col("node_id").alias("m"), F.col("pre").alias("m_pre"), F.col("last").alias("m_last"), *(F.col(x).alias(f"m_{x}") for x in ("down_log", "down_zero", "up_log", "up_zero")))
    child = full.where("parent_id IS NOT NULL").select("tree_id", F.col("node_id").alias("c"), F.col("parent_id").alias("m"), F.col("pre").alias("c_pre"), F.col("last").alias("c_last"))
    begin = start.select("tree_id", F.col("node_id").alias("rooting"), (F.col("up_log") - F.col("own_log") + F.col("half_log")).alias("r_log"), (F.col("up_zero") - F.col("own_zero") + F.col("half_zero")).alias("r_zero"))
    ways = climbs.join(child, ["tree_id", "c"]).join(turn, ["tree_id", "m"]).join(begin, ["tree_id", "rooting"])
    side = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    spans = ways.select(
        "tree_id", "rooting", (F.col("r_log") - F.col("m_up_log") - F.col("m_down_log")).alias("way_log"), (F.col("r_zero") - F.col("m_up_zero") - F.col("m_down_zero")).alias("way_zero"),
        F.explode(F.array(side(F.col("m_pre"), F.col("c_pre") - 1), side(F.col("c_last") + 1, F.col("m_last")))).alias("s"),
    ).select("tree_id", "rooting", "way_log", "way_zero", "s.*")
    return placed, full, spans


def _red(way_log, way_zero):
    return F.when(F.col("is_leaf") | (way_zero + F.col("down_zero") > 0), 1.0).otherwise(1 - F.exp(way_log + F.col("down_log")))


def divergence_over_rootings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree_id, rooting, node_id, red): divergence of every node outside of each rooting's clade.

    ``roots`` (tree_id, node_id) are the nodes whose edges take the root in their middle. Nodes below the rooting and
    the old root have no row, leaves have 1. A rooting without leaves on the other side has no rows, nor has one at
    the old root. One row of the result is one pair, so no rooting is a group of its own.
    """
    placed, full, spans = _spans(nodes, roots)
    met = nested.descendants(placed, spans).withColumnRenamed("desc_id", "node_id").join(full.select(*KEY, "parent_id", "is_leaf", "down_log", "down_zero"), KEY).where("parent_id IS NOT NULL")
    return met.select("tree_id", "rooting", "node_id", _red(F.col("way_log"), F.col("way_zero")).alias("red"))


def median_divergence(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree_id, node_id, n_rootings, red): the median of every node's divergence over the rootings that see it.

    Between two ends of spans all nodes are seen by the same ways, so the ways are gathered once for such a stretch and
    every node takes those of its own, instead of one row for every node and rooting. Leaves only need their number.
    """
    placed, full, spans = _spans(nodes, roots)
    spans = written(spans.where("lo <= hi"))
    ends = spans.select("tree_id", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("at")).distinct()
    ends = written(running(ends.withColumn("one", F.lit(1).cast("long")), ["tree_id"], ["at"], k=("sum", "one")).select("tree_id", "at", "k"))
    # every span as the stretches from its first end to its last
    ranked = spans.join(ends.select("tree_id", F.col("at").alias("lo"), F.col("k").alias("from")), ["tree_id", "lo"])
    ranked = ranked.join(ends.select("tree_id", (F.col("at") - 1).alias("hi"), (F.col("k") - 1).alias("to")), ["tree_id", "hi"])
    over = ranked.select("tree_id", "way_log", "way_zero", F.explode(F.sequence("from", "to")).alias("k"))
    ways = written(over.groupBy("tree_id", "k").agg(F.count("*").alias("n_rootings"), F.collect_list(F.struct("way_log", "way_zero")).alias("ways")))
    cells = ends.select("tree_id", "k", F.col("at").alias("lo")).join(ends.select("tree_id", (F.col("k") - 1).alias("k"), (F.col("at") - 1).alias("hi")), ["tree_id", "k"])
    cells = cells.join(ways.select("tree_id", "k", "n_rootings"), ["tree_id", "k"])
    seen = nested.descendants(placed, cells).withColumnRenamed("desc_id", "node_id").join(full.select(*KEY, "parent_id", "is_leaf", "down_log", "down_zero"), KEY).where("parent_id IS NOT NULL")
    leaves = seen.where("is_leaf").select(*KEY, "n_rootings", F.lit(1.0).alias("red"))
    inner = seen.where("NOT is_leaf").join(ways.select("tree_id", "k", "ways"), ["tree_id", "k"])
    reds = inner.select(*KEY, "n_rootings", F.array_sort(F.transform("ways", lambda w: _red(w["way_log"], w["way_zero"]))).alias("reds"))
    middle = lambda k: F.get("reds", F.floor((F.col("n_rootings") - k) / 2).cast("int"))
    return leaves.unionAll(reds.select(*KEY, "n_rootings", ((middle(1) + middle(0)) / 2).alias("red")))
