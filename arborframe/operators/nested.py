"""Trees by intervals: pre-order numbers by levels or from an Euler tour, sums over paths and over subtrees, in linear space.

``tree.encode`` keeps every node's path, which is best for trees of moderate depth. Here a node has two numbers, its
place in pre-order and that of the last node below it, so that a subtree is a range; a tree may be as deep as it has nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written
from .scan import running

KEY = ["tree_id", "node_id"]
#: Levels that are counted one by one; a tour of more than a million steps takes as many rounds over all of them.
LEVELS = 20


def jumps(rows: DataFrame, key: str, up: str, sums: list[str]) -> DataFrame:
    """``sums`` of every row added over its way along ``up``, itself included, by doubling: each round doubles the stretch.

    A row whose ``up`` is null ends a way. A way that comes back to itself fails: the rows of a cycle still have a
    next one when the stretches are longer than the table.
    """
    own, length = written(rows.select("tree_id", key, up, *sums)), 1
    n = own.count()
    while not own.where(F.col(up).isNotNull()).isEmpty():
        if length > n:
            raise ValueError("the parents form a cycle")
        above = own.select("tree_id", F.col(key).alias(up), F.col(up).alias("__up"), *(F.col(s).alias(f"__{s}") for s in sums))
        open_ = own.where(F.col(up).isNotNull()).join(above, ["tree_id", up], "left")
        moved = open_.select("tree_id", key, F.col("__up").alias(up), *((F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0))).alias(s) for s in sums))
        own = written(own.where(F.col(up).isNull()).unionByName(moved))
        length *= 2
    return own.drop(up)


def numbered(nodes: DataFrame) -> DataFrame:
    """Add ``pre`` (from 0), ``last``, ``depth``, ``dist_root`` and ``is_leaf`` to a node table.

    Siblings follow in the order of ``ord`` where there is one and of their ids. Trees of at most ``LEVELS`` levels are
    counted level by level, deeper ones by a tour. A node table of several trees is one pass.
    """
    order = ["ord", "node_id"] if "ord" in nodes.columns else ["node_id"]
    rows = nodes.select(*KEY, "parent_id", *([c for c in order if c != "node_id"]), F.coalesce("edge_length", F.lit(0.0)).alias("edge"))
    ways = written(jumps(rows.select(*KEY, "parent_id", F.when(F.col("parent_id").isNull(), F.lit(0.0)).otherwise(F.col("edge")).alias("dist_root"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth")), "node_id", "parent_id", ["dist_root", "depth"]))
    deepest = ways.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    placed = _by_levels(rows, ways, order, deepest) if deepest <= LEVELS else _by_tour(rows, ways, order)
    return written(nodes.join(placed.select(*KEY, "pre", (F.col("pre") + F.col("inside") - 1).alias("last"), "depth", "dist_root", (F.col("inside") == 1).alias("is_leaf")), KEY))


def _by_levels(rows: DataFrame, ways: DataFrame, order: list[str], deepest: int) -> DataFrame:
    """Nodes of every subtree from the deepest level up, then ``pre``: a node comes after all that its way passes on the left.

    Every row is counted once, at its own level, so the work grows with the rows and not with their logarithm.
    """
    held = written(rows.select(*KEY, "parent_id", *[c for c in order if c != "node_id"]).join(ways.select(*KEY, "depth"), KEY))
    below, levels = None, []
    for depth in range(deepest, -1, -1):
        level = held.where(F.col("depth") == depth)
        level = level.withColumn("inside", F.lit(1).cast("long")) if below is None else level.join(below, KEY, "left").withColumn("inside", 1 + F.coalesce("below", F.lit(0))).drop("below")
        level = written(level)
        below = level.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.sum("inside").alias("below"))
        levels.append(level)
    sizes = reduce(DataFrame.unionAll, levels)
    before = F.sum("inside").over(Window.partitionBy("tree_id", "parent_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("parent_id").isNull(), F.lit(0).cast("long")).otherwise(1 + F.coalesce(before, F.lit(0)))
    pre = jumps(sizes.select(*KEY, "parent_id", "inside", step.alias("pre")), "node_id", "parent_id", ["pre"])
    return pre.join(sizes.select(*KEY, "inside"), KEY).join(ways, KEY)


def _by_tour(rows: DataFrame, ways: DataFrame, order: list[str]) -> DataFrame:
    """The same for trees of any depth: the steps of a tour down into every node and up out of it, ranked by doubling."""
    ahead = Window.partitionBy("tree_id", "parent_id").orderBy(*order)
    kids = rows.where("parent_id IS NOT NULL").select("*", F.lead("node_id").over(ahead).alias("next"), F.lag("node_id").over(ahead).alias("before"))
    first = kids.where("before IS NULL").select("tree_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("first"))
    linked = rows.select(*KEY, "parent_id", "edge").join(kids.select(*KEY, "next"), KEY, "left").join(first, KEY, "left")
    down, up = (lambda c: F.struct(F.col(c).alias("id"), F.lit(0).alias("side"))), (lambda c: F.struct(F.col(c).alias("id"), F.lit(1).alias("side")))
    steps = linked.select(
        "tree_id",
        F.explode(
            F.array(
                F.struct(down("node_id").alias("step"), F.coalesce(F.when(F.col("first").isNotNull(), down("first")), up("node_id")).alias("succ")),
                F.struct(up("node_id").alias("step"), F.when(F.col("next").isNotNull(), down("next")).when(F.col("parent_id").isNotNull(), up("parent_id")).alias("succ")),
            )
        ).alias("s"),
    ).select("tree_id", "s.*", F.lit(1).cast("long").alias("left"))
    ranked = jumps(steps, "step", "succ", ["left"]).select("tree_id", F.col("step.id").alias("node_id"), F.col("step.side").alias("side"), "left")
    whole = ranked.groupBy("tree_id").agg(F.max("left").alias("whole"))
    # what is left at the way in and at the way out tells how many steps, and so nodes, lie between
    spans = ranked.groupBy(*KEY).agg(F.max(F.when(F.col("side") == 0, F.col("left"))).alias("enter"), F.max(F.when(F.col("side") == 1, F.col("left"))).alias("leave"))
    entered = spans.join(F.broadcast(whole) if whole.limit(10_001).count() <= 10_000 else whole, "tree_id").join(ways, KEY)
    # steps before the way in are entries or exits; of s steps at depth d, (s + d) / 2 are entries
    pre = ((F.col("whole") - F.col("enter") + F.col("depth")) / 2).cast("long")
    inside = ((F.col("enter") - F.col("leave") + 1) / 2).cast("long")
    return entered.select(*KEY, pre.alias("pre"), inside.alias("inside"), "depth", "dist_root")


def path_sums(nodes: DataFrame, **values) -> DataFrame:
    """(tree_id, node_id, name...) of ``name=column``: its sum over the way from the root to each node, both included."""
    return jumps(nodes.select(*KEY, "parent_id", *(c.alias(n) for n, c in values.items())), "node_id", "parent_id", list(values))


def subtree_sums(placed: DataFrame, **values) -> DataFrame:
    """(tree_id, node_id, name...) of ``name=column``: its sum over each node and all below, from one running sum by ``pre``."""
    rows = placed.select(*KEY, "pre", "last", *(c.alias(n) for n, c in values.items()))
    summed = written(running(rows, ["tree_id"], ["pre"], **{f"__s_{n}": ("sum", n) for n in values}))
    ends = summed.select("tree_id", F.col("pre").alias("last"), *(F.col(f"__s_{n}").alias(f"__e_{n}") for n in values))
    return summed.join(ends, ["tree_id", "last"]).select(*KEY, *((F.col(f"__e_{n}") - F.col(f"__s_{n}") + F.col(n)).alias(n) for n in values))


def stretch(placed: DataFrame) -> DataFrame:
    """(tree_id, width): the square root of a tree's size, with which spans and points meet."""
    return placed.groupBy("tree_id").agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("width"))


def ancestors(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, anc_id): every ancestor of ``nodes`` (tree_id, node_id), themselves included."""
    widths = stretch(placed)
    points = nodes.join(placed.select(*KEY, F.col("pre").alias("at")), KEY).join(widths, "tree_id")
    spans = placed.select("tree_id", F.col("node_id").alias("anc_id"), F.col("pre").alias("lo"), F.col("last").alias("hi")).join(widths.withColumnRenamed("width", "w"), "tree_id")
    spans = spans.withColumn("bins", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")), F.floor(F.col("hi") / F.col("w")))))
    met = points.withColumn("bins", F.floor(F.col("at") / F.col("width"))).join(spans, ["tree_id", "bins"])
    return met.where("at BETWEEN lo AND hi").select(*KEY, "anc_id")


def descendants(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (tree_id, lo, hi and others) with the ``desc_id`` of every node whose ``pre`` they hold."""
    widths = stretch(placed)
    each = spans.where("lo <= hi").join(widths, "tree_id").withColumn("bins", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor(F.col("hi") / F.col("width"))))).drop("width")
    points = placed.select("tree_id", F.col("node_id").alias("desc_id"), F.col("pre").alias("at")).join(widths, "tree_id").withColumn("bins", F.floor(F.col("at") / F.col("width"))).drop("width")
    return points.join(each, ["tree_id", "bins"]).where("at BETWEEN lo AND hi").drop("bins", "at")
