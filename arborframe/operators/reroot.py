"""New roots for trees in node tables: on the edge of an outgroup, at the midpoint, or none.

All of them change parents along one path of a tree, so they are joins with one row a tree; no tree is walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree

_ADDED = ("path", "depth", "dist_root", "is_leaf")


def reroot(encoded: DataFrame, edges: DataFrame) -> DataFrame:
    """Node tables with a root on the edge above ``node_id``, at ``below`` from it (``edges``: one row a tree).

    Nodes on the way to the old root hang from the one that they carried; an old root that is left with one child goes,
    and its edges join. Labels stay with their nodes. Trees without an edge, or with one at the root, stay as they are.
    """
    names = [c for c in encoded.columns if c not in _ADDED]
    at = encoded.select("tree_id", "node_id", "path", "edge_length").join(edges, ["tree_id", "node_id"]).where(F.size("path") > 1)
    way = at.select("tree_id", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("i", "node_id"))
    way = way.join(encoded.select("tree_id", "node_id", F.coalesce("edge_length", F.lit(0.0)).alias("edge")), ["tree_id", "node_id"])
    way = way.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("i", "node_id", "edge"))).alias("way"))
    kids = encoded.groupBy("tree_id", F.col("parent_id").alias("top")).agg(F.count("*").alias("n"))
    target = at.select("tree_id", F.col("node_id").alias("t_node"), "below", F.coalesce("edge_length", F.lit(0.0)).alias("t_edge")).join(way, "tree_id")
    target = target.withColumn("top", F.col("way")[0]["node_id"]).join(kids, ["tree_id", "top"]).withColumn("goes", F.col("n") == 2)
    new_root = F.concat(F.lit("root:"), F.col("t_node")) if dict(encoded.dtypes)["node_id"] == "string" else -1 - F.col("t_node")
    target = target.withColumn("new_root", new_root).withColumn("way_ids", F.transform("way", lambda x: x["node_id"])).drop("n")
    rows = encoded.join(target, "tree_id", "left")
    place = F.array_position("way_ids", F.col("node_id")).cast("int")
    here = F.col("t_node").isNotNull()
    last, rest = F.size("way"), F.col("t_edge") - F.col("below")
    above = lambda i: F.when(i == last, F.col("new_root")).otherwise(F.get("way", i)["node_id"])
    length = lambda i: F.when(i == last, rest).otherwise(F.get("way", i)["edge"])
    side = here & F.col("goes") & (F.col("parent_id") == F.col("top")) & (place == 0) & (F.col("node_id") != F.col("t_node"))
    one = F.lit(1)
    parent = (
        F.when(here & (F.col("node_id") == F.col("t_node")), F.col("new_root")).when(here & (place > 0), above(place)).when(side, above(one)).otherwise(F.col("parent_id"))
    )
    edge = (
        F.when(here & (F.col("node_id") == F.col("t_node")), F.col("below")).when(here & (place > 0), length(place))
        .when(side, F.coalesce("edge_length", F.lit(0.0)) + length(one)).otherwise(F.col("edge_length"))
    )
    moved = rows.where(~F.coalesce(here & F.col("goes") & (F.col("node_id") == F.col("top")), F.lit(False)))
    moved = moved.select(*({"parent_id": parent, "edge_length": edge}.get(c, F.col(c)).alias(c) for c in names))
    types = dict(encoded.dtypes)
    roots = target.select(*({"tree_id": F.col("tree_id"), "node_id": F.col("new_root")}.get(c, F.lit(None)).cast(types[c]).alias(c) for c in names))
    return moved.unionAll(roots)


def outgroup_edges(encoded: DataFrame, outgroup: DataFrame) -> DataFrame:
    """The edge of each tree that parts its outgroup (tree_id, node_id of leaves) from as few other leaves as can be.

    The outgroup may lie below the edge or on the other side, where a tree is rooted within it. The root goes to the
    middle of the edge. Trees without a leaf of the outgroup have no row.
    """
    marked = outgroup.select("tree_id", F.col("node_id").alias("desc_id"), F.lit(1).alias("out")).distinct()
    below = tree.closure(encoded).join(marked, ["tree_id", "desc_id"], "left").groupBy("tree_id", F.col("anc_id").alias("node_id")).agg(F.count("*").alias("n"), F.count("out").alias("n_out"))
    whole = encoded.where("depth = 0").select("tree_id", "node_id").join(below, ["tree_id", "node_id"]).select("tree_id", F.col("n").alias("all"), F.col("n_out").alias("all_out"))
    strange = F.when(F.col("n_out") == F.col("all_out"), F.col("n") - F.col("all_out")).when(F.col("n_out") == 0, F.col("all") - F.col("n") - F.col("all_out"))
    sides = encoded.where("depth > 0").join(below, ["tree_id", "node_id"]).join(whole.where("all_out > 0"), "tree_id").withColumn("strange", strange).where("strange IS NOT NULL")
    best = sides.groupBy("tree_id").agg(F.min_by(F.struct("node_id", "edge_length"), F.struct("strange", F.col("n_out") == 0, F.col("depth"), "node_id")).alias("b"))
    return best.select("tree_id", "b.node_id", (F.coalesce("b.edge_length", F.lit(0.0)) / 2).alias("below"))


def midpoint_edges(encoded: DataFrame) -> DataFrame:
    """The middle of the longest way between two leaves of each tree.

    The leaf farthest from the root is an end of a longest way, and the leaf farthest from it the other end.
    """
    leaves = encoded.where("is_leaf AND depth > 0").select("tree_id", "node_id", "dist_root")
    far = leaves.groupBy("tree_id").agg(F.max_by("node_id", F.struct("dist_root", "node_id")).alias("a"))
    ways = tree.patristic(encoded, leaves.join(far, "tree_id").select("tree_id", "a", F.col("node_id").alias("b")))
    ends = ways.groupBy("tree_id").agg(F.max(F.struct("distance", "a", "b")).alias("w")).select("tree_id", "w.*")
    deep = ends.select("tree_id", "distance", F.explode(F.array("a", "b")).alias("node_id")).join(leaves, ["tree_id", "node_id"])
    deep = deep.groupBy("tree_id").agg(F.max(F.struct("dist_root", "node_id", "distance")).alias("d")).select("tree_id", "d.node_id", (F.col("d.dist_root") - F.col("d.distance") / 2).alias("middle"))
    up = deep.join(encoded.select("tree_id", "node_id", "path"), ["tree_id", "node_id"]).select("tree_id", "middle", F.explode("path").alias("node_id"))
    passed = up.join(encoded.select("tree_id", "node_id", "dist_root", "depth"), ["tree_id", "node_id"]).where("depth > 0 AND dist_root >= middle")
    first = passed.groupBy("tree_id").agg(F.min(F.struct("depth", "node_id", (F.col("dist_root") - F.col("middle")).alias("below"))).alias("f"))
    return first.select("tree_id", "f.node_id", "f.below")


def unroot(encoded: DataFrame) -> DataFrame:
    """Node tables whose root of two children takes in one of them that is no leaf; the other's edge gets its length."""
    names = [c for c in encoded.columns if c not in _ADDED]
    kids = encoded.where("depth = 1")
    two = kids.groupBy("tree_id").agg(F.count("*").alias("n"), F.min(F.when(~F.col("is_leaf"), F.col("node_id"))).alias("goes")).where("n = 2 AND goes IS NOT NULL")
    gone = two.join(kids.select("tree_id", F.col("node_id").alias("goes"), F.col("parent_id").alias("top"), F.coalesce("edge_length", F.lit(0.0)).alias("more")), ["tree_id", "goes"]).select("tree_id", "goes", "top", "more")
    rows = encoded.join(gone, "tree_id", "left").where(~F.coalesce(F.col("node_id") == F.col("goes"), F.lit(False)))
    parent = F.when(F.col("parent_id") == F.col("goes"), F.col("top")).otherwise(F.col("parent_id"))
    edge = F.when(F.col("parent_id") == F.col("top"), F.coalesce("edge_length", F.lit(0.0)) + F.col("more")).otherwise(F.col("edge_length"))
    return rows.select(*({"parent_id": parent, "edge_length": edge}.get(c, F.col(c)).alias(c) for c in names))
