"""Placed sequences as leaves of their reference tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import written
from .scan import running


def best_placements(placements: DataFrame) -> DataFrame:
    """(tree_id, name, edge_num, distal, pendant): of each name's placements (name, placement) the one of most weight, the first on ties."""
    weight = F.struct(F.coalesce(F.col("placement")["like_weight_ratio"], F.lit(0.0)), -F.col("k"))
    top = placements.groupBy("tree_id", "name").agg(F.max_by("placement", weight).alias("p"))
    return top.select("tree_id", "name", F.col("p")["edge_num"].cast("long").alias("edge_num"), F.col("p")["distal_length"].alias("distal"), F.col("p")["pendant_length"].alias("pendant"))


def graft(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """A node table with a leaf for every row of ``placed`` (tree_id, node_id, query, distal, pendant).

    ``node_id`` is the lower end of the edge, ``distal`` the way up from it, held within the edge; each query hangs by
    ``pendant`` from a node of its own, called ``at:`` and the query, so those of one edge follow each other by distal
    length and name. Only one edge of the tree changes for each query: no way between two old nodes does. Ids become
    strings; other columns are null in new rows. Placements on edges that the table lacks are left out. On an edge of
    any number of queries the neighbours come from a running value, not from one task. A query at the root lies above it.
    """
    columns = nodes.columns
    own = nodes.withColumns({c: F.col(c).cast("string") for c in ("node_id", "parent_id")})
    edges = own.select("tree_id", "node_id", F.col("parent_id").alias("top"), F.coalesce("edge_length", F.lit(0.0)).alias("edge"))
    at = placed.select("tree_id", F.col("node_id").cast("string").alias("node_id"), F.col("query").cast("string").alias("query"), F.coalesce("distal", F.lit(0.0)).alias("distal"), F.coalesce("pendant", F.lit(0.0)).alias("pendant"))
    rows = at.join(edges, ["tree_id", "node_id"]).withColumn("distal", F.greatest(F.lit(0.0), F.when(F.col("top").isNull(), F.col("distal")).otherwise(F.least("distal", "edge"))))
    # from the top of the edge downwards, the neighbour above is the one before
    ordered = rows.withColumns({"down": -F.col("distal"), "here": F.struct("distal", "query")})
    placed_at = written(_with_above(ordered))
    new = F.concat(F.lit("at:"), F.col("query"))
    joint = placed_at.select(
        "tree_id", new.alias("node_id"), F.coalesce(F.concat(F.lit("at:"), F.col("above.query")), F.col("top")).alias("parent_id"),
        F.when(F.col("above").isNotNull(), F.col("above.distal") - F.col("distal")).when(F.col("top").isNotNull(), F.col("edge") - F.col("distal")).alias("edge_length"),
    )
    leaf = placed_at.select("tree_id", F.col("query").alias("node_id"), new.alias("parent_id"), F.col("pendant").alias("edge_length"))
    lowest = placed_at.groupBy("tree_id", "node_id").agg(F.min("here").alias("l"))
    kept = own.join(lowest, ["tree_id", "node_id"], "left").withColumns({
        "parent_id": F.coalesce(F.concat(F.lit("at:"), F.col("l.query")), F.col("parent_id")), "edge_length": F.coalesce("l.distal", "edge_length"),
    })
    added = joint.unionByName(leaf)
    types = dict(own.dtypes)
    full = added.select(*(F.col(c) if c in added.columns else F.lit(None).cast(types[c]).alias(c) for c in columns))
    return kept.select(*columns).unionAll(full.select(*(F.col(c).cast(types[c]).alias(c) for c in columns)))


def _with_above(ordered: DataFrame) -> DataFrame:
    """``above``: the next query up the same edge. Queries at one point count by name, the larger above.

    A running value goes up in its order, so names count by the complement of their bytes and a mark after the last.
    """
    back = ordered.withColumn("reverse", F.concat(F.translate(F.hex(F.encode("query", "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~")))
    return running(back, ["tree_id", "node_id"], ["down", "reverse"], inclusive=False, above=("last", "here"))
