"""Running aggregates over an order, in two passes over range partitions, so that no task holds a whole key.

Rows are dealt to ranges of (keys, order). The first pass sums up every range's part of a key; what comes before a
range is then known for the one key that it shares with earlier ranges, which is at most one carry a range, whatever
the number of rows and keys. The second pass runs inside the ranges and adds the carry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: What may be carried: how two stretches combine, and the stretch of several rows (``last`` skips nulls).
COMBINE = {"sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
WITHIN = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(rows: DataFrame, keys: list[str], order: list[str], inclusive: bool = True, ranges: int | None = None, **outputs: tuple[str, str]) -> DataFrame:
    """``rows`` with ``name=(kind, column)`` outputs: the sum, maximum or last value up to each row of its key.

    Without ``inclusive`` the row itself does not count. ``order`` should be total within a key: rows that are equal in
    keys and order share a range and stand in no particular order. Without ``keys`` the whole table is one key. Nulls
    count for nothing; before the first value an output is null. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    own = ["__range", *keys]
    position = F.struct(*order)
    total = {
        "sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), position)),
    }
    parts = held.groupBy(*own).agg(*(total[kind](c).alias(f"__t_{name}") for name, (kind, c) in outputs.items()), F.lit(1).alias("__one"))
    # a key has at most one row for every range
    before = Window.partitionBy(*(keys or ["__one"])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carries = parts.select(*own, F.count("*").over(before).alias("__n"), *(WITHIN[kind](F.col(f"__t_{name}")).over(before).alias(f"__c_{name}") for name, (kind, _) in outputs.items()))
    # only the first key of a range can have begun in an earlier one: at most one row a range
    carries = F.broadcast(cut(carries.where("__n > 0").drop("__n")))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in own])
    joined = held.alias("l").join(carries.alias("r"), same, "left").select("l.*", *(F.col(f"r.__c_{name}") for name in outputs))
    here = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = joined.select("*", *(WITHIN[kind](F.col(c)).over(here).alias(f"__l_{name}") for name, (kind, c) in outputs.items()))
    return local.select(*rows.columns, *(COMBINE[kind](F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name) for name, (kind, _) in outputs.items()))
