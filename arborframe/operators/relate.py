"""Joins, sets and interval operators on plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import running


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of keys that occur once; a repeated key fails the query, as in a keyed store."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = df.withColumn("__n", n)
    return checked.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.concat_ws(",", *keys)))).otherwise(F.lit(True))).drop("__n")


def must_match(left: DataFrame, right: DataFrame, on: list[str], mark: str) -> DataFrame:
    """Left join that fails on a row without a partner; ``mark`` is a column of the right side that is never null."""
    joined = left.join(right, on, "left")
    return joined.withColumn(mark, F.when(F.col(mark).isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *[F.col(c).cast("string") for c in on]))).otherwise(F.col(mark)))


def exclude(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier stage has not handled."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def rename(df: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Old ids replaced by new ones (old, first, second): the first that is not null, else the old one."""
    return df.join(names.select(F.col("old").alias(key), "first", "second"), key, "left").withColumn(key, F.coalesce("first", "second", key)).drop("first", "second")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    left, right = a.select(key).distinct().withColumn("__l", F.lit(1)), b.select(key).distinct().withColumn("__r", F.lit(1))
    return left.join(right, key, "full_outer").where("__l IS NULL OR __r IS NULL").select(key, F.when(F.col("__l").isNotNull(), "left").otherwise("right").alias("side"))


def as_of(events: DataFrame, quotes: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """The last quote of the same key at or before each event; both sides are one ordered table, and a key of any size is dealt to ranges of time."""
    rows = events.select("event_id", by, time, F.lit(None).cast(quotes.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        quotes.select(F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), by, time, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    )
    return running(rows, [by], [time, "__side"], quote=("last", "__v")).where("__side = 1").select("event_id", by, time, "quote")


def merge_notes(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Rows of both tables by key, notes of a key in both joined by ``;`` in order."""
    joined = rows.select(key, F.col("note").alias("__a")).join(more.select(key, F.col("note").alias("__b")), key, "full_outer")
    notes = F.array_sort(F.array_distinct(F.array_compact(F.array("__a", "__b"))))
    return joined.select(key, F.array_join(notes, ";").alias("note"))


def chunked(df: DataFrame, n: int, *order: str) -> DataFrame:
    """``chunk`` from 0: rows dealt evenly by a hash of the keys, without a global sort."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(n)))


def reasons(*tests: tuple[Column, str]) -> Column:
    """All failed tests of a row, in order, joined by ``; ``; null if none."""
    return F.nullif(F.concat_ws("; ", *(F.when(c, F.lit(m)) for c, m in tests)), F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lost(asked: DataFrame, placed: DataFrame, key: str, **noted) -> DataFrame:
    """Keys that went into a step and did not come out, with what is noted of the step."""
    gone = asked.select(key).distinct().join(placed.select(key), key, "left_anti")
    return gone.select(key, *(F.lit(v).alias(c) for c, v in noted.items()))


def batches(routed: DataFrame) -> DataFrame:
    """Subtrees with the number of their queries, the largest first."""
    return routed.where("tree_id IS NOT NULL").groupBy("tree_id").agg(F.count("*").alias("n_queries")).orderBy(F.desc("n_queries"), "tree_id")


def taxa_of_classes(taxonomy: DataFrame, classes: list[str], rank: int) -> DataFrame:
    """Distinct taxa at a rank in lineages whose class is one of ``classes``."""
    return taxonomy.where(F.get("taxa", F.lit(2)).isin(*classes)).select(F.get("taxa", F.lit(rank)).alias("taxon")).distinct()


def first_in(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The first value of each key in an order, such as that of paths or depths."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def top(rows: DataFrame, n: int, *order: Column, skip: int = 0) -> DataFrame:
    """``n`` rows in an order, after ``skip``."""
    return rows.orderBy(*order).offset(skip).limit(n)


def genomes_of(genes: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the sequence of their gene; a hit without one fails."""
    return must_match(hits, genes.select("genome_id", "gene_id", "seq"), ["genome_id", "gene_id"], "seq")
