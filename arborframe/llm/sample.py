"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_per_class: tuple[int, int]) -> tuple[DataFrame, tuple[int, int]]:
    """Texts with ``y`` for at most so many documents of each class, and how many labelled documents the classes have.

    Labels of ids that ``docs`` lacks count for nothing. The sample is chosen by a hash of the id, the same on every run.
    Only its ids are broadcast, at most ``sum(max_per_class)``, and each gives one row: of several texts with one id the
    least. Null ids and labels are left out; an id with several labels counts with the largest.
    """
    own = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).join(own, "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, most in enumerate(max_per_class):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"), (counts.get(0, 0), counts.get(1, 0))
