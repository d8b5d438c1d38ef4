"""A pipeline over ``documents``: toxic documents go, repeated lines go, near copies go, documents that hold benchmark
passages go, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.llm import bpe, decontaminate, lines, simhash, toxicity
from arborframe.llm.common import drop, quoted, shared_dir, table
from arborframe.llm.sample import remainder


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with its columns under their numbers, so that no name clashes with a stage's outputs, and that of ``text``."""
    return docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns))), f"c{docs.columns.index('text')}"


def _named(held: DataFrame, docs: DataFrame) -> DataFrame:
    return held.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the learning rows of ``labels``, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0)
    held, text = _numbered(docs)
    return _named(toxicity.classify(held, model, text).where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line repeats exactly or within two edits."""
    cleaned = lines.deduplicate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    held, text = _numbered(docs)
    return _named(decontaminate.decontaminate(held, table(spark, sf_dir, "benchmark"), text).where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that tell whether they decode to its text.

    Of the other columns ``doc_id``, ``lang`` and ``source`` stay, as far as there are.
    """
    import public_tokenizers

    return bpe.bpe(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Classifiers, fingerprints and merges are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before has been read
            drop(spark, f"{folder}/{k - 1}")
    return docs
