"""Cutting a plan's lineage in the shared folder, for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a session in one process (tests) gets a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not chosen.isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    return chosen.get()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder. Unlike a checkpoint it does not hand on what the plan implied about its columns, of
    which an iteration gathers more in every round until the optimiser is lost in it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
