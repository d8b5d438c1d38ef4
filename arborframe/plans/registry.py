"""Named queries over the driver's tables, with the SQL each one must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import derived, hierarchy, rooted, sketches, streams, tables

MODULES = (hierarchy, tables, derived, rooted, sketches, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best representative of every query genome, with its radius verdict."""
    return tables.ani_closest(spark, sf_dir)
