from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        if hasattr(v, "tolist") and not isinstance(v, str):
            v = v.tolist()
        return str(v) if isinstance(v, (list, tuple, dict)) else "null" if v is None or pd.isna(v) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def agree(duck):
    """Asserts that a DataFrame has the columns and rows of a DuckDB query."""

    def check(df, sql: str) -> None:
        want, got = duck.execute(sql).df(), df.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)

    return check
