"""Queries on events that arrive as streams in several batches, each with the SQL over the whole table it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.streaming import state
from arborframe.streaming.events import shared_folder

#: Slices of time in which the events arrive, and the days that each one holds.
STARTS, DAYS = ("2024-01-01", "2024-01-11", "2024-01-21"), 10
#: Of the events, every fifth arrives so much later than it happened.
LAG = "11 days"


def _fed(spark: SparkSession, sf_dir: str, arrival: Column, run: Callable[[Callable[[str], DataFrame], str], DataFrame]) -> DataFrame:
    """What ``run`` returns after the events have arrived in three slices of ``arrival``, with a run after each one.

    Events before the first slice come with it, those after the last with the last, those without a time with the first.
    ``run`` gets a function from a condition to the stream of the events that meet it, and the folder of its own.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # in UTC, as in all queries
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    place = F.coalesce(sum((arrival >= F.lit(s).cast("timestamp")).cast("int") for s in STARTS[1:]), F.lit(0))
    read = lambda kind: spark.readStream.schema(events.schema).parquet(f"{folder}/in").where(kind)
    for k in range(len(STARTS)):
        events.where(place == k).write.mode("append").parquet(f"{folder}/in")
        rows = run(read, f"{folder}/out")
    return rows


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every user, with state that would be forgotten after a day without an event of the user."""
    out = _fed(spark, sf_dir, F.col("ts"), lambda read, folder: state.totals(read("true"), "user_id", folder, ttl=24 * 3600 * 1000))
    return out.withColumn("total", F.col("total").cast("double"))


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases of the same user within twelve hours; a slice is never late by its own latest row."""
    run = lambda read, folder: state.followed(
        read("event_type = 'click'"), read("event_type = 'purchase'"), "user_id", "12 hours", f"{DAYS + 1} days", folder
    )
    return _fed(spark, sf_dir, F.col("ts"), run)


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events come later than a day behind the latest of the batches before, where every fifth is held up."""
    arrival = F.col("ts") + F.when(F.col("event_id") % 5 == 0, F.expr(f"INTERVAL {LAG}")).otherwise(F.expr("INTERVAL 0 days"))
    return _fed(spark, sf_dir, arrival, lambda read, folder: state.with_late(read("true"), "1 day", folder)).select("event_id", "batch", "late")


QUERIES = {f.__name__: f for f in (stream_totals, stream_join, stream_late)}

SQL = {
    "stream_totals": "SELECT user_id, count(*) AS n, CAST(coalesce(sum(CAST(value AS DECIMAL(18,6))), 0) AS DOUBLE) AS total FROM events GROUP BY 1",
    "stream_join": """SELECT c.user_id, c.event_id AS first_id, p.event_id AS then_id FROM events c JOIN events p
        ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 12 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
    "stream_late": """WITH a AS (SELECT *, ts + CASE WHEN event_id % 5 = 0 THEN INTERVAL 11 DAY ELSE INTERVAL 0 DAY END AS came FROM events),
        b AS (SELECT *, CASE WHEN came >= TIMESTAMP '2024-01-21' THEN 2 WHEN came >= TIMESTAMP '2024-01-11' THEN 1 ELSE 0 END AS batch FROM a),
        m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM b GROUP BY batch)
        SELECT event_id, CAST(batch AS BIGINT) AS batch, coalesce(ts < mark, false) AS late FROM b JOIN m USING (batch)""",
}
