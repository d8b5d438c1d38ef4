"""State over streams: totals that expire, joins of two streams by event time, and late rows kept beside the others.

Each function takes a stream and ``folder`` (in the shared folder), where its checkpoint and its rows are, runs through what
has arrived since it last ran there, and returns all rows so far. A run that was lost is taken up by the next one: a batch
that was under way is written over.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: What state that is forgotten by the clock needs: the one store that can, and no batches without data, which never end.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Parts that the rows of one key are dealt to, so that a frequent key is more than one task's work.
PARTS = 8
#: States that the parts of all keys are dealt to; every one that a batch touches is a call, so calls do not grow with the keys.
BUCKETS = 1024


def _run(rows: DataFrame, folder: str, mode: str, write: Callable[[DataFrame, int], None]) -> None:
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def _kept(spark: SparkSession, folder: str, schema: StructType, *parts: str) -> DataFrame:
    """The rows of all batches with their ``batch``; an empty one keeps the folder readable before the first."""
    spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/rows/batch=-1")
    return spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{folder}/rows")


class Totals(StatefulProcessor):
    """Count and sum of the rows of every key and part of a bucket since these were last forgotten; ``ttl`` in milliseconds
    after the last update of each. A bucket is one state, so a batch reads and writes it once and not for every key."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "entries string", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, before = timerValues.getCurrentProcessingTimeInMs(), self.held.get()
        held = {(k, part): (n, total, seen) for k, part, n, total, seen in (json.loads(before[0]) if before else ()) if seen + self.ttl > now}
        changed = {}
        for some in rows:
            some["known"] = some["key"].notna()
            some["key"] = some["key"].fillna("")
            for k, known, part, n, total in some.groupby(["key", "known", "part"], sort=False)["millionths"].agg(["size", "sum"]).reset_index().itertuples(index=False):
                at = (k if known else None, int(part))
                more = changed.get(at) or held.get(at, (0, 0))
                changed[at] = (more[0] + int(n), more[1] + int(total), now)
        held |= changed
        self.held.update((json.dumps([[*at, *values] for at, values in held.items()]),))
        columns = zip(*((*at, *values[:2]) for at, values in changed.items()), strict=True)
        yield pd.DataFrame(dict(zip(("key", "part", "n", "millionths"), map(list, columns), strict=True)))

    def close(self) -> None:
        pass


def totals(events: DataFrame, key: str, folder: str, ttl: int, parts: int = PARTS) -> DataFrame:
    """Count and sum of ``value`` (to six decimals, null as nothing) of every key of the stream: ``key, n, total``.

    The state of a key, dealt to ``parts`` by a hash of the row, is forgotten ``ttl`` milliseconds after the part's last
    row, so that keys that stay away do not fill the state store; a part that returns begins anew, and what it last
    showed before is no longer counted. A null key is a key. Parts of keys share the states of ``BUCKETS`` buckets, each
    with its own time; what is forgotten leaves a bucket when rows come to it.
    """
    spark = events.sparkSession
    dealt = events.select(
        F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64(*events.columns), F.lit(parts)).cast("int").alias("part"),
        F.coalesce((F.col("value").cast("decimal(18,6)") * 1000000).cast("long"), F.lit(0)).alias("millionths"),
    )
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(BUCKETS)).cast("int"))
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        updates = dealt.groupBy("bucket").transformWithStateInPandas(Totals(ttl), "key string, part int, n long, millionths long", "Update", "ProcessingTime")
        _run(updates, folder, "update", lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={k}"))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    last = _kept(spark, folder, updates.schema).groupBy("key", "part").agg(F.max_by(F.struct("n", "millionths"), "batch").alias("t"))
    summed = last.groupBy("key").agg(F.sum("t.n").alias("n"), (F.sum("t.millionths") / 1000000).alias("total"))
    return summed.select(F.col("key").cast(events.schema[key].dataType).alias(key), "n", "total")


def followed(first: DataFrame, then: DataFrame, key: str, within: str, delay: str, folder: str) -> DataFrame:
    """Pairs of a row of ``first`` and a row of ``then`` of the same key, not before it and at most ``within`` later.

    Columns ``key, first_id, then_id``. Either side waits in state until the watermark, ``delay`` behind the latest row,
    shows that nothing can meet it any more; rows that come later than that are dropped. Null keys and times meet nothing.
    """
    spark = first.sparkSession
    a = first.select(F.col(key), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", delay)
    b = then.select(F.col(key).alias("then_key"), F.col("event_id").alias("then_id"), F.col("ts").alias("then_ts")).withWatermark("then_ts", delay)
    near = (F.col(key) == F.col("then_key")) & F.col("then_ts").between(F.col("first_ts"), F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    pairs = a.join(b, near).select(key, "first_id", "then_id")
    _run(pairs, folder, "append", lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={k}"))
    return _kept(spark, folder, pairs.schema).drop("batch")


def with_late(events: DataFrame, delay: str, folder: str) -> DataFrame:
    """All rows with ``late``: earlier than the latest row of the batches before, less ``delay``; and with their ``batch``.

    One pass writes both kinds, in folders of their own by ``late``. A row without a time is not late.
    """
    spark, schema = events.sparkSession, StructType([*events.schema, StructField("late", BooleanType())])

    def write(batch: DataFrame, k: int) -> None:
        before = _kept(batch.sparkSession, folder, schema, "late").where(F.col("batch") < k)
        mark = before.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("mark"))  # one row, so it is sent to all tasks
        late = F.coalesce(F.col("ts") < F.col("mark"), F.lit(False))
        marked = batch.crossJoin(F.broadcast(mark)).select(*batch.columns, late.alias("late"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={k}")

    _run(events, folder, "append", write)
    return _kept(spark, folder, schema, "late")
