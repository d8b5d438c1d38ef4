"""What several of the corpus operators need: tables, checkpoints, row keys and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests) gets a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is large or read by columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and characters of texts that a function sees at once, so that a batch of long texts takes bounded memory.
SLICE_ROWS = 256
SLICE_CHARS = 1 << 21


def quoted(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(columns: list[str], outputs) -> list[str]:
    """Columns that no output replaces; names that differ in case only are the same, as Spark resolves them."""
    new = {o.lower() for o in outputs}
    return [c for c in columns if c.lower() not in new]


def with_text_outputs(df: DataFrame, text: str, outputs: dict[str, str], prepare: Callable[[], Callable[[list[str]], dict]], keep=None) -> DataFrame:
    """Columns ``keep`` (all by default) and ``outputs`` (name: type), computed from whole texts without a shuffle.

    ``prepare`` runs once a task and returns a function of a list of texts (null: empty) that gives the outputs' values.
    A text crosses to Python once and no other column is unpacked there. Columns travel under positions, so
    the input may have any names; one named like an output is replaced.
    """
    keep = others(list(df.columns if keep is None else keep), outputs)
    sent = keep if text in keep else [*keep, text]
    held = df.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(sent)))
    new = StructType.fromDDL(", ".join(f"o{j} {t}" for j, t in enumerate(outputs.values())))
    schema = StructType([*held.schema.fields[: len(keep)], *new.fields])
    at, names, types, wanted = sent.index(text), list(outputs), [to_arrow_type(f.dataType) for f in new.fields], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            column = batch.column(at)
            ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo, before = 0, 0
            while lo < len(column):
                hi = min(lo + SLICE_ROWS, max(lo + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right"))), len(column))
                found = compute([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
                own = [found[o] if isinstance(found[o], pa.Array) else pa.array(found[o], type=t) for o, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), *own], names=wanted)
                lo, before = hi, int(ends[hi - 1])

    out = held.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"o{j}").alias(o) for j, o in enumerate(outputs)))


#: Numbers (of 16 bytes at most, in any columns) that a side of a join may have to be broadcast: 24 MB at most.
BROADCAST_CELLS = 1_500_000


def sized(small: DataFrame, cells: Column | None = None) -> DataFrame:
    """A materialised side of a join, broadcast if it has few numbers and shuffled otherwise.

    ``cells`` counts what a row has besides its flat columns, such as the items of arrays.
    """
    small = stored(small)
    more = F.coalesce(F.sum(cells), F.lit(0)) if cells is not None else F.lit(0)
    rows, items = small.agg(F.count("*"), more).first()
    return F.broadcast(small) if rows * len(small.columns) + items <= BROADCAST_CELLS else small


def text_key(text: Column) -> Column:
    """64-bit key that tells apart rows which share a doc_id but not their text."""
    return F.xxhash64(F.lit("row"), F.coalesce(text, F.lit("")))


def hash128(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes; together they identify a string in corpora of any practical size."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge: columns ``vertex`` and ``component``.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014), until a round changes nothing; they need about as many as the logarithm of the longest path. Every round is two joins of the edges with per-vertex minima; a hub's edges are spread by
    AQE's skew join. Edges with a null end and loops are ignored; no edges give an empty frame.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = checkpointed(
        edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u IS NOT NULL AND u <> v AND v IS NOT NULL").distinct()
    )
    before = _signature(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        e = checkpointed(small)
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
