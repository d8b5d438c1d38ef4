"""Product quantisation of vectors by member-resident Lloyd iterations.

A vector is cut into parts and each position has a codebook. The parts live in partitions that own (position, entry,
salt): an owner adds up the members it holds, the sums of an entry's owners give the next entry, and in the next round
only parts whose nearest entry has changed go through the shuffle; all others stay where they are. All arithmetic is
in integers, so that the result is the same however rows are dealt.

Residence is a property of an RDD's partitioner, which no DataFrame operator in Python keeps; what moves there are
packed blocks of many parts. The rest is DataFrames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, sized, stored, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts that a block holds, about, and an owner's share of the parts where that makes more partitions than the session has.
BLOCK_ROWS = 1 << 16
OWNER_ROWS = 1 << 20

#: partition; then of each part: position, entry, row, components
Block = tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def sound(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def limit(width: int) -> int:
    """Largest component for which squared distances of ``width`` components are exact in 64 bits."""
    return int((2**62 / max(1, width)) ** 0.5) // 2


def floors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column in double precision, one row each; short rows end in zeros, and what is beyond ``limit`` is held there."""
    most = limit(width)
    flat = np.clip(np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -most, most).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of least squared distance, the lower of equals, and that distance, for rows of one position."""
    x, book = x.astype(np.int64), book.astype(np.int64)
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if x.shape[1] * (2 * int(most)) ** 2 < 1 << 53:  # exact in doubles, whose products are faster
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        d = np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def assign(position: np.ndarray, values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry, error = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64)
    for p in range(len(books)):
        at = np.flatnonzero(position == p)
        if len(at):
            entry[at], error[at] = nearest(values[at], books[p])
    return entry, error


class Owners:
    """Which partition owns a (position, entry, salt): an entry has enough salts to fill a position's share of partitions."""

    def __init__(self, parts: int, entries: int, partitions: int):
        self.entries, self.partitions, self.salts = entries, partitions, -(-partitions // parts)

    def of(self, position: np.ndarray, entry: np.ndarray, row: np.ndarray) -> np.ndarray:
        salt = ((row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % self.salts
        return ((position.astype(np.int64) * self.entries + entry) * self.salts + salt) % self.partitions

    def deal(self, position: np.ndarray, entry: np.ndarray, row: np.ndarray, values: np.ndarray) -> Iterator[Block]:
        owner = self.of(position, entry, row)
        order = np.argsort(owner, kind="stable")
        starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
        for at in np.split(order, starts[1:]):
            if len(at):
                yield int(owner[at[0]]), (position[at], entry[at], row[at], values[at])


def joined(blocks: Iterable[Block]) -> Iterator[Block]:
    """The same members in blocks of ``BLOCK_ROWS`` parts or so."""
    held, n, owner = [], 0, 0
    pack = lambda: (owner, tuple(np.concatenate(c) for c in zip(*held, strict=True)))
    for owner, block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= BLOCK_ROWS:
            yield pack()
            held, n = [], 0
    if held:
        yield pack()


def settle(members: RDD, books: np.ndarray, owners: Owners) -> RDD:
    """Members after an assignment to ``books``: those of the same entry stay, the others migrate to its owner."""
    shared = members.context.broadcast(books)

    def split(blocks: Iterable[Block], leave: bool) -> Iterator[Block]:
        for owner, (position, entry, row, values) in blocks:
            new, _ = assign(position, values, shared.value)
            at = np.flatnonzero((new != entry) == leave)
            if not len(at):
                continue
            if leave:
                yield from owners.deal(position[at], new[at], row[at], values[at])
            else:
                yield owner, (position[at], entry[at], row[at], values[at])

    stay = members.mapPartitions(lambda b: split(b, False), preservesPartitioning=True)
    moved = members.mapPartitions(lambda b: split(b, True)).partitionBy(owners.partitions, int)
    # both have the same partitioner, so their union puts partition beside partition
    return stay.union(moved).mapPartitions(joined, preservesPartitioning=True)


def update(members: RDD, books: np.ndarray) -> np.ndarray:
    """The next codebooks: owners add up their members, and the floor of the mean replaces an entry that has any."""
    parts, entries, width = books.shape

    def sums(blocks: Iterable[Block]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, (position, entry, _, values) in blocks:
            at = position.astype(np.int64) * entries + entry
            order = np.argsort(at, kind="stable")
            own, starts = np.unique(at[order], return_index=True)
            total[own] += np.add.reduceat(values[order].astype(np.int64), starts, axis=0)
            count[own] += np.diff(np.append(starts, len(at)))
        for k in np.flatnonzero(count):
            yield int(k), np.append(total[k], count[k])

    out = books.copy()
    # one sum of each entry comes back, whatever the number of owners
    for k, s in members.mapPartitions(sums).reduceByKey(lambda a, b: a + b, min(parts * entries, members.getNumPartitions())).collect():
        out[k // entries, k % entries] = s[:-1] // s[-1]
    return out


def codebooks(rows: DataFrame, width: int, n: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[np.ndarray, RDD]:
    """Codebooks after ``rounds`` rounds over ``rows`` (row, vec_id, embedding), and the members where they then live.

    Fewer rounds run if one changes no entry, as all later ones would change none either.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()["embedding"].combine_chunks()
    cut = lambda x: x.reshape(len(x), parts, width // parts)
    books = np.ascontiguousarray(cut(floors(first, width, scale)).transpose(1, 0, 2))
    owners = Owners(parts, books.shape[1], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // OWNER_ROWS)))
    shared = spark.sparkContext.broadcast(books)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS // parts):
                part = batch.slice(lo, BLOCK_ROWS // parts)
                values = cut(floors(part.column(1), width, scale)).reshape(-1, width // parts).astype(np.int32)
                row, position = np.repeat(part.column(0).to_numpy(), parts), np.tile(np.arange(parts, dtype=np.int16), part.num_rows)
                entry = assign(position, values, shared.value)[0].astype(np.int16)
                found = list(owners.deal(position, entry, row, values))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in found]), *(pa.array([b[1][k].tobytes() for b in found], pa.binary()) for k in range(4))], ["owner", *"abcd"])

    def unpack(r) -> Block:
        position, entry, row = np.frombuffer(r.a, np.int16), np.frombuffer(r.b, np.int16), np.frombuffer(r.c, np.int64)
        return r.owner, (position, entry, row, np.frombuffer(r.d, np.int32).reshape(len(row), -1))

    shared_dir(spark)
    blocks = rows.select("row", "embedding").mapInArrow(pack, "owner long, a binary, b binary, c binary, d binary")
    members = blocks.rdd.map(unpack).partitionBy(owners.partitions, int).mapPartitions(joined, preservesPartitioning=True)
    for k in range(rounds):
        if k:
            members = settle(before := members, books, owners)
        members.persist(StorageLevel.DISK_ONLY)
        members.checkpoint()  # a lost executor costs a read; the disk copy saves writing from another computation
        books, last = update(members, books), books
        if k:
            before.unpersist()
        if np.array_equal(books, last):
            break
    return books, members


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``row``, ``vec_id``, ``label``, ``code`` and ``error`` of every sound row of (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors of several lengths are
    filled up with zeros to the longest, and that to a multiple of ``parts``. Components beyond ``limit`` (x of 32,768
    for 64 components at the default scale) are held there. Null ids sort last, equal ids by their vectors; repeated
    rows are parts of their own. With fewer rows than ``entries`` the codebooks have as many entries as rows. No sound
    row gives no rows and empty codebooks. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = stored(vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding")).where(sound(F.col("embedding"))).select(F.monotonically_increasing_id().alias("row"), "*"))
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n:
        return rows.select("row", "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    width = max(1, -(-longest // parts)) * parts
    books, members = codebooks(rows, width, n, parts, entries, rounds, scale)
    shared = spark.sparkContext.broadcast(books)

    def last(block: Block) -> tuple[bytes, bytes, bytes, bytes]:
        position, _, row, values = block[1]
        entry, error = assign(position, values, shared.value)
        return position.tobytes(), entry.astype(np.int16).tobytes(), row.tobytes(), error.tobytes()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], t).astype(np.int64)) for c, t in (("c", np.int64), ("a", np.int16), ("b", np.int16), ("d", np.int64))], ["row", "position", "entry", "error"])

    packed = spark.createDataFrame(members.map(last), "a binary, b binary, c binary, d binary")
    coded = packed.mapInArrow(spread, "row long, position long, entry long, error long")
    digits = [F.lower(F.lpad(F.hex(F.max(F.when(F.col("position") == p, F.col("entry")))), 2, "0")) for p in range(parts)]
    codes = coded.groupBy("row").agg(F.concat(*digits).alias("code"), F.sum("error").alias("error"))
    return rows.select("row", "vec_id", "label").join(codes, "row"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors of all rows of an equal label, nulls together, as far as 64 bits hold it."""
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = sized(total.select(F.col("label").alias("of"), "label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector of ``embeddings`` under the codebooks of six rounds; see ``compress`` for odd rows."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(stored(coded.drop("row")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op13_codes": op13_codes}


def _sql() -> str:
    width = f"(SELECT greatest(1, CAST(ceil(coalesce(max(len(e)), 0) / {PARTS}) AS INTEGER)) FROM sound)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT row, p, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.row, x.p, c.entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{k} c ON x.p = c.p AND x.i = c.i GROUP BY x.row, x.p, c.entry
  ) GROUP BY row, p
)""")
        if k < ROUNDS:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.entry, c.i, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT x.p, a.entry, x.i, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} a ON x.row = a.row AND x.p = a.p GROUP BY x.p, a.entry, x.i
  ) m ON c.p = m.p AND c.entry = m.entry AND c.i = m.i
)""")
    return f"""
WITH sound AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cells AS (SELECT unnest(range({PARTS} * {width})) AS k),
x AS MATERIALIZED (
  SELECT row, k // {width} AS p, k % {width} AS i, CAST(coalesce(floor({SCALE} * CAST(e[k + 1] AS DOUBLE)), 0) AS BIGINT) AS v FROM sound, cells
),
c0 AS (SELECT p, row AS entry, i, v FROM x WHERE row < {ENTRIES}),{",".join(steps)},
codes AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, entry, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM codes JOIN sound USING (row)
"""


SQL = {"op13_codes": _sql()}
