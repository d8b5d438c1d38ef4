"""Exact top-k search by inner product over M-trees (Ciaccia, Patella and Zezula, 1997).

Vectors of integers get one more coordinate that brings all of them to the same length; then the largest inner product
with a query, which has zero there, is the least Euclidean distance. Rows are dealt to the nearest of a bounded number
of pivots, and crowded cells to several shards. A shard is one tree in pages of bounded size: an entry of a page has
its distance to the object that routes to the page, and an inner one its covering radius. A query visits pages in the
order of their least possible distance, until none can hold a result; entries which the stored distances rule out cost no
computation. The shards of its own cell come first, and what they find decides which other cells it must visit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codes import floors, sound
from .common import sized, stored, table

K = 10
SCALE = 1024
EVERY = 100
#: Entries of a page and children of an inner page.
PAGE = 64
FANOUT = 16
#: Vectors of a tree at most, about, and queries that visit it in one task.
SHARD_ROWS = 1 << 14
QUERY_BLOCK = 1 << 10
#: Floor of a query that has none yet; a value and not null, as pandas turns nullable longs to doubles.
NO_FLOOR = -(1 << 63)
#: Pivots at most; below that they grow with the square root of the rows.
PIVOTS = 1024


@dataclass(frozen=True)
class Space:
    """Length that all vectors have with their last coordinate, and whether doubles hold every product."""

    norm: int

    @property
    def exact(self) -> bool:
        return self.norm < 1 << 52

    @property
    def slack(self) -> float:
        """Far above the error of a distance, which is at most the square root of that of a square."""
        return 1e-7 * (1 + self.norm**0.5)

    def products(self, values: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (values.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if self.exact else values.astype(np.int64) @ q.astype(np.int64)

    def last(self, values: np.ndarray) -> np.ndarray:
        v = values.astype(np.int64)
        return np.sqrt((self.norm - (v * v).sum(axis=-1)).astype(np.float64))

    def between(self, values: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Distances of rows to an object, from differences, so that equal ones are at exactly zero."""
        d = values.astype(np.float64) - o.astype(np.float64)
        return np.sqrt((d * d).sum(axis=-1) + (self.last(values) - self.last(o)) ** 2)

    def to_query(self, products: np.ndarray, square: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, float(square) + float(self.norm) - 2.0 * products))


@dataclass
class Page:
    """Objects with distances to the object that routes here; ``radius`` and ``refs`` of an inner page are those of its children, ``refs`` of a leaf the ids."""

    leaf: bool
    values: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray
    refs: np.ndarray


def load(ids: np.ndarray, values: np.ndarray, space: Space, seed: int = 0) -> list[Page]:
    """Pages of a tree, the root first. Children hold at most half of their parent's rows, equal vectors or not."""
    rng, pages = np.random.default_rng(seed), []

    def grow(own: np.ndarray, parent: np.ndarray | None) -> int:
        at = len(pages)
        pages.append(None)
        away = lambda v: np.zeros(len(v)) if parent is None else space.between(v, parent)
        if len(own) <= PAGE:
            pages[at] = Page(True, values[own], away(values[own]), np.zeros(len(own)), ids[own])
            return at
        seeds = rng.choice(own, size=min(FANOUT, -(-len(own) // PAGE)), replace=False)
        near = np.stack([space.between(values[own], values[s]) for s in seeds]).argmin(axis=0)
        groups = [(s, own[near == j]) for j, s in enumerate(seeds)]
        halves = [(s, part) for s, g in groups for part in (np.array_split(g, 2) if 2 * len(g) > len(own) else [g]) if len(part)]
        routes = values[[s for s, _ in halves]]
        radius = np.array([space.between(values[g], values[s]).max() for s, g in halves])
        refs = np.array([grow(g, values[s]) for s, g in halves], np.int64)
        pages[at] = Page(False, routes, away(routes), radius, refs)
        return at

    grow(np.argsort(ids, kind="stable"), None)
    return pages


@dataclass
class Visit:
    """One query on one tree, and what it cost."""

    found: list[tuple[int, int]] = field(default_factory=list)
    computed: int = 0
    skipped: int = 0


def search(pages: list[Page], space: Space, q: np.ndarray, k: int, floor: int | None = None, own: int | None = None) -> Visit:
    """The ``k`` best (score, id), ties to the smaller id, of those not below ``floor``, best first; the id ``own`` is left out."""
    square, out = int((q.astype(np.int64) ** 2).sum()), Visit()
    reach = lambda score: float("inf") if score is None else float(space.to_query(np.float64(score), square)) + space.slack
    limit, heap = reach(floor), [(0.0, 0, None)]
    while heap:
        least, at, d = heapq.heappop(heap)
        if least > limit:
            break
        page = pages[at]
        # triangle inequality over the routing object: nothing is computed for what lies too far on either side of it
        some = np.arange(len(page.refs)) if d is None else np.flatnonzero(np.abs(d - page.to_parent) - page.radius <= limit)
        out.computed += len(some)
        out.skipped += len(page.refs) - len(some)
        if not len(some):
            continue
        scores = space.products(page.values[some], q)
        if page.leaf:
            ids = page.refs[some]
            fine = np.ones(len(ids), bool) if floor is None else scores >= floor
            if own is not None:
                fine &= ids != own
            out.found = sorted([*out.found, *zip((-scores[fine]).tolist(), ids[fine].tolist(), strict=True)])[:k]
            if len(out.found) == k:
                limit = min(limit, reach(-out.found[-1][0]))
            continue
        away = space.to_query(scores, square)
        for i, x in zip(some.tolist(), away.tolist(), strict=True):
            if (lower := max(0.0, x - page.radius[i])) <= limit:
                heapq.heappush(heap, (lower, int(page.refs[i]), x))
    out.found = [(-s, i) for s, i in out.found]
    return out


def numbers(vectors: DataFrame, scale: int) -> tuple[DataFrame, int, int, Space]:
    """``row``, ``vec_id``, ``v`` and ``square`` of every sound row as a stored table, their number, width and space."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & sound(F.col("embedding")))
    width = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0] or 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = floors(batch.column(1), width, scale)
            lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, width, dtype=np.int32), v.reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array((v * v).sum(axis=1))], ["vec_id", "v", "square"])

    out = stored(rows.mapInArrow(cut, "vec_id long, v array<int>, square long").select(F.monotonically_increasing_id().alias("row"), "*"))
    n, most = out.agg(F.count("*"), F.coalesce(F.max("square"), F.lit(0))).first()
    return out, n, width, Space(most)


def matrix(column, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).reshape(len(column), width) if len(column) else np.zeros((0, width), np.int32)


class Index:
    """Pages of all shards as a stored table, and the cells: pivot, covering radius and number of shards of each."""

    def __init__(self, rows: DataFrame, n: int, width: int, space: Space):
        spark, self.width, self.space = rows.sparkSession, width, space
        most = min(PIVOTS, max(1, int(n**0.5) // 4))
        pivots = matrix(rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(most).toPandas()["v"], width)
        shared = spark.sparkContext.broadcast((pivots, space))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pivots, space = shared.value
            for pdf in batches:
                v = matrix(pdf["v"], width)
                best, cell = np.full(len(v), np.inf), np.zeros(len(v), np.int32)
                for j, p in enumerate(pivots):
                    d = space.between(v, p)
                    nearer = d < best
                    best[nearer], cell[nearer] = d[nearer], j
                yield pdf.assign(cell=cell, away=best)

        self.placed = stored(rows.mapInPandas(place, "row long, vec_id long, v array<int>, square long, cell int, away double"))
        # at most PIVOTS rows
        cells = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").toPandas()
        self.cells, self.radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
        self.pivots, self.shards = pivots[self.cells], (-(-cells["n"] // SHARD_ROWS)).to_numpy()
        salts = F.element_at(F.array(*(F.lit(int(x)) for x in np.bincount(self.cells, self.shards, most).astype(int))), F.col("cell") + 1)
        shard = F.col("cell") + PIVOTS * F.pmod(F.xxhash64("row"), salts)
        self.pages = stored(self.placed.select(shard.alias("shard"), "vec_id", "v").groupBy("shard").applyInPandas(self._build(), "shard long, page int, leaf boolean, vals binary, away binary, radius binary, refs binary"))

    def _build(self):
        width, space = self.width, self.space

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            shard = pdf["shard"].iloc[0]
            pages = load(pdf["vec_id"].to_numpy(), matrix(pdf["v"], width), space, int(shard))
            rows = [(shard, k, p.leaf, p.values.tobytes(), p.to_parent.tobytes(), p.radius.tobytes(), p.refs.tobytes()) for k, p in enumerate(pages)]
            return pd.DataFrame(rows, columns=["shard", "page", "leaf", "vals", "away", "radius", "refs"])

        return build

    def ask(self, visits: DataFrame, k: int) -> DataFrame:
        """``row``, ``query_id``, ``vec_id`` and ``score`` of the best of every (shard, row, query_id, v, floor) in ``visits``.

        Queries of a shard meet its pages in blocks, of which each has its copy of the pages.
        """
        width, space = self.width, self.space
        visits = stored(visits)
        counts = sized(visits.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")))
        asked = visits.join(counts, "shard").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
        pages = self.pages.join(counts, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def answer(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("page")
            tree = [
                Page(bool(r.leaf), np.frombuffer(r.vals, np.int32).reshape(-1, width), np.frombuffer(r.away), np.frombuffer(r.radius), np.frombuffer(r.refs, np.int64))
                for r in own.itertuples()
            ]
            out = []
            if tree:
                for row, i, v, floor in zip(queries["row"], queries["query_id"], queries["v"], queries["floor"], strict=True):
                    found = search(tree, space, np.asarray(v), k, None if floor == NO_FLOOR else int(floor), int(i)).found
                    out += [(row, i, vec, score) for score, vec in found]
            return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"])

        keys = ("shard", "block")
        return pages.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(answer, "row long, query_id long, vec_id long, score long")

    def visits(self, queries: DataFrame, home: bool) -> DataFrame:
        """Shards that queries (row, query_id, v, cell, floor) must visit: those of their own cell, or of the others that may hold a result."""
        width, space = self.width, self.space
        shared = queries.sparkSession.sparkContext.broadcast((self.cells, self.pivots, self.radius, self.shards))

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells, pivots, radius, shards = shared.value
            for pdf in batches:
                for r in pdf.itertuples():
                    own = cells == r.cell
                    if not home:
                        q = np.asarray(r.v)
                        square = int((q.astype(np.int64) ** 2).sum())
                        limit = np.inf if r.floor == NO_FLOOR else space.to_query(np.float64(r.floor), square) + space.slack
                        own = ~own & (space.to_query(space.products(pivots, q), square) - radius <= limit)
                    ids = [int(c) + PIVOTS * s for c, m in zip(cells[own], shards[own], strict=True) for s in range(int(m))]
                    if ids:
                        yield pd.DataFrame({"shard": ids, "row": r.row, "query_id": r.query_id, "v": [r.v] * len(ids), "floor": [r.floor] * len(ids)})

        return queries.select("row", "query_id", "v", "cell", "floor").mapInPandas(choose, "shard long, row long, query_id long, v array<int>, floor long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asked: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` rows of (vec_id, embedding) with the largest inner product.

    Components are floor(scale * x); queries are the rows for which ``asked``, a condition on ``vec_id``, holds, candidates
    all rows of other ids. Ties go to the smaller id. Rows whose vector is null or holds a null or non-finite component
    and rows without an id take no part. Repeated rows are candidates of their own, and queries too (each is answered).
    Shorter vectors end in zeros. Large components are held at ``codes.limit``. With fewer candidates there are fewer
    rows; an empty table, or one without queries, gives none. Other columns are not read.
    """
    rows, n, width, space = numbers(vectors, scale)
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("square").alias("score"))
    index = Index(rows, n, width, space)
    queries = index.placed.where(asked).select("row", F.col("vec_id").alias("query_id"), "v", "cell")
    near = stored(best(index.ask(index.visits(queries.withColumn("floor", F.lit(NO_FLOOR)), True), k), k).drop("rank"))
    floors_ = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    far = index.ask(index.visits(queries.join(floors_, "row", "left").na.fill({"floor": NO_FLOOR}), False), k)
    return best(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of ``embeddings`` with the largest integer inner product for every hundredth id; see ``top_k`` for odd rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op11_topk": op11_topk}
SQL = {
    "op11_topk": f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}
""",
}
