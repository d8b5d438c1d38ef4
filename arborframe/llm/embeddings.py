"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells (Babenko and Lempitsky, "The Inverted
Multi-Index", 2012). Every vector is compared with what lives in the cells nearest to it, in the order of the
multi-sequence traversal; how many cells that takes is measured against brute force on a query sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, hash128, table

THRESHOLD = 0.93
#: Vectors that the codebooks are fitted on: this many, or ``FIT_CODE`` for each code where that is more (it grows with
#: the square root of the rows), and vectors compared with all rows to find how many cells the recall takes.
FIT_ROWS = 8192
FIT_CODE = 16
QUERY_ROWS = 128
#: Share of a query's neighbours that its own traversal must reach; the neighbours' traversals add to it.
TARGET = 0.99
#: Times the cells that the sample needs for it, since the sample is small.
MARGIN = 2
#: Vectors a cell should hold, about: the codebooks grow with the square root of the rows.
CELL_ROWS = 48
#: Sides of the tiles that large cells are cut into.
TILE = (2048, 8192)


def unit(rows: list | np.ndarray, width: int | None = None) -> np.ndarray:
    """Unit vectors in double precision; shorter ones end in zeros up to ``width``."""
    if isinstance(rows, np.ndarray):
        x = np.asarray(rows, dtype=np.float64)
    else:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        x = np.zeros((len(rows), width or int(sizes.max())))
        x[np.arange(x.shape[1]) < sizes[:, None]] = np.concatenate(rows)
    # scaled first, so that squares of large or tiny components stay in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = n > 0
        centres[full] = sums[full] / n[full, None]
        centres[~full] = x[rng.choice(len(x), size=int((~full).sum()))]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


@dataclass(frozen=True)
class Grid:
    first: np.ndarray
    second: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared(x[:, :half], self.first), squared(x[:, half:], self.second)

    def traverse(self, x: np.ndarray, t: int) -> np.ndarray:
        """The ``t`` cells of least summed distance for every row, nearest first.

        Cell (i, j) in the order of the two halves comes after the (i + 1)(j + 1) - 1 cells that it dominates, so
        only those with (i + 1)(j + 1) <= t can be among the first t.
        """
        a, b = self.distances(x)
        t = min(t, a.shape[1] * b.shape[1])
        pairs = np.array([(i, j) for i in range(min(t, a.shape[1])) for j in range(min(t // (i + 1), b.shape[1]))])
        oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        sums = np.take_along_axis(a, oa, 1)[:, pairs[:, 0]] + np.take_along_axis(b, ob, 1)[:, pairs[:, 1]]
        best = np.argsort(sums, axis=1, kind="stable")[:, :t]
        return (oa[:, pairs[:, 0]] * b.shape[1] + ob[:, pairs[:, 1]])[np.arange(len(x))[:, None], best].astype(np.int32)


def fit(vectors: DataFrame, n: int, width: int, threshold: float, target: float) -> tuple[Grid, int]:
    """Codebooks from a sample of ``FIT_ROWS`` rows or more, and the number of cells that reach the target recall."""
    codes = max(2, int(np.sqrt(n / CELL_ROWS)))
    sample = unit([r["embedding"] for r in vectors.orderBy(F.xxhash64("cid"), "cid").select("embedding").limit(max(FIT_ROWS, FIT_CODE * codes)).toLocalIterator()], width)
    half = max(1, width // 2)
    grid = Grid(kmeans(sample[:, :half], codes, seed=1), kmeans(sample[:, half:], codes, seed=2))
    queries = vectors.orderBy(F.xxhash64(F.lit("query"), "cid"), "cid").select("cid", "label", "embedding").limit(QUERY_ROWS).toPandas()
    q = unit(list(queries["embedding"]), width)
    a, b = grid.distances(q)
    order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(q), -1), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    shared = vectors.sparkSession.sparkContext.broadcast((grid, q, queries["cid"].to_numpy(), queries["label"].to_numpy(), rank))

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q, ids, labels, rank = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = unit(list(pdf["embedding"]), width)
            hit = (q @ x.T >= threshold) & (labels[:, None] == pdf["label"].to_numpy()) & (ids[:, None] != pdf["cid"].to_numpy())
            i, j = np.nonzero(hit)
            if len(i):
                cells = own.traverse(x[j], 1)[:, 0]
                yield pd.DataFrame({"q": i, "rank": rank[i, cells]}).value_counts().rename("n").reset_index()

    found = vectors.select("cid", "label", "embedding").mapInPandas(reached, "q long, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        # no query has a neighbour: vectors turned by a random angle at the threshold stand in
        rng = np.random.default_rng(3)
        aside = rng.normal(size=q.shape)
        aside -= (aside * q).sum(axis=1, keepdims=True) * q
        turned = threshold * q + np.sqrt(max(0.0, 1 - threshold**2)) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        ranks, weight = rank[np.arange(len(q)), grid.traverse(turned, 1)[:, 0]], np.ones(len(q))
    else:
        ranks, weight = found["rank"].to_numpy(), (found["n"] / found.groupby("q")["n"].transform("sum")).to_numpy()
    by_rank = np.argsort(ranks, kind="stable")
    share = np.cumsum(weight[by_rank]) / weight.sum()
    return grid, MARGIN * (int(ranks[by_rank][np.searchsorted(share, min(target, share[-1]))]) + 1)


def _count_links(shared, threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, t, width = shared.value
        home, other = pdf["home"].to_numpy(dtype=bool), pdf["other"].to_numpy(dtype=bool)
        cell = int(pdf["cell"].iloc[0])
        ids, weight = pdf["cid"].to_numpy(), pdf["w"].to_numpy()
        x = unit(list(pdf["embedding"]), width)
        own = pdf["own_cell"].to_numpy()
        a, b = np.flatnonzero(home), np.flatnonzero(other)
        nodes = np.unique(ids)
        at = np.searchsorted(nodes, ids)
        links, root = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
        step = max(1, 2_000_000 // max(1, len(b)))
        for k in range(0, len(a), step):
            i, j = np.nonzero(x[a[k : k + step]] @ x[b].T >= threshold)
            if not len(i):
                continue
            near = np.unique(i)
            visits = grid.traverse(x[a[k + near]], t)[np.searchsorted(near, i)]
            i, j = a[k + i], b[j]
            # a pair of one cell stands in both orders, once is enough; a pair of two cells that visit each
            # other's is counted in the lower cell
            once = np.where(own[j] == cell, ids[i] < ids[j], (cell < own[j]) | ~(visits == own[j][:, None]).any(axis=1))
            i, j = i[once], j[once]
            np.add.at(links, at[i], weight[j])
            np.add.at(links, at[j], weight[i])
            u, v = at[i], at[j]
            while True:
                ru, rv = root[u], root[v]
                apart = ru != rv
                if not apart.any():
                    break
                u, v = u[apart], v[apart]
                root[np.maximum(ru, rv)[apart]] = np.minimum(ru, rv)[apart]
                while not np.array_equal(root, deeper := root[root]):
                    root = deeper
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": nodes[some], "n": links[some], "root": nodes[root[some]]})

    return compare


def _linked(classes: DataFrame, n: int, width: int, threshold: float, target: float) -> DataFrame:
    """``cid``, ``n`` (weight of the other classes linked) and ``root`` rows, several of a class.

    A visit ships the vector alone, in the precision of the input; which cells a vector visits is found anew from the
    grid for those that have a neighbour.
    """
    grid, t = fit(classes, n, width, threshold, target)
    shared = classes.sparkSession.sparkContext.broadcast((grid, t, width))
    kind = classes.schema["embedding"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, t, width = shared.value
        for pdf in batches:
            if len(pdf):
                cells = own.traverse(unit(list(pdf["embedding"]), width), t)
                yield pd.DataFrame({"cid": pdf["cid"], "label": pdf["label"], "own_cell": cells[:, 0], "cells": list(cells)})

    placed = checkpointed(classes.select("cid", "label", "embedding").mapInPandas(place, "cid long, label long, own_cell int, cells array<int>"))
    visits = placed.select("cid", "label", "own_cell", F.posexplode("cells").alias("k", "cell"))
    sizes = visits.groupBy("label", "cell").agg(F.count_if(F.col("k") == 0).alias("here"), F.count("*").alias("there"))
    tiles = sizes.where(f"here > {TILE[0]} OR there > {TILE[1]}").select("label", "cell", F.ceil(F.col("here") / TILE[0]).cast("int").alias("rows"), F.ceil(F.col("there") / TILE[1]).cast("int").alias("cols"))
    dealt = visits.join(tiles, ["label", "cell"], "left").na.fill(1, ["rows", "cols"])
    home, one = F.col("k") == 0, (F.col("rows") <= 1) & (F.col("cols") <= 1)
    i, j = F.pmod(F.xxhash64("cid"), F.greatest("rows", F.lit(1))), F.pmod(F.xxhash64(F.lit("side"), "cid"), F.greatest("cols", F.lit(1)))
    place_of = lambda row, col, h, o: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), h.alias("home"), o.alias("other"))
    seats = F.when(one, F.array(place_of(F.lit(0), F.lit(0), home, F.lit(True)))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.greatest("rows", F.lit(1)) - 1), lambda r: place_of(r, j, F.lit(False), F.lit(True))),
            F.when(home, F.transform(F.sequence(F.lit(0), F.greatest("cols", F.lit(1)) - 1), lambda c: place_of(i, c, F.lit(True), F.lit(False)))).otherwise(F.array().cast("array<struct<row:bigint,col:bigint,home:boolean,other:boolean>>")),
        )
    )
    # a class has a few seats; they are gathered by class before they meet its vector, so that vectors are read once
    seated = dealt.select("cid", "label", "cell", "own_cell", F.explode(seats).alias("s")).groupBy("cid").agg(F.collect_list(F.struct("label", "cell", "own_cell", "s.*")).alias("seats"))
    full = seated.join(classes.select("cid", "w", "embedding"), "cid").select("cid", "w", "embedding", F.explode("seats").alias("s")).select("cid", "w", F.col("embedding").cast(kind).alias("embedding"), "s.*")
    return full.groupBy("label", "cell", "row", "col").applyInPandas(_count_links(shared, threshold), "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of (vec_id, embedding, label).

    Equal vectors of one label are one weighted class and are not compared; classes of one label and length are
    compared in the cells of the grid, by cosine in double precision of the components as they are given. A vector that
    is null, empty or zero, holds a null or non-finite component, or has no label links with nothing, its component is
    itself. Vectors of different lengths do not link; they share the grid, with zeros after the shorter ones. A null
    vec_id counts as a vector; its component is the smallest id of those linked, null if there is none. Repeated rows
    link with one another. An empty table gives an empty result; other columns of ``vectors`` are dropped.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    sound = F.col("label").isNotNull() & F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    k1, k2 = hash128("label", "embedding")
    keyed = rows.select("vec_id", "label", "embedding", F.when(sound, k1).alias("k1"), F.when(sound, k2).alias("k2"))
    classes = checkpointed(
        keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count("*").alias("w"), F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # of labels and lengths together: vectors meet only where both are equal
    split = classes.withColumn("label", F.xxhash64("label", F.size("embedding")))
    found = _linked(split, n, width, threshold, target)
    found = checkpointed(found)
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    placed = (
        classes.select("k1", "k2", "w", "rep", "cid").join(counts, "cid", "left").join(parts.withColumnRenamed("vertex", "cid"), "cid", "left")
        .select("k1", "k2", "rep", F.coalesce("component", "cid").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    )
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    of_class = placed.join(least, "component").select("k1", "k2", "n_links", "least")
    return keyed.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least"))).alias("kept"),
    )


def recall(vectors: DataFrame, found: DataFrame, every: int = 20, threshold: float = THRESHOLD, block: int = 1024) -> tuple[int, int]:
    """Links of the vectors whose id is divisible by ``every``, as found and by brute force against all rows, in blocks."""
    sound = vectors.where("label IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    asked = sound.where(F.col("vec_id") % every == 0)
    context, links = vectors.sparkSession.sparkContext, 0
    fine = lambda x: x is not None and len(x) and np.isfinite(np.asarray(x, float)).all() and np.any(x)
    # a stated set of queries, sent in blocks of bounded size
    parts = asked.select("vec_id", "label", "embedding").toLocalIterator()
    while part := [r for _, r in zip(range(block), parts, strict=False)]:
        part = [r for r in part if fine(r["embedding"])]
        if not part:
            continue
        shared = context.broadcast(([r["vec_id"] for r in part], [r["label"] for r in part], [r["embedding"] for r in part]))

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, labels, q = shared.value
            width = max(map(len, q))
            size, q = np.array([len(x) for x in q]), unit([np.asarray(x, float) for x in q], width)
            for pdf in batches:
                pdf = pdf[[fine(x) and len(x) <= width for x in pdf["embedding"]]]
                if len(pdf):
                    near = (q @ unit(list(pdf["embedding"]), width).T >= threshold) & (np.array(labels)[:, None] == pdf["label"].to_numpy())
                    near &= (size[:, None] == pdf["embedding"].map(len).to_numpy()) & (np.array(ids)[:, None] != pdf["vec_id"].to_numpy())
                    yield pd.DataFrame({"n": [int(near.sum())]})

        links += sound.mapInPandas(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found.where(F.col("vec_id") % every == 0).agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0], links


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and whether it is kept, for every vector; vectors that cannot link are their own component.

    An empty table gives no rows; repeated rows link with one another; extra columns are dropped.
    """
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embeddings": op2_embeddings}
SQL = {
    "op2_embeddings": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON e.vec_id = c.a
""",
}
