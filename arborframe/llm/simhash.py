"""SimHash near-duplicates with vantage-point trees.

A tree over whole 64-bit fingerprints hardly prunes at a radius of 4: distances to a vantage point lie around
32 with a deviation of 4, so three in four queries go down both sides of a split. The fingerprint is therefore cut
into four blocks of 16 bits. Two fingerprints within 4 bits agree in some block up to 1 bit, so one tree over the
values of each block, searched with radius 1, meets every pair; pairs are then compared in full. A block has 65,536
values at most, so the trees are built from exact counts of bounded size, not from a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, quoted, sized, table, text_key, with_text_outputs

SHINGLE = 4
RADIUS = 4
BITS = 64
BLOCKS = 4
#: Fingerprints of a shard, about; a value that more of them share is dealt to tiles of these sides.
SHARD = 1024
TILE = (8192, 32768)
#: Vantage points tried at a split.
TRIALS = 12

_LOWER = bytes(b | 0x20 if 65 <= b <= 90 else b for b in range(256))
_SPAN = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= n:
        bounds = [(0, len(joined))]
    else:
        starts = np.concatenate([[0], ends[:-n] + 1])
        bounds = zip(starts.tolist(), ends[n - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in bounds], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, n: int = SHINGLE) -> DataFrame:
    """Append ``fp``, the fingerprint as a signed long. No shuffle; texts are read whole; null counts as wordless."""
    def of(texts: list[str]) -> dict:
        return {"fp": np.fromiter((fingerprint(t, n) for t in texts), np.uint64, len(texts)).view(np.int64)}

    return with_text_outputs(docs, text, {"fp": "long"}, lambda: of, keep)


@dataclass(frozen=True)
class Forest:
    """Trees over block values, as arrays over nodes; a leaf is a shard (``left`` is -1).

    Values within ``mu`` of a node's vantage point live on its left, the others on its right.
    """

    radius: int
    roots: tuple[int, ...]
    vantage: np.ndarray
    mu: np.ndarray
    left: np.ndarray
    right: np.ndarray
    tiles: np.ndarray

    def route(self, values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home) of every shard that a value lives in or must be compared in.

        Of two values on different sides of a split, the right one visits the left: by the triangle inequality it
        is within ``mu + radius`` of the vantage point if the pair is within the radius. A visitor goes on to each
        side that its ball may reach.
        """
        at = np.arange(len(values))
        node = np.full(len(values), self.roots[block])
        home = np.ones(len(values), dtype=bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            leaf = self.left[node] < 0
            done.append((at[leaf], node[leaf], home[leaf]))
            at, node, home = at[~leaf], node[~leaf], home[~leaf]
            d = np.bitwise_count(values[at] ^ self.vantage[node]).astype(np.int64)
            mu = self.mu[node]
            own_left = home & (d <= mu)
            go_left = own_left | (d <= mu + self.radius)
            go_right = np.where(home, d > mu, d > mu - self.radius)
            at, node, home = (
                np.concatenate([at[go_left], at[go_right]]),
                np.concatenate([self.left[node[go_left]], self.right[node[go_right]]]),
                np.concatenate([own_left[go_left], home[go_right]]),
            )
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (at, node, home)


def plant(counts: np.ndarray, radius: int, shard: int = SHARD) -> Forest:
    """Trees for ``counts`` (blocks x 65536), split at the vantage point and distance that send the fewest visitors."""
    vantage, mu, left, right = [], [], [], []

    def node() -> int:
        for column, x in ((vantage, 0), (mu, 0), (left, -1), (right, -1)):
            column.append(x)
        return len(left) - 1

    roots = []
    for block in range(len(counts)):
        rng = np.random.default_rng(block)
        roots.append(node())
        values = np.flatnonzero(counts[block]).astype(np.uint16)
        todo = [(roots[-1], values, counts[block][values])]
        while todo:
            at, values, weight = todo.pop()
            total = int(weight.sum())
            if total <= shard or len(values) < 2:
                continue
            best = None
            for v in rng.choice(values, size=min(TRIALS, len(values)), replace=False):
                d = np.bitwise_count(values ^ v)
                reach = np.cumsum(np.bincount(d, weights=weight, minlength=17 + radius))
                for m in range(16):
                    lo = reach[m]
                    if 0 < lo < total:
                        # what a balanced split would leave to compare, with its visitors
                        cost = lo * reach[m + radius] + (total - lo) ** 2
                        if best is None or cost < best[0]:
                            best = (cost, v, m, d)
            if best is None:
                continue
            _, v, m, d = best
            vantage[at], mu[at], left[at], right[at] = int(v), m, node(), node()
            inside = d <= m
            todo += [(left[at], values[inside], weight[inside]), (right[at], values[~inside], weight[~inside])]
    n = len(left)
    forest = Forest(radius, tuple(roots), np.array(vantage, np.uint16), np.array(mu), np.array(left), np.array(right), np.ones((n, 2), np.int64))
    here, there = np.zeros(n), np.zeros(n)
    for block in range(len(counts)):
        values = np.flatnonzero(counts[block]).astype(np.uint16)
        at, leaf, home = forest.route(values, block)
        weight = counts[block][values[at]]
        np.add.at(there, leaf, weight)
        np.add.at(here, leaf[home], weight[home])
    forest.tiles[:, 0] = np.maximum(1, np.ceil(here / TILE[0]))
    forest.tiles[:, 1] = np.maximum(1, np.ceil(there / TILE[1]))
    return forest


def block_values(fps: np.ndarray, block: int) -> np.ndarray:
    return (fps >> np.uint64(16 * block)).astype(np.uint16)


def spanning(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that joins what links of ``a`` with ``b`` join; never more than there are fingerprints."""
    nodes = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    root = np.arange(len(nodes))
    step = max(1, 2_000_000 // max(1, len(b)))
    for k in range(0, len(a), step):
        rows, cols = np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b) <= radius)
        u, v = ia[k + rows], ib[cols]
        while True:
            ru, rv = root[u], root[v]
            apart = ru != rv
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            root[np.maximum(ru, rv)[apart]] = np.minimum(ru, rv)[apart]
            while not np.array_equal(root, deeper := root[root]):
                root = deeper
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``) whose components are those of all links.

    Every fingerprint goes to its shard in each block's tree and, as a visitor, to the shards that its ball
    overlaps. Shards that many fingerprints share are cut into tiles; a tile answers with a spanning forest.
    """
    if radius >= 2 * BLOCKS:
        raise ValueError("the blocks are too few for this radius")
    parts = distinct.select(F.explode(F.array(*(F.struct(F.lit(k).alias("block"), (F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int").alias("value")) for k in range(BLOCKS)))).alias("x"))
    seen = parts.groupBy("x.block", "x.value").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((BLOCKS, _SPAN), dtype=np.int64)
    counts[seen["block"].to_numpy(dtype=np.int64), seen["value"].to_numpy(dtype=np.int64)] = seen["n"]
    shared = distinct.sparkSession.sparkContext.broadcast(plant(counts, radius // BLOCKS, shard))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value
        for pdf in batches:
            fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            spread = (fps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for block in range(BLOCKS):
                at, leaf, home = forest.route(block_values(fps, block), block)
                rows, cols = forest.tiles[leaf, 0], forest.tiles[leaf, 1]
                i, j = (spread[at] % rows.astype(np.uint64)).astype(np.int64), (spread[at] // 7 % cols.astype(np.uint64)).astype(np.int64)
                one = (rows == 1) & (cols == 1)
                yield pd.DataFrame({"shard": leaf[one], "tile": 0, "home": home[one], "other": True, "fp": fps[at[one]].view(np.int64)})
                many = np.flatnonzero(~one)
                if len(many):
                    # the right side of a pair in every row of tiles, the left side in every column
                    k = np.repeat(many, rows[many])
                    row = np.arange(len(k)) - np.repeat(np.cumsum(rows[many]) - rows[many], rows[many])
                    yield pd.DataFrame({"shard": leaf[k], "tile": row * 100_000 + j[k], "home": False, "other": True, "fp": fps[at[k]].view(np.int64)})
                    own = many[home[many]]
                    k = np.repeat(own, cols[own])
                    col = np.arange(len(k)) - np.repeat(np.cumsum(cols[own]) - cols[own], cols[own])
                    yield pd.DataFrame({"shard": leaf[k], "tile": i[k] * 100_000 + col, "home": True, "other": False, "fp": fps[at[k]].view(np.int64)})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = spanning(fps[pdf["home"].to_numpy(dtype=bool)], fps[pdf["other"].to_numpy(dtype=bool)], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInPandas(deal, "shard long, tile long, home boolean, other boolean, fp long")
    return dealt.groupBy("shard", "tile").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row: the smallest id among all that links reach.

    Exact copies share a fingerprint and are compared once. Wordless and null texts have fingerprint 0 and link like
    any other. A null id is carried along and is no component's id unless all its ids are null. An empty table gives
    an empty result.
    """
    found = _placed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ("doc_id",), radius, n)
    return found.select("doc_id", "fp", "component_id")


def _placed(docs: DataFrame, keep: tuple[str, ...], radius: int, n: int) -> DataFrame:
    """``keep``, ``fp``, ``component`` (a fingerprint of it) and ``component_id`` (its smallest doc_id)."""
    fps = checkpointed(fingerprints(docs, keep=keep, n=n))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(checkpointed(reps.select("fp")), radius))
    placed = reps.join(found, reps["fp"] == found["vertex"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return fps.join(placed.join(least, "component").select("fp", "component", "component_id"), "fp").select(*keep, "fp", "component", "component_id")


def representatives(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text and others) with one document of each component: that of the smallest id, then text key.

    A null id comes last. Of rows that share id and text one stays. Ids and fingerprints are grouped, texts are not:
    the rows that go are joined against by key, and broadcast while they are few.
    """
    key = text_key(F.col("text"))
    found = checkpointed(_placed(docs.select("doc_id", key.alias("th"), "text"), ("doc_id", "th"), radius, n))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    stays = found.groupBy("component").agg(F.min(rank).alias("first")).select("component", "first")
    gone = found.join(stays, "component").where(~rank.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th")).distinct()
    held = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("doc_id").alias("doc_id"), key.alias("th"))
    kept = held.join(sized(gone), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left_anti")
    if not found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "th"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and wordless texts have fingerprint 0 and link like any other.

    An empty table gives no rows, repeated rows have a row each.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
