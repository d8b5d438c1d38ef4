"""Pairwise similarity of genomes and references: top hits, radii, reports and joins by range."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written
from .sketch import blocks, small


def _rank(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query").orderBy(*order))


#: Vectors of a label that meet in one task, of either side, and queries whose products are held at once.
BLOCK, SLICE = 4096, 512


def _classes(x: np.ndarray) -> np.ndarray:
    """Indicators of what sign a component has; numbers that are none have their own."""
    return np.concatenate([x > 0, x < 0, x == 0, np.isnan(x)], axis=1).astype(np.float32)


def compared(queries: DataFrame, refs: DataFrame, min_af: float | None = None, best: bool = False) -> DataFrame:
    """(query, ref, ani, af) of queries and references of one label: cosine to nine decimals, and the share of equal signs.

    ``queries`` has query, label and v, ``refs`` ref, label, v and, where hits must reach it, ``radius``. Hits below
    ``min_af`` are left out; with ``best`` each block of references shows a query's best only, from which :func:`closest`
    picks. Vectors of one label meet in cells of a block of queries and a block of references, as matrices: every pair is
    compared, a vector travels once for a block of the other side, and a task holds two blocks. Vectors that are null or
    hold nulls, null labels and pairs of different lengths take no part. A cosine that is no number reaches every radius and is the last of a query.
    """
    bounded = "radius" in refs.columns
    key = ["label", "dims"]
    whole = lambda df: df.where("label IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)").withColumn("dims", F.size("v"))
    queries, refs = whole(queries), whole(refs)
    parts = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = parts(queries, "q_parts").join(parts(refs, "r_parts"), key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = queries.join(counts, key).select("query", *key, "v", own("query", "q_parts").alias("q_part"), every("r_parts").alias("r_part"))
    placed = own("ref", "r_parts").alias("at_r"), every("q_parts").alias("at_q")
    held = refs.join(counts, key).select("ref", F.col("label").alias("of"), F.col("dims").alias("long"), F.col("v").alias("w"), *["radius"] * bounded, *placed)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            right = right.sort_values("ref")  # of equal hits the first is the smallest
            w = np.stack(right["w"].to_numpy()).astype(np.float64)
            w_norm, w_signs, ref = np.sqrt((w * w).sum(1)), _classes(w), right["ref"].to_numpy()
            for lo in range(0, len(left), SLICE):
                v = np.stack(left["v"].to_numpy()[lo : lo + SLICE]).astype(np.float64)
                with np.errstate(all="ignore"):
                    ani = np.round(v @ w.T / (np.sqrt((v * v).sum(1))[:, None] * w_norm), 9)
                af = (_classes(v) @ w_signs.T).astype(np.float64) / w.shape[1]
                is_hit = np.ones(ani.shape, bool) if min_af is None else af >= min_af
                if bounded:
                    is_hit &= ~(ani < right["radius"].to_numpy(np.float64))
                if best:
                    value = np.where(is_hit, np.where(np.isnan(ani), -2.0, ani), -np.inf)
                    is_hit &= value == value.max(1, keepdims=True)
                    rest = np.where(is_hit, af, -1.0)
                    at = rest.argmax(1)
                    i = np.flatnonzero(is_hit[np.arange(len(at)), at])
                    j = at[i]
                else:
                    i, j = np.nonzero(is_hit)
                found.append(pd.DataFrame({"query": left["query"].to_numpy()[lo : lo + SLICE][i], "ref": ref[j], "ani": ani[i, j], "af": af[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "ref": [], "ani": [], "af": []})

    at = [*key, "q_part", "r_part"]
    ids = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query"), (refs, "ref"))]
    return asked.groupBy(*at).cogroup(held.groupBy("of", "long", "at_q", "at_r")).applyInPandas(cell, f"{', '.join(ids)}, ani double, af double")


BY_ANI = (F.desc, "ani"), (F.desc, "af"), (F.asc, "ref")


def order() -> list[Column]:
    return [f(c) for f, c in BY_ANI]


def closest(hits: DataFrame, min_af: float) -> DataFrame:
    """Best hit of every query with enough coverage: by ani, then af, then id. A partial minimum, not a window."""
    best = hits.where(F.col("af") >= min_af).groupBy("query").agg(F.min(F.struct((-F.col("ani")).alias("a"), (-F.col("af")).alias("f"), "ref")).alias("b"))
    return best.select("query", "b.ref", (-F.col("b.a")).alias("ani"), (-F.col("b.f")).alias("af"))


def report_closest(queries: DataFrame, hits: DataFrame, min_af: float, radius: DataFrame | None = None) -> DataFrame:
    """One row an input query: its best hit and whether that is within the reference's radius; nulls without a hit."""
    top = closest(hits, min_af)
    found = queries.select("query").join(top, "query", "left")
    if radius is None:
        return found
    return found.join(radius.select("ref", F.col("ani").alias("radius")), "ref", "left").select("query", "ref", "ani", "af", (F.col("ani") >= F.col("radius")).alias("within"))


def within_radius(hits: DataFrame, radius: DataFrame) -> DataFrame:
    """Hits that reach the radius of their reference."""
    return hits.join(radius.select("ref", F.col("ani").alias("radius")), "ref").where(F.col("ani") >= F.col("radius"))


def screen(hits: DataFrame, radius: DataFrame, min_af: float) -> DataFrame:
    """Radius first, then the best hit: what the screen before placement classifies."""
    return closest(within_radius(hits, radius).select("query", "ref", "ani", "af"), min_af)


def confirm(hits: DataFrame, radius: DataFrame, min_af: float) -> DataFrame:
    """The best hit first, then its radius: what classification after placement accepts."""
    return within_radius(closest(hits, min_af), radius).select("query", "ref", "ani", "af")


def other_related(hits: DataFrame, min_af: float) -> DataFrame:
    """All hits but the best of every query with enough coverage, in the order of the report."""
    ranked = hits.where(F.col("af") >= min_af).withColumn("rank", _rank(order()))
    return ranked.where("rank > 1").groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("ref").cast("string").alias("ref")))), lambda r: r["ref"]), "; ").alias("related"))


def in_report_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy("query", F.desc("af"), F.desc("ani"), "ref")


def with_lineage(hits: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The lineage of each hit's reference; a reference without one stays, as null."""
    return hits.join(taxonomy.select(F.col("genome_id").alias("ref"), "taxa"), "ref", "left")


def near_ranks(values: DataFrame, medians: DataFrame, most: float = 0.1) -> DataFrame:
    """Ranks whose median lies within ``most`` of a value, nearest first, joined by ``&``. Medians are a few rows."""
    ranks = F.broadcast(medians.agg(F.collect_list(F.struct("rank", "median_red")).alias("__m")))
    close = F.filter(F.transform("__m", lambda m: F.struct(F.abs(F.col("red") - m["median_red"]).alias("d"), m["rank"].alias("rank"))), lambda m: m["d"] <= most)
    return values.crossJoin(ranks).withColumn("near", F.array_join(F.transform(F.array_sort(close), lambda m: m["rank"]), "&")).drop("__m")


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(text: str, k: int) -> np.ndarray:
    """64-bit hashes of the distinct k-letter substrings, in order; a shorter text is one."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    width = min(k, len(letters))
    h = np.full(len(letters) - width + 1, width, np.uint64)
    for j in range(width):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + letters[j : len(letters) - width + 1 + j])
    return np.unique(h)


#: Pairs at the least similarity that the comparison of signatures may lose, and substrings of the texts in a block.
LOST, SHINGLES = 1e-6, 2**21


def shingle_signatures(docs: DataFrame, k: int = 5, n: int = 40) -> DataFrame:
    """``docs`` (seq and others) with ``bands``, ``symbols`` and ``n_shingles`` of the k-letter substrings.

    Each of ``n`` bands is a hash of the minima of two families; of all 2 * ``n`` minima the last four bits are kept,
    sixteen in a number.
    """

    @F.pandas_udf("bands array<long>, symbols array<long>, n_shingles long")
    def signed(texts: pd.Series) -> pd.DataFrame:
        seeds = _mixed(np.arange(1, 4 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        factors, seeds = seeds[: 2 * n] | np.uint64(1), seeds[2 * n :]
        at, rows = np.uint64(4) * (np.arange(2 * n, dtype=np.uint64) % np.uint64(16)), []
        for text in texts:
            x = _shingles(text, k)
            least = np.array([((x ^ s) * f >> np.uint64(32)).min() for s, f in zip(seeds, factors, strict=True)])
            symbols = np.add.reduceat((least & np.uint64(15)) << at, np.arange(0, 2 * n, 16))
            rows.append((_mixed(least[::2] << np.uint64(32) | least[1::2]).view(np.int64), symbols.view(np.int64), len(x)))
        return pd.DataFrame(rows, columns=["bands", "symbols", "n_shingles"])

    return docs.select(*docs.columns, signed("seq").alias("s")).select(*docs.columns, "s.*")


def _agreeing(slots: int, least: float) -> int:
    """Symbols of ``slots`` that a pair of similarity ``least`` has equal, but for a share of ``LOST``; one in 16 is equal by chance."""
    p, total = (1 + 15 * least) / 16, 0.0
    for m in range(slots + 1):
        total += comb(slots, m) * p**m * (1 - p) ** (slots - m)
        if total > LOST:
            return m if least > 0 else 0
    return 0


def _mistaken(least: float, n: int) -> int:
    """Bands that a pair of similarity ``least`` or more may seem to share, by four bits of each minimum, before the first
    that it does share, but for a share of ``LOST`` squared."""
    wrong = 2 * least * (1 - least) / 16 + (1 - least) ** 2 / 256
    share = wrong / (wrong + least**2)
    return next((m for m in range(n) if share ** (m + 1) <= LOST**2), n)


def _met(classes: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b): classes of different numbers that share a band and whose signatures don't show that they are below ``least``.

    The signatures travel with the bands, so that only what passes is listed; near copies meet in nearly every band, of
    which only the first ones count.
    """
    longs = range(-(-2 * n // 16))
    banded = classes.select("num", "is_query", "is_ref", "n_shingles", *(F.element_at("symbols", i + 1).alias(f"s{i}") for i in longs), F.posexplode("bands").alias("slot", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    total = lambda xs: sum(xs, F.lit(0))
    ones = lambda x: F.shiftrightunsigned(x, 1).bitwiseOR(x)
    apart = [F.shiftrightunsigned(ones(x), 2).bitwiseOR(ones(x)).bitwiseAND(F.lit(0x1111111111111111)) for x in (F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}")) for i in longs)]
    differ = total(F.bit_count(x) for x in apart)
    alike = [F.bitwise_not(F.shiftrightunsigned(x, 4).bitwiseOR(x)).bitwiseAND(F.lit(0x0101010101010101)) for x in apart]
    # eight bands in a number: those before this slot
    before = lambda i: F.when(F.col("a.slot") >= 8 * i + 8, F.lit(-1).cast("long")).when(F.col("a.slot") <= 8 * i, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, 8 * (a.slot - {8 * i})) - 1L"))
    seemed = total(F.bit_count(x.bitwiseAND(before(i))) for i, x in enumerate(alike))
    asked = F.expr("(a.is_query AND b.is_ref) OR (b.is_query AND a.is_ref)")
    near = (F.least("a.n_shingles", "b.n_shingles") >= least * F.greatest("a.n_shingles", "b.n_shingles")) & (differ <= 2 * n - _agreeing(2 * n, least)) & (seemed <= _mistaken(least, n))
    met = a.join(b, F.expr("a.slot = b.slot AND a.value = b.value AND a.num < b.num") & asked & near)
    return met.select(F.col("a.num").alias("a"), F.col("b.num").alias("b")).distinct()


def similar(sequences: DataFrame, k: int = 5, n: int = 40, least: float = 0.0) -> DataFrame:
    """(query, ref, similarity): Jaccard similarity of the k-letter substrings of queries and references that share a band
    of signatures and have ``least`` or more. ``sequences`` has id, seq, is_query and is_ref.

    The bands only find the candidates: a pair of similarity s is among them with probability 1 - (1 - s ** 2) ** n, at
    40 bands 0.99999 for s = 0.5. Those whose numbers of substrings or whose signatures show that they are below ``least``
    go, and what is left is counted from the substrings. Equal texts are one class, compared once, and two classes meet
    once for both directions. Neighbours lie in one block where they can; a text travels once for every cell of two
    blocks that it has candidates in.
    """
    rows = sequences.where("seq IS NOT NULL AND (is_query OR is_ref)").select("id", "seq", "is_query", "is_ref", F.unhex(F.md5(F.col("seq").cast("binary"))).alias("cls"))
    members = written(rows.drop("seq"))
    signed = shingle_signatures(rows, k, n).drop("seq")
    classes = signed.groupBy("cls").agg(F.min("id").alias("first"), F.bool_or("is_query").alias("is_query"), F.bool_or("is_ref").alias("is_ref"), *(F.first(c).alias(c) for c in ("bands", "symbols", "n_shingles")))
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()))
    pairs = written(_met(classes, n, least))
    turned = pairs.unionAll(pairs.select("b", "a"))
    labels = turned.groupBy(F.col("a").alias("num")).agg(F.least("num", F.min("b")).alias("least"))
    sized = written(labels.join(classes.select("num", F.col("n_shingles").alias("n")), "num"))
    placed = written(blocks(sized.withColumnRenamed("num", "cls"), SHINGLES))
    at = lambda c: placed.select(F.col("cls").alias(c), F.col("block").alias(f"{c}_block"))
    cells = pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.least("a_block", "b_block").alias("x"), F.greatest("a_block", "b_block").alias("y"))
    cells = written(cells)
    found = cells.select("x", "y", F.col("a").alias("num"), F.col("b").alias("other")).unionAll(cells.select("x", "y", F.col("b").alias("num"), F.lit(None).cast("long").alias("other")))
    found = found.groupBy("x", "y", "num").agg(F.collect_list("other").alias("found")).join(classes.select("num", "cls", "first"), "num")
    held = rows.select("cls", "id", "seq").join(small(written(found)), "cls").where(F.col("id").eqNullSafe(F.col("first"))).select("x", "y", "num", "found", "seq")

    def counted(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("num")  # an id may stand in several rows
        sets = [_shingles(t, k) for t in cell["seq"]]
        size = [len(x) for x in sets]
        _, entry = np.unique(np.concatenate(sets), return_inverse=True)
        sets = dict(zip(cell["num"], np.split(entry, np.cumsum(size)[:-1]), strict=True))
        own, out = np.zeros(entry.max() + 1, bool), []
        for a, others in zip(cell["num"], cell["found"], strict=True):
            if len(others):
                own[u := sets[a]] = True
                for b in others:
                    same = int(np.count_nonzero(own[v := sets[b]]))
                    out.append((a, b, same / (len(u) + len(v) - same)))
                own[u] = False
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    judged = written(held.groupBy("x", "y").applyInPandas(counted, "a long, b long, similarity double").where(F.col("similarity") >= least))
    names = members.join(classes.select("cls", "num"), "cls")
    named = lambda kind, c, name: names.where(kind).select(F.col("num").alias(c), F.col("id").alias(name))
    equal = classes.where("is_query AND is_ref").select(F.col("num").alias("a"), F.col("num").alias("b"), F.lit(1.0).alias("similarity"))
    links = judged.unionAll(judged.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionAll(equal)
    return links.join(named("is_query", "a", "query"), "a").join(named("is_ref", "b", "ref"), "b").select("query", "ref", "similarity")


def sketch_similarity(queries: DataFrame, refs: DataFrame, k: int = 5, n: int = 40, least: float = 0.0) -> DataFrame:
    """:func:`similar` of queries and references in tables of their own, with id and seq."""
    side = lambda df, asks: df.select("id", "seq", F.lit(asks).alias("is_query"), F.lit(not asks).alias("is_ref"))
    return similar(side(queries, True).unionByName(side(refs, False)), k, n, least)
