"""Substring deduplication by sliding runs of sentences.

Every run of consecutive sentences is hashed; runs meet by hash across the corpus, and the sentences that a
repeated run covers are removed everywhere but where it stands first. A long sentence counts as several: it is cut
where its words say, so that a passage inside one sentence is cut alike wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, sized, stored, table, text_key
from .decontaminate import _FOLD

#: A run is the shortest one from its first sentence that has so many sentences, and so many words.
SENTENCES = 2
WORDS = 20
#: A sentence of more words is cut, at the word of the least hash in every window of so many words, which is every fifth
#: or sixth. In a passage of 50 words the cuts of 32 at least do not depend on what stands around it.
LONG = 20
WINDOW = 10
#: A run that has more than one in so many of the repeated runs is dealt to several tasks; there are fewer such runs.
HOT_SHARE = 1000
#: Places of a hot run that a task gets, about.
SALT_ROWS = 20_000
#: Texts and bytes of texts that are split and hashed together.
SLICE_TEXTS = 128
SLICE_BYTES = 1 << 20
#: Bytes that are hashed at once, and bytes of a word beyond which it is hashed by itself.
BLOCK = 1 << 20
LONG_WORD = 1 << 16

_MARKS = ("。".encode(), "！".encode(), "？".encode())
_FAR_MARKS = re.compile(b"(?:" + b"|".join(_MARKS) + b")+")
_RUNS = "doc_id long, th long, h1 long, h2 long, k int"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2F
_BLANK, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"\t\n\v\f\r ", b".!?"))


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=3)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for 2^bits places."""

    def steps(by: int) -> np.ndarray:
        out = np.full(1 << bits, by, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return steps(_BASE), steps(pow(_BASE, -1, 1 << 64))


def _sentence_ends(raw: bytes) -> np.ndarray:
    """Where sentences end: after white space that follows ``.!?`` or holds a line break, and after full stops of other
    scripts with the white space behind them."""
    b = np.frombuffer(raw, np.uint8)
    blank = _BLANK[b]
    edge = np.diff(np.concatenate([[False], blank, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lines = np.concatenate([[0], np.cumsum(b == 10)])
    closes = (lines[ends] > lines[starts]) | (_MARK[b[np.maximum(starts - 1, 0)]] & (starts > 0))
    if not any(mark in raw for mark in _MARKS):
        return ends[closes]
    far = np.fromiter((m.end() for m in _FAR_MARKS.finditer(raw)), np.int64)
    followed = np.searchsorted(starts, far)
    behind = (followed < len(starts)) & (starts[np.minimum(followed, max(0, len(starts) - 1))] == far) if len(starts) else np.zeros(len(far), bool)
    return np.unique(np.concatenate([ends[closes], far[~behind], ends[followed[behind]]]))


def _word_hashes(folded: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, by differences of prefix sums over blocks of bytes."""
    import xxhash

    up, down = _powers(21)
    values = _mixed(np.arange(256, dtype=np.uint64))
    out, lo = np.empty(len(at), np.uint64), 0
    long = ends - at > LONG_WORD
    while lo < len(at):
        base = int(at[lo])
        hi = int(np.searchsorted(at, base + BLOCK))
        stop = min(int(ends[hi - 1]), base + BLOCK + LONG_WORD)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[folded[base:stop]] * up[: stop - base], dtype=np.uint64)])
        a, b = at[lo:hi] - base, np.minimum(ends[lo:hi], stop) - base
        out[lo:hi] = _mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(folded[at[i] : ends[i]].tobytes())
    return out


@dataclass(frozen=True)
class Units:
    """Sentences with words of several texts: where each starts (byte of its text, number of its first word), and its text."""

    text: np.ndarray
    start: np.ndarray
    word: np.ndarray
    hashes: np.ndarray

    def runs(self, least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end unit of every run that ends within its text."""
        n = len(self.text)
        k = np.arange(n)
        bounds = np.append(self.word, len(self.hashes))
        e = np.maximum(k + least, np.searchsorted(bounds, bounds[:-1] + words))
        fits = e <= n
        k, e = k[fits], e[fits]
        same = self.text[k] == self.text[e - 1]
        return k[same], e[same]

    def run_hashes(self, k: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the words of units k to e: differences of prefix sums, moved to one place and mixed."""
        up, down = _powers(max(16, int(len(self.hashes)).bit_length()))
        bounds = np.append(self.word, len(self.hashes))
        a, b = bounds[k], bounds[e]
        out = []
        for salt in (0, 0x2545F4914F6CDD1D):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.hashes, salt) * up[: len(self.hashes)], dtype=np.uint64)])
            out.append(_mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64))
        return out[0], out[1]


def units(texts: list[bytes], long: int = LONG, window: int = WINDOW) -> Units:
    """Sentences and parts of long sentences; what has no word belongs to the sentence before it."""
    joined = b"\n".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    folded = joined.translate(_FOLD)
    for mark in _MARKS:  # bytes of other scripts are parts of words, but for these
        folded = folded.replace(mark, b"   ")
    letters = np.frombuffer(folded, np.uint8)
    edge = np.diff(np.concatenate([[False], letters != 32, [False]]).astype(np.int8))
    at = np.flatnonzero(edge == 1)
    h = _word_hashes(letters, at, np.flatnonzero(edge == -1))
    # white space after a line break may reach into the next text
    ends = np.unique(np.concatenate([[0], _sentence_ends(joined), begins]))
    sentence = np.searchsorted(ends, at, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]])) if len(at) else np.empty(0, np.int64)
    starts, places = ends[sentence[first]], first
    count = np.diff(np.append(first, len(at)))
    if len(count) and count.max() > long:
        least = np.lib.stride_tricks.sliding_window_view(_mixed(h) >> np.uint64(32), window).argmin(axis=1) + np.arange(len(h) - window + 1)
        inside = np.repeat(count > long, count)[: len(least)] & (sentence[: len(least)] == sentence[window - 1 :])
        cuts = np.setdiff1d(np.unique(least[inside]), first)
        order = np.argsort(np.concatenate([places, cuts]), kind="stable")
        starts, places = np.concatenate([starts, at[cuts]])[order], np.concatenate([places, cuts])[order]
    text = np.searchsorted(begins, at[places], side="right") - 1
    return Units(text, starts - begins[text], places, h)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo >= SLICE_TEXTS or size + len(t) > SLICE_BYTES):
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def hashed_runs(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, th, h1, h2, k) of every run of every text: key of the row, 128-bit hash, first sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = _raw(part.column(2))
                for lo, hi in _slices(texts):
                    found = units(texts[lo:hi])
                    k, e = found.runs(least, words)
                    h1, h2 = found.run_hashes(k, e)
                    row = found.text[k]
                    begins = np.searchsorted(found.text, np.arange(hi - lo))
                    own = part.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(h1), pa.array(h2), pa.array((k - begins[row]).astype(np.int32))],
                        names=["doc_id", "th", "h1", "h2", "k"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("th"), "text").mapInArrow(run, _RUNS)


def _dealt(rows: DataFrame, hot: DataFrame, keys: list[str], copies: bool) -> DataFrame:
    """``rows`` with a ``salt``: one of as many as the run's places need, or a row for each of them (``copies``).

    ``hot`` is broadcast: fewer than ``HOT_SHARE`` runs can have so large a share.
    """
    marked = rows.join(F.broadcast(hot), "h1", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)) if copies else F.pmod(F.xxhash64(*keys), F.col("salts")).cast("int")
    return marked.withColumn("salt", salt).drop("salts")


def repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, th), ``starts`` (first sentences of runs that stand elsewhere before) and ``repeats_of`` (where they do).

    Two passes: the first counts one 64-bit hash of every run with partial sums, the second moves the rows of runs
    whose hash came more than once, and finds the first place by doc_id, text key and sentence. The places of a run
    that a large share of the corpus holds are dealt to several tasks in both joins.
    """
    often = stored(hashed_runs(docs, least, words).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = often.where(F.col("n") * HOT_SHARE > total).select("h1", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")).where("salts > 1")
    place = ["doc_id", "th", "k"]
    again = stored(_dealt(hashed_runs(docs, least, words), hot, place, False).join(_dealt(often.select("h1"), hot, [], True), ["h1", "salt"]))
    first = again.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = again.join(_dealt(stored(first), hot, [], True), ["h1", "h2", "salt"]).where(~F.struct(*place).eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("k")).alias("starts"), F.sort_array(F.collect_set("first.doc_id")).alias("repeats_of"))


def covered(found: Units, starts: list, least: int, words: int) -> np.ndarray:
    """Which units of one text the runs from ``starts`` cover."""
    k, e = found.runs(least, words)
    change = np.zeros(len(found.text) + 1, np.int64)
    taken = np.isin(k, np.asarray(starts, np.int64))
    np.add.at(change, k[taken], 1)
    np.add.at(change, e[taken], -1)
    return np.cumsum(change)[:-1] > 0


def deduplicate(docs: DataFrame, least: int = SENTENCES, words: int = WORDS, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text and others) without repeated sentences, and ``n_removed`` (sentences) and ``repeats_of``.

    Every row stays; a text that goes whole is empty, a null text stays null. Rows that share doc_id and text are one
    document. A null doc_id sorts first, so such a row keeps its runs. Repeats within one text count as well, and texts
    of any length are read whole; an empty table stays empty. The parts of a long sentence count as sentences. Columns
    of ``docs`` with an output's name, in any case, are replaced; others may have any name but those and stay. Only
    texts that lose something go to Python again.
    """
    keep = others(docs.columns, ("n_removed", "repeats_of"))
    held = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("doc_id"), quoted(text).alias("text"), text_key(quoted(text)).alias("th"))
    found = repeats(docs.select("doc_id", quoted(text).alias("text")), least, words)
    found = sized(found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "starts", "repeats_of"), F.size("starts") + F.size("repeats_of"))
    joined = held.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")

    @F.pandas_udf("struct<text:string,n_removed:long>")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, starts, strict=True):
            if s is None:
                rows.append((None, 0))
                continue
            raw = t.encode("utf-8", "surrogatepass")
            own = units([raw])
            away = covered(own, s, least, words)
            bounds = [0, *own.start[1:].tolist(), len(raw)]
            left = b"".join(raw[a:b] for a, b, x in zip(bounds[:-1], bounds[1:], away, strict=True) if not x)
            rows.append((left.decode("utf-8", "surrogatepass"), int(away.sum())))
        return pd.DataFrame(rows, columns=["text", "n_removed"])

    lost = F.col("starts").isNotNull()
    out = joined.withColumn("cut", cut(F.when(lost, F.col("text")), "starts"))
    return out.select(
        *((F.when(lost, F.col("cut.text")).otherwise(F.col("text")) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(keep)),
        "cut.n_removed", F.coalesce("repeats_of", F.array().cast("array<bigint>")).alias("repeats_of"),
    )


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without passages that stand elsewhere before, and how many sentences went.

    Null texts stay null and have no sentences; an empty table gives no rows; repeated rows get the same text.
    """
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_spans": op6_spans}
SQL: dict[str, str] = {}
