"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_text_outputs

#: Widths of the padded matrices; a longer piece is merged by a heap instead, in L log L steps.
BUCKETS = (8, 16, 32, 64, 128, 256, 512)
#: Rows of a matrix, so that one round works on a bounded block.
BLOCK_CELLS = 500_000
#: Pieces whose ids a worker remembers before it starts afresh.
CACHE_PIECES = 200_000
NO_RANK = np.iinfo(np.int32).max

OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "binary",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


class PairTable:
    """(left id, right id) -> id of the joined bytes, in an open-addressing hash table of numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        size = 1 << self.bits
        self.one = dict(zip(keys, values, strict=True))
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, NO_RANK, dtype=np.int32)
        todo_k, todo_v = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        slot = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            first = np.zeros(len(slot), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = todo_k[put], todo_v[put]
            todo_k, todo_v, slot = todo_k[~put], todo_v[~put], (slot[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, ``NO_RANK`` where the bytes joined are no token or a side is padding (negative)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NO_RANK, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.uint64) << np.uint64(32) | right[at].astype(np.uint64)
        slot = self._slot(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            at, keys, slot = at[go], keys[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Codec:
    """Encoder and decoder of one rank file, alike to ``encode_ordinary`` and ``decode_bytes`` of a tiktoken encoding."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.by_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.by_bytes)
        self.byte_ids = np.array([self.by_bytes[bytes([i])] for i in range(256)], dtype=np.int32)
        self.by_id = {rank: token for token, rank in self.by_bytes.items()}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``width`` bytes.

        Each round merges the leftmost pair of minimum rank in every row at once, closes the gap, and looks up
        only the two pairs that changed; rows without a mergeable pair leave the matrix.
        """
        n = len(pieces)
        out: list[np.ndarray] = [np.empty(0, np.int32)] * n
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        tokens = np.full((n, width + 1), -1, dtype=np.int32)
        inside = np.arange(width + 1) < sizes[:, None]
        tokens[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pairs.ranks(tokens[:, :-1], tokens[:, 1:])
        rows, cols = np.arange(n), np.arange(width + 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = tokens[i, : sizes[i]].copy()
                go = ~done
                rows, sizes, tokens, ranks, at, best = rows[go], sizes[go], tokens[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
                # the widest row left bounds the matrix
                keep = int(sizes.max())
                tokens, ranks, cols = tokens[:, : keep + 1], ranks[:, :keep], cols[: keep + 1]
            i = np.arange(len(rows))
            tokens[i, at] = best
            shift = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)
            tokens = np.take_along_axis(tokens, shift, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], ranks.shape[1] - 1), axis=1)
            sizes -= 1
            tokens[i, sizes] = -1
            ranks[i, np.minimum(sizes, ranks.shape[1] - 1)] = NO_RANK
            ranks[i, at] = self.pairs.ranks(best, tokens[i, at + 1])
            before = np.maximum(at - 1, 0)
            again = at > 0
            ranks[i[again], before[again]] = self.pairs.ranks(tokens[i[again], before[again]], best[again])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece, with a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        n = len(ids)
        first = self.pairs.ranks(ids[:-1], ids[1:])
        tok, after, prior = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first != NO_RANK)]
        heapq.heapify(heap)
        rank = dict(zip((i for _, i in heap), (r for r, _ in heap), strict=True))

        def look(i: int) -> None:
            rank.pop(i, None)
            j = after[i]
            if j < n:
                r = self.pairs.one.get(tok[i] << 32 | tok[j])
                if r is not None:
                    rank[i] = r
                    heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank.get(i) != r:
                continue
            j = after[i]
            tok[i], after[i] = r, after[j]
            rank.pop(j, None)
            if after[j] < n:
                prior[after[j]] = i
            tok[j] = -1
            look(i)
            if prior[i] >= 0:
                look(prior[i])
        return np.array([t for t in tok if t >= 0], dtype=np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not met before and append them to the store."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            whole = self.by_bytes.get(piece)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(piece) > BUCKETS[-1]:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(next(w for w in BUCKETS if len(piece) <= w), []).append(i)
        for width, members in buckets.items():
            step = max(1, BLOCK_CELLS // width)
            for k in range(0, len(members), step):
                block = members[k : k + step]
                for i, ids in zip(block, self.merge_rows([raw[i] for i in block], width), strict=True):
                    out[i] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        base = len(self.flat)
        self.starts = np.concatenate([self.starts, base + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *out]) if out else self.flat

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE_PIECES:
            self._forget()
        known = self.known
        new = list({p: None for pieces in split for p in set(pieces) if p not in known})
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._learn(new)
        result = []
        for pieces in split:
            index = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            sizes = self.sizes[index]
            ends = np.cumsum(sizes)
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[index] - ends + sizes, sizes)
            result.append(self.flat[where])
        return result

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id that is no token raises KeyError."""
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def codec(ranks: bytes, pattern: str) -> Codec:
    """Built once in a worker for the content of a rank file."""
    return Codec(ranks, pattern)


def _shipped(df: DataFrame, rank_file: str):
    """The rank file (1 MB or so), read on the driver and broadcast: executors need not have it."""
    with open(rank_file, "rb") as ranks:
        return df.sparkSession.sparkContext.broadcast(ranks.read())


def bpe(df: DataFrame, rank_file: str, pattern: str, text: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append what ``outputs`` names (see ``OUTPUTS``) for every text to the columns ``keep`` (all by default).

    Repeated rows are encoded alike and stay; an empty table stays empty.

    ``decoded`` comes from decoding the ids again. Rows are independent: no shuffle, one pass, bounded memory
    (a batch of texts and a cache of pieces). A null text counts as empty: no tokens, empty bytes. Texts of any
    length are encoded whole. A column of ``df`` that has the name of an output is replaced.
    """
    shared = _shipped(df, rank_file)

    def encoder():
        own = codec(shared.value, pattern)

        def run(texts: list[str]) -> dict:
            all_ids = own.encode_batch(texts)
            sizes = np.array([len(ids) for ids in all_ids], dtype=np.int64)
            decoded = [own.decode(ids) for ids in all_ids] if {"decoded", "decoded_sha256"} & set(outputs) else []
            made = {
                "n_tokens": lambda: sizes,
                "ids": lambda: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(all_ids))),
                "decoded": lambda: decoded,
                "ids_sha256": lambda: [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in all_ids],
                "decoded_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in decoded],
            }
            return {o: made[o]() for o in outputs}

        return run

    return with_text_outputs(df, text, {o: OUTPUTS[o] for o in outputs}, encoder, keep)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes of a column of ids; null ids give empty bytes, an unknown id fails the task."""

    shared = _shipped(df, rank_file)

    @F.pandas_udf("binary")
    def to_bytes(column: pd.Series) -> pd.Series:
        own = codec(shared.value, pattern)
        return column.map(lambda x: b"" if x is None else own.decode(np.asarray(x)))

    return df.withColumn(out, to_bytes(F.col(ids)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of what they decode to; a null text is empty.

    An empty table gives no rows, repeated rows have a row each.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",),
    )


QUERIES = {"op9_bpe": op9_bpe}
SQL: dict[str, str] = {}
