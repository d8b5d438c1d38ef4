"""Alignments in column blocks: the sequences of an Arrow batch as one matrix of bytes, cut and counted by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a batch that are worked on at once, and cells of a task's dense table of counts.
SLICE_LETTERS = 1 << 22
DENSE_CELLS = 1 << 24


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row begins and ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets.astype(np.int64) - offsets[0]


def _strings(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int64) * width), pa.py_buffer(np.ascontiguousarray(matrix))) if n else pa.array([], pa.large_string())


def chosen_columns(column: pa.Array, at: np.ndarray, width: int) -> pa.Array:
    """Rows of ``width`` letters cut to the columns ``at``; nulls stay."""
    full = column.drop_null() if column.null_count else column
    parts = []
    for lo in range(0, len(full), max(1, SLICE_LETTERS // max(1, width))):
        part = full.slice(lo, max(1, SLICE_LETTERS // max(1, width)))
        data, ends = _bytes(part)
        if len(data) == len(part) * width:  # a byte a letter
            parts.append(_strings(data.reshape(len(part), width)[:, at]))
        else:
            codes = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(part), width)[:, at]
            text = np.ascontiguousarray(codes).tobytes().decode("utf-32-le")
            parts.append(pa.array([text[k * len(at) : (k + 1) * len(at)] for k in range(len(part))], pa.large_string()))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    if column.null_count:
        place = np.cumsum(column.is_valid().to_numpy(zero_copy_only=False)) - 1
        out = out.take(pa.array(np.where(column.is_valid().to_numpy(zero_copy_only=False), place, 0), mask=column.is_null().to_numpy(zero_copy_only=False)))
    return out.cast(pa.string())


def cut(seq: Column, keep: str) -> Column:
    """A sequence as long as ``keep``, cut to the columns where that has a 1."""
    at, width = np.flatnonzero(np.frombuffer(keep.encode(), np.uint8) == ord("1")), len(keep)

    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return chosen_columns(s, at, width)

    return run(seq)


def _sparse(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = np.arange(len(codes), dtype=np.int64) - np.repeat(ends[:-1], np.diff(ends))
    keys, n = np.unique(col << 21 | codes.astype(np.int64), return_counts=True)
    return keys >> 21, keys & (1 << 21) - 1, n


def letter_counts(msa: DataFrame) -> DataFrame:
    """(col, aa, n): how often every letter stands in every column of (seq), columns from 0.

    Each task adds up its own rows in a table of columns by bytes and hands out what is in it once, so what is shuffled
    is a few numbers a column, whatever the rows. Rows may differ in length; null and empty ones have no columns. Letters
    of several bytes, and what lies beyond the table, are counted slice by slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((0, 256), np.int64)
        give = lambda col, code, n: pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array([chr(c) for c in code.tolist()], pa.string()), pa.array(n, pa.int64())], ["col", "aa", "n"])
        for batch in batches:
            column = batch.column(0).drop_null()
            sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            lo, total = 0, np.concatenate([[0], np.cumsum(sizes)])
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SLICE_LETTERS, side="right")) - 1)
                part = column.slice(lo, hi - lo)
                data, ends = _bytes(part)
                widest = int(np.diff(ends).max(initial=0))
                if len(data) and data.max() < 128 and widest * 256 <= DENSE_CELLS:
                    if widest > len(dense):
                        dense = np.concatenate([dense, np.zeros((widest - len(dense), 256), np.int64)])
                    col = np.arange(len(data), dtype=np.int64) - np.repeat(ends[:-1], np.diff(ends))
                    dense[:widest] += np.bincount(col * 256 + data, minlength=widest * 256).reshape(-1, 256)
                elif len(data):
                    texts = part.to_pylist()
                    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                    yield give(*_sparse(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), ends))
                lo = hi
        for lo in range(0, len(dense), 1 << 16):
            col, code = np.nonzero(dense[lo : lo + (1 << 16)])
            if len(col):
                yield give(col + lo, code, dense[lo : lo + (1 << 16)][col, code])

    return msa.select("seq").mapInArrow(run, "col int, aa string, n long").groupBy("col", "aa").agg(F.sum("n").alias("n"))
