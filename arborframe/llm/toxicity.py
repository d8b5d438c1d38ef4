"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

After Wang and Manning, "Baselines and Bigrams: Simple, Good Sentiment and Topic Classification" (2012), with a
logistic loss and n-grams hashed to buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, table, with_text_outputs
from .fit import minimise
from .sample import labelled, remainder

BITS = 18
ORDERS = (3, 4, 5)
#: Largest sample that a model is fitted on: rows of class 0 and of class 1.
MAX_ROWS = (3500, 1500)
#: Characters hashed at once, so that a long text takes bounded memory.
CHUNK = 1 << 20
PENALTY = 3e-6
SCALE = 10.0
#: A bucket that fewer rows of the sample hold has no weight.
LEAST_ROWS = 3
#: Rows of the sample that the fit reads at once.
#: Partitions that the sample of the fit comes to the driver in.
SAMPLE_PARTITIONS = 8
BLOCK_ROWS = 256

_seen = np.zeros(1 << BITS, dtype=bool)


def buckets(text: str | None) -> np.ndarray:
    """Buckets of the distinct n-grams of the whole text, lower-cased, white space as blanks; sorted."""
    padded = f" {(text or '').lower()} "
    for start in range(0, len(padded), CHUNK):
        part = padded[start : start + CHUNK + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        codes[(codes >= 9) & (codes <= 13)] = 32
        h = codes
        for n in range(2, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in ORDERS:
                _seen[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).view(np.int64)] = True
    found = np.flatnonzero(_seen)
    _seen[found] = False
    return found.astype(np.int32)


@dataclass(frozen=True)
class Model:
    """One weight a bucket (log-count ratio times coefficient) and an intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[buckets(text)].sum(dtype=np.float64)) + self.intercept
        return 1 / (1 + np.exp(-z)) if z > -500 else 0.0


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: tuple[int, int] = MAX_ROWS, penalty: float = PENALTY) -> Model:
    """Fit on at most ``max_rows`` documents of the classes, of those that ``learn`` admits.

    The executors turn texts into buckets; the driver gets at most ``sum(max_rows)`` bucket lists. Where the documents do
    not have labels of both classes, every text scores their share of class 1, or 0.5 where there is none.
    """
    texts, (n0, n1) = labelled(docs, labels, label, learn, max_rows)
    size = 1 << BITS
    if not n0 or not n1:
        share = np.clip(n1 / (n0 + n1), 1e-6, 1 - 1e-6) if n0 + n1 else 0.5
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "b": [buckets(t).tobytes() for t in pdf["text"]]})

    # the sample as sparse rows in one buffer, which goes back to the system at the end: the buckets of all rows and
    # how many each has
    ys, sizes, packed = [], [], bytearray()
    # few partitions: the driver asks for one after the other
    for r in texts.coalesce(SAMPLE_PARTITIONS).mapInPandas(features, "y int, b binary").toLocalIterator():
        ys.append(r["y"])
        sizes.append(len(r["b"]) // 4)
        packed += r["b"]
    y, sizes, flat = np.array(ys, dtype=np.float64), np.array(sizes), np.frombuffer(packed, dtype=np.int32)
    ends = np.cumsum(sizes)
    counts = np.zeros((2, size))
    for k, n, end in zip(ys, sizes.tolist(), ends.tolist(), strict=True):
        counts[k, flat[end - n : end]] += 1
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[p + q - 2 < LEAST_ROWS] = 0
    scale = (ratio / SCALE).astype(np.float32)
    used = (ratio != 0)[flat]
    sizes = np.array([np.count_nonzero(used[end - n : end]) for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)], np.int64)
    flat = flat[used]
    del packed, used
    # in blocks: the buckets, where rows start, and their sizes; a row without buckets has one of no weight
    blocks, at = [], 0
    for lo in range(0, len(sizes), BLOCK_ROWS):
        own = sizes[lo : lo + BLOCK_ROWS]
        wide = np.maximum(own, 1)
        starts, part = np.cumsum(wide) - wide, np.full(wide.sum(), size, np.int32)
        part[np.repeat(starts - np.cumsum(own) + own, own) + np.arange(own.sum())] = flat[at : at + own.sum()]
        blocks.append((part, starts, wide))
        at += own.sum()
    del flat

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = theta[:-1], theta[-1]
        scaled = np.append((w * scale).astype(np.float32), np.float32(0))
        value, grad, shift, at = penalty / 2 * float(w @ w), np.zeros(size + 1), 0.0, 0
        for flat, starts, sizes in blocks:
            own = y[at : at + len(sizes)]
            z = np.add.reduceat(scaled[flat], starts, dtype=np.float64) + b
            value += float(np.sum(np.logaddexp(0, z) - own * z)) / len(y)
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - own) / len(y)
            grad += np.bincount(flat, weights=np.repeat(error, sizes), minlength=size + 1)
            shift, at = shift + float(error.sum()), at + len(sizes)
        return value, np.append(grad[:size] * scale + penalty * w, shift)

    theta = minimise(loss, np.append(np.zeros(size), np.log(y.mean() / (1 - y.mean()))), rounds=40)
    # the sample's classes are not as frequent as the corpus's
    prior = np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))
    model = Model((theta[:-1] * scale).astype(np.float32), float(theta[-1] + prior))
    if not (np.isfinite(model.weights).all() and np.isfinite(model.intercept)):
        raise ArithmeticError("the fit did not stay finite")
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append ``score`` (0 to 1) and ``predicted`` (1 from 0.5) to every row, over its whole text.

    No shuffle; the model (1 MB, whatever the corpus) is broadcast. Null and empty texts have no n-grams but the
    padding's and score the intercept. Very long texts are hashed in parts of bounded size; repeated rows score alike and
    all stay; an empty table stays empty. Columns with an output's name, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = with_text_outputs(
        docs, text, {"score": "double"}, lambda: lambda texts: {"score": [shared.value.score(t) for t in texts]}, others(list(docs.columns if keep is None else keep), ("predicted",))
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from the labels that are not held out.

    Null and empty texts score the intercept; a null doc_id has a null held_out; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0)
    scored = classify(docs, model, keep=("doc_id",))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
