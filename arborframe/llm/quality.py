"""Quality: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad from its own features and those of its neighbours; the marginals of the
forward-backward pass, weighted by line length, give the quality of the document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, table, with_text_outputs
from .fit import minimise
from .sample import labelled, remainder

#: Largest sample that a model is fitted on: rows of class 0 and of class 1.
MAX_ROWS = (2500, 3500)
#: The fit reads whole texts, as chains of so many lines at most, and of those chains at most so many, chosen by a hash.
CHAIN_LINES = 200
MAX_CHAINS = 12_000
BINS = 10
PENALTY = 1e-4
FEATURES = ("length", "upper", "symbols", "digits", "word_length", "distinct", "stutter", "odd_symbols", "repeated", "closed", "longest_word")
#: Offsets of the lines whose features a line's label sees.
NEIGHBOURS = (-1, 0, 1)
_SPACE, _UPPER, _LETTER, _DIGIT, _PLAIN, _SYMBOL, _BREAK = range(7)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every code point up to U+FFFF; what lies above counts as a symbol."""
    kinds = np.full(65536, _SYMBOL, dtype=np.uint8)
    for code in range(65535):
        c = unicodedata.category(chr(code))
        kinds[code] = _SPACE if chr(code).isspace() else _UPPER if c in ("Lu", "Lt") else _LETTER if c[0] in "LM" else _DIGIT if c[0] == "N" else _SYMBOL
    for mark in ".,;:'\"-()!?":
        kinds[ord(mark)] = _PLAIN
    kinds[10] = _BREAK
    return kinds


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x features) and lengths of the lines that hold more than white space."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.empty((0, len(FEATURES)), np.float32), np.empty(0)
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _kinds()[np.minimum(codes, 65535)]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    share = {k: np.add.reduceat((kinds == k).astype(np.int64), starts) for k in (_SPACE, _UPPER, _LETTER, _DIGIT, _PLAIN, _SYMBOL)}
    ink = np.maximum(1, size - share[_SPACE])
    letters = np.maximum(1, share[_UPPER] + share[_LETTER])
    n = np.empty((4, len(lines)))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n[0, i], n[1, i] = len(words), len(set(words))
        n[2, i] = sum(map(str.__eq__, words, words[1:]))
        n[3, i] = max(map(len, words))
    repeated = np.array([x in seen or seen.add(x) is not None for x in lines], dtype=np.float32)
    closed = np.array([x.rstrip()[-1] in ".!?" for x in lines], dtype=np.float32)
    out = np.stack([
        np.log1p(size), share[_UPPER] / letters, (share[_PLAIN] + share[_SYMBOL]) / ink, share[_DIGIT] / ink,
        ink / n[0], n[1] / n[0], n[2] / n[0], share[_SYMBOL] / ink, repeated, closed, np.log1p(n[3]),
    ], axis=1)
    return out.astype(np.float32), size.astype(np.float64)


def _chains(sizes: list[int], cells: int = 200_000) -> Iterator[list[int]]:
    """Documents by number of lines, in blocks whose padded matrices stay small."""
    order = sorted((i for i, n in enumerate(sizes) if n), key=sizes.__getitem__)
    block: list[int] = []
    for i in order:
        if block and (len(block) + 1) * sizes[i] > cells or block and sizes[i] > 2 * sizes[block[0]] + 8:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def forward_backward(odds: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of label 1, expected transition counts, and log partition sums of padded chains.

    ``odds``: documents x lines, the potential of label 1 (that of label 0 is 0); ``links``: 2 x 2 potentials.
    """
    docs, width = odds.shape
    alpha, beta = np.zeros((docs, width, 2)), np.zeros((docs, width, 2))
    alpha[:, 0, 1] = odds[:, 0]
    for t in range(1, width):
        into = alpha[:, t - 1, :, None] + links
        alpha[:, t] = np.logaddexp(into[:, 0], into[:, 1])
        alpha[:, t, 1] += odds[:, t]
    for t in range(width - 2, -1, -1):
        ahead = beta[:, t + 1].copy()
        ahead[:, 1] += odds[:, t + 1]
        out = links + ahead[:, None, :]
        beta[:, t] = np.where((t + 1 < sizes)[:, None], np.logaddexp(out[:, :, 0], out[:, :, 1]), 0)
    last = alpha[np.arange(docs), sizes - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    inside = np.arange(width) < sizes[:, None]
    marginal = np.where(inside, np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]), 0)
    pairs = np.zeros((2, 2))
    if width > 1:
        for a in (0, 1):
            for b in (0, 1):
                step = alpha[:, :-1, a] + links[a, b] + beta[:, 1:, b] + (odds[:, 1:] if b else 0) - total[:, None]
                pairs[a, b] = np.exp(step[inside[:, 1:]]).sum()
    return np.minimum(marginal, 1), pairs, total


@dataclass(frozen=True)
class Model:
    """Bin edges (features x bins - 1), weights (neighbours x features x bins), an offset, link potentials, prior."""

    edges: np.ndarray
    weights: np.ndarray
    offset: float
    links: np.ndarray
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Index of every line's weights, lines x (neighbours * features); -1 where there is no neighbour."""
        return _cells(x, self.edges)

    def line_odds(self, x: np.ndarray) -> np.ndarray:
        flat = np.append(self.weights.ravel(), 0.0)
        return flat[self.cells(x)].sum(axis=1) + self.offset

    def score_batch(self, texts: list[str]) -> list[tuple[float, np.ndarray]]:
        """Quality of every text and the marginals of its lines; a text without lines gets the prior."""
        seen = [features(t) for t in texts]
        out: list[tuple[float, np.ndarray]] = [(self.prior, np.empty(0))] * len(texts)
        sizes = [len(x) for x, _ in seen]
        for block in _chains(sizes):
            n = np.array([sizes[i] for i in block])
            odds = np.zeros((len(block), n.max()))
            inside = np.arange(n.max()) < n[:, None]
            odds[inside] = np.concatenate([self.line_odds(seen[i][0]) for i in block])
            marginal, _, _ = forward_backward(odds, n, self.links)
            for k, i in enumerate(block):
                m = marginal[k, : n[k]]
                out[i] = (float(np.clip(m @ seen[i][1] / seen[i][1].sum(), 0, 1)), m)
        return out


def _cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n, f = x.shape
    bins = np.empty((n, f), dtype=np.int64)
    for j in range(f):
        bins[:, j] = np.searchsorted(edges[j], x[:, j], side="right")
    bins += np.arange(f) * BINS
    out = np.full((n, len(NEIGHBOURS) * f), -1, dtype=np.int64)
    for k, offset in enumerate(NEIGHBOURS):
        lo, hi = max(0, -offset), min(n, n - offset)
        if lo < hi:
            out[lo:hi, k * f : (k + 1) * f] = bins[lo + offset : hi + offset] + k * f * BINS
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, max_rows: tuple[int, int] = MAX_ROWS, penalty: float = PENALTY, max_chains: int = MAX_CHAINS) -> Model:
    """Fit on at most ``max_rows`` documents of the classes, of those that ``learn`` admits, and ``max_chains`` chains.

    Only documents have labels, so those of lines are latent: first every line has its document's and is judged by
    itself, then lines that look otherwise take the other label, as long as most of a document's length keeps its own,
    and the chain is fitted to those sequences, twice. The weights maximise the penalised conditional likelihood of the
    label sequences. Only line features reach the driver. Where the documents do not have labels of both classes, or not
    both have lines, every text scores the share of class 1, or 0.5.
    """
    texts, (n0, n1) = labelled(docs, labels, label, learn, max_rows)
    f, k = len(FEATURES), len(NEIGHBOURS)
    prior = n1 / (n0 + n1) if n0 + n1 else 0.5
    odds = float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / np.clip(1 - prior, 1e-6, 1)))
    flat = Model(np.zeros((f, BINS - 1)), np.zeros((k, f, BINS)), odds, np.zeros((2, 2)), prior)
    if not n0 or not n1:
        return flat

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(y, x[at : at + CHAIN_LINES].tobytes()) for y, t in zip(pdf["y"], pdf["text"], strict=True) for x in [features(t or "")[0]] for at in range(0, len(x), CHAIN_LINES)]
            yield pd.DataFrame(found, columns=["y", "x"])

    chains = texts.mapInPandas(extract, "y int, x binary").orderBy(F.xxhash64("x"), "x", "y").limit(max_chains)
    rows = [(r["y"], np.frombuffer(r["x"], np.float32).reshape(-1, f)) for r in chains.toLocalIterator()]
    if len({y for y, _ in rows}) < 2:
        return flat
    rows.sort(key=lambda r: (len(r[1]), r[0], r[1].tobytes()))
    every = np.concatenate([x for _, x in rows])
    edges = np.quantile(every, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    blocks = []
    for block in _chains([len(x) for _, x in rows]):
        n = np.array([len(rows[i][1]) for i in block])
        cells = np.concatenate([_cells(rows[i][1], edges) for i in block])
        inside = np.arange(n.max()) < n[:, None]
        length = np.zeros(inside.shape)
        length[inside] = np.expm1(np.concatenate([rows[i][1][:, 0] for i in block]))
        y = np.array([rows[i][0] for i in block], dtype=np.float64)
        blocks.append([n, inside, cells, length, y, np.where(inside, y[:, None], 0)])
    size, count = k * f * BINS, len(rows)

    def odds_of(theta: np.ndarray, inside: np.ndarray, cells: np.ndarray) -> np.ndarray:
        odds = np.zeros(inside.shape)
        odds[inside] = np.append(theta[:size], 0.0)[cells].sum(axis=1) + theta[size]
        return odds

    def loss(theta: np.ndarray, chained: bool = True) -> tuple[float, np.ndarray]:
        links = theta[size + 1 :].reshape(2, 2) * chained
        value, grad = penalty / 2 * float(theta @ theta), penalty * theta
        for n, inside, cells, _, _, truth in blocks:
            odds = odds_of(theta, inside, cells)
            marginal, pairs, total = forward_backward(odds, n, links)
            after, before = (truth[:, 1:], truth[:, :-1])
            gold = np.array([[((a == before) & (b == after))[inside[:, 1:]].sum() for b in (0, 1)] for a in (0, 1)], dtype=np.float64)
            value += (total.sum() - (odds * truth).sum() - (links * gold).sum()) / count
            error = ((marginal - truth) / count)[inside]
            flat = np.bincount(np.where(cells < 0, size, cells).ravel(), weights=np.repeat(error, cells.shape[1]), minlength=size + 1)
            grad += np.concatenate([flat[:size], [error.sum()], ((pairs - gold) / count * chained).ravel()])
        return value, grad

    theta = minimise(lambda t: loss(t, False), np.zeros(size + 5), rounds=60)
    for _ in range(2):
        for block in blocks:
            block[5] = relabelled(odds_of(theta, block[1], block[2]), *block[1:2], *block[3:5])
        theta = minimise(loss, theta, rounds=80)
    return Model(edges, theta[:size].reshape(k, f, BINS), float(theta[size]), theta[size + 1 :].reshape(2, 2), prior)


def relabelled(odds: np.ndarray, inside: np.ndarray, length: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of lines: their document's, but for the lines that speak most clearly for the other one, together less
    than half of the document's length."""
    against = np.where(inside, np.where(y[:, None] == 1, -odds, odds), -np.inf)
    order = np.argsort(-against, axis=1, kind="stable")
    used = np.cumsum(np.take_along_axis(length, order, 1), axis=1)
    turned = (np.take_along_axis(against, order, 1) > 0) & (used < length.sum(axis=1, keepdims=True) / 2)
    flips = np.zeros(inside.shape, dtype=bool)
    np.put_along_axis(flips, order, turned, axis=1)
    return np.where(inside, np.where(flips, 1 - y[:, None], y[:, None]), 0)


def classify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None, lines: bool = False) -> DataFrame:
    """Append ``score`` (0 to 1), ``predicted`` (1 from 0.5) and, with ``lines``, the ``line_good`` marginals.

    No shuffle; the model (a few kB) is broadcast. Lines of white space count for nothing; a null text, an empty
    one and one of such lines score the share of class 1 in the labels. Texts of any length are labelled whole, in slices
    of bounded size; repeated rows score alike and all stay; an empty table stays empty. Columns with an output's name,
    in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled_texts(texts: list[str]) -> dict:
        found = shared.value.score_batch(texts)
        return {"score": [s for s, _ in found], "line_good": [m for _, m in found]}

    outputs = {"score": "double", "line_good": "array<double>"} if lines else {"score": "double"}
    kept = others(list(docs.columns if keep is None else keep), ("score", "predicted", "line_good"))
    return with_text_outputs(docs, text, outputs, lambda: labelled_texts, kept).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from the labels that are not held out.

    Null and empty texts score the share of good labels; a null doc_id has a null held_out; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 3) != 1)
    scored = classify(docs, model, keep=("doc_id",))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
