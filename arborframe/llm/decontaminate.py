"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items."""

from __future__ import annotations

import hashlib
import re
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, quoted, stored, table, with_text_outputs

WINDOW = 10
OUTPUTS = ("n_words", "n_hit", "hit_spans", "items")
SPANS = "array<struct<begin:int,end:int>>"
WORDS = "array<struct<a:int,b:int>>"
#: Characters of benchmark text that one automaton may be built from; beyond it the items are dealt to several passes.
AUTOMATON_CHARS = 4_000_000

#: A byte of a word stays (A-Z in lower case), any other becomes a blank; bytes from 0x80 up belong to words.
_FOLD = bytes((b | 0x20) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANKS = re.compile(rb" +")


def fold(text: str | None) -> str:
    """Words joined by single blanks, with a blank at both ends; one character for each UTF-8 byte. No words: ''."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(folded: str, n: int = WINDOW) -> list[str]:
    words = folded.split(" ")[1:-1]
    return [f" {' '.join(words[i : i + n])} " for i in range(max(1, len(words) - n + 1))] if words else []


class Scanner:
    """The automaton of a list of (item id, text), with offsets of what it finds mapped to the original text."""

    def __init__(self, items: list[tuple], n: int = WINDOW):
        import ahocorasick

        owners: dict[str, set] = {}
        for item, text in items:
            if item is not None:
                for w in windows(fold(text), n):
                    owners.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.automaton.add_word(w, (len(w), tuple(ids)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged hit ranges as (first word, end word), and the items found."""
        folded = fold(text)
        n_words = max(0, folded.count(" ") - 1)
        spans: list[list[int]] = []
        items: set = set()
        if n_words and not self.empty:
            word, seen = 0, 0
            for end, (size, ids) in self.automaton.iter(folded):
                items.update(ids)
                # the match ends with the blank after its last word; blanks before it count the words
                word += folded.count(" ", seen, end)
                seen = end
                begin = word - folded.count(" ", end - size + 1, end)
                while spans and begin <= spans[-1][1]:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, word])
        return n_words, [(a, b) for a, b in spans], items

    @staticmethod
    def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Character offsets in the original text of ranges of words."""
        if not spans:
            return []
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))]
        return [(at[a][0], at[b - 1][1]) for a, b in spans]


_LOWER = {i: i + 32 for i in range(65, 91)}
_SCANNERS: dict[str, Scanner] = {}


def _scanner(shared, n: int) -> Scanner:
    """Built once in a worker for each broadcast."""
    key = f"{shared.value[0]}:{n}"
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(shared.value[1], n)
    return _SCANNERS[key]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, keep: tuple[str, ...] | None = None, max_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Append ``n_words``, ``hit_spans`` (character ranges of the original), ``n_hit`` (words) and ``items`` (found ids).

    Documents are scanned whole, once, without a shuffle. The items go to every worker, so their size is measured
    first: when their text exceeds ``max_chars`` they are split by a hash into groups below it, each group scans
    in a pass of its own whose findings are written out, and the findings of a document are merged at the end.
    A null or wordless text has no words and no hits; an item without words or without an id has no windows;
    repeated items and windows count once; an empty benchmark hits nothing. Columns of ``docs`` named like an
    output are replaced.
    """
    held = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL").distinct()
    chars = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    groups = max(1, -(-chars // max_chars))
    found = f"array<{items.schema[item_id].dataType.simpleString()}>"
    kept = others(list(docs.columns if keep is None else keep), OUTPUTS)
    if groups == 1:
        return _scan(docs, held, text, n, {"n_words": "long", "n_hit": "long", "hit_spans": SPANS, "items": found}, kept)
    # one pass an automaton, each written out before the next starts, so that no worker holds two
    out = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(kept)), quoted(text).alias("t"))
    for g in range(groups):
        part = held.where(F.pmod(F.xxhash64("id", "t"), F.lit(groups)) == g)
        out = stored(_scan(out, part, "t", n, {f"n{g}": "long", f"w{g}": WORDS, f"i{g}": found}, None))
    every = lambda x: F.array(*(F.col(f"{x}{g}") for g in range(groups)))

    @F.pandas_udf(f"struct<n_hit:long,hit_spans:{SPANS}>")
    def whole(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        joined = [_merged([(x["a"], x["b"]) for x in each]) for each in spans]
        places = [Scanner.offsets(t or "", x) for t, x in zip(texts, joined, strict=True)]
        return pd.DataFrame({"n_hit": [sum(b - a for a, b in x) for x in joined], "hit_spans": [[{"begin": a, "end": b} for a, b in x] for x in places]})

    out = out.withColumn("x", whole("t", F.flatten(every("w")))).withColumn("items", F.sort_array(F.array_distinct(F.flatten(every("i")))))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("n0").alias("n_words"), "x.n_hit", "x.hit_spans", "items")


def _scan(docs: DataFrame, items: DataFrame, text: str, n: int, outputs: dict[str, str], keep: list[str] | None) -> DataFrame:
    """Append, in the order of ``outputs``: number of words, what of the hits it names by type, and items found."""
    part = [(r["id"], r["t"]) for r in items.toLocalIterator()]
    shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, part))

    def scanner():
        own = _scanner(shared, n)

        def run(texts: list[str]) -> dict:
            found = [own.scan(t) for t in texts]
            made = {
                "long": lambda k: [x[0] if k == 0 else sum(b - a for a, b in x[1]) for x in found],
                SPANS: lambda k: [[{"begin": a, "end": b} for a, b in own.offsets(t, x[1])] for t, x in zip(texts, found, strict=True)],
                WORDS: lambda k: [[{"a": a, "b": b} for a, b in x[1]] for x in found],
            }
            return {o: made[t](k) if t in made else [sorted(x[2]) for x in found] for k, (o, t) in enumerate(outputs.items())}

        return run

    return with_text_outputs(docs, text, outputs, scanner, keep)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and found items of every document; null texts have no words, an empty table gives no rows."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op10_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, s, win.n AS n FROM runs JOIN win ON runs.win = win.win AND runs.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
