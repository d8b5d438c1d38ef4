"""Similarity of all documents: every document asks, and what is no link is not listed."""

from __future__ import annotations

import random

from test_sketch import moved

from arborframe.operators import similarity as S
from arborframe.plans import tables


def shares(sets):
    return {(q, r): len(sets[q] & sets[r]) / len(sets[q] | sets[r]) for q in sets for r in sets if q != r}


def test_every_document_asks(spark, tmp_path, monkeypatch):
    """Near copies, equal texts and texts that are short, empty or missing, in cells of one and of two blocks."""
    monkeypatch.setattr(S, "SHINGLES", 2000)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh é漢") for _ in range(300)) for _ in range(4)]
    cut = lambda t, n: "".join(c if rng.random() > n / len(t) else "#" for c in t)
    rows = [(i, cut(base[i % 4], i // 8)) for i in range(1, 80)] + [(81, ""), (82, ""), (83, "short"), (84, "short"), (85, None), (86, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {p: s for p, s in shares({i: {t[j : j + 8] for j in range(max(1, len(t) - 7))} for i, t in rows if t is not None}).items() if s >= 0.5}
    got = tables.minhash_similarity(spark, str(tmp_path)).collect()
    assert {(r["query"], r["ref"]): r["similarity"] for r in got} == want and len(got) == len(want)
    assert any(q % 20 for q, _ in want) and any(0.5 <= s < 0.7 for s in want.values())


def test_texts_that_share_a_passage_are_not_listed(spark):
    """Most pairs meet in some band and none is a link: what moves is a few rows for each band of a text, not a row for each pair."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(120)
    rows = [(i, shared + word(380)) for i in range(400)]

    docs = spark.createDataFrame(rows, "id long, seq string")
    found = lambda: S.sketch_similarity(docs, docs, 8, 40, 0.5).where("query <> ref").collect()
    assert moved(spark, found) < 2 * 40 * len(rows)
    assert found() == []
