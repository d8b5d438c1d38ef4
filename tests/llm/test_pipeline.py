from __future__ import annotations

import hashlib

import corpus_pipeline
from arborframe.llm.common import table


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    held, ids = docs, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = stage(spark, held, sf_dir)
        kept = {r["doc_id"] for r in held.select("doc_id").collect()}
        assert kept <= ids
        if k < 4:
            assert held.columns == names
        if k in (1, 4):
            assert kept == ids
        held, ids = spark.createDataFrame(held.toPandas(), held.schema), kept
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in held.collect())


def test_decoded_texts_are_those_encoded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
    assert all(texts[r["doc_id"]] == r["decoded_sha256"] for r in corpus_pipeline.encode(spark, docs, sf_dir).collect())


def test_copies_go_and_one_stays(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "quite another text of some other words"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [1, 3, 4]


def test_against_brute_force(spark, sf_dir):
    """The five stages by plain Python, SQL of other engines and public libraries, from the same classifier's weights."""
    import duckdb
    import public_tokenizers
    import tiktoken
    from pyspark.sql import functions as F
    from test_brute import components, plain_fingerprint
    from tiktoken.load import load_tiktoken_bpe

    from arborframe.llm import decontaminate, lines, toxicity
    from arborframe.llm.sample import remainder

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 5) != 0)
    held = docs.select("doc_id", "text").toPandas()
    held = held[[model.score(t) < 0.5 for t in held["text"]]]
    con = duckdb.connect()
    con.register("benchmark", table(spark, sf_dir, "benchmark").toPandas())
    con.register("documents", held)
    gone = dict(con.execute(f"SELECT doc_id, removed FROM ({lines.SQL['op5_lines']})").fetchall())
    held["text"] = [t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(gone[d] or [])) for d, t in zip(held["doc_id"], held["text"], strict=True)]
    held = held.sort_values("doc_id").reset_index(drop=True)
    fps = [plain_fingerprint(t) for t in held["text"]]
    root = components(len(held), [(i, j) for i in range(len(held)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    held = held[[r == i for i, r in enumerate(root)]]
    con.register("documents", held)
    clean = {d for d, c in con.execute(f"SELECT doc_id, contaminated FROM ({decontaminate.SQL['op10_decontaminate']})").fetchall() if not c}
    known = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: known.encode_ordinary(t or "") for d, t in zip(held["doc_id"], held["text"], strict=True) if d in clean}
    assert 0 < len(want) < docs.count()
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want


def test_odd_rows(spark, sf_dir):
    """Nulls, empty and repeated rows, clashing names and an empty table go through every stage."""
    same = "A clean line of some words that stands here twice."
    rows = [(1, same, "en", "web", 5, "x", "y"), (1, same, "en", "web", 5, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", "y"), (None, "A null id has its own words to say here.", "en", "a", 9, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Score string, f_id string")
    for start, ids in ((docs, {1, 2, None}), (docs.limit(0), set())):
        held = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            held = stage(spark, held, sf_dir)
            assert k == 4 or held.columns == docs.columns
            rows = held.collect()
            held = spark.createDataFrame(rows, held.schema)
        assert {r["doc_id"] for r in rows} == ids and len(rows) == len(ids)
