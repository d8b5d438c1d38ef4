"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator on documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.llm import bpe, decontaminate, lines, pii, quality, simhash, spans, toxicity, warc

DOCS = "doc_id long, text string, score string, n_tokens string, fp string, items string, n_hit string, n_entities string, n_removed string, first string, th string, line_good string"
LONG = "The quick brown fox jumps over the lazy dog again. " * 4000
TEXTS = [(1, "A line that is long enough to count.\nshort"), (1, "A line that is long enough to count.\nshort"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, LONG), (5, " \n\t\n "), (6, "x" * 30000), (7, "naïve 漢字 \U0001f600 mail a.b@c.org")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, *["kept"] * 10) for r in rows], DOCS)


def score_model():
    return toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)


def line_model():
    f, k = len(quality.FEATURES), len(quality.NEIGHBOURS)
    return quality.Model(np.zeros((f, quality.BINS - 1)), np.zeros((k, f, quality.BINS)), 0.0, np.zeros((2, 2)), 0.25)


def encoded(d):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.bpe(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def scanned(d):
    items = d.sparkSession.createDataFrame([(1, "brown fox jumps over the lazy dog again the quick brown"), (2, None), (None, "x"), (3, "")], "item_id int, text string")
    return decontaminate.decontaminate(d, items)


OPERATORS = {
    "toxicity": lambda d: toxicity.classify(d, score_model()), "quality": lambda d: quality.classify(d, line_model(), lines=True), "lines": lines.deduplicate,
    "line report": lines.report, "simhash": simhash.near_duplicates, "spans": spans.deduplicate, "pii": lambda d: pii.replace(d, b"a key"), "bpe": encoded, "decontaminate": scanned,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_stays(spark, name):
    out = OPERATORS[name](docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "lines", "spans", "pii", "bpe"])
def test_extra_columns_stay(spark, name):
    out = OPERATORS[name](docs(spark))
    assert {r["th"] for r in out.collect()} == {"kept"} and {r["first"] for r in out.collect()} == {"kept"}
    assert len(out.columns) == len(set(out.columns))


def test_scores_of_empty_texts(spark):
    out = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark), line_model()).collect() if r["doc_id"]}
    assert out[2] == out[3] == out[5] == 0.25
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify(docs(spark), score_model()).collect())


def test_models_of_one_class(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs(spark), labels, "toxic", F.lit(True)).score("any") < 0.01
    assert quality.fit(docs(spark), labels, "quality", F.lit(True)).score_batch(["any line"])[0][0] > 0.99
    assert toxicity.fit(docs(spark), labels.limit(0), "toxic", F.lit(True)).score("any") == 0.5


def test_representatives_keep_one_of_a_group(spark):
    out = simhash.representatives(docs(spark)).collect()
    wordless = [r["doc_id"] for r in out if not (r["text"] or "").strip()]
    assert wordless == [2]
    assert sum(r["doc_id"] == 1 for r in out) == 1


def test_pages(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, "http://c", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "http://d/é \n", "漢" * 200000)]
    rows += [(7, "http://e", "<p>y</p>")] * 3 + [(6, "http://e", "<p>y</p>"), (None, "u", "<p>z</p>"), (None, "u", "<p>z</p>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, frame int")
    out = warc.read(warc.archive(pages)).collect()
    said = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0) for r in out)
    assert said == sorted([
        (0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "revisit", 2), (3, "revisit", 4), (4, "response", 0), (5, "response", 0),
        (7, "response", 0), (7, "revisit", 7), (7, "revisit", 7), (6, "revisit", 7), (0, "response", 0), (0, "response", 0),
    ])
    assert next(r["url"] for r in out if r["page_id"] == 2 and r["record_type"] == "response") == "http://b"
    assert next(r["payload"] for r in out if r["page_id"] == 5).decode() == "漢" * 200000
    assert warc.read(warc.archive(pages.limit(0))).count() == 0


def test_bundles_by_their_seek_table(spark, tmp_path):
    import io
    import re

    import zstandard

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 7 * 50)) for i in range(400)], "page_id long, url string, html string")
    index = warc.write(warc.planned(pages).coalesce(1), f"file://{tmp_path}", frame_bytes=4096, bundle_bytes=1 << 15).collect()
    bundles = sorted(tmp_path.glob("*.zst"))
    assert len(bundles) > 1
    for path in bundles:
        data = path.read_bytes()
        frames = warc.read_seek_table(data)
        own = [r for r in index if r["path"].endswith(path.name)]
        assert len(frames) == 1 + max(r["frame"] for r in own)
        # a standard decoder reads the whole bundle as one file, and every frame by itself
        whole, at, raw = b"", 0, io.BytesIO(data)
        for packed, size in frames:
            part = zstandard.ZstdDecompressor().decompress(data[at : at + packed])
            assert len(part) == size
            whole, at = whole + part, at + packed
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
            assert reader.read() == whole
        assert len(re.findall(rb"^WARC/1.1\r$", whole, re.M)) == len(own)
        for r in own:
            found = warc.parse(zstandard.ZstdDecompressor().decompress(data[r["frame_offset"] : r["frame_offset"] + r["frame_bytes"]])[r["record_offset"] :][: r["record_bytes"]])
            assert int(found["headers"]["warc-page"]) == r["page_id"]
    with pytest.raises(ValueError):
        warc.read_seek_table(bundles[0].read_bytes()[:-1])
