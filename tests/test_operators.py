"""Small literal cases for functions and operators."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arborframe.functions import normalize as N
from arborframe.operators import alignment as A
from arborframe.operators import hits as H
from arborframe.operators import similarity as S
from arborframe.operators import taxonomy as T
from arborframe.plans import tables
from arborframe.streaming import events as E


def values(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_identifiers(spark):
    assert set(values(spark, N.canonical_id, "GCF_005435135.1_ASM543513v1_genomic", "RS_GCF_005435135.1", "GB_GCA_005435135.1")) == {"G005435135"}
    assert values(spark, N.prefixed_id, "GCF_123.1", "GCA_456.1", "genome_1") == ["RS_GCF_123.1", "GB_GCA_456.1", "genome_1"]
    assert values(spark, N.is_float, "0.1", "-0.1", "100.0", "1", "a", "", None) == [True] * 4 + [False] * 3


def test_labels(spark):
    assert [tuple(x) for x in values(spark, N.parse_label, "1.0:o__something|foo", "1.0:o__something", "1.0")] == [(1.0, "o__something", "foo"), (1.0, "o__something", None), (1.0, None, None)]


def test_standardise(spark):
    out = values(spark, lambda t: N.standardise(F.split(t, ";"), F.lit("d__Bacteria")), "p__phylum1;c_class1")
    assert ";".join(out[0]) == "d__Bacteria;p__phylum1;c_class1;o__;f__;g__;s__"


def test_extensions(spark):
    assert values(spark, N.remove_extension, "foo.root.txt", "foo.txt", "foo") == ["foo.root", "foo", "foo"]
    assert values(spark, lambda t: N.remove_extension(t, "root.txt"), "foo.root.txt") == ["foo"]


def test_mask(spark):
    msa = spark.createDataFrame([("a", "DDRMIENV"), ("b", "RDRMIE-V"), ("c", "-DRMIENV"), ("d", "---MIE-V")], "id string, seq string")
    cut = A.apply_mask(msa, "11100011")
    assert {r["id"]: r["seq"] for r in cut.collect()} == {"a": "DDRNV", "b": "RDR-V", "c": "-DRNV", "d": "----V"}
    assert {r["id"]: r["kept"] for r in A.prune(cut, 0.5).collect()} == {"a": True, "b": True, "c": True, "d": False}
    with pytest.raises(PySparkException):
        A.apply_mask(msa, "101").collect()


def test_consensus(spark):
    msa = spark.createDataFrame([("a", "AAVWAWGG"), ("b", "AAVW-WGA"), ("c", "--AW-GGG")], "id string, seq string")
    assert {r["col"] for r in A.consensus(msa, 0.5, 0.25, 0.95).where("kept AND col < 7").collect()} == {2, 5}


def test_best_hits(spark):
    rows = [("a", "b", 0.1, 10.0), ("a", "b", 0.1, 20.0), ("a", "c", 0.1, 10.0), ("x", "y", 0.1, 10.0), ("x", "y", 0.2, 10.0)]
    hits = spark.createDataFrame(rows, "gene_id string, hmm_id string, e_val double, bit_score double")
    found = {r["gene_id"]: (r["hmm_id"], r["e_val"], r["bit_score"]) for r in H.best(hits, "gene_id").collect()}
    assert found == {"a": ("b", 0.1, 20.0), "x": ("y", 0.1, 10.0)}


def test_screen_and_confirm_differ(spark):
    hits = spark.createDataFrame([("q", "r1", 96.0, 0.9), ("q", "r2", 95.5, 0.9)], "query string, ref string, ani double, af double")
    radius = spark.createDataFrame([("r1", 97.0), ("r2", 95.0)], "ref string, ani double")
    assert [r["ref"] for r in S.screen(hits, radius, 0.5).collect()] == ["r2"]
    assert S.confirm(hits, radius, 0.5).count() == 0


def test_sketches_share_all_slots_of_equal_texts(spark):
    docs = spark.createDataFrame([(1, "the same sequence of letters"), (2, "the same sequence of letters"), (3, "0123456789")], "id long, seq string")
    out = {(r["query"], r["ref"]): r["similarity"] for r in S.sketch_similarity(docs, docs, 5, 8).collect()}
    assert out == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0}


def test_first_events_of_a_folder(spark, tmp_path):
    """Three files, in which the first events come last and a day late, and keys return after the delay."""
    rows = [(i, i % 7, "ab"[i % 2], f"2024-01-0{3 - i // 20} 0{i % 10}:00:00") for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = {}
    for e, u, t, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        want.setdefault((u, t), e)
    source = E.stream(spark, f"{tmp_path}/events.parque[t]", "event_id long, user_id long, event_type string, ts timestamp")
    got = E.first_events(source, "user_id", "event_type").collect()
    assert sorted(((r["user_id"], r["event_type"]), r["event_id"]) for r in got) == sorted(want.items())
    assert sorted(((u, t), e) for u, t, e in tables.stream_dedup(spark, str(tmp_path)).collect()) == sorted(want.items())


def test_minhash_by_brute_force(spark, tmp_path):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh é漢") for _ in range(300)) for _ in range(6)]
    cut = lambda t, n: "".join(c if rng.random() > n / len(t) else "#" for c in t)
    rows = [(i, cut(base[i % 6], i // 6)) for i in range(120)] + [(120, ""), (121, ""), (140, "short"), (141, "short"), (160, None), (161, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: {t[j : j + 8] for j in range(max(1, len(t) - 7))} for i, t in rows if t is not None}
    share = {(q, r): len(sets[q] & sets[r]) / len(sets[q] | sets[r]) for q in sets if q % 20 == 0 for r in sets if q != r}
    got = {(r["query"], r["ref"]): r["similarity"] for r in tables.minhash_similarity(spark, str(tmp_path)).collect()}
    assert got == {p: s for p, s in share.items() if s >= 0.5} and any(0.5 <= s < 0.7 for s in got.values())


def test_vectors_of_a_label_meet_in_blocks(spark, monkeypatch):
    """Several blocks of either side, nulls, zeros, other lengths: every pair once, and the best of each query."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(7)
    rows = [(i, i % 3 or None, [rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(6)] + [1.0]) for i in range(240)] + [(500, 1, None), (501, 1, [1.0, None]), (502, 1, [1.0, 2.0]), (503, 2, [])]
    df = spark.createDataFrame(rows, "id long, label int, v array<float>")
    queries, refs = df.where("id % 4 <> 0").withColumnRenamed("id", "query"), df.where("id % 4 = 0").withColumnRenamed("id", "ref").withColumn("radius", F.lit(0.3))
    want = {}
    for q, label, v in rows:
        for r, other, w in rows:
            if q % 4 and not r % 4 and label and label == other and v and w and len(v) == len(w) and None not in v + w:
                ani = round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 9)
                want[q, r] = ani, sum((a > 0) - (a < 0) == (b > 0) - (b < 0) for a, b in zip(v, w)) / len(v)
    plain = lambda found: {(x["query"], x["ref"]): (round(x["ani"], 8), x["af"]) for x in found.collect()}
    near = lambda pairs: {p: (round(a, 8), f) for p, (a, f) in pairs.items()}
    assert plain(S.compared(queries, refs.drop("radius"))) == near(want)
    held = {p: x for p, x in want.items() if x[0] >= 0.3 and x[1] >= 0.4}
    assert plain(S.compared(queries, refs, 0.4)) == near(held)
    best = {q: min((-a, -f, r) for (p, r), (a, f) in held.items() if p == q) for q, _ in held}
    got = S.closest(S.compared(queries, refs, 0.4, best=True), 0.4).collect()
    assert {x["query"]: x["ref"] for x in got} == {q: x[2] for q, x in best.items()}


def test_only_pairs_of_the_least_similarity_are_counted(spark):
    """Texts that share a third with all others are no links; copies are, of queries and references alike."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared, rows = word(200), []
    for i in range(40):
        own = word(300)
        rows += [(3 * i, shared + own), (3 * i + 1, shared + own), (3 * i + 2, shared + own[:290] + word(10))]
    docs = spark.createDataFrame(rows, "id long, seq string")
    sets = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in rows}
    share = {(q, r): len(sets[q] & sets[r]) / len(sets[q] | sets[r]) for q in sets if q % 6 == 0 for r in sets}
    got = {(x["query"], x["ref"]): x["similarity"] for x in S.sketch_similarity(docs.where("id % 6 = 0"), docs, 8, 40, 0.5).collect()}
    assert got == {p: s for p, s in share.items() if s >= 0.5} and len(got) == 60


def test_children_of_a_genome_in_two_rows(spark):
    """Each row is a lineage of its own; open ranks are skipped, and rows are dealt out before they become seven."""
    rows = [("g1", ["d__A", "p__", "c__C"]), ("g1", ["d__A", "p__", "c__C"]), ("g2", ["d__A", "p__B", "c__"]), ("g3", None)]
    taxonomy = spark.createDataFrame(rows, "genome_id string, taxa array<string>")
    got = {(r["rank_idx"], r["taxon"]): r["children"] for r in T.children(taxonomy).collect()}
    assert got == {(0, "d__A"): ["c__C", "p__B"], (1, "p__B"): ["g2"], (2, "c__C"): ["g1"]}
    assert "Window" not in T.children(taxonomy)._jdf.queryExecution().optimizedPlan().toString()
