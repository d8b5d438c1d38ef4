"""Containment sketches against plain sets, and what sampling loses."""

from __future__ import annotations

import random

import pytest

from arborframe.operators import sketch as K

SCHEMA = "id long, seq string, is_query boolean, is_ref boolean"


def entries(seq, k, scaled, section):
    """Plain twin: (hash, section) of the sampled substrings."""
    codes = [ord(c) for c in seq]
    codes += [0] * (k - len(codes))
    out = []
    for i in range(len(codes) - k + 1):
        high, low = 0, 0
        for c in codes[i : i + k]:
            high, low = (high * K.BASES[0] + c) % K.PRIME, (low * K.BASES[1] + c) % K.PRIME
        out.append((high, low, i // section))
    kept = [x for x in out if scaled == 1 or x[0] < K.PRIME // scaled] or [min(out)]
    return {(high * 2**31 + low, s) for high, low, s in kept}


def plain(rows, k, scaled, section, ani, af):
    made = {i: entries(s, k, scaled, section) for i, s, *_ in rows if s}
    out = {}
    for q, s, is_query, _ in rows:
        if not is_query:
            continue
        found = []
        for r, t, _, is_ref in rows:
            if not is_ref or r == q or not s or not t:
                continue
            held = {h for h, _ in made[r]}
            size, same = {}, {}
            for h, part in made[q]:
                size[part] = size.get(part, 0) + 1
                same[part] = same.get(part, 0) + (h in held)
            good = [p for p in size if same[p] and same[p] / size[p] >= ani**k]
            inside = sum(size[p] for p in good)
            if inside and inside / len(made[q]) >= af:
                found.append((-sum(same[p] for p in good) / inside, -inside / len(made[q]), r))
        best = min(found, default=None)
        out[q] = (len(found), best and best[2], best and round((-best[0]) ** (1 / k), 9), best and round(-best[1], 9))
    return out


def family(rng, n):
    """Sequences of four letters: some are copies with changes, some share a passage, some are equal, short or empty."""
    make = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    common, base, seqs = make(300), [make(900) for _ in range(4)], []
    for i in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 5, 40])):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        text = "".join(s)
        seqs.append([text, text[: rng.randrange(100, 900)], common + make(300), make(5), "", None, "é\U0001f600" + text][i % 7])
    return [(i, s, i % 3 == 0, i % 5 != 4) for i, s in enumerate(seqs)]


@pytest.mark.parametrize("scaled", [1, 8])
def test_agrees_with_plain_sets(spark, scaled, monkeypatch):
    monkeypatch.setattr(K, "POSTINGS", 3)  # many hashes are split
    monkeypatch.setattr(K, "BLOCK", 500)  # and many blocks
    rows = family(random.Random(5), 70)
    out = K.closest(spark.createDataFrame(rows, SCHEMA), 12, scaled, 100, 0.9, 0.4).collect()
    got = {r["query"]: (r["n_links"], r["ref"], r["ani"] and round(r["ani"], 9), r["af"] and round(r["af"], 9)) for r in out}
    want = plain(rows, 12, scaled, 100, 0.9, 0.4)
    assert got == want and len(out) == len(want)
    assert any(n for n, *_ in want.values()) and any(n == 0 for n, *_ in want.values())


def test_hot_hashes_by_shuffle(spark, monkeypatch):
    rows = family(random.Random(6), 40)
    table = spark.createDataFrame(rows, SCHEMA)
    usual = sorted(map(tuple, K.closest(table, 12, 4, 100, 0.9, 0.4).collect()), key=str)
    monkeypatch.setattr(K, "POSTINGS", 2)
    monkeypatch.setattr(K, "BROADCAST", -1)
    assert sorted(map(tuple, K.closest(table, 12, 4, 100, 0.9, 0.4).collect()), key=str) == usual


def test_sampling_finds_what_whole_sets_do(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("ACGT") for _ in range(6000)) for _ in range(5)]
    rows = []
    for i in range(60):
        s = list(base[i % 5])
        for at in rng.sample(range(6000), rng.choice([10, 60, 120])):
            s[at] = rng.choice("ACGT")
        rows.append((i, "".join(s), i % 20 == 0, True))
    table = spark.createDataFrame(rows, SCHEMA)
    whole, sampled = ({r["query"]: r for r in K.closest(table, 16, scaled, 1000, 0.9, 0.5).collect()} for scaled in (1, 16))
    assert sum(r["n_links"] for r in sampled.values()) >= 0.9 * sum(r["n_links"] for r in whole.values()) > 0
    assert all(abs(sampled[q]["ani"] - whole[q]["ani"]) < 0.01 for q in whole)


def test_no_rows_and_no_references(spark):
    assert K.closest(spark.createDataFrame([], SCHEMA), 12, 8, 100, 0.9, 0.4).collect() == []
    alone = K.closest(spark.createDataFrame([(1, "ACGT" * 50, True, False), (2, None, True, None)], SCHEMA), 12, 8, 100, 0.9, 0.4)
    assert {r["query"]: r["n_links"] for r in alone.collect()} == {1: 0, 2: 0}
    twin = K.closest(spark.createDataFrame([(2, "ACGT" * 50, True, True), (1, "ACGT" * 50, True, True)], SCHEMA), 12, 8, 100, 0.9, 0.4)
    assert {r["query"]: (r["n_links"], r["ref"], r["ani"], r["af"]) for r in twin.collect()} == {1: (1, 2, 1.0, 1.0), 2: (1, 1, 1.0, 1.0)}


def moved(spark, run):
    """Rows that ``run`` shuffles and writes."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(x.shuffleWriteRecords() + x.outputRecords() for x in map(stages.apply, range(stages.size())))

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = rows()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows() - before


def test_pairs_of_near_copies_are_not_moved(spark):
    """Four times the near copies make sixteen times the links, which are summed where they are found."""
    rng = random.Random(8)
    base = "".join(rng.choice("ACGT") for _ in range(600))
    rows = [(i, base[: 2 * i] + "#" + base[2 * i + 1 :], True, True) for i in range(200)]
    table = lambda n: spark.createDataFrame(rows[:n], SCHEMA)
    few, many = (moved(spark, lambda n=n: K.closest(table(n), 12, 8, 100, 0.9, 0.4).collect()) for n in (50, 200))
    assert many < 6 * few
    assert {r["n_links"] for r in K.closest(table(200), 12, 8, 100, 0.9, 0.4).collect()} == {199}
