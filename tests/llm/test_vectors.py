"""Exact search, vector codes and the filter audit against plain versions, on odd rows and empty tables; fits on odd labels."""

from __future__ import annotations

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborframe.llm import audit, codes, mtree, quality, toxicity

NAN, INF = float("nan"), float("inf")
ODD = [(None, None, 1), (1, None, 1), (2, [NAN] * 8, 1), (3, [INF] * 8, None), (4, [None] + [0.5] * 7, 2), (None, [0.1] * 8, 2)]
SCHEMA = "vec_id long, embedding array<float>, label int, row string, cell string, code string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def cloud(n, seed=5, width=8):
    """Clusters, exact copies of one vector for a third of the rows, and a few long vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, width))[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * 0.2
    x[: n // 3] = x[0]
    x[-3:] *= 50
    return [(int(i), [float(np.float32(c)) for c in v], int(i) % 4 or None) for i, v in zip(rng.permutation(n) + 100, x, strict=True)]


def brute_top(rows, k, every, scale=1024):
    sound = [(i, [int(np.floor(scale * c)) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, v in sound:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in sound if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [3, 900])
def test_search_by_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 100)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 8)
    rows = cloud(n) + ODD + [(200, [1.0, 2.0], 1), (201, [], 1)] + [cloud(n)[0]]
    found = mtree.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=7)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 7, 10)


def test_search_without_rows(spark):
    for rows in ([], ODD, [(7, [1.0] * 8, 1)]):
        assert mtree.top_k(table(spark, rows), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_save_computations():
    rng = np.random.default_rng(1)
    x = (1024 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16)) * 0.05)).astype(np.int32)
    space = mtree.Space(int((x.astype(np.int64) ** 2).sum(axis=1).max()))
    pages = mtree.load(np.arange(4000), x, space)
    assert max(len(p.refs) for p in pages) <= mtree.PAGE
    visit = mtree.search(pages, space, x[17], 10, own=17)
    scores = x.astype(np.int64) @ x[17].astype(np.int64)
    assert visit.found == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(4000), -scores)) if i != 17][:10]
    assert visit.computed < 2000 and visit.skipped > 0


def test_large_products_are_exact():
    x = np.random.default_rng(2).integers(-(1 << 28), 1 << 28, size=(300, 8)).astype(np.int32)
    space = mtree.Space(int((x.astype(np.int64) ** 2).sum(axis=1).max()))
    assert not space.exact
    scores = x.astype(np.int64) @ x[0].astype(np.int64)
    assert mtree.search(mtree.load(np.arange(300), x, space), space, x[0], 5).found == [(int(scores[i]), int(i)) for i in np.argsort(-scores)[:5]]


def brute_codes(rows, width, parts=8, entries=16, rounds=6, scale=4096):
    sound = sorted(((i is None, i or 0, v), i, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v))
    most = codes.limit(width)
    x = [[max(-most, min(most, int(np.floor(scale * c)))) for c in s[0][2]] + [0] * (width - len(s[0][2])) for s in sound]
    w = width // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found, strict=True) if f[p] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(s[1], s[2], "".join(f"{near(p, v[p])[1]:02x}" for p in range(parts)), sum(near(p, v[p])[0] for p in range(parts))) for s, v in zip(sound, cut, strict=True)]
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("n", "width"), [(5, 8), (700, 8), (300, 24)])
def test_codes_by_brute_force(spark, n, width):
    rows = cloud(n, width=width) + [(i, v and v * (width // 8), lab) for i, v, lab in ODD] + [(200, [1.0, -2.0], 1), (201, [], 1), (202, [1e30] * width, 3)] + [cloud(n, width=width)[0]] * 3
    coded, books = codes.compress(table(spark, rows))
    want, sha = brute_codes(rows, width)
    got = codes.with_label_error(coded).collect()
    plain = lambda rows: sorted((-1 if a is None else a, -1 if b is None else b, c, d) for a, b, c, d in rows)
    assert plain((r["vec_id"], r["label"], r["code"], r["error"]) for r in got) == plain(want)
    assert codes.digest(books) == sha
    total = lambda lab: min(2**63 - 1, sum(w[3] for w in want if w[1] == lab))
    assert all(r["label_error"] == total(r["label"]) for r in got)


def test_codes_without_rows(spark):
    for rows in ([], ODD[:5]):
        coded, books = codes.compress(table(spark, rows))
        assert codes.with_label_error(coded).count() == 0 and books.size == 0


def test_members_stay_with_their_owners(spark):
    """After a round every part is in its owner's partition, and only those that changed entry went through the shuffle."""
    rng = np.random.default_rng(3)
    position, values = np.tile(np.arange(8, dtype=np.int16), 500), rng.integers(-900, 900, size=(4000, 4)).astype(np.int32)
    row, books = np.repeat(np.arange(500, dtype=np.int64), 8), rng.integers(-900, 900, size=(8, 16, 4))
    owners = codes.Owners(8, 16, 20)
    assert owners.salts == 3
    entry, _ = codes.assign(position, values, books)
    members = spark.sparkContext.parallelize(list(owners.deal(position, entry, row, values)), 3).partitionBy(20, int)
    nudged = books + rng.integers(-60, 60, size=books.shape)
    after = codes.settle(members, nudged, owners)
    assert after.getNumPartitions() == 20
    held = after.mapPartitionsWithIndex(lambda i, blocks: [(i, b) for _, b in blocks]).collect()
    new, _ = codes.assign(position, values, nudged)
    assert sum(len(b[0]) for _, b in held) == 4000 and 0 < (new != entry).sum() < 2000
    for i, (p, e, r, v) in held:
        assert (owners.of(p, e, r) == i).all() and (e == new[r * 8 + p]).all() and (v == values[r * 8 + p]).all()
    moved = after.toDebugString().decode()
    assert moved.count("PartitionerAwareUnionRDD") == 1


def test_intervals_cover_all_orders():
    for n in (1, 3, 5):
        orders = list(permutations(range(n)))
        seen = set()
        for mask, f, step, begin, end in audit.removals(n):
            for rank in range(begin, end):
                assert (mask, rank) not in seen
                seen.add((mask, rank))
                assert orders[rank][step - 1] == f and mask >> f & 1 and not any(mask >> g & 1 for g in orders[rank][: step - 1])
        assert len(seen) == (2**n - 1) * len(orders)


def test_audit_by_brute_force(spark):
    rng = random.Random(4)
    odd = ["", None, " \n\t ", "A $ b", "ÄÖ Äx", "word " * 60, "a b c " * 30, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), "same same", "\x0b\x0cx y"]
    rows = [(i, rng.choice(odd), rng.choice(["s1", "s2", None, ""])) for i in range(120)] + [(None, "same same", "s1"), (3, "twice", "s2"), (3, "twice", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, part string, mask string")
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    import re

    def fails(i, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = min(j for j, u, _ in rows if j is not None and (u or "") == t)
        tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first)
        return "".join(c for c, x in zip("ABCDE", tests, strict=True) if x)

    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    marked = [(s or "", i, fails(i, t)) for i, t, s in rows]
    want = []
    for part in {m[0] for m in marked}:
        own, share, lines = [m for m in marked if m[0] == part], {c: 0 for c in "ABCDE"}, []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                out = [m for m in left if c in m[2]]
                left = [m for m in left if c not in m[2]]
                share[c] += len(out)
                lines.append([part, order, step, len(left), len(out), sum(c in m[2] for m in own) - len(out), sum(m[2] == c for m in own), sum(m[1] in good for m in out), sum(m[1] in toxic for m in out), c])
        want += [(*x[:-1], share[x[-1]]) for x in lines]
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)
    assert audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("docs", [[], [(1, ""), (2, " \n "), (3, None)], [(90, "a text"), (91, "another one")], [(1, "a text"), (1, "a text")], [(1, "x\ny"), (2, " \n ")]])
def test_fits_on_odd_labels(spark, docs):
    """No document, none with lines, none with a label, one class, one class with lines: a finite flat score, and no crash."""
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    share = {0: 0.5}.get(docs.count(), None)
    q, t = quality.fit(docs, labels, "quality", F.lit(True)), toxicity.fit(docs, labels, "toxic", F.lit(True))
    a, b = q.score_batch(["some line"])[0][0], t.score("some text")
    assert 0 <= a <= 1 and 0 <= b <= 1 and np.isfinite([a, b]).all()
    if share is not None:
        assert a == b == share


def test_one_class_left_is_the_answer(spark):
    docs = spark.createDataFrame([(1, "a text"), (3, "b text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    assert [r["predicted"] for r in toxicity.classify(docs, model).collect()] == [1, 1]


def test_sample_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "clean")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    from arborframe.llm.sample import labelled

    texts, counts = labelled(docs, labels, "toxic", F.lit(True), (5, 5))
    assert counts == (1, 1) and sorted(map(tuple, texts.collect())) == [("clean", 0), ("text 0", 1)]


def test_log_count_ratios_by_hand(spark, monkeypatch):
    """Of two documents a class, the bucket of an n-gram in both toxic ones and no other gets the larger weight."""
    monkeypatch.setattr(toxicity, "LEAST_ROWS", 2)
    rows = [(1, "zzz zzz"), (2, "zzz yyy"), (3, "aaa bbb"), (4, "aaa ccc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    assert model.score("zzz") > 0.5 > model.score("aaa")
    counts = np.zeros((2, len(model.weights)))
    for i, t in rows:
        counts[int(i < 3), toxicity.buckets(t)] += 1
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    used = counts.sum(axis=0) >= toxicity.LEAST_ROWS
    assert (np.sign(model.weights[used]) == np.sign(ratio[used])).all() and not model.weights[~used].any()
