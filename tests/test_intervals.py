"""Running aggregates, trees by intervals, divergence over rootings and grafts, against plain walks."""

from __future__ import annotations

import json
import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from arborframe.operators import graft as G
from arborframe.operators import nested as S
from arborframe.operators import rooting as M
from arborframe.operators.scan import running
from arborframe.sources import newick, sequences, tables
from test_trees import distances, random_tree

SCHEMA = "tree_id int, node_id string, parent_id string, edge_length double, taxon string"


def tree(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], SCHEMA)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, inclusive):
    """One key has most of the rows, one is null, and values have gaps; ranges are more than keys."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), t, rng.choice([None, rng.randint(-9, 9)])) for t in rng.sample(range(5000), 400)]
    out = running(spark.createDataFrame(rows, "k string, t int, v long"), ["k"], ["t"], inclusive, ranges=13, s=("sum", "v"), m=("max", "v"), l=("last", "v"))
    want = []
    for k, t, v in rows:
        seen = [w for j, u, w in sorted(rows, key=lambda r: r[1]) if j == k and (u <= t if inclusive else u < t) and w is not None]
        want.append((k or "", t, v, sum(seen) if seen else None, max(seen, default=None), seen[-1] if seen else None))
    assert sorted((r["k"] or "", *r[1:]) for r in out.collect()) == sorted(want)


def test_running_without_keys_or_rows(spark):
    rows = spark.range(1000).withColumn("one", F.lit(1))
    out = running(rows, [], ["id"], s=("sum", "one"))
    assert out.where("s <> id + 1").isEmpty() and out.count() == 1000
    assert running(rows.limit(0), [], ["id"], s=("sum", "one")).count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().toString()


def test_ladders_and_stars(spark):
    """A tree as deep as it has nodes, and one node with all the others below."""
    n = 1500
    ladder = [(1, f"x{i}", f"x{i - 1}" if i else None, 1.0, None) for i in range(n)]
    star = [(2, f"x{i}", "x0" if i else None, 2.0, None) for i in range(n)]
    placed = S.numbered(spark.createDataFrame(ladder + star, SCHEMA))
    got = {(r["tree_id"], r["node_id"]): r for r in placed.collect()}
    assert all((r["pre"], r["last"], r["depth"], r["dist_root"]) == (i, n - 1, i, float(i)) for i in range(n) for r in [got[1, f"x{i}"]])
    order = sorted(f"x{i}" for i in range(1, n))
    assert all(got[2, x]["pre"] == got[2, x]["last"] == k for k, x in enumerate(order, 1)) and got[2, "x0"]["last"] == n - 1
    sums = {(r["tree_id"], r["node_id"]): r["n"] for r in S.subtree_sums(placed, n=F.lit(1)).collect()}
    assert sums[1, "x7"] == n - 7 and sums[2, "x0"] == n and sums[2, "x5"] == 1
    assert S.ancestors(placed, spark.createDataFrame([(1, "x9"), (2, "x9")], "tree_id int, node_id string")).count() == 12


def test_few_levels_take_few_rounds(spark, monkeypatch):
    """Trees of few levels are numbered as by the tour, and the rounds do not grow with the nodes."""
    star = [(3, f"x{i}", "x0" if i else None, 2.0, None) for i in range(2000)]
    trees = spark.createDataFrame([(k, *r) for k in (1, 2) for r in random_tree(k, 30)] + star, SCHEMA)
    rounds, write = [], S.written
    monkeypatch.setattr(S, "written", lambda df: rounds.append(1) or write(df))
    S.numbered(spark.createDataFrame(star, SCHEMA))
    assert len(rounds) < 13  # a tour of 4,000 steps takes 12 rounds besides
    both = []
    for levels in (100, -1):
        monkeypatch.setattr(S, "LEVELS", levels, raising=False)
        both.append({tuple(r) for r in S.numbered(trees).drop("taxon").collect()})
    assert both[0] == both[1] and len(both[0]) == trees.count()


def test_cycles_fail(spark):
    with pytest.raises(ValueError, match="cycle"):
        S.jumps(tree(spark, [("a", "b", 1.0, None), ("b", "a", 1.0, None)]).withColumn("one", F.lit(1)), "node_id", "parent_id", ["one"])


def rerooted(rows, at):
    """Neighbours of every node once a root stands in the middle of the edge above ``at``."""
    near: dict = {}
    for n, p, e, *_ in rows:
        if p is not None:
            near.setdefault(n, {})[p] = e
            near.setdefault(p, {})[n] = e
    parent = next(p for n, p, *_ in rows if n == at)
    half = near[at].pop(parent) / 2
    near[parent].pop(at)
    near["new"] = {at: half, parent: half}
    near[at]["new"] = near[parent]["new"] = half
    return near


def plain_red(near):
    """Divergence from the root ``new``, by the recursion over children."""

    def below(n, last):
        kids = [m for m in near[n] if m != last]
        return [d + near[n][m] for m in kids for d in below(m, n)] if kids else [0.0]

    red, stack = {"new": 0.0}, [("new", None)]
    while stack:
        n, last = stack.pop()
        for m in near[n]:
            if m != last:
                a, d = near[n][m], below(m, n)
                b = sum(d) / len(d)
                red[m] = 1.0 if len(near[m]) == 1 else red[n] if a + b == 0 else red[n] + a / (a + b) * (1 - red[n])
                stack.append((m, n))
    return red


@pytest.mark.parametrize("seed", [1, 2])
def test_rootings_by_rerooting(spark, seed):
    rng = random.Random(seed)
    rows = [(n, p, e if p is None or rng.random() < 0.8 else 0.0, t) for n, p, e, t in random_tree(seed, 14)]
    at = rng.sample([n for n, p, *_ in rows if p is not None], 6)
    found = {(r["rooting"], r["node_id"]): r["red"] for r in M.divergence_over_rootings(tree(spark, rows), tree(spark, [r for r in rows if r[0] in at])).collect()}
    want = {}
    for p in at:
        red = plain_red(rerooted(rows, p))
        want |= {(p, n): red[n] for n, q, *_ in rows if q is not None and not n.startswith(p)}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], abs_tol=1e-12) for k in want)
    middle = {r["node_id"]: (r["n_rootings"], r["red"]) for r in M.median_divergence(tree(spark, rows), tree(spark, [r for r in rows if r[0] in at])).collect()}
    for n, (k, x) in middle.items():
        own = [v for (_, m), v in want.items() if m == n]
        assert k == len(own) and math.isclose(x, median(own), abs_tol=1e-12)


def test_rootings_without_another_side(spark):
    rows = [("r", None, None, None), ("a", "r", 1.0, None), ("b", "a", 1.0, None), ("c", "a", 1.0, None)]
    assert M.divergence_over_rootings(tree(spark, rows), tree(spark, rows[:2])).count() == 0


def test_grafts_keep_distances(spark):
    rows = random_tree(5, 9)
    rng = random.Random(5)
    edges = {n: e for n, p, e, _ in rows if p is not None}
    placed = [(1, e, f"q{k}", rng.choice([0.0, edges[e] / 2, edges[e] * 2]), float(k)) for k, e in enumerate(rng.choices(list(edges)[:4], k=12))] + [(1, "none", "lost", 0.0, 1.0)]
    out = G.graft(tree(spark, rows), spark.createDataFrame(placed, "tree_id int, node_id string, query string, distal double, pendant double"))
    assert out.columns == ["tree_id", "node_id", "parent_id", "edge_length", "taxon"]
    new = [(r["node_id"], r["parent_id"], r["edge_length"], None) for r in out.collect()]
    assert len(new) == len(rows) + 24 and len({r[0] for r in new}) == len(new)
    old, now = distances(rows), distances(new)
    assert all(math.isclose(now[k], d) for k, d in old.items())
    up = {n: p for n, p, *_ in rows}

    def way(n):  # to every leaf from a point on the way up from n
        return {leaf: d for (a, leaf), d in old.items() if a == n}

    leaves = {a for a, _ in old}
    for _, e, q, distal, pendant in placed[:-1]:
        point = min(distal, edges[e])
        for leaf in leaves:
            inside, at = leaf, leaf
            while at is not None and at != e:
                at = up[at]
            if e in leaves:
                want = pendant + (point if leaf == e else way(e)[leaf] - point)
                assert math.isclose(now[q, leaf], want), (q, leaf, inside)


def test_placement_files(spark, tmp_path):
    text = {"tree": "((A:0.5{0},B:0.25{1}):1{2},C:2.0{3}){4};", "fields": ["distal_length", "edge_num", "like_weight_ratio", "likelihood", "pendant_length"],
            "placements": [{"p": [[0.1, 1, 0.2, -5, 0.3], [0.2, 2, 0.7, -4, 0.4]], "nm": [["g1", 1]]}, {"p": [[0.0, 3, 1, -4, 0.5]], "nm": [["g2", 1]]}]}
    path = tmp_path / "x.json"
    path.write_text(json.dumps(text))
    nodes = newick.read_placement_tree(spark, str(path))
    best = G.best_placements(tables.read_placements(spark, str(path))).withColumnRenamed("name", "query")
    out = G.graft(nodes, best.join(nodes.select("tree_id", "edge_num", "node_id"), ["tree_id", "edge_num"]))
    got = {r["node_id"]: (r["parent_id"], r["edge_length"]) for r in out.collect()}
    inner = next(p for n, (p, _) in got.items() if n == "A")
    assert got[inner] == ("at:g1", 0.2) and math.isclose(got["at:g1"][1], 0.8) and got["g1"] == ("at:g1", 0.4)
    assert got["C"] == ("at:g2", 0.0) and got["at:g2"][1] == 2.0


def test_marks_inside_headers(spark, tmp_path):
    path = tmp_path / "a.fna"
    path.write_bytes(b">g1 note 5'->3' end\nAC\n\nGT\r\n>g2 a>b\r\nTT\r\n>g3\n")
    rows = {r["seq_id"]: (r["annotation"], r["seq"]) for r in sequences.read_fasta(spark, str(path)).collect()}
    assert rows == {"g1": ("note 5'->3' end", "ACGT"), "g2": ("a>b", "TT"), "g3": ("", "")}


def test_display_labels(spark):
    from arborframe.functions import normalize as N

    row = spark.createDataFrame([("d__X; p__'Y;c__Z", 0.25, "95.0")], "t string, e double, s string").select(N.itol_label(F.col("t")), N.itol_length(F.col("e"), F.col("s"))).first()
    assert tuple(row) == ("d__X|p__Y|c__Z", "0.25[95.0]")
    nodes = spark.createDataFrame([(1, 0, None, 0, None, "r", None), (1, 1, 0, 0, 0.5, "in", "0.5[9]"), (1, 2, 1, 0, 1.0, "a", None)], "tree_id int, node_id long, parent_id long, ord int, edge_length double, label string, edge_text string")
    assert newick.write_newick(nodes).first()["newick"] == "((a:1)in:0.5[9])r;"


def test_columns_of_odd_alignments(spark, monkeypatch):
    """Letters of several bytes, nulls, empty and ragged rows, in slices of a few rows, against plain strings."""
    from arborframe.operators import alignment as A
    from arborframe.operators import blocks

    rng = random.Random(6)
    rows = ["".join(rng.choice("ACGT-äß漢\U0001f600" if k % 5 == 0 else "acGT-") for _ in range(12)) for k in range(300)] + [None]
    msa = spark.createDataFrame([(str(k), s) for k, s in enumerate(rows)], "id string, seq string")
    mask = "101100000011"
    got = {r["id"]: r["seq"] for r in A.apply_mask(msa, mask).collect()}
    assert got == {str(k): s and "".join(c for c, m in zip(s, mask, strict=True) if m == "1") for k, s in enumerate(rows)}
    assert A.apply_mask(msa, "0" * 12).where("seq <> ''").isEmpty() and A.apply_mask(msa.limit(0), mask).isEmpty()
    ragged = spark.createDataFrame([(s and s[: rng.randint(0, 12)],) for s in rows] + [("x" * 70_000,)], "seq string")
    want: dict = {}
    for r in ragged.collect():
        for i, c in enumerate(r["seq"] or ""):
            want[i, c] = want.get((i, c), 0) + 1
    assert {(r["col"], r["aa"]): r["n"] for r in blocks.letter_counts(ragged).collect()} == want
