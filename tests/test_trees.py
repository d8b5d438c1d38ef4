"""Rerooting, labels and backbone rules on small trees, against walks over plain dictionaries."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arborframe.operators import classify as C
from arborframe.operators import reroot as Z
from arborframe.operators import tree as R

SCHEMA = "tree_id int, node_id string, parent_id string, edge_length double, taxon string"


def encoded(spark, rows):
    return R.encode(spark.createDataFrame([(1, *r) for r in rows], SCHEMA))


def random_tree(seed: int, leaves: int) -> list[tuple]:
    rng = random.Random(seed)
    parent = {"root": None}
    open_nodes = ["root"]
    while len(open_nodes) < leaves:
        node = open_nodes.pop(rng.randrange(len(open_nodes)))
        for k in range(2):
            parent[f"{node}{k}"] = node
            open_nodes.append(f"{node}{k}")
    return [(n, p, None if p is None else float(rng.randint(1, 40)), None) for n, p in parent.items()]


def distances(rows) -> dict[tuple[str, str], float]:
    """Length of the way between any two leaves, over the unrooted graph."""
    near: dict[str, dict[str, float]] = {}
    for n, p, e, *_ in rows:
        near.setdefault(n, {})
        if p is not None:
            near.setdefault(p, {})
            near[n][p] = near[p][n] = e or 0.0
    parents = {p for _, p, *_ in rows}
    leaves = [n for n, p, *_ in rows if n not in parents]
    out = {}
    for a in leaves:
        stack = [(a, None, 0.0)]
        while stack:
            n, last, d = stack.pop()
            if n in leaves:
                out[a, n] = d
            stack += [(m, n, d + e) for m, e in near[n].items() if m != last]
    return out


def plain(df) -> list[tuple]:
    return [(r["node_id"], r["parent_id"], r["edge_length"], r["taxon"]) for r in df.collect()]


def below(rows, node) -> set[str]:
    kids: dict = {}
    for n, p, *_ in rows:
        kids.setdefault(p, []).append(n)
    out, stack = set(), [node]
    while stack:
        n = stack.pop()
        stack += kids.get(n, [])
        if n not in kids:
            out.add(n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_outgroup_root(spark, seed):
    rows = random_tree(seed, 12)
    whole = below(rows, "root")
    for target in ("root0", "root10", sorted(whole)[3]):
        for out in (below(rows, target), whole - below(rows, target)):
            enc = encoded(spark, rows)
            edges = Z.outgroup_edges(enc, spark.createDataFrame([(1, n) for n in out], "tree_id int, node_id string"))
            new = plain(Z.reroot(enc, edges))
            root = next(n for n, p, *_ in new if p is None)
            sides = [below(new, n) for n, p, *_ in new if p == root]
            assert sorted(map(sorted, sides)) == sorted(map(sorted, (out, whole - out)))
            assert {k: pytest.approx(v) for k, v in distances(rows).items()} == distances(new)
            assert len({n for n, *_ in new}) == len(new)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_midpoint_root(spark, seed):
    rows = random_tree(seed, 14)
    enc = encoded(spark, rows)
    new = plain(Z.reroot(enc, Z.midpoint_edges(enc)))
    assert {k: pytest.approx(v) for k, v in distances(rows).items()} == distances(new)
    far = {r["node_id"]: r["dist_root"] for r in encoded(spark, new).where("is_leaf").collect()}
    assert max(far.values()) == pytest.approx(max(distances(rows).values()) / 2)


def test_unroot(spark):
    rows = random_tree(6, 9)
    new = plain(Z.unroot(encoded(spark, rows)))
    root = next(n for n, p, *_ in new if p is None)
    assert sum(p == root for _, p, *_ in new) == 3 and len(new) == len(rows) - 1
    assert {k: pytest.approx(v) for k, v in distances(rows).items()} == distances(new)


def test_reroot_leaves_other_trees(spark):
    rows = random_tree(7, 5)
    enc = encoded(spark, rows)
    assert sorted(plain(Z.reroot(enc, Z.outgroup_edges(enc, spark.createDataFrame([], "tree_id int, node_id string"))))) == sorted(plain(enc.select("node_id", "parent_id", "edge_length", "taxon")))


def test_ladder(spark):
    """A tree of depth 1,000: every node has a leaf beside it."""
    rows = [("n0", None, None, None)]
    for k in range(1, 1000):
        rows += [(f"n{k}", f"n{k - 1}", 1.0, None), (f"l{k}", f"n{k - 1}", 1.0, None)]
    enc = encoded(spark, rows)
    new = plain(Z.reroot(enc, Z.outgroup_edges(enc, spark.createDataFrame([(1, "l900")], "tree_id int, node_id string"))))
    parents = dict((n, p) for n, p, *_ in new)
    assert parents["l900"] == "root:l900" and parents["n899"] == "root:l900" and parents["n898"] == "n899" and "n0" not in parents


LABELLED = [
    ("root", None, None, "d__B"), ("p", "root", 1.0, "p__P"), ("c", "p", 1.0, "c__C;o__O"), ("a", "c", 1.0, None), ("b", "c", 1.0, None), ("q", "p", 1.0, None),
    ("x", "root", 1.0, "p__X"), ("e", "x", 1.0, None), ("f", "x", 1.0, None),
]


def test_labels(spark):
    enc = encoded(spark, LABELLED)
    red = R.relative_divergence(enc)
    assert {r["node_id"]: r["taxon"] for r in R.named_divergence(enc, red).collect()} == {"root": "d__B", "p": "p__P", "c": "o__O", "x": "p__X"}
    assert [r["node_id"] for r in R.labelled_node(enc, "c__C").collect()] == ["c"] and R.labelled_node(enc, "c__D").isEmpty()
    twice = encoded(spark, [*LABELLED, ("y", "x", 1.0, "p__P"), ("z", "y", 1.0, None)])
    with pytest.raises(PySparkException):
        R.labelled_node(twice, "p__P").collect()
    assert [r["lineage"] for r in R.first_taxa(enc, "p__").orderBy("path").collect()] == ["d__B;p__P", "d__B;p__X"]
    assert {(r["node_id"], r["taxon"]) for r in R.strip_labels(enc).collect() if r["taxon"]} == set()
    pairs = spark.createDataFrame([("a|b", 0.5), ("a|q", 0.25), ("a", 1.0), ("a|none", 0.1)], "labels string, red double")
    assert {(r["node_id"], r["red"]) for r in R.pair_divergence(enc, pairs).collect()} == {("c", 0.5), ("p", 0.25)}
    marked = spark.createDataFrame([(1, "a"), (1, "f")], "tree_id int, node_id string")
    asked = spark.createDataFrame([(1, "q"), (1, "b"), (1, "e"), (1, "a")], "tree_id int, node_id string")
    assert {(r["node_id"], r["leaf"]) for r in R.nearest_marked(enc, asked, marked).collect()} == {("q", "a"), ("b", "a"), ("e", "f"), ("a", "a")}


def test_single_reference(spark):
    enc = encoded(spark, LABELLED)
    asked = spark.createDataFrame([(1, "b"), (1, "q"), (1, "e")], "tree_id int, node_id string")
    refs = spark.createDataFrame([(1, "a"), (1, "f")], "tree_id int, node_id string")
    assert {(r["node_id"], r["reference"]) for r in R.single_reference(enc, asked, refs).collect()} == {("b", "a"), ("q", "a"), ("e", "f")}
    more = refs.unionAll(spark.createDataFrame([(1, "q")], "tree_id int, node_id string"))
    assert {r["node_id"] for r in R.single_reference(enc, asked.where("node_id = 'e'"), more).collect()} == {"e"}


def test_median_over_rootings(spark):
    rows = spark.createDataFrame([(r, n, v) for r, vs in enumerate([(0.1, 0.5), (0.3, 0.6), (0.2, 0.9)]) for n, v in zip("ab", vs, strict=True)], "rooting int, node_id string, red double")
    assert {r["node_id"]: r["red"] for r in R.median_over_rootings(rows).collect()} == {"a": 0.2, "b": 0.6}


MEDIANS = {"d__": 0.0, "p__": 0.3, "c__": 0.45, "o__": 0.6, "f__": 0.75, "g__": 0.9}
TAXA = ["d__B", "p__P", "c__C", "o__O", "f__F", "g__G", "s__S"]


def plain_terminal(taxa, parent, red):
    """The first rank, from the genus up to the one below the parent, nearer to ``red`` than the rank above."""
    order = list(MEDIANS)
    for k in range(5, parent, -1):
        if abs(red - MEDIANS[order[k]]) < abs(red - MEDIANS[order[k - 1]]):
            return k
    return parent


def test_terminal_and_internal_ranks(spark):
    rows = [(p, r / 50) for p in range(6) for r in range(51)]
    df = spark.createDataFrame(rows, "p int, r double").withColumn("t", F.array(*map(F.lit, TAXA)))
    child = F.expr("slice(t, p + 2, 2)")
    out = df.select(
        "p", "r", C.terminal_rank(F.col("t"), F.col("p"), F.col("r"), MEDIANS).alias("k"), C.terminal_branch(F.col("t"), F.col("p"), F.col("r"), MEDIANS).alias("l"),
        F.when(F.col("p") < 5, C.internal_rank(child, F.lit(0.7), F.get("t", F.col("p")), F.col("r"), MEDIANS)).alias("i"),
        F.when(F.col("p") < 4, C.internal_rank(child, F.lit(0.7), F.get("t", F.col("p")), F.col("r"), MEDIANS, True)).alias("e"),
    ).collect()
    order = list(MEDIANS)
    for r in out:
        k = plain_terminal(TAXA, r["p"], r["r"])
        assert r["k"] == k and r["l"] == [t if j <= max(k, 2) else t[:3] for j, t in enumerate(TAXA)]
        near = lambda j, v=r["r"]: abs(v - MEDIANS[order[j]])
        if r["p"] < 4:
            first = r["p"] + 1
            takes = near(first) < abs(0.7 - MEDIANS[order[first]]) and near(first) < near(r["p"])
            assert r["i"] == TAXA[first if takes else r["p"]]
            second = first + 1
            deep = near(second) < near(first) and near(second) < abs(0.7 - MEDIANS[order[second]])
            assert r["e"] == TAXA[second if deep else first if takes else r["p"]]


def backbone_tree(spark):
    """Queries q1 (beside one reference), q2 (above a named class) and q3 (among references of two classes)."""
    rows = [
        ("root", None, None, "d__B"), ("p", "root", 0.4, "p__P"), ("u", "p", 0.1, None), ("q2", "u", 0.3, None), ("c", "u", 0.2, "c__C"), ("a", "c", 0.5, None), ("v", "c", 0.2, None),
        ("q1", "v", 0.3, None), ("b", "v", 0.3, None), ("x", "root", 0.4, "p__X"), ("w", "x", 0.1, None), ("q3", "w", 0.2, None), ("y", "w", 0.1, None), ("e", "y", 0.3, None), ("f", "y", 0.3, None),
    ]
    taxa = {
        "a": ["d__B", "p__P", "c__C", "o__A", "f__A", "g__A", "s__A"], "b": ["d__B", "p__P", "c__C", "o__O", "f__F", "g__G", "s__S"],
        "e": ["d__B", "p__X", "c__E", "o__E", "f__E", "g__E", "s__E"], "f": ["d__B", "p__X", "c__F", "o__F", "f__F2", "g__F2", "s__F2"],
    }
    red = {"root": 0.0, "p": 0.3, "u": 0.36, "c": 0.47, "v": 0.62, "x": 0.3, "w": 0.4, "y": 0.5} | {k: 1.0 for k in ("q1", "q2", "q3", "a", "b", "e", "f")}
    enc = encoded(spark, rows)
    refs = spark.createDataFrame([(1, k, t) for k, t in taxa.items()], "tree_id int, node_id string, taxa array<string>")
    reds = spark.createDataFrame([(1, k, v) for k, v in red.items()], "tree_id int, node_id string, red double")
    asked = spark.createDataFrame([(1, q) for q in ("q1", "q2", "q3")], "tree_id int, node_id string")
    return enc, reds, asked, refs


def test_backbone(spark):
    enc, red, asked, refs = backbone_tree(spark)
    out = {r["query"]: r for r in C.backbone(enc, red, asked, refs, MEDIANS, "d__B").collect()}
    joined = lambda q, c: ";".join(out[q][c])
    # beside b under the class: 0.62 is nearest to the order
    assert out["q1"]["is_terminal"] and out["q1"]["red"] == 0.62 and joined("q1", "terminal") == "d__B;p__P;c__C;o__O;f__;g__;s__" == joined("q1", "red_taxa")
    assert joined("q1", "placement") == "d__B;p__P;c__C;o__;f__;g__;s__"
    # 0.36 is nearer to the phylum than to the class; the class below is lent to the terminal lineage
    assert not out["q2"]["is_terminal"] and joined("q2", "red_taxa") == "d__B;p__P;c__;o__;f__;g__;s__" and joined("q2", "terminal") == "d__B;p__P;c__C;o__;f__;g__;s__"
    # two classes below: the placement stands
    assert joined("q3", "red_taxa") == "d__B;p__X;c__;o__;f__;g__;s__" == joined("q3", "placement") and joined("q3", "terminal") == "d__B;p__;c__;o__;f__;g__;s__"
    mapping = spark.createDataFrame([("c__C", 7)], "class string, tree_id int")
    routed = {r["query"]: (r["tree_id"], r["named_by"], r["rule"]) for r in C.route_backbone(C.backbone(enc, red, asked, refs, MEDIANS, "d__B"), mapping).collect()}
    assert routed == {"q1": (7, "RED", None), "q2": (7, "TERMINAL", None), "q3": (None, None, "Rule 1")}


def test_classify_by_divergence(spark):
    enc, red, asked, refs = backbone_tree(spark)
    out = {r["query"]: (r["case"], r["rank"], ";".join(r["taxa"])) for r in C.classify_by_divergence(enc, red, asked, refs, MEDIANS, "d__B").collect()}
    assert out["q3"][:2] == ("2", "p__") and out["q1"][0] == "1b" and out["q2"][0] == "3b"
    assert out["q1"][2] == "d__B;p__P;c__C;o__O;f__;g__;s__" and out["q2"][1] == "p__" and out["q3"][2] == "d__B;p__X;c__;o__;f__;g__;s__"


def test_route_and_reconcile(spark):
    placed = spark.createDataFrame([("a", "c__X", "c__Y"), ("b", "c__", "c__Y"), ("c", "c__", "c__"), ("d", "c__N", None)], "query string, red_class string, terminal_class string")
    mapping = spark.createDataFrame([("c__X", 1), ("c__Y", 2)], "class string, tree_id int")
    assert {r["query"]: r["tree_id"] for r in C.route(placed, mapping).collect()} == {"a": 1, "b": 2, "c": None, "d": None}
    tree_rows = spark.createDataFrame([("a", TAXA), ("b", [*TAXA[:5], "g__Z", "s__"])], "query string, taxa array<string>")
    ani = spark.createDataFrame([("b", TAXA), ("c", TAXA)], "query string, taxa array<string>")
    out = {r["query"]: (r["method"], r["taxa"][5]) for r in C.reconcile(ani, tree_rows).collect()}
    assert out == {"a": ("topology", "g__G"), "b": ("ani and topology incongruent", "g__G"), "c": ("ani", "g__G")}


def test_rule_6_keeps_what_agrees(spark):
    pairs = spark.createDataFrame([("q", ["d__B", "p__P", "c__C", "o__", "f__", "g__", "s__"], ["d__B", "p__Z", "c__", "o__", "f__", "g__", "s__"])], "query string, backbone array<string>, subtree array<string>")
    assert [(r["rule"], ";".join(r["taxa"])) for r in C.merge_lineages(pairs, ["c__Q"], ["p__Q"]).collect()] == [(6, "d__B;p__;c__;o__;f__;g__;s__")]


def test_nearest_marked_leaves_make_no_pairs(spark):
    """Sums by ancestor agree with the pairs, under a star of many leaves too."""
    rows = [(1, "r", None, None)] + [(1, c, "r", 1.0) for c in "ab"] + [(1, f"a{i:02}", "a", 1.0) for i in range(30)] + [(1, f"b{i}", "b", 1.0) for i in range(3)]
    encoded = R.encode(spark.createDataFrame(rows, "tree_id int, node_id string, parent_id string, edge_length double"))
    leaves = encoded.where("is_leaf").select("tree_id", "node_id")
    marked = leaves.where("node_id IN ('a05', 'a07', 'a11')")
    got = {(x["node_id"], x["anc_id"], x["n_leaves"], x["first_leaf"]) for x in R.nearest_summary(encoded, leaves, marked).collect()}
    pairs = {}
    for x in R.nearest_marked(encoded, leaves, marked).collect():
        pairs.setdefault((x["node_id"], x["anc_id"]), []).append(x["leaf"])
    assert got == {(n, a, len(found), min(found)) for (n, a), found in pairs.items()} and len(got) == 33
