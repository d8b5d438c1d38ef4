"""The steps of a run on a small package."""

from __future__ import annotations

import pytest

from arborframe.operators import alignment as A
from arborframe.operators import tree as R
from arborframe.plans import workflows as W

TAXA = {"a": "d__B;p__P;c__C;o__O;f__F;g__G;s__A", "b": "d__B;p__P;c__C;o__O;f__F;g__G;s__B", "e": "d__B;p__X;c__D;o__E;f__E;g__E;s__E", "f": "d__B;p__X;c__D;o__E;f__E;g__E;s__F"}
NODES = [("root", None, None), ("x", "root", 1.0), ("y", "root", 1.0), ("a", "x", 1.0), ("b", "x", 1.0), ("e", "y", 1.0), ("f", "y", 1.0)]


def package(spark):
    taxonomy = spark.createDataFrame([(k, v.split(";")) for k, v in TAXA.items()], "genome_id string, taxa array<string>")
    encoded = R.encode(spark.createDataFrame([(1, *r, None) for r in NODES], "tree_id int, node_id string, parent_id string, edge_length double, taxon string"))
    return taxonomy, encoded


def test_identify_and_align(spark):
    schema = "genome_id string, gene_id string, hmm_id string, e_val double, bit_score double"
    first = spark.createDataFrame([("g", "x", "P1", 0.1, 50.0), ("g", "x", "P2", 0.1, 20.0)], schema)
    second = spark.createDataFrame([("g", "y", "T1", 0.1, 50.0), ("g", "y", "T2", 0.1, 20.0), ("h", "z", "T1", 0.1, 9.0)], schema)
    genes = spark.createDataFrame([("g", "x", "VV"), ("g", "y", "AA"), ("h", "z", "CC")], "genome_id string, gene_id string, seq string")
    markers = spark.createDataFrame([("P1", "d"), ("P2", "d"), ("T1", "d"), ("T2", "d")], "marker_id string, domain string")
    genomes = spark.createDataFrame([("g",), ("h",)], "genome_id string")
    out = {(r["genome_id"], r["marker_id"]): r["status"] for r in W.identify(first, second, genes, markers, genomes).collect()}
    assert out == {("g", "P1"): "unq", ("g", "P2"): "unq", ("g", "T1"): "unq", ("g", "T2"): "mis", ("h", "P1"): "mis", ("h", "P2"): "mis", ("h", "T1"): "unq", ("h", "T2"): "mis"}
    aligned = spark.createDataFrame([("g", 1, "ACD"), ("g", 2, "EF"), ("h", 2, "-F")], "id string, marker_id int, seq string")
    lengths = spark.createDataFrame([(1, 3), (2, 2)], "marker_id int, length int")
    kept, few = W.align(aligned, lengths, aligned, "10111", 0.5)
    assert {r["id"]: r["seq"] for r in kept.collect()} == {"g": "ADEF"} and [r["genome_id"] for r in few.collect()] == ["h"]
    msa = spark.createDataFrame([("a", "AAVWAWGG"), ("b", "AAVW-WGA"), ("c", "--AW-GGG")], "id string, seq string")
    placed = A.offsets(spark.createDataFrame([("m1", 4), ("m2", 4)], "marker_id string, length long"))
    mask = W.trim(msa, placed, 1, 0.5, 0.25, 0.95, 7)
    assert len(mask) == 8 and mask[:4] == "0010" and mask[4:].count("1") == 1


def test_root_decorate_and_ranks(spark):
    taxonomy, encoded = package(spark)
    rooted = {r["node_id"]: r["parent_id"] for r in W.root(encoded, taxonomy, "g__E").collect()}
    assert rooted["y"] == "root:y" and rooted["x"] == "root:y" and "root" not in rooted
    labels = {r["node_id"]: r["taxon"] for r in W.decorate(encoded, taxonomy).collect()}
    assert labels["root"] == "d__B" and labels["x"] == "p__P; c__C; o__O; f__F; g__G" and labels["y"] == "p__X; c__D; o__E; f__E; g__E" and labels["a"] is None
    marked = R.encode(W.decorate(encoded, taxonomy))
    ranks = {r["node_id"]: (r["red"], r["near"]) for r in W.infer_ranks(marked, "p__P", taxonomy, {"d__B": {"phylum": 0.45, "class": 0.5, "genus": 0.9}}).collect()}
    assert ranks == {"x": (0.5, "class&phylum")}
    with pytest.raises(ValueError):
        W.infer_ranks(marked, "p__N", taxonomy, {})


def test_screen_and_classify(spark):
    taxonomy, encoded = package(spark)
    hits = spark.createDataFrame([("q", "a", 96.0, 0.9), ("r", "b", 90.0, 0.9)], "query string, ref string, ani double, af double")
    radii = spark.createDataFrame([("a", 95.0), ("b", 95.0)], "ref string, ani double")
    found = W.screen(hits, radii, taxonomy, 0.5).collect()
    assert [(r["query"], r["taxa"][6], r["method"]) for r in found] == [("q", "s__A", "ani_screen")]
    decorated = W.decorate(encoded, taxonomy).select("tree_id", "node_id", "parent_id", "edge_length", "taxon")
    placed = R.encode(decorated.unionAll(spark.createDataFrame([(1, "q", "x", 1.0, None), (1, "r", "y", 1.0, None)], "tree_id int, node_id string, parent_id string, edge_length double, taxon string")))
    refs = taxonomy.selectExpr("1 AS tree_id", "genome_id AS node_id", "taxa")
    asked = spark.createDataFrame([(1, "q"), (1, "r")], "tree_id int, node_id string")
    medians = {"d__": 0.0, "p__": 0.3, "c__": 0.45, "o__": 0.6, "f__": 0.75, "g__": 0.9}
    out = {r["query"]: r["method"] for r in W.classify(placed, R.relative_divergence(placed), asked, refs, medians, "d__B", W.screen(hits, radii, taxonomy, 0.5)).collect()}
    assert set(out) == {"q", "r"} and out["r"] == "topology" and out["q"].startswith("ani and topology")
