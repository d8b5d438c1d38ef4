"""Readers and writers on small files, and what must fail."""

from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arborframe.functions import normalize as N
from arborframe.operators import alignment as A
from arborframe.operators import hits as H
from arborframe.operators import relate as J
from arborframe.operators import taxonomy as T
from arborframe.sources import newick, sequences, summary, tables

TAXA = "d__B;p__P;c__C;o__O;f__F;g__G;s__S"


def put(path, text: str) -> str:
    path.write_text(text)
    return str(path)


def lines(path) -> list[str]:
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().split("\n") if x]


def test_fasta(spark, tmp_path):
    put(tmp_path / "a.fna", ">s1 first one\nAC\nGT\n\n>s2\nTTTT\n>s1 again\nGG\n")
    (tmp_path / "b.fna.gz").write_bytes(gzip.compress(b">z\nAAAA\n"))
    put(tmp_path / "c.fna", "")
    rows = {(r["seq_id"], r["annotation"], r["seq"]) for r in sequences.read_fasta(spark, f"{tmp_path}/*").collect()}
    assert rows == {("s1", "again", "GG"), ("s2", "", "TTTT"), ("z", "", "AAAA")}
    assert sequences.read_fasta(spark, f"{tmp_path}/a.fna", last_wins=False).count() == 3
    with pytest.raises(ValueError):
        sequences.read_fasta(spark, "reads.fastq.gz")
    seqs = spark.createDataFrame([("s1", "note", "A" * 100), ("s2", "", "CC")], "seq_id string, annotation string, seq string")
    sequences.write_fasta(seqs.coalesce(1), f"{tmp_path}/out")
    assert lines(tmp_path / "out") == [">s1 note", "A" * 80, "A" * 20, ">s2", "CC"]
    assert {(r["seq_id"], r["seq"]) for r in sequences.read_fasta(spark, f"{tmp_path}/out").collect()} == {("s1", "A" * 100), ("s2", "CC")}


def test_alignment_text(spark, tmp_path):
    put(tmp_path / "a.sto", "# STOCKHOLM 1.0\n\ng1 AC-GT\ng2 A--GT\n#=GC RF xx.xx\n\ng1 TT\ng2 T-\n#=GC RF x.\n//\n")
    assert {r["seq_id"]: r["seq"] for r in sequences.read_aligned(spark, f"{tmp_path}/a.sto").collect()} == {"g1": "ACGTT", "g2": "A-GTT"}
    put(tmp_path / "b.sto", "g1 ACG\n//\n")
    with pytest.raises(PySparkException):
        sequences.read_aligned(spark, f"{tmp_path}/b.sto").collect()


def test_genome_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("g1.fna", ">a\nA\n"), ("g2.fna", ""), ("deep/g3.fna", ">b\nC\n"), ("g4.txt", "x")):
        put(tmp_path / "in" / name, text)
    found = lambda **k: sorted(r["genome_id"] for r in sequences.genome_files(spark, f"{tmp_path}/in", **k).collect())
    assert found() == ["g1"] and found(recursive=True) == ["g1", "g3"]
    kept, empty = sequences.gene_files(spark, f"{tmp_path}/in", ".fna")
    assert sorted(r["genome_id"] for r in kept.collect()) == ["g1", "g3"] and [r["genome_id"] for r in empty.collect()] == ["g2"]
    refs = spark.createDataFrame([("RS_g3",)], "genome_id string")
    assert tables.assert_new(sequences.genome_files(spark, f"{tmp_path}/in"), refs).count() == 1
    with pytest.raises(PySparkException):
        tables.assert_new(sequences.genome_files(spark, f"{tmp_path}/in", recursive=True), refs).collect()
    assert sorted(r[0] for r in tables.reference_ids(refs).collect()) == ["RS_g3", "g3"]


def test_digests(spark, tmp_path):
    put(tmp_path / "a.txt", "This is a test!\nFoo\n")
    put(tmp_path / "b.txt", "b")
    found = sequences.digests(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[-1]: r["sha1"] for r in found.collect()}["a.txt"] == "ac4ecc7c839524f886136fbe2e3e17ab6a806a25"
    assert sequences.same_digests(found, found).isEmpty()
    assert sequences.same_digests(found, found.withColumn("sha1", F.lit("x"))).count() == 2 and sequences.same_digests(found, found.limit(1)).count() == 1
    whole = "".join(hashlib.sha1(p.read_bytes()).hexdigest() for p in sorted(tmp_path.glob("*.txt")))
    assert tables.directory_digest(spark, str(tmp_path)) == hashlib.sha1(whole.encode()).hexdigest()
    assert [r["value"] for r in sequences.digest_lines(spark, str(tmp_path)).collect()][1] == f"b.txt: {hashlib.md5(b'b').hexdigest()}"
    listing = found.select(F.regexp_replace("path", "^.*/", "").alias("name"))
    assert tables.missing_and_extra(listing, ["a.txt", "c.txt"]) == (["c.txt"], ["b.txt"])


def test_batch_file(spark, tmp_path):
    path = put(tmp_path / "batch.tsv", "p1\tg1\n\np2\tg2\t4\np3\tg3\t7\n\tg4\np5\t\nonly\np6\tg6\np7\tg6\n")
    rows, bad = tables.read_batch(spark, path)
    assert {(r["genome_id"], r["translation_table"]) for r in rows.collect()} == {("g1", None), ("g2", 4)}
    assert sorted(r["reason"] for r in bad.collect()) == ["blank id", "blank path", "column count", "repeated id", "repeated id", "unknown table"]


def test_taxonomy_file(spark, tmp_path):
    path = put(tmp_path / "t.tsv", f"RS_GCF_1.1\t{TAXA};\ng2\td__A; p__Q\ng2\td__A;p__R\n")
    assert {r["genome_id"]: ";".join(r["taxa"]) for r in tables.read_taxonomy(spark, path).collect()} == {"RS_GCF_1.1": TAXA, "g2": "d__A;p__R"}
    assert {r["genome_id"] for r in tables.read_taxonomy(spark, path, canonical=True).collect()} == {"G1", "g2"}
    with pytest.raises(PySparkException):
        tables.read_taxonomy(spark, put(tmp_path / "bad.tsv", "one column\n")).collect()
    tables.write_taxonomy(tables.read_taxonomy(spark, path).coalesce(1), f"{tmp_path}/out")
    assert sorted(lines(tmp_path / "out")) == [f"RS_GCF_1.1\t{TAXA}", "g2\td__A;p__R"]


def test_small_tables(spark, tmp_path):
    radii = tables.read_table(spark, put(tmp_path / "r.tsv", "s__A\tGB_GCA_1.1\t95.5\ns__B\tRS_GCF_2.1\t96\n"), "radii")
    assert {(r["ref"], r["ani"]) for r in tables.radii_by_accession(radii).collect()} == {("GCA_1.1", 95.5), ("GCF_2.1", 96.0)}
    hits = spark.createDataFrame([("q", "RS_GCF_2.1", 97.0)], "query string, ref string, ani double")
    assert tables.checked_radius(hits, radii).first()["radius"] == 96.0
    with pytest.raises(PySparkException):
        tables.checked_radius(hits.withColumn("ref", F.lit("none")), radii).collect()
    assert [(r["class"], r["tree_id"]) for r in tables.read_classes(spark, put(tmp_path / "c.txt", "c__A   3\nc__B\t4\n\n")).collect()] == [("c__A", "3"), ("c__B", "4")]
    assert {tuple(r["members"]) for r in tables.read_divergence(spark, put(tmp_path / "d.tsv", "a|b\t0.5\nc\t1.0\n")).collect()} == {("a", "b"), ("c",)}
    assert tables.read_mask(spark, put(tmp_path / "m.txt", "0110\n")) == "0110"
    assert tables.read_if_there(spark, f"{tmp_path}/none.tsv", "reasons").isEmpty()
    assert tables.read_if_there(spark, put(tmp_path / "f.tsv", "g1\tno genes\n"), "reasons").first()["reason"] == "no genes"
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        tables.read_table(spark, put(tmp_path / "bad.tsv", "s__A\tr\tnot a number\n"), "radii").collect()
    table = tables.read_translation(spark, put(tmp_path / "tln.tsv", "best_translation_table\t11\ncoding_density_4\t0.5\ncoding_density_11\t0.9\n")).first()
    assert (table["best_translation_table"], table["coding_density_4"], table["coding_density_11"]) == (11.0, 0.5, 0.9)
    with pytest.raises(PySparkException):
        tables.read_translation(spark, put(tmp_path / "tln2.tsv", "best_translation_table\televen\n")).collect()
    assert tables.read_table(spark, put(tmp_path / "s.tsv", "g1\t11\ng2\t4\n"), "translation_summary").agg(F.sum("translation_table")).first()[0] == 15


def test_hits_and_markers(spark, tmp_path):
    rows = [("x", "y", 0.1, 10.0), ("a", "b", 0.1, 10.0), ("a", "c", 0.1, 20.0)]
    hits = spark.createDataFrame(rows, "gene_id string, hmm_id string, e_val double, bit_score double")
    assert {r["gene_id"]: r["hits"] for r in H.hit_text(hits, "gene_id").collect()} == {"a": "c,0.1,20.0;b,0.1,10.0", "x": "y,0.1,10.0"}
    tables.write_table(H.hit_text(hits, "gene_id"), f"{tmp_path}/hits", ["gene_id"])
    back = tables.read_hits(spark, f"{tmp_path}/hits")
    assert sorted(map(tuple, back.collect())) == sorted(rows) and {tuple(r) for r in H.best(back, "gene_id").collect()} == {("a", "c", 0.1, 20.0), ("x", "y", 0.1, 10.0)}
    assert [r["hmm_id"] for r in H.lookup(hits, "a", "c").collect()] == ["c"] and H.lookup(hits, "a").count() == 2 and H.lookup(hits, "n").isEmpty()
    put(tmp_path / "tab.txt", "# comment\ng1 - m TIGR1.1 1e-5 30.5 0 x\n\n")
    assert tuple(tables.read_raw_hits(spark, f"{tmp_path}/tab.txt").first()) == ("g1", "TIGR1", 1e-5, 30.5)
    put(tmp_path / "pf.txt", "# c\ng1 1 9 1 9 PF00001.12 name Domain 1 9 10 40.5 2e-7 1 No\n")
    assert tuple(tables.read_raw_hits(spark, f"{tmp_path}/pf.txt", pfam=True).first()) == ("g1", "PF00001", 2e-7, 40.5)
    put(tmp_path / "M1.2.hmm", "HMMER3/f\nNAME  M1\nDESC  a marker\nLENG  120\nALPH amino\n")
    assert tuple(tables.read_markers(spark, f"{tmp_path}/*.hmm").first()) == ("M1.2", "M1", "a marker", 120)
    put(tmp_path / "n.tsv", "name\tn_unq\tn_mul\tn_muq\tn_mis\tl1\tl2\tl3\tl4\ng1\t2\t0\t0\t1\tA,B\t\t\tC\n")
    assert {(r["marker_id"], r["status"]) for r in tables.read_copy_number(spark, f"{tmp_path}/n.tsv").collect()} == {("A", "unq"), ("B", "unq"), ("C", "mis")}
    put(tmp_path / "n2.tsv", "name\tn_unq\tn_mul\tn_muq\tn_mis\tl1\tl2\tl3\tl4\ng1\t3\t0\t0\t1\tA,B\t\t\tC\n")
    with pytest.raises(PySparkException):
        tables.read_copy_number(spark, f"{tmp_path}/n2.tsv").collect()
    merged = {r["hmm_id"]: (r["n_genes"], r["n_hits"]) for r in H.merged_by_model(hits, hits.withColumn("hmm_id", F.lit("b"))).collect()}
    assert merged == {"b": (2, 4), "c": (1, 1), "y": (1, 1)}
    genes = spark.createDataFrame([("g", "a", "VV"), ("g", "x", "AA")], "genome_id string, gene_id string, seq string")
    assert J.genomes_of(genes, hits.withColumn("genome_id", F.lit("g"))).count() == 3
    with pytest.raises(PySparkException):
        J.genomes_of(genes.limit(1), hits.withColumn("genome_id", F.lit("g"))).collect()


def test_copy_number_of_two_genomes(spark):
    markers = spark.createDataFrame([(m,) for m in ("PFAM_1", "PFAM_2", "PFAM_3", "TIGR_1", "TIGR_2")], "marker_id string")
    seqs = {1: {"a": "VVVVVV", "b": "AAVVPP", "c": "AAVVPP*", "x": "AAAAAA"}, 2: {"a": "VVVVVV", "w": "AAAVVV", "x": "AAAVVV", "y": "VVVAAA", "z": "VVVAAA"}}
    rows = [(1, "a", "PFAM_1", 0.1, 50.0), (1, "b", "PFAM_2", 0.1, 200.0), (1, "c", "PFAM_2", 0.1, 100.0), (1, "x", "TIGR_1", 0.1, 50.0), (2, "a", "PFAM_2", 0.1, 50.0), (2, "w", "PFAM_1", 0.1, 50.0), (2, "z", "PFAM_1", 0.1, 50.0)]
    rows += [(2, "y", "PFAM_3", 0.1, 50.0), (2, "x", "PFAM_3", 0.1, 50.0), (2, "w", "TIGR_1", 0.1, 100.0), (2, "x", "TIGR_1", 0.1, 200.0), (2, "y", "TIGR_2", 0.01, 50.0), (2, "z", "TIGR_2", 0.05, 50.0)]
    hits = spark.createDataFrame([(*r, seqs[r[0]][r[1]]) for r in rows], "genome_id int, gene_id string, marker_id string, e_val double, bit_score double, seq string")
    status = H.copy_number(hits, markers, hits)
    found = {(r["genome_id"], r["marker_id"]): (r["status"], r["gene_id"]) for r in status.collect()}
    assert found[1, "PFAM_2"] == ("muq", "b") and found[1, "PFAM_3"] == ("mis", None) and found[1, "TIGR_1"] == ("unq", "x")
    assert found[2, "TIGR_1"] == ("muq", "x") and found[2, "TIGR_2"] == ("muq", "y") and found[2, "PFAM_1"] == ("mul", None) and found[2, "PFAM_2"] == ("unq", "a")
    table = {r["genome_id"]: (r["n_unq"], r["n_mul"], r["n_muq"], r["n_mis"]) for r in H.status_table(status).collect()}
    assert table == {1: (2, 0, 1, 2), 2: (1, 2, 2, 0)}


def test_similarity_summary(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "query\tref\tani\taf\tlineage\nq1\tr1\t95.5\t0.8\tX\nq1\tr2\t96.5\t0.9\tN/A\nq2\tr1\t90\t0.5\tX\n")
    assert {r["query"]: (r["ref"], r["lineage"]) for r in tables.read_similarity(spark, path).collect()} == {"q1": ("r2", None), "q2": ("r1", "X")}
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        tables.read_table(spark, put(tmp_path / "b.tsv", "query\tanother\tani\taf\tlineage\nq\tr\t1\t1\tX\n"), "similarity", header=True).collect()


def test_genes(spark, tmp_path):
    put(tmp_path / "g.gff", "##gff-version 3\n# Model Data: transl_table=11;x\nc1\tP\tCDS\t1\t9\t1.0\t+\t0\tID=1\nc1\tP\tCDS\t5\t20\t1.0\t-\t0\tID=2\nc2\tP\tCDS\t3\t4\t1.0\t+\t0\tID=3\n")
    genes, table = tables.read_genes(spark, f"{tmp_path}/g.gff")
    assert table.first()["translation_table"] == 11 and genes.count() == 3
    named = genes.withColumn("genome_id", F.lit("g"))
    assert {r["contig"]: r["coding_bases"] for r in H.coding_bases(named).collect()} == {"c1": 19, "c2": 1}
    contigs = spark.createDataFrame([("g", "c1", 40), ("g", "c2", 10), ("g", "c3", 50)], "genome_id string, contig string, length long")
    assert H.coding_density(named, contigs).first()["density"] == 0.2


def test_metadata_and_logs(spark, tmp_path):
    rows = {r["key"]: r["numbers"] for r in tables.read_metadata(spark, put(tmp_path / "m.txt", 'VERSION_DATA=r226\nRED={"p__": 0.3}\nno value here\n')).collect()}
    assert rows == {"VERSION_DATA": None, "RED": {"p__": 0.3}}
    (tmp_path / "wide.tsv.gz").write_bytes(gzip.compress(f"accession\tother\tncbi_taxonomy\tgtdb_taxonomy\tgtdb_genome_representative\nR1\tx\td__B;p__N\t{TAXA}\tR1\nG2\tx\td__B;p__\t{TAXA}\tR1\n".encode()))
    names = {"accession": "accession", "gtdb_taxonomy": "gtdb_taxonomy", "ncbi_taxonomy": "ncbi_taxonomy", "gtdb_genome_representative": "representative"}
    held = tables.metadata_lookups(tables.read_wide(spark, f"{tmp_path}/wide.tsv.gz", names))
    assert held["gtdb"].count() == 2 and held["species"].first()["species"] == "s__S" and held["cluster"].count() == 2 and held["ncbi"].count() == 2
    assert sorted((r["rank_idx"], r["taxon"]) for r in held["ncbi_named"].collect()) == [(0, "d__B"), (0, "d__B"), (1, "p__N")] and held["gtdb_named"].count() == 14
    votes = {(r["cluster"], r["rank_idx"]): (r["winner"], r["votes"]) for r in T.votes(tables.species_votes(held)).collect()}
    assert votes == {("s__S", 0): ("d__B", 2), ("s__S", 1): ("p__N", 1)}
    with pytest.raises(ValueError):
        tables.read_wide(spark, f"{tmp_path}/wide.tsv.gz", {"none": "none"})
    steps = spark.createDataFrame([("identify", "completed", "2024-01-01T00:00:00", "2024-01-01T00:01:05"), ("align", "started", "2024-01-01T00:02:00", None)], "name string, status string, starts_at string, ends_at string")
    tables.write_run_log(steps, f"{tmp_path}/log", "2.5", "run all")
    log = tables.read_run_log(spark, f"{tmp_path}/log", ("identify", "align"))
    assert tables.completed(log, "identify") and not tables.completed(log, "align")
    assert {r["name"]: r["seconds"] for r in tables.durations(log).collect()} == {"identify": 65, "align": None}
    with pytest.raises(PySparkException):
        tables.read_run_log(spark, f"{tmp_path}/log", ("identify",)).collect()
    assert tables.recent_enough("r226", "r220") and not tables.recent_enough("r95", "r220")


def test_placements(spark, tmp_path):
    put(tmp_path / "p.json", '{"tree": "(a,b);", "fields": ["edge_num", "likelihood"], "placements": [{"p": [[3, -1.5], [4, -2.5]], "nm": [["q", 1]]}]}')
    rows = tables.read_placements(spark, f"{tmp_path}/p.json").orderBy("k").collect()
    assert [(r["name"], r["k"], r["placement"]["edge_num"]) for r in rows] == [("q", 0, 3.0), ("q", 1, 4.0)]


def test_newick(spark, tmp_path):
    put(tmp_path / "a.tree", "((x:1.5,'y z':2)\n'0.9:p__P':3,\nw);\n")
    nodes = newick.read_newick(spark, f"{tmp_path}/a.tree")
    assert {r["leaf_label"] for r in nodes.collect() if r["leaf_label"]} == {"x", "y z", "w"}
    assert [(r["support"], r["taxon"]) for r in nodes.where("taxon IS NOT NULL").collect()] == [(0.9, "p__P")]
    labels = nodes.withColumn("label", F.coalesce("leaf_label", N.create_label(F.col("support"), F.col("taxon"), F.col("aux"))))
    text = newick.write_newick(labels).first()["newick"]
    assert text == "((x:1.5,'y z':2)'0.9:p__P':3,w);"
    for bad in ("((a,b);", "a,b;", "(a,b));"):
        with pytest.raises(ValueError):
            newick.parse(bad)


def test_alignment_outputs(spark, tmp_path):
    msa = spark.createDataFrame([("g2", "ACDE"), ("g1", "-C-E"), ("g3", "----")], "id string, seq string")
    taxonomy = spark.createDataFrame([("g1", ["d__B", "p__P"])], "genome_id string, taxa array<string>")
    sequences.write_alignment(msa, taxonomy, f"{tmp_path}/msa", "gzip")
    text = "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((tmp_path / "msa").glob("part-*.gz")))
    assert text.split() == [">g1", "d__B;p__P", "-C-E", ">g2", "ACDE", ">g3", "----"]
    placed = A.offsets(spark.createDataFrame([("m1", 1), ("m2", 3)], "marker_id string, length long"))
    slices = A.marker_slices(msa, placed)
    assert {(r["marker_id"], r["id"]): r["seq"] for r in slices.where("id = 'g2'").collect()} == {("m1", "g2"): "A", ("m2", "g2"): "CDE"}
    sequences.write_by_marker(slices.where("seq <> '-' AND seq <> '---'"), f"{tmp_path}/by")
    assert sorted(p.name for p in (tmp_path / "by").glob("marker_id=*")) == ["marker_id=m1", "marker_id=m2"]
    assert {r["id"]: (r["percent"], r["kept"]) for r in A.trim_statistics(msa, 50.0).collect()} == {"g1": (50.0, True), "g2": (100.0, True), "g3": (0.0, False)}
    kept = spark.createDataFrame([("m1", c) for c in range(4)] + [("m2", c) for c in range(2)], "marker_id string, col int")
    assert tuple(A.columns_per_marker(kept).first()) == (3.0, 1.0)
    sample = A.sample_columns(kept, 3, seed=1)
    assert {r["marker_id"]: r["count"] for r in sample.groupBy("marker_id").count().collect()} == {"m1": 3, "m2": 2}
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, A.sample_columns(kept.repartition(3), 3, seed=1).collect()))
    routed = spark.createDataFrame([("g1", 1), ("g2", 2)], "query string, tree_id int")
    assert [r["id"] for r in sequences.sub_alignment(msa, routed, 2).collect()] == ["g2"]
    owners = A.owner(spark.range(300).select(F.col("id").alias("col")), A.offsets(spark.createDataFrame([(1, 70), (2, 0), (3, 200)], "marker_id int, length long")))
    assert {r["marker_id"]: r["count"] for r in owners.groupBy("marker_id").count().collect()} == {1: 70, 3: 200}


def test_summary(spark, tmp_path):
    lineage = spark.createDataFrame([("g2", TAXA.split(";"), "topology"), ("g1", [*TAXA.split(";")[:6], "s__"], "ani")], "query string, taxa array<string>, method string")
    ani = spark.createDataFrame([("g1", "r1", 95.0, TAXA.split(";"), 97.25, 0.9)], "query string, ref string, radius double, ref_taxa array<string>, ani double, af double")
    placement = spark.createDataFrame([("g2", TAXA.split(";"), 0.1234567)], "query string, taxa array<string>, red double")
    percent = spark.createDataFrame([("g1", 50.5), ("g2", 60.0)], "query string, percent double")
    tln = spark.createDataFrame([("g1", 11)], "query string, translation_table int")
    notes = spark.createDataFrame([("g2", "b"), ("g2", "a"), ("g2", "a")], "query string, warning string")
    rows = summary.assemble(lineage, ani, placement, percent, tln, notes)
    summary.write_summary(rows, f"{tmp_path}/s")
    assert lines(tmp_path / "s")[0].split("\t") == list(summary.SUMMARY) and [x.split("\t")[0] for x in lines(tmp_path / "s")[1:]] == ["g1", "g2"]
    assert lines(tmp_path / "s")[2].split("\t")[-2:] == ["0.12346", "a;b"] and lines(tmp_path / "s")[1].split("\t")[-1] == "N/A"
    back = summary.read_summary(spark, f"{tmp_path}/s")
    assert {r["user_genome"]: (r["closest_genome_ani"], r["translation_table"], r["red_value"]) for r in back.collect()} == {"g1": (97.25, 11, None), "g2": (None, None, 0.12346)}
    assert {r["genome_id"]: len(r["taxa"]) for r in summary.lineages(back).collect()} == {"g1": 7, "g2": 7}
    assert [r["genome_id"] for r in summary.classified(back).collect()] == ["g2"]
    assert {r["user_genome"]: r["row"].get("warnings") for r in summary.as_records(back).collect()} == {"g1": None, "g2": "a;b"}
    filtered = spark.createDataFrame([("g2", "too few"), ("g3", "no markers")], "genome_id string, reason string")
    failed = spark.createDataFrame([("g4", "no genes"), ("g3", "no genes")], "genome_id string, reason string")
    full = {r["user_genome"]: (r["classification"], r["warnings"]) for r in summary.complete(back, filtered, failed, "Bacteria").collect()}
    assert full["g2"] == (TAXA, "a;b;too few") and full["g3"] == ("Unclassified Bacteria", "no markers") and full["g4"] == ("Unclassified", "no genes") and full["g1"][1] is None
    (tmp_path / "bad").mkdir()
    put(tmp_path / "bad" / "part-0", "\t".join([*list(summary.SUMMARY)[:-1], "other"]) + "\n")
    with pytest.raises(PySparkException):
        summary.read_summary(spark, f"{tmp_path}/bad").collect()
    with pytest.raises(PySparkException):
        summary.lineages(back.withColumn("classification", F.lit("d__B"))).collect()
    twice = spark.createDataFrame([("g1",), ("g1",)], "user_genome string")
    summary.write_summary(twice.withColumn("classification", F.lit(TAXA)), f"{tmp_path}/twice")
    with pytest.raises(PySparkException):
        summary.read_summary(spark, f"{tmp_path}/twice").collect()


def test_run_folders(spark, tmp_path):
    put(tmp_path / "x.bac.classify.tree.3.tree", ";")
    put(tmp_path / "x.bac.classify.tree.12.tree", ";")
    put(tmp_path / "x.backbone.bac.classify.tree", ";")
    found = [p.rsplit("/", 1)[-1] for p in tables.class_trees(spark, str(tmp_path), "x", "bac")]
    assert found == ["x.backbone.bac.classify.tree", "x.bac.classify.tree.3.tree", "x.bac.classify.tree.12.tree"]
    put(tmp_path / "x.bac.classify.tree", ";")
    assert tables.class_trees(spark, str(tmp_path), "x", "bac") == [f"{tmp_path}/x.bac.classify.tree"]
    assert tables.exists(spark, f"{tmp_path}/x.*") and not tables.exists(spark, f"{tmp_path}/none")
    spark.range(3).write.parquet(f"{tmp_path}/tmp")
    tables.publish(spark, f"{tmp_path}/tmp", f"{tmp_path}/final")
    assert spark.read.parquet(f"{tmp_path}/final").count() == 3 and tables.remove(spark, f"{tmp_path}/final") and not tables.remove(spark, f"{tmp_path}/final")


def test_package_problems(spark):
    taxonomy = spark.createDataFrame([("a", ["d__B"]), ("b", ["d__B"])], "genome_id string, taxa array<string>")
    msa = spark.createDataFrame([("a", "ACG"), ("b", "ACG"), ("c", "AC")], "id string, seq string")
    leaves = spark.createDataFrame([("a",)], "leaf_label string")
    radii = spark.createDataFrame([("a", 95.0), ("b", 95.0)], "ref string, ani double")
    assert {tuple(r) for r in tables.package_problems(taxonomy, msa, leaves, radii).collect()} == {("only in alignment", "c"), ("not in tree", "b"), ("length", "c")}


def test_keyed_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert J.unique(rows, "k").count() == 2
    with pytest.raises(PySparkException):
        J.unique(rows.unionAll(rows.limit(1)), "k").collect()
    assert J.lost(rows, rows.where("k = 'a'"), "k", step="placing").collect()[0].asDict() == {"k": "b", "step": "placing"}
    assert tables.same_ids(rows, rows.withColumn("v", F.lit(0)), "k") and not tables.same_ids(rows, rows.limit(1), "k")
    routed = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", None)], "query string, tree_id int")
    assert [tuple(r) for r in J.batches(routed).collect()] == [(2, 2), (1, 1)]
    assert sorted(r["chunk"] for r in J.chunked(spark.range(1000), 4, "id").groupBy("chunk").count().collect()) == [0, 1, 2, 3]
    taxonomy = spark.createDataFrame([("g", TAXA.split(";")), ("h", ["d__B", "p__P", "c__D", "o__X", "f__", "g__", "s__"])], "genome_id string, taxa array<string>")
    assert [r["taxon"] for r in J.taxa_of_classes(taxonomy, ["c__C"], 3).collect()] == ["o__O"]
    assert {r["k"]: r["v"] for r in J.first_in(spark.createDataFrame([("a", 5, 2), ("a", 6, 1), ("b", 7, 9)], "k string, v int, depth int"), "k", "v", "depth").collect()} == {"a": 6, "b": 7}
    assert [r["id"] for r in J.top(spark.range(10), 2, F.desc("id"), skip=1).collect()] == [8, 7]


def test_functions(spark):
    row = lambda *cols: spark.range(1).select(*cols).first()
    text = lambda t: F.lit(t)
    assert row(N.taxa_at_ranks(text("d__B; p__P")))[0] == {"d__": "d__B", "p__": "p__P"}
    assert [row(N.valid_species(text(t)))[0] for t in ("s__Escherichia coli K12", "s__", "s__Candidatus Foo bar", "s__Foo sp. X")] == ["s__Escherichia coli", None, "s__Foo bar", None]
    assert row(N.species_with_genus(F.split(text("d__B;p__P;c__C;o__O;f__F;g__Esch;s__coli"), ";")))[0][6] == "s__Esch coli"
    assert row(N.rank_medians(F.create_map(text("Phylum"), F.lit(0.3), text("genus"), F.lit(0.9), text("other"), F.lit(1.0))))[0] == {"p__": 0.3, "g__": 0.9}
    for v, d in ((2.675, 2), (0.125, 2), (0.375, 2), (1.005, 2), (2.5, 0), (3.14159, 3), (-0.125, 2), (96.985, 2)):
        assert row(N.half_even(F.lit(v), d))[0] == round(v, d), v
    assert [row(N.bad_path(text(t)))[0] for t in ("/a/b", "/a b", "")] == [None, "space in path", "blank path"]
    assert row(N.is_user_genome(text("U_1")), N.is_user_genome(text("GU_1")))[:] == (True, False)
    assert row(N.create_label(F.lit(1.0), text("o__X"), text("foo")), N.create_label(F.lit(None).cast("double"), text("o__X"), F.lit(None).cast("string")))[:] == ("1.0:o__X|foo", "o__X")
    related = "r1, s__A, 95.00, 97.50, 0.900; r2, s__B, 95.00, x, 0.9; r3, s__C"
    assert [tuple(x) for x in row(N.parse_related(text(related)))[0]] == [("r1", 97.5, 0.9)]
    assert row(N.without_related(text("r1, a; r2, b"), text("r1")), N.without_related(text("r1, a"), text("r1")))[:] == ("r2, b", None)
    assert row(N.warnings((F.lit(True), "b"), (F.lit(False), "c"), (F.lit(True), "a")), N.warnings((F.lit(False), "x")))[:] == ("a;b", None)
    assert row(N.strip_hmm(text("PF1.HMM.x")), N.itol_label(text("a;b")))[:] == ("PF1.x", "a|b")
    assert ";".join(row(N.fill_missing(F.array(text("d__B"), text("c__C"))))[0]) == "d__B;p__;c__C;o__;f__;g__;s__"
    assert ";".join(row(N.fill_trailing(F.array(text("d__B"), text("p__P"))))[0]) == "d__B;p__P;c__;o__;f__;g__;s__"
    assert row(N.split_lineage(text("d__B; p__P;")))[0] == ["d__B", "p__P"]
