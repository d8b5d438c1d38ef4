"""The steps of a run as functions over DataFrames: what each command does with its tables, without files or programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.operators import alignment as A
from arborframe.operators import classify as C
from arborframe.operators import hits as H
from arborframe.operators import relate as J
from arborframe.operators import reroot as Z
from arborframe.operators import similarity as S
from arborframe.operators import taxonomy as T
from arborframe.operators import tree as R


def identify(first: DataFrame, second: DataFrame, genes: DataFrame, markers: DataFrame, genomes: DataFrame) -> DataFrame:
    """Status of every marker (marker_id, domain) in every genome, from the hits of two databases.

    Of the first a gene keeps its best hit of each model, of the second its best hit at all. A hit without its gene's
    sequence fails.
    """
    keys = ("genome_id", "gene_id")
    kept = H.best(first, *keys, "hmm_id").unionByName(H.best(second, *keys))
    hits = J.genomes_of(genes, kept).withColumnRenamed("hmm_id", "marker_id").join(markers.select("marker_id"), "marker_id", "left_semi")
    return H.copy_number(hits, markers, genomes).join(markers.select("marker_id", "domain"), "marker_id")


def align(aligned: DataFrame, markers: DataFrame, genomes: DataFrame, mask: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Concatenated alignments (id, seq) under a mask, and genomes (genome_id, reason) with too few residues in theirs."""
    cut = A.prune(A.apply_mask(A.concatenate(aligned, markers, genomes), mask), least)
    few = cut.where("NOT kept").select(F.col("id").alias("genome_id"), F.lit("insufficient number of amino acids in the alignment").alias("reason"))
    return cut.where("kept").drop("kept"), few


def screen(hits: DataFrame, radii: DataFrame, taxonomy: DataFrame, min_af: float) -> DataFrame:
    """(query, taxa, method) of genomes within the radius of a reference; the others go on to placement."""
    return S.with_lineage(S.screen(hits, radii, min_af), taxonomy).select("query", "taxa", F.lit("ani_screen").alias("method"))


def classify(encoded: DataFrame, red: DataFrame, queries: DataFrame, references: DataFrame, medians: dict[str, float], domain: str, by_ani: DataFrame) -> DataFrame:
    """(query, taxa, method): by divergence and topology for what was placed, similarity before it where both speak."""
    placed = C.classify_by_divergence(encoded, red, queries, references, medians, domain)
    return C.reconcile(by_ani.select("query", "taxa"), placed.select("query", "taxa"))


def root(encoded: DataFrame, taxonomy: DataFrame, outgroup: str) -> DataFrame:
    """Node tables rooted between the leaves (genome_id) of an outgroup taxon and the rest."""
    held = taxonomy.where(F.array_contains("taxa", outgroup)).select(F.col("genome_id").alias("node_id"))
    leaves = encoded.where("is_leaf").join(held, "node_id", "left_semi").select("tree_id", "node_id")
    return Z.reroot(encoded, Z.outgroup_edges(encoded, leaves))


def decorate(encoded: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Node tables whose inner nodes carry the taxa that fit them best; supports stay, old taxa go."""
    leaves = encoded.where("is_leaf").select("tree_id", "node_id", F.col("node_id").alias("genome_id"))
    long = leaves.join(T.long_form(taxonomy), "genome_id").select("tree_id", "node_id", "rank_idx", "taxon")
    labels = R.assign_labels(R.best_nodes(R.clade_statistics(encoded, long), encoded))
    names = [c for c in encoded.columns if c not in ("path", "depth", "dist_root", "is_leaf")]
    bare = encoded.select(*names, "is_leaf").drop("taxon").join(labels, ["tree_id", "node_id"], "left")
    return bare.select(*(F.when(~F.col("is_leaf"), F.col("taxon")).alias(c) if c == "taxon" else F.col(c) for c in names))


def infer_ranks(encoded: DataFrame, ingroup: str, taxonomy: DataFrame, medians: dict[str, dict[str, float]]) -> DataFrame:
    """(tree_id, node_id, red, near) of the inner nodes below an ingroup: the ranks whose medians lie near."""
    own = medians[T.domain_of(taxonomy, ingroup)]
    top = R.labelled_node(encoded, ingroup).withColumnRenamed("node_id", "top")
    inside = encoded.where("NOT is_leaf").join(top, "tree_id").where(F.array_contains("path", F.col("top"))).select("tree_id", "node_id")
    rows = inside.join(R.relative_divergence(encoded), ["tree_id", "node_id"]).select("tree_id", "node_id", "red")
    named = encoded.sparkSession.createDataFrame([(k, float(v)) for k, v in own.items()], "rank string, median_red double")
    return S.near_ranks(rows, named)


def trim(msa: DataFrame, placed: DataFrame, per_marker: int, min_taxa: float, least: float, most: float, seed: int) -> str:
    """A mask of the columns that consensus admits, at most so many of each marker, chosen by a seeded hash."""
    kept = A.owner(A.consensus(msa, min_taxa, least, most).where("kept").select("col"), placed).select("marker_id", "col")
    chosen = {r["col"] for r in A.sample_columns(kept, per_marker, seed).select("col").collect()}  # as long as a mask at most
    width = placed.agg(F.max("end")).first()[0]
    return "".join("1" if i in chosen else "0" for i in range(width))
