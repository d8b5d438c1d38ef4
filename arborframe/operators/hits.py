"""Marker hits of genes: best hits, copy number, domain votes and coding density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running

#: What makes one hit more significant than another, as a struct whose minimum is the best hit.
HIT = ("bit_score", "e_val", "hmm_id", "gene_id")


def significance() -> Column:
    return F.struct((-F.col("bit_score")).alias("neg_bit"), "e_val", "hmm_id", "gene_id")


def best(hits: DataFrame, *keys: str) -> DataFrame:
    """The most significant hit of each key: highest bit score, lowest e-value, then ids. One partial-final aggregate."""
    top = hits.groupBy(*keys).agg(F.min(significance()).alias("top"))
    rest = [c for c in ("hmm_id", "gene_id") if c not in keys]
    return top.select(*keys, *(F.col(f"top.{c}").alias(c) for c in rest), F.col("top.e_val").alias("e_val"), (-F.col("top.neg_bit")).alias("bit_score"))


def hit_text(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits of a key as ``hmm,e,bit`` joined by ``;``, the most significant first."""
    ordered = F.array_sort(F.collect_list(F.struct(*significance_fields(), "e_text", "bit_text")))
    rows = hits.withColumn("e_text", F.col("e_val").cast("string")).withColumn("bit_text", F.col("bit_score").cast("string"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda h: F.concat_ws(",", h["hmm_id"], h["e_text"], h["bit_text"])), ";").alias("hits"))


def significance_fields() -> list[Column]:
    return [(-F.col("bit_score")).alias("neg_bit"), F.col("e_val"), F.col("hmm_id"), F.col("gene_id")]


def copy_number(hits: DataFrame, markers: DataFrame, genomes: DataFrame) -> DataFrame:
    """Status of every marker in every genome, with the top gene where one is used.

    ``mis`` without hits, ``unq`` with one, ``muq`` with several of one sequence (a trailing ``*`` does not count),
    ``mul`` with several sequences. ``markers`` is a list of fixed length.
    """
    seen = (
        hits.groupBy("genome_id", "marker_id")
        .agg(F.count("*").alias("n"), F.count_distinct(F.regexp_replace("seq", r"\*$", "")).alias("n_seq"), F.min(F.struct((-F.col("bit_score")).alias("b"), "e_val", "gene_id")).alias("top"))
    )
    grid = genomes.select("genome_id").distinct().crossJoin(markers.select("marker_id").distinct())
    status = F.when(F.col("n").isNull(), "mis").when(F.col("n") == 1, "unq").when(F.col("n_seq") == 1, "muq").otherwise("mul")
    return grid.join(seen, ["genome_id", "marker_id"], "left").select(
        "genome_id", "marker_id", status.alias("status"), F.when(status.isin("unq", "muq"), F.col("top.gene_id")).alias("gene_id")
    )


def status_table(status: DataFrame) -> DataFrame:
    """One row a genome: count and sorted markers of each status."""
    names = ("unq", "mul", "muq", "mis")
    aggs = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in names]
    aggs += [F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("marker_id")))), ",").alias(f"list_{s}") for s in names]
    return status.groupBy("genome_id").agg(*aggs)


def single_copy(status: DataFrame) -> DataFrame:
    return status.where(F.col("status").isin("unq", "muq"))


def domain_vote(status: DataFrame, sizes: dict[str, int], close: float = 10.0) -> DataFrame:
    """Domain whose share of single-copy markers is the larger, the first named on a tie; ``unclear`` if both are near.

    ``status`` has domain, genome_id, status; ``sizes`` maps the two domains to their numbers of markers.
    """
    (a, na), (b, nb) = sizes.items()
    held = single_copy(status).groupBy("genome_id").agg(*(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in (a, b)))
    pa, pb = F.col(f"n_{a}") * 100.0 / na, F.col(f"n_{b}") * 100.0 / nb
    return held.select("genome_id", f"n_{a}", f"n_{b}", F.when(pa >= pb, a).otherwise(b).alias("domain"), (F.abs(pa - pb) <= close).alias("unclear"))


def multi_hit(counts: DataFrame, n_markers: int, least: float = 10.0) -> DataFrame:
    """Genomes of which at least ``least`` percent of the markers are multiple."""
    return counts.withColumn("multi_percent", F.col("n_mul") * 100.0 / n_markers).where(F.col("multi_percent") >= least)


def coding_bases(genes: DataFrame) -> DataFrame:
    """Bases of each contig that some gene covers, overlaps once; one base less a contig, as genes count from 1.

    ``genes`` has genome_id, contig, begin, end. How far earlier genes reach is a running maximum over ranges of begins,
    so that a contig of any number of genes is dealt to several tasks.
    """
    rows = running(genes.select("genome_id", "contig", "begin", "end"), ["genome_id", "contig"], ["begin", "end"], inclusive=False, reached=("max", "end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin") - 1, F.coalesce("reached", F.lit(0))))
    return rows.groupBy("genome_id", "contig").agg((F.sum(new) - 1).alias("coding_bases"))


def coding_density(genes: DataFrame, contigs: DataFrame) -> DataFrame:
    """Coding bases over the length of every genome (contigs: genome_id, contig, length); contigs without genes count."""
    covered = contigs.join(coding_bases(genes), ["genome_id", "contig"], "left")
    return covered.groupBy("genome_id").agg(F.coalesce(F.sum("coding_bases"), F.lit(0)).alias("coding_bases"), F.sum("length").alias("length")).withColumn("density", F.try_divide("coding_bases", "length"))


def merged_by_model(*tables: DataFrame) -> DataFrame:
    """Hits of several databases together, and how many genes and hits each model has."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("hmm_id").agg(F.count_distinct("gene_id").alias("n_genes"), F.count("*").alias("n_hits"), F.max("bit_score").alias("best_bit"))


def lookup(hits: DataFrame, gene_id, hmm_id=None) -> DataFrame:
    """The hits of a gene, or its hit of one model; none if it has none."""
    found = hits.where(F.col("gene_id") == gene_id)
    return found if hmm_id is None else found.where(F.col("hmm_id") == hmm_id)
