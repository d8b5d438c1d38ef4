"""Taxonomies (genome_id, taxa): roll-ups, validation, overlays, majority votes and rank medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborframe.functions.normalize import RANKS, bad_species, is_full, prefixes


def dealt(taxonomy: DataFrame) -> DataFrame:
    """The lineages dealt to all tasks by genome, before each becomes seven rows: a small file may hold very many."""
    return taxonomy.repartition("genome_id")


def long_form(taxonomy: DataFrame) -> DataFrame:
    """(genome_id, rank_idx, taxon) of named taxa."""
    return taxonomy.select("genome_id", F.posexplode("taxa").alias("rank_idx", "taxon")).where(F.length("taxon") > 3)


def extant(taxonomy: DataFrame) -> DataFrame:
    """Genomes of every named taxon, as a count by (rank, taxon)."""
    return long_form(dealt(taxonomy)).groupBy("rank_idx", "taxon").agg(F.count_distinct("genome_id").alias("n_genomes"))


def children(taxonomy: DataFrame) -> DataFrame:
    """Distinct child taxa of every taxon, genomes for species. A gap in a lineage is skipped."""
    each = F.transform("taxa", lambda t, i: F.struct(i.alias("rank_idx"), t.alias("taxon")))
    rows = dealt(taxonomy).select("genome_id", F.filter(each, lambda x: F.length(x["taxon"]) > 3).alias("named"))
    below = F.coalesce(F.get("named", F.col("at") + 1)["taxon"], F.col("genome_id").cast("string"))
    linked = rows.select("genome_id", "named", F.posexplode("named").alias("at", "x")).select("x.rank_idx", "x.taxon", below.alias("child"))
    return linked.distinct().groupBy("rank_idx", "taxon").agg(F.array_sort(F.collect_list("child")).alias("children"))


def parents(taxonomy: DataFrame) -> DataFrame:
    """Lineage above every taxon; with several, the number of them and the first in order."""
    above = dealt(taxonomy).select("genome_id", "taxa", F.posexplode("taxa").alias("rank_idx", "taxon")).where(F.length("taxon") > 3)
    lineage = F.array_join(F.expr("slice(taxa, 1, rank_idx)"), ";")
    return above.groupBy("rank_idx", "taxon").agg(F.min(lineage).alias("lineage"), F.count_distinct(lineage).alias("n_lineages"))


def duplicate_names(taxonomy: DataFrame) -> DataFrame:
    """Taxa that stand under more than one lineage."""
    return parents(taxonomy).where("n_lineages > 1")


def problems(taxonomy: DataFrame) -> DataFrame:
    """(kind, subject, detail) of every fault: ranks missing, wrong prefixes, group marks, bad species, split parents."""
    rows = taxonomy.select("genome_id", "taxa")
    subject = F.col("genome_id").cast("string").alias("subject")
    count = rows.where(F.size("taxa") != 7).select(F.lit("rank count").alias("kind"), subject, F.size("taxa").cast("string").alias("detail"))
    marked = F.zip_with("taxa", prefixes(), lambda t, p: F.when(~t.startswith(p), t))
    prefix = rows.where((F.size("taxa") == 7) & ~is_full(F.col("taxa"))).select(F.lit("prefix").alias("kind"), subject, F.array_join(F.array_compact(marked), ";").alias("detail"))
    each = rows.select("genome_id", F.explode("taxa").alias("taxon"))
    groups = each.where(F.col("taxon").rlike(r"[()\[\]{}]")).select(F.lit("group mark").alias("kind"), subject, F.col("taxon").alias("detail"))
    species = each.where(F.col("taxon").startswith("s__") & bad_species(F.col("taxon")).isNotNull()).select(F.lit("species").alias("kind"), F.col("taxon").alias("subject"), bad_species(F.col("taxon")).alias("detail")).distinct()
    split = duplicate_names(taxonomy).select(F.lit("several parents").alias("kind"), F.col("taxon").alias("subject"), F.col("n_lineages").cast("string").alias("detail"))
    return count.unionAll(prefix).unionAll(groups).unionAll(species).unionAll(split)


def overlay(*layers: DataFrame) -> DataFrame:
    """One lineage a genome, that of the last layer which has it."""
    stacked = [t.select("genome_id", "taxa", F.lit(k).alias("layer")) for k, t in enumerate(layers)]
    union = stacked[0]
    for t in stacked[1:]:
        union = union.unionByName(t)
    return union.groupBy("genome_id").agg(F.max_by("taxa", "layer").alias("taxa"))


def votes(members: DataFrame) -> DataFrame:
    """Winner of every (cluster, rank_idx): the one named taxon with at least half of the votes, null without one.

    ``members`` has cluster, rank_idx and taxon. Votes are summed by taxon before the taxa of a cluster meet, so a
    cluster with most of the rows is a few sums.
    """
    counts = members.groupBy("cluster", "rank_idx", "taxon").agg(F.count("*").alias("n"))
    total = counts.groupBy("cluster", "rank_idx").agg(F.sum("n").alias("votes"), F.collect_list(F.struct("taxon", "n")).alias("taxa"))
    winners = F.filter("taxa", lambda t: (F.length(t["taxon"]) > 3) & (2 * t["n"] >= F.col("votes")))
    one = F.size(winners) == 1
    return total.select("cluster", "rank_idx", "votes", F.when(one, F.get(winners, F.lit(0))["taxon"]).alias("winner"), F.when(one, F.get(winners, F.lit(0))["n"]).alias("n_winner"))


def resolved(winners: DataFrame) -> DataFrame:
    """The deepest rank of each cluster that has a winner."""
    return winners.where("winner IS NOT NULL").groupBy("cluster").agg(F.max_by("winner", "rank_idx").alias("taxon"), F.max("rank_idx").alias("rank_idx"))


def rank_medians(divergence: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """Median over the taxa of a rank of their median divergence; ``divergence`` has rank_idx, taxon, red."""
    taxa = taxon_medians(divergence)
    taxa = taxa if trusted is None else taxa.join(trusted.select("taxon").distinct(), "taxon", "left_semi")
    return taxa.groupBy("rank_idx").agg(F.median("red").alias("median_red"))


def taxon_medians(divergence: DataFrame) -> DataFrame:
    return divergence.groupBy("rank_idx", "taxon").agg(F.median("red").alias("red"))


def outliers(divergence: DataFrame) -> DataFrame:
    """Difference of every taxon from its rank's median, the nearest rank, and the class at 0.1 and 0.2.

    The medians are seven rows at most and are broadcast.
    """
    medians = rank_medians(divergence)
    nearest = F.broadcast(medians.agg(F.array_sort(F.collect_list(F.struct("rank_idx", "median_red"))).alias("__ranks")))
    taxa = taxon_medians(divergence).join(F.broadcast(medians), "rank_idx").crossJoin(nearest)
    delta = F.col("red") - F.col("median_red")
    close = F.array_min(F.transform("__ranks", lambda r: F.struct(F.abs(F.col("red") - r["median_red"]).alias("d"), r["rank_idx"].alias("rank_idx"))))
    verdict = F.when(delta < -0.2, "very overclassified").when(delta < -0.1, "overclassified").when(delta > 0.2, "very underclassified").when(delta > 0.1, "underclassified").otherwise("OK")
    return taxa.select("rank_idx", "taxon", "red", "median_red", delta.alias("delta"), close["rank_idx"].alias("closest_rank"), verdict.alias("class"))


def inference_taxa(taxonomy: DataFrame, min_children: int = 2, trusted: DataFrame | None = None) -> DataFrame:
    """Taxa with enough children to tell their rank's divergence, of the trusted ones if given; species always count."""
    counted = children(taxonomy).where((F.size("children") >= min_children) | (F.col("rank_idx") == 6))
    if trusted is not None:
        species = counted.where("rank_idx = 6")
        counted = counted.where("rank_idx < 6").join(trusted.select("taxon").distinct(), "taxon", "left_semi").select(*species.columns).unionAll(species)
    return counted.select("rank_idx", "taxon")


def in_rank_order(taxa: DataFrame, column: str = "taxon") -> DataFrame:
    """Taxa by rank, then by name."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.substring(column, 1, 3))
    return taxa.orderBy(rank, column)


def domain_of(taxonomy: DataFrame, taxon: str) -> str:
    """The domain of a taxon; one that no lineage has raises."""
    row = taxonomy.where(F.array_contains("taxa", taxon)).agg(F.min(F.get("taxa", F.lit(0)))).first()
    if row[0] is None:
        raise ValueError(f"{taxon} is in no lineage")
    return row[0]
