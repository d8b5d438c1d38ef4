"""The summary of a classification run: its twenty columns, how it is put together, written, read and used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.functions.normalize import half_even, prefixes
from arborframe.operators.relate import unique

from .tables import MISSING

# The columns of the file, in its order, with their types.
SUMMARY = {
    "user_genome": "string", "classification": "string", "closest_genome_reference": "string", "closest_genome_reference_radius": "double", "closest_genome_taxonomy": "string",
    "closest_genome_ani": "double", "closest_genome_af": "double", "closest_placement_reference": "string", "closest_placement_radius": "double", "closest_placement_taxonomy": "string",
    "closest_placement_ani": "double", "closest_placement_af": "double", "pplacer_taxonomy": "string", "classification_method": "string", "note": "string",
    "other_related_references(genome_id,species_name,radius,ANI,AF)": "string", "msa_percent": "double", "translation_table": "int", "red_value": "double", "warnings": "string",
}
RELATED = "other_related_references(genome_id,species_name,radius,ANI,AF)"


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def read_strict(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table with a header that names exactly ``columns``; another header, or a value of another type, fails.

    Headers are lines of the file that start with the first column's name, so that many part files can be read.
    """
    lines = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("p"))
    names = list(columns)
    is_head = F.get("p", F.lit(0)) == names[0]
    wrong = (is_head & (F.col("p") != F.array(*map(F.lit, names)))) | (F.size("p") != len(names))
    checked = lines.select(F.when(wrong, F.raise_error(F.concat(F.lit("columns differ: "), F.array_join("p", ",")))).otherwise(F.col("p")).alias("p")).where(~is_head)
    value = lambda k: F.nullif(F.get("p", F.lit(k)), F.lit(MISSING))
    return checked.select(*(value(k).cast(t).alias(c) for k, (c, t) in enumerate(columns.items())))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a summary; a genome in two rows fails."""
    return unique(read_strict(spark, path, SUMMARY), "user_genome")


def write_summary(rows: DataFrame, path: str, columns: dict[str, str] | None = None) -> None:
    """Rows sorted by genome, with a header; nulls as ``N/A``, divergence to five decimals. Columns may be missing: null."""
    columns = columns or SUMMARY
    held = {c for c in rows.columns}
    value = lambda c, t: _column(c) if c in held else F.lit(None).cast(t)
    rounded = lambda c, t: half_even(value(c, t), 5) if c == "red_value" else value(c, t)
    text = F.array_join(F.array(*(F.coalesce(rounded(c, t).cast("string"), F.lit(MISSING)) for c, t in columns.items())), "\t")
    first = next(iter(columns))
    body = rows.select(F.lit(1).alias("part"), _column(first).alias("key"), text.alias("value"))
    head = rows.sparkSession.createDataFrame([(0, "", "\t".join(columns))], "part int, key string, value string")
    body.unionAll(head).orderBy("part", "key").select("value").write.text(path)


def lineages(summary: DataFrame) -> DataFrame:
    """(genome_id, taxa) of a summary; a classification without seven ranks fails."""
    taxa = F.split("classification", ";")
    seven = F.when(F.size(taxa) != 7, F.raise_error(F.concat(F.lit("not seven ranks: "), F.col("user_genome")))).otherwise(taxa)
    return summary.select(F.col("user_genome").alias("genome_id"), seven.alias("taxa"))


def classified(summary: DataFrame) -> DataFrame:
    """Genomes with a species, which later stages leave out."""
    return lineages(summary).where(F.length(F.get("taxa", F.lit(6))) > 3).select("genome_id")


def as_records(summary: DataFrame) -> DataFrame:
    """(user_genome, row): every row as a map of its filled columns."""
    return summary.select("user_genome", F.map_filter(F.map_from_arrays(F.array(*map(F.lit, SUMMARY)), F.array(*(_column(c).cast("string") for c in SUMMARY))), lambda k, v: v.isNotNull()).alias("row"))


def assemble(lineage: DataFrame, ani: DataFrame, placement: DataFrame, percent: DataFrame, tables: DataFrame, warnings: DataFrame) -> DataFrame:
    """Summary rows of all genomes with a lineage (query, taxa, method); what another frame lacks is null.

    ``ani`` has query, ref, radius, ref_taxa, ani and af; ``placement`` query, taxa and red; ``percent`` query and percent;
    ``tables`` query and translation_table; ``warnings`` query and warning, of which a genome may have several.
    """
    said = warnings.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("warning")), ";").alias("warnings"))
    joined = (
        lineage.select("query", F.array_join("taxa", ";").alias("classification"), F.col("method").alias("classification_method"))
        .join(ani.select("query", F.col("ref").alias("closest_genome_reference"), F.col("radius").alias("closest_genome_reference_radius"), F.array_join("ref_taxa", ";").alias("closest_genome_taxonomy"), F.col("ani").alias("closest_genome_ani"), F.col("af").alias("closest_genome_af")), "query", "left")
        .join(placement.select("query", F.array_join("taxa", ";").alias("pplacer_taxonomy"), F.col("red").alias("red_value")), "query", "left")
        .join(percent.select("query", F.col("percent").alias("msa_percent")), "query", "left").join(tables, "query", "left").join(said, "query", "left")
    )
    held = {c for c in joined.columns}
    return joined.select(F.col("query").alias("user_genome"), *((_column(c) if c in held else F.lit(None)).cast(t).alias(c) for c, t in SUMMARY.items() if c != "user_genome"))


def complete(summary: DataFrame, filtered: DataFrame, failed: DataFrame, domain: str) -> DataFrame:
    """A summary with rows for genomes (genome_id, reason) that were filtered or failed.

    A filtered genome that has a row gets its reason as a further warning; one without a row, and every failed one
    without a row, gets an unclassified row: the domain where it is known, and its reason.
    """
    notes = filtered.select(F.col("genome_id").alias("user_genome"), F.col("reason").alias("more"))
    joined = summary.join(notes, "user_genome", "left").withColumn("warnings", F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.concat(F.split("warnings", ";"), F.array("more"))))), ";"), F.lit("")))
    kept = summary.withColumn("more", F.lit(None).cast("string")).join(notes.select("user_genome"), "user_genome", "left_anti").unionByName(joined.where("more IS NOT NULL")).drop("more")
    unclassified = lambda df, name: df.select("genome_id", F.lit(name).alias("classification"), F.col("reason").alias("warnings"))
    extra = unclassified(filtered, f"Unclassified {domain}").unionAll(unclassified(failed.join(filtered.select("genome_id"), "genome_id", "left_anti"), "Unclassified"))
    new = extra.join(summary.select(F.col("user_genome").alias("genome_id")), "genome_id", "left_anti")
    held = {"user_genome": F.col("genome_id"), "classification": F.col("classification"), "warnings": F.col("warnings")}
    return kept.select(*map(_column, SUMMARY)).unionAll(new.select(*(held.get(c, F.lit(None)).cast(t).alias(c) for c, t in SUMMARY.items())))


def bare_lineage(domain: str) -> Column:
    return F.array_join(prefixes(domain), ";")
