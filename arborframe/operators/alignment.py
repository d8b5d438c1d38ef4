"""Alignments: columns as rows, consensus, masks, pruning and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import cut, letter_counts
from .scan import running

GAPS = "-._*"


def columns(msa: DataFrame) -> DataFrame:
    """(id, col, aa) of aligned sequences (id, seq), columns from 0."""
    return msa.select("id", F.posexplode(F.split("seq", "")).alias("col", "aa"))


def consensus(msa: DataFrame, min_taxa: float = 0.5, least: float = 0.25, most: float = 0.95) -> DataFrame:
    """Per column: rows, gaps, top residue count, and whether the column is kept.

    Kept are columns whose gap share is at most 1 - ``min_taxa`` and whose top residue has at least ``least`` and less
    than ``most`` of the rest. Every task counts its rows in a table of columns by letters, so a column of any depth is
    a few partial sums. Null and empty sequences have no columns.
    """
    counts = letter_counts(msa).groupBy("col", F.upper("aa").alias("aa")).agg(F.sum("n").alias("n"))
    gap = F.col("aa").isin(*GAPS)
    per = counts.groupBy("col").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(gap, F.col("n"))), F.lit(0)).alias("n_gaps"), F.max(F.when(~gap, F.col("n"))).alias("n_top"))
    full = F.col("n_rows") - F.col("n_gaps")
    share = F.col("n_top") / F.nullif(full, F.lit(0))
    kept = (F.col("n_gaps") <= (1 - min_taxa) * F.col("n_rows")) & (share >= least) & (share < most)
    return per.select("col", "n_rows", "n_gaps", F.coalesce("n_top", F.lit(0)).alias("n_top"), F.coalesce(kept, F.lit(False)).alias("kept"))


def sample_columns(kept: DataFrame, per_marker: int, seed: int = 0) -> DataFrame:
    """At most ``per_marker`` columns of every marker (marker_id, col), by a seeded hash."""
    order = Window.partitionBy("marker_id").orderBy(F.xxhash64(F.lit(seed), "marker_id", "col"), "col")
    return kept.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= per_marker).drop("__rank")


def apply_mask(msa: DataFrame, mask: str) -> DataFrame:
    """Sequences cut to the columns where ``mask`` has a 1; a sequence of another length fails, null stays. Rows are cut as byte matrices, a batch at once."""
    keep = mask.strip()
    checked = F.when(F.length("seq") != len(keep), F.raise_error(F.concat(F.lit("length differs from the mask's: "), F.col("id")))).otherwise(F.col("seq"))
    return msa.withColumn("seq", cut(checked, keep))


def trim_statistics(msa: DataFrame, least_percent: float) -> DataFrame:
    """Every sequence's length, percent of letters and whether it has ``least_percent`` of them; an empty one has none."""
    percent = F.coalesce(residue_percent(F.col("seq")), F.lit(0.0))
    return msa.select("id", F.length("seq").alias("length"), percent.alias("percent"), (percent >= least_percent).alias("kept"))


def columns_per_marker(kept: DataFrame) -> DataFrame:
    """Mean and population deviation of the number of columns (marker_id, col) over markers."""
    return kept.groupBy("marker_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def marker_slices(msa: DataFrame, placed: DataFrame) -> DataFrame:
    """(marker_id, id, seq): the part of every concatenated sequence that a marker has, by its offsets."""
    return msa.crossJoin(placed.select("marker_id", "start", "length")).select("marker_id", "id", F.col("seq").substr((F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("seq"))


def prune(msa: DataFrame, least: float) -> DataFrame:
    """``kept`` for sequences of which at least ``least`` of the columns are neither ``.`` nor ``-``."""
    valid = F.length(F.translate("seq", "-.", ""))
    return msa.withColumn("kept", valid >= F.length("seq") * least)


def residue_percent(seq):
    """Percent of letters in a sequence, null for an empty one."""
    return F.length(F.regexp_replace(seq, "[^A-Za-z]", "")) * 100.0 / F.nullif(F.length(seq), F.lit(0))


def offsets(markers: DataFrame) -> DataFrame:
    """First column and end of every marker (marker_id, length) in the concatenation by marker_id: a running sum over ranges of ids."""
    placed = running(markers.select("marker_id", "length"), [], ["marker_id"], end=("sum", "length"))
    return placed.select("marker_id", "length", (F.col("end") - F.col("length")).alias("start"), "end")


def concatenate(aligned: DataFrame, markers: DataFrame, genomes: DataFrame) -> DataFrame:
    """One row a genome: its marker alignments in order, gaps for those it lacks."""
    grid = genomes.select("id").distinct().crossJoin(markers.select("marker_id", "length"))
    filled = grid.join(aligned, ["id", "marker_id"], "left").withColumn("seq", F.coalesce("seq", F.expr("repeat('-', length)")))
    return filled.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("marker_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def owner(cols: DataFrame, placed: DataFrame) -> DataFrame:
    """The marker of every alignment column, by its offsets: the last start at or before it, carried along the columns.

    Starts and columns are one ordered table, so a marker of any length is one row of it. Columns beyond the last marker
    have none and are left out.
    """
    kind = placed.schema["marker_id"].dataType
    begins = placed.where("length > 0").select(F.col("start").cast("long").alias("__at"), F.lit(0).alias("__side"), F.struct("marker_id", "end").alias("__m"))
    rows = cols.select(F.struct(*cols.columns).alias("__row"), F.col("col").cast("long").alias("__at"))
    both = begins.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)).unionByName(rows.select("__row", "__at", F.lit(1).alias("__side"), F.lit(None).cast(begins.schema["__m"].dataType).alias("__m")))
    held = running(both, [], ["__at", "__side"], last=("last", "__m")).where("__side = 1 AND __at < last.end")
    return held.select("__row.*", F.col("last.marker_id").cast(kind).alias("marker_id"))


def filter_by_taxa(msa: DataFrame, taxonomy: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows with a wanted taxon in their lineage, and those without a lineage."""
    kept = F.col("taxa").isNull() | F.arrays_overlap("taxa", F.array(*map(F.lit, wanted)))
    return msa.join(taxonomy.select("id", "taxa"), "id", "left").where(kept).drop("taxa")
