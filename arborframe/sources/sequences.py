"""FASTA and alignment files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of read files, which hold qualities and are refused.
READ_SUFFIXES = (".fq", ".fastq", ".fq.gz", ".fastq.gz")


def read_fasta(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    """(source, ord, seq_id, annotation, seq) of plain or gzipped FASTA files.

    Files are split at lines that begin with ``>``, so a plain file is read by many tasks and a header may hold the mark
    again; white space inside sequences goes, blank lines and
    empty files give nothing. Of records with one id in a file the last stays, unless ``last_wins`` is false.
    """
    if path.endswith(READ_SUFFIXES):
        raise ValueError(f"{path} holds reads, not sequences")
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", r"^\s*>", "").alias("value"))
    parts = parts.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    rows = parts.select("source", "ord", F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("annotation"), body.alias("seq"))
    if not last_wins:
        return rows
    kept = rows.groupBy("source", "seq_id").agg(F.max(F.struct("ord", "annotation", "seq")).alias("r"))
    return kept.select("source", "r.ord", "seq_id", "r.annotation", "r.seq")


def write_fasta(df: DataFrame, path: str, wrap: int = 80, compression: str | None = None) -> None:
    """``>seq_id annotation`` and the sequence in lines of ``wrap`` letters, 0 for one line."""
    seq = F.regexp_replace("seq", rf"(.{{{wrap}}})(?!$)", "$1\n") if wrap else F.col("seq")
    head = F.concat_ws(" ", "seq_id", F.nullif("annotation", F.lit(""))) if "annotation" in df.columns else F.col("seq_id")
    out = df.select(F.concat(F.lit(">"), head, F.lit("\n"), seq).alias("value")).write
    (out.option("compression", compression) if compression else out).text(path)


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq) of a profile alignment in Stockholm text, cut to the columns of its consensus mask.

    A file without a mask line fails. The mask is one line and is broadcast.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("source"), "value")
    masks = lines.where(F.col("value").startswith("#=GC RF")).select("source", F.regexp_extract("value", r"^#=GC RF\s+(\S+)", 1).alias("m"), F.monotonically_increasing_id().alias("o"))
    mask = masks.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "m"))), lambda x: x["m"]), "").alias("mask"))
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "//") & (F.trim("value") != "")).select("source", F.monotonically_increasing_id().alias("o"), F.split(F.trim("value"), r"\s+").alias("p"))
    whole = rows.groupBy("source", F.get("p", F.lit(0)).alias("seq_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.get("p", F.lit(1)).alias("s")))), lambda x: x["s"]), "").alias("raw"))
    joined = whole.join(mask, "source", "left")
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("raw", "").alias("c"), F.split("mask", "").alias("m")), lambda x: x["m"] == "x"), lambda x: x["c"]), "")
    return joined.select("source", "seq_id", F.when(F.col("mask").isNull(), F.raise_error(F.concat(F.lit("no mask in "), F.col("source")))).otherwise(kept).alias("seq"))


def genome_files(spark: SparkSession, folder: str, extension: str = "fna", recursive: bool = False) -> DataFrame:
    """(genome_id, path, length) of the files with an extension that hold anything; the id is the name before it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", recursive).load(folder).select("path", "length")
    return files.where("length > 0").select(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), rf"\.\Q{extension}\E$", "").alias("genome_id"), "path", "length")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-1 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha1("content").alias("sha1"))


def same_digests(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest is not the expected one, or that stand on one side only; empty if all is well."""
    joined = found.select("path", F.col("sha1").alias("found")).join(expected.select("path", F.col("sha1").alias("expected")), "path", "full_outer")
    return joined.where(~F.col("found").eqNullSafe(F.col("expected")))


def write_alignment(msa: DataFrame, taxonomy: DataFrame, path: str, compression: str | None = None) -> None:
    """Aligned sequences (id, seq) as FASTA in the order of their ids, each on one line, its lineage behind the id."""
    named = msa.join(taxonomy.select(F.col("genome_id").alias("id"), F.array_join("taxa", ";").alias("lineage")), "id", "left").orderBy("id")
    out = named.select(F.concat(F.lit(">"), F.concat_ws(" ", "id", "lineage"), F.lit("\n"), F.col("seq")).alias("value")).write
    (out.option("compression", compression) if compression else out).text(path)


def write_by_marker(rows: DataFrame, path: str) -> None:
    """FASTA of every marker (marker_id, id, seq) in a folder of its own; markers without rows have none."""
    text = rows.select("marker_id", F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), F.col("seq")).alias("value"))
    text.repartition("marker_id").sortWithinPartitions("marker_id", "value").write.partitionBy("marker_id").text(path)


def sub_alignment(msa: DataFrame, routed: DataFrame, tree_id) -> DataFrame:
    """The rows of an alignment that go to one subtree (query, tree_id)."""
    return msa.join(routed.where(F.col("tree_id") == tree_id).select(F.col("query").alias("id")), "id", "left_semi")


def gene_files(spark: SparkSession, folder: str, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(genome_id, path) of the gene files of a folder and its subfolders that hold anything, and genomes whose file is
    empty. Empty files are not scanned by Spark, so they are taken from the listing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{{*,*/*}}{suffix}")
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    empty = [(s.getPath().getName().removesuffix(suffix),) for s in listed if s.isFile() and s.getLen() == 0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder).where("length > 0")
    named = files.select(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), rf"\Q{suffix}\E$", "").alias("genome_id"), "path")
    return named, spark.createDataFrame(empty, "genome_id string")


def digest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``name: md5`` of every file of a folder, in the order of names."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^.*/", "").alias("name"), F.md5("content").alias("md5"))
    return files.orderBy("name").select(F.concat_ws(": ", "name", "md5").alias("value"))
