"""Tab-separated tables: readers that hold a file to its schema, and writers in its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborframe.functions.normalize import canonical_id, split_lineage

MISSING = "N/A"

SCHEMAS = {
    "batch": "path string, genome_id string, translation_table string",
    "radii": "species string, ref string, ani double",
    "divergence": "labels string, red double",
    "translation_summary": "genome_id string, translation_table int",
    "reasons": "genome_id string, reason string",
    "classes": "class string, tree_id string",
    "similarity": "query string, ref string, ani double, af double, lineage string",
    "mapping": "user_genome string, is_ani_classification string, class_tree_mapped string, classification_rule string",
    "marker_info": "marker_id string, name string, description string, length int",
}


def read_table(spark: SparkSession, path: str, kind: str, header: bool = False) -> DataFrame:
    """A table of a known kind. With a header its names must be the schema's; a malformed row fails the query."""
    reader = spark.read.schema(SCHEMAS[kind]).option("sep", "\t").option("mode", "FAILFAST").option("nullValue", MISSING)
    return reader.option("header", header).option("enforceSchema", not header).csv(path)


def read_taxonomy(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """(genome_id, taxa) of a table of two columns; ids repeated keep their last row."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("ord"))
    two = F.when(F.size("p") != 2, F.raise_error(F.concat(F.lit("not two columns: "), F.array_join("p", " ")))).otherwise(F.get("p", F.lit(0)))
    gid = canonical_id(two) if canonical else two
    read = rows.select(gid.alias("genome_id"), split_lineage(F.get("p", F.lit(1))).alias("taxa"), "ord")
    return read.groupBy("genome_id").agg(F.max_by("taxa", "ord").alias("taxa"))


def read_batch(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch file and what is wrong with them (line, reason): blanks, tables other than 4 and 11, repeated ids."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("p"), "value")
    at = lambda k: F.trim(F.coalesce(F.get("p", F.lit(k)), F.lit("")))
    table = F.nullif(at(2), F.lit(""))
    parsed = rows.select("value", F.size("p").alias("n"), at(0).alias("path"), at(1).alias("genome_id"), table.alias("t"))
    again = parsed.groupBy("genome_id").count().where("count > 1 AND genome_id <> ''").select("genome_id", F.lit(True).alias("again"))
    checked = parsed.join(again, "genome_id", "left")
    reason = (
        F.when(~F.col("n").isin(2, 3), "column count").when(F.col("path") == "", "blank path").when(F.col("genome_id") == "", "blank id")
        .when(F.col("t").isNotNull() & ~F.col("t").isin("4", "11"), "unknown table").when(F.col("again"), "repeated id")
    )
    checked = checked.withColumn("reason", reason)
    return checked.where("reason IS NULL").select("path", "genome_id", F.col("t").cast("int").alias("translation_table")), checked.where("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of a top-hit table: genes with ``hmm,e,bit`` triples joined by ``;``."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("gene_id string, hits string").csv(path)
    each = rows.select("gene_id", F.explode(F.split("hits", ";")).alias("h")).select("gene_id", F.split("h", ",").alias("p"))
    return each.select("gene_id", F.get("p", F.lit(0)).alias("hmm_id"), F.get("p", F.lit(1)).cast("double").alias("e_val"), F.get("p", F.lit(2)).cast("double").alias("bit_score"))


def read_copy_number(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, marker_id, status) of a marker summary; counts that differ from their lists fail."""
    names = ("unq", "mul", "muq", "mis")
    schema = ", ".join(["genome_id string", *(f"n_{s} int" for s in names), *(f"list_{s} string" for s in names)])
    rows = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    out = None
    for s in names:
        markers = F.filter(F.split(F.coalesce(f"list_{s}", F.lit("")), ","), lambda x: x != "")
        checked = F.when(F.size(markers) != F.col(f"n_{s}"), F.raise_error(F.concat(F.lit("count differs from list in "), F.col("genome_id")))).otherwise(markers)
        part = rows.select("genome_id", F.explode(checked).alias("marker_id"), F.lit(s).alias("status"))
        out = part if out is None else out.unionAll(part)
    return out


def read_similarity(spark: SparkSession, path: str) -> DataFrame:
    """Last row of every query of a similarity summary."""
    rows = read_table(spark, path, "similarity", header=True).withColumn("ord", F.monotonically_increasing_id())
    return rows.groupBy("query").agg(F.max_by(F.struct("ref", "ani", "af", "lineage"), "ord").alias("r")).select("query", "r.*")


def read_genes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes (source, contig, ord, begin, end, strand) of GFF files, and the translation table of each file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("ord"), "value")
    table = lines.where(F.col("value").contains("transl_table=")).select("source", F.regexp_extract("value", r"transl_table=(\d+)", 1).cast("int").alias("translation_table")).distinct()
    p = F.split("value", "\t")
    genes = lines.where(~F.col("value").startswith("#") & (F.size(p) >= 8)).select("source", F.get(p, F.lit(0)).alias("contig"), "ord", F.get(p, F.lit(3)).cast("long").alias("begin"), F.get(p, F.lit(4)).cast("long").alias("end"), F.get(p, F.lit(6)).alias("strand"))
    return genes, table


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(marker_id, name, description, length) from the headers of profile files."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace(F.input_file_name(), "^.*/", ""), r"\.[^.]*$", "").alias("marker_id"), "value")
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}\s+(.*)$", 1)
    return texts.select("marker_id", field("NAME").alias("name"), field("DESC").alias("description"), field("LENG").cast("int").alias("length"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, numbers) of ``KEY=VALUE`` lines; JSON values are maps in ``numbers``, other lines are skipped."""
    rows = spark.read.text(path).where(F.col("value").contains("="))
    value = F.trim(F.regexp_replace("value", "^[^=]*=", ""))
    return rows.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), value.alias("value"), F.when(value.startswith("{"), F.from_json(value, "map<string,double>")).alias("numbers"))


def read_placements(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, name, rank of the placement, fields by name) of placement JSON files; the tree's id is the file's name."""
    schema = "tree string, fields array<string>, placements array<struct<p:array<array<double>>,nm:array<array<string>>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.regexp_replace(F.input_file_name(), "^.*/", "").alias("tree_id"), "fields", F.explode("placements").alias("x"))
    placed = each.select("tree_id", "fields", F.explode("x.nm").alias("nm"), "x.p").select("tree_id", "fields", F.get("nm", F.lit(0)).alias("name"), F.posexplode("p").alias("k", "values"))
    return placed.select("tree_id", "name", "k", F.map_from_arrays("fields", "values").alias("placement"))


def read_run_log(spark: SparkSession, path: str, known: tuple[str, ...]) -> DataFrame:
    """Steps (name, status, start, end) of a run log; an unknown name fails."""
    rows = spark.read.schema("version string, command_line string, steps array<struct<name:string,status:string,starts_at:string,ends_at:string>>").option("multiLine", True).json(path)
    step = rows.select(F.explode("steps").alias("s")).select("s.*")
    return step.withColumn("name", F.when(~F.col("name").isin(*known), F.raise_error(F.concat(F.lit("unknown step "), F.col("name")))).otherwise(F.col("name")))


def completed(log: DataFrame, name: str) -> bool:
    """Whether a step can be reused: the log has it as completed."""
    return not log.where((F.col("name") == name) & (F.col("status") == "completed")).isEmpty()


def write_table(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> None:
    """Tab-separated with a header, sorted, nulls as ``N/A``; arrays are joined by ``;``."""
    picked = df.select(*(columns or df.columns))
    flat = picked.select(*(F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in picked.dtypes))
    flat.orderBy(*order).write.option("sep", "\t").option("header", True).option("nullValue", MISSING).option("emptyValue", "").csv(path)


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    taxonomy.select(F.concat_ws("\t", "genome_id", F.array_join("taxa", ";")).alias("value")).write.text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any file that a pattern names, is there; in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_if_there(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of a known kind, empty where its file is missing."""
    return read_table(spark, path, kind) if exists(spark, path) else spark.createDataFrame([], SCHEMAS[kind])


def read_wide(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Some columns of a wide table with a header, plain or gzipped, found by their names wherever they stand.

    ``columns`` maps names of the file to ours; a name that the header lacks fails.
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("nullValue", MISSING).csv(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing[0]}")
    return rows.select(*(F.col(f"`{c}`").alias(name) for c, name in columns.items()))


def metadata_lookups(metadata: DataFrame) -> dict[str, DataFrame]:
    """What a metadata table (accession, gtdb_taxonomy, ncbi_taxonomy, representative) tells, as six tables.

    Lineages by either taxonomy, the clusters of representatives by genome and by species, and the named taxa of either.
    """
    rows = metadata.select("accession", split_lineage(F.col("gtdb_taxonomy")).alias("gtdb"), split_lineage(F.coalesce("ncbi_taxonomy", F.lit(""))).alias("ncbi"), "representative")
    named = lambda c: rows.select("accession", F.posexplode(c).alias("rank_idx", "taxon")).where(F.length("taxon") > 3)
    return {
        "gtdb": rows.select(F.col("accession").alias("genome_id"), F.col("gtdb").alias("taxa")), "ncbi": rows.select(F.col("accession").alias("genome_id"), F.col("ncbi").alias("taxa")),
        "cluster": rows.select("representative", "accession"), "species": rows.where("accession = representative").select(F.get("gtdb", F.lit(6)).alias("species"), "representative"),
        "gtdb_named": named("gtdb"), "ncbi_named": named("ncbi"),
    }


def species_votes(lookups: dict[str, DataFrame]) -> DataFrame:
    """(cluster, rank_idx, taxon) for a vote: a species' name leads to its representative, and that to its members' taxa."""
    of = lookups["species"].join(lookups["cluster"], "representative")
    return of.join(lookups["ncbi_named"], "accession").select(F.col("species").alias("cluster"), "rank_idx", "taxon")


def radii_by_accession(radii: DataFrame) -> DataFrame:
    """Radii under accessions without their source's prefix; the version stays."""
    return radii.select(F.regexp_replace("ref", "^(GB_|RS_)", "").alias("ref"), "ani")


def checked_radius(hits: DataFrame, radii: DataFrame) -> DataFrame:
    """Hits with the radius of their reference; a reference without one fails."""
    joined = hits.join(radii.select("ref", F.col("ani").alias("radius")), "ref", "left")
    return joined.withColumn("radius", F.when(F.col("radius").isNull(), F.raise_error(F.concat(F.lit("no radius for "), F.col("ref")))).otherwise(F.col("radius")))


def reference_ids(ids: DataFrame) -> DataFrame:
    """Accessions with and without their source's prefix, each once."""
    return ids.select(F.explode(F.array(F.col("genome_id"), F.regexp_replace("genome_id", "^(GB_|RS_)", ""))).alias("genome_id")).distinct()


def assert_new(genomes: DataFrame, references: DataFrame) -> DataFrame:
    """Genomes, none of which may have the id of a reference; one that does fails the query."""
    known = reference_ids(references).withColumn("known", F.lit(True))
    joined = genomes.join(known, "genome_id", "left")
    return joined.where(F.when(F.col("known"), F.raise_error(F.concat(F.lit("the id of a reference: "), F.col("genome_id")))).otherwise(F.lit(True))).drop("known")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether two tables hold the same ids."""
    return a.select(key).exceptAll(a.select(key).intersect(b.select(key))).isEmpty() and b.select(key).subtract(a.select(key)).isEmpty()


def read_translation(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of ``key value`` lines: the best table and the densities of both; a value that is no number fails."""
    rows = spark.read.text(path).select(F.input_file_name().alias("source"), F.split("value", "\t").alias("p")).where(F.size("p") == 2)
    value = F.get("p", F.lit(1)).try_cast("double")
    checked = rows.select("source", F.get("p", F.lit(0)).alias("key"), F.when(value.isNull(), F.raise_error(F.concat(F.lit("not a number: "), F.array_join("p", " ")))).otherwise(value).alias("v"))
    return checked.groupBy("source").pivot("key", ["best_translation_table", "coding_density_4", "coding_density_11"]).agg(F.first("v"))


def read_mask(spark: SparkSession, path: str) -> str:
    """The first line of a mask file, without white space at its end."""
    return spark.read.text(path).first()[0].strip()


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(class, tree_id) of lines parted by white space."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("class"), F.get(p, F.lit(1)).alias("tree_id"))


def read_divergence(spark: SparkSession, path: str) -> DataFrame:
    """(labels, members, red) of a table of nodes named by one or two leaves."""
    return read_table(spark, path, "divergence").select("labels", F.split("labels", r"\|").alias("members"), "red")


# The columns of raw hit tables, parted by white space, as far as hits need them.
HMM_COLUMNS = {0: "gene_id", 3: "hmm_id", 4: "e_val", 5: "bit_score"}
PFAM_COLUMNS = {0: "gene_id", 5: "hmm_id", 12: "e_val", 11: "bit_score"}


def read_raw_hits(spark: SparkSession, path: str, pfam: bool = False) -> DataFrame:
    """(gene_id, hmm_id, e_val, bit_score) of raw hit tables; comments and blank lines go, model versions as well."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    at = {name: F.get("p", F.lit(k)) for k, name in (PFAM_COLUMNS if pfam else HMM_COLUMNS).items()}
    return lines.select(at["gene_id"].alias("gene_id"), F.regexp_replace(at["hmm_id"], r"\.\d+$", "").alias("hmm_id"), at["e_val"].cast("double").alias("e_val"), at["bit_score"].cast("double").alias("bit_score"))


def class_trees(spark: SparkSession, folder: str, prefix: str, domain: str, most: int = 100) -> list[str]:
    """The trees of a run: the whole one if it is there, else the backbone and the class trees that are."""
    whole = f"{folder}/{prefix}.{domain}.classify.tree"
    if exists(spark, whole):
        return [whole]
    backbone = f"{folder}/{prefix}.backbone.{domain}.classify.tree"
    parts = [f"{folder}/{prefix}.{domain}.classify.tree.{k}.tree" for k in range(most)]
    held = {s.getPath().getName() for s in _listed(spark, f"{folder}/{prefix}.{domain}.classify.tree.*.tree")}
    return [p for p in [backbone] if exists(spark, p)] + [p for p in parts if p.rsplit("/", 1)[-1] in held]


def _listed(spark: SparkSession, pattern: str) -> list:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or [])


def remove(spark: SparkSession, path: str) -> bool:
    """Delete intermediate output; false if there was none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def publish(spark: SparkSession, path: str, target: str) -> None:
    """Move finished output to its place, over what stood there."""
    remove(spark, target)
    source, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    if not source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, to):
        raise OSError(f"{path} could not be moved to {target}")


def write_run_log(steps: DataFrame, path: str, version: str, command_line: str) -> None:
    """A run log (name, status, starts_at, ends_at) as one JSON object."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("starts_at", "name", "status", "ends_at"))), lambda s: F.struct(s["name"].alias("name"), s["status"].alias("status"), s["starts_at"].alias("starts_at"), s["ends_at"].alias("ends_at")))
    steps.agg(listed.alias("steps")).select(F.lit(version).alias("version"), F.lit(command_line).alias("command_line"), "steps").coalesce(1).write.json(path)


def durations(log: DataFrame) -> DataFrame:
    """Whole seconds that each step of a log took."""
    return log.select("name", (F.unix_timestamp(F.to_timestamp("ends_at")) - F.unix_timestamp(F.to_timestamp("starts_at"))).alias("seconds"))


def recent_enough(version: str, least: str) -> bool:
    """Whether a package version such as ``r226`` is not older than another."""
    number = lambda v: float(v.lstrip("rR") or 0)
    return number(version) >= number(least)


def package_problems(taxonomy: DataFrame, msa: DataFrame, leaves: DataFrame, radii: DataFrame) -> DataFrame:
    """(kind, subject) of what does not fit in a reference package: ids that one part lacks, and rows of another length."""
    known = taxonomy.select("genome_id").distinct()
    out = None
    for name, part, key in (("alignment", msa, "id"), ("tree", leaves, "leaf_label"), ("radii", radii, "ref")):
        other = part.select(F.col(key).alias("genome_id")).distinct()
        both = known.join(other, "genome_id", "left_anti").select(F.lit(f"not in {name}").alias("kind"), F.col("genome_id").alias("subject"))
        both = both.unionAll(other.join(known, "genome_id", "left_anti").select(F.lit(f"only in {name}").alias("kind"), F.col("genome_id").alias("subject")))
        out = both if out is None else out.unionAll(both)
    length = msa.groupBy(F.length("seq").alias("n")).count().agg(F.max_by("n", "count").alias("usual"))
    odd = msa.join(F.broadcast(length), F.length("seq") != F.col("usual")).select(F.lit("length").alias("kind"), F.col("id").alias("subject"))
    return out.unionAll(odd)


def directory_digest(spark: SparkSession, folder: str) -> str:
    """SHA-1 over the digests of all files of a folder in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha1("content").alias("sha1"))
    return files.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha1"))), lambda x: x["sha1"]), "").cast("binary")).alias("d")).first()["d"]


def missing_and_extra(listing: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    """Names that a listing (name) lacks, and those that nobody asked for."""
    wanted = listing.sparkSession.createDataFrame([(n,) for n in required], "name string")
    return sorted(r[0] for r in wanted.subtract(listing.select("name")).collect()), sorted(r[0] for r in listing.select("name").subtract(wanted).collect())
