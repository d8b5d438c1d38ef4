"""Queries on orders, lineitem, part, embeddings, events and documents: hits, similarity, alignments, joins, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborframe.functions import normalize as N
from arborframe.operators import alignment as A
from arborframe.operators import hits as H
from arborframe.operators import relate as J
from arborframe.operators import similarity as S
from arborframe.streaming import events as E

from .hierarchy import LINEAGE, lineage, read


def scan_projection_filter(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where((F.col("l_quantity") < 10) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber", "l_extendedprice")


def canonical_id(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    raw = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "RS_GCF_").when(F.col("s_suppkey") % 3 == 1, "GCA_").otherwise("U_"), F.col("s_suppkey").cast("string"), F.lit(".1"))
    text = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal").cast("string")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", N.canonical_id(raw).alias("canonical"), N.prefixed_id(F.regexp_replace(raw, "^RS_", "")).alias("prefixed"), N.is_float(text).alias("is_number"), N.is_integer(F.concat(F.lit("1"), F.substring(text, 1, 1))).alias("is_integer"))


def label_parse(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(":", F.col("p_size").cast("string"), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(":"), F.col("p_type"), F.lit("|x"))).otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", N.parse_label(label).alias("l")).select("p_partkey", "l.support", "l.taxon", "l.aux")


def hit_table(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("gene_id"), (F.col("l_suppkey") % 3).alias("hmm_id"), F.col("l_discount").alias("e_val"), F.col("l_extendedprice").alias("bit_score"),
        F.col("l_orderkey").alias("genome_id"), (F.col("l_partkey") % 12).alias("marker_id"), F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.when(F.col("l_linenumber") % 2 == 0, "*").otherwise("")).alias("seq"), "l_orderkey", "l_linenumber",
    )


def tophit_per_gene_hmm(spark, sf_dir):
    return H.best(hit_table(spark, sf_dir), "gene_id", "hmm_id")


def tophit_per_gene(spark, sf_dir):
    return H.best(hit_table(spark, sf_dir), "gene_id")


def _status(spark, sf_dir):
    """Orders as genomes and their lines as hits of twelve markers: few lines of an order have a marker in common."""
    rows = hit_table(spark, sf_dir)
    return H.copy_number(rows.withColumn("gene_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), rows, rows)


def copy_number_status(spark, sf_dir):
    return _status(spark, sf_dir)


def copy_number_table(spark, sf_dir):
    return H.status_table(_status(spark, sf_dir))


def domain_vote(spark, sf_dir):
    status = _status(spark, sf_dir).withColumn("domain", F.when(F.col("marker_id") < 7, "bacteria").otherwise("archaea"))
    return H.domain_vote(status, {"bacteria": 7, "archaea": 5}, 30.0)


def multihit_warning(spark, sf_dir):
    return H.multi_hit(H.status_table(_status(spark, sf_dir)).select("genome_id", "n_mul"), 12)


def coding_union(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    begin = (F.col("event_id") % 1000 + 1).cast("long")
    genes = ev.select(F.col("user_id").alias("genome_id"), F.col("event_type").alias("contig"), begin.alias("begin"), (begin + 10 + F.col("event_id") % 90).alias("end"))
    return H.coding_bases(genes)


def batchfile_validate(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    gid = F.when(F.col("c_custkey") % 50 == 0, " ").when(F.col("c_custkey") % 50 == 1, "a(b)").otherwise(F.col("c_name"))
    table = F.when(F.col("c_custkey") % 20 == 0, 5).otherwise(11)
    return c.select("c_custkey", J.reasons((N.bad_id(gid) == "blank", "blank id"), (N.bad_id(gid) == "illegal character", "illegal id"), (~table.isin(4, 11), "unknown table")).alias("reasons"))


def taxa_filter(spark, sf_dir):
    rows = lineage(spark, sf_dir).withColumnRenamed("genome_id", "id")
    msa = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("seq"))
    return A.filter_by_taxa(msa, rows.where("id % 11 <> 0"), ["p__NATION_1", "d__ASIA"])


def _msa(spark, sf_dir):
    """Whole texts as an alignment of 64 columns: every block of 64 characters is a row, the last one filled with gaps."""
    docs = read(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.translate("text", " .\nß", "-*_s").alias("text"))
    blocks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,64}"), 0)).alias("block", "seq"))
    return blocks.select(F.concat_ws("-", "doc_id", "block").alias("id"), F.rpad("seq", 64, "-").alias("seq"))


MASK = "1100" * 12 + "0111" * 4


def mask_project(spark, sf_dir):
    return A.prune(A.apply_mask(_msa(spark, sf_dir), MASK), 0.9)


def column_consensus(spark, sf_dir):
    return A.consensus(_msa(spark, sf_dir), 0.5, 0.05, 0.95)


def residue_percent(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", A.residue_percent(F.col("text")).alias("percent"))


def _markers(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("marker_id"), F.col("p_size").cast("long").alias("length"))


def marker_offsets(spark, sf_dir):
    return A.offsets(_markers(spark, sf_dir))


def column_owner(spark, sf_dir):
    cols = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("col"))
    return A.owner(cols, A.offsets(_markers(spark, sf_dir)))


def concatenate_markers(spark, sf_dir):
    markers = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 12).alias("marker_id")).agg((F.max("p_size") % 10 + F.count("*") % 7 + 1).cast("long").alias("length"))
    grid = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).crossJoin(markers)
    aligned = grid.where("(id + marker_id) % 3 <> 0").select("id", "marker_id", F.expr("repeat(chr(cast(65 + marker_id as int)), cast(length as int))").alias("seq"))
    return A.concatenate(aligned, markers, grid)


def _ani(spark, sf_dir, min_af=None, best=False, bounded=False):
    """Queries against the representatives (every tenth vector) of their label: cosine as ani, share of equal signs as af."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    reps = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "ref")
    if bounded:
        reps = reps.join(_radius(spark, sf_dir).withColumnRenamed("ani", "radius"), "ref")
    return S.compared(e.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "query"), reps, min_af, best)


def _radius(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("ref"), (F.lit(0.1) + (F.col("vec_id") % 7) * 0.05).alias("ani"))


def ani_closest(spark, sf_dir):
    queries = read(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0").select(F.col("vec_id").alias("query"))
    return S.report_closest(queries, _ani(spark, sf_dir, 0.6, best=True), 0.6, _radius(spark, sf_dir))


def ani_topk_screen(spark, sf_dir):
    return S.screen(_ani(spark, sf_dir, 0.55, best=True, bounded=True), _radius(spark, sf_dir), 0.55)


def ani_topk_confirm(spark, sf_dir):
    return S.confirm(_ani(spark, sf_dir, 0.55, best=True), _radius(spark, sf_dir), 0.55)


def theta_radius_join(spark, sf_dir):
    return _ani(spark, sf_dir, bounded=True).select("query", "ref")


def related_refs(spark, sf_dir):
    return S.other_related(_ani(spark, sf_dir, 0.62), 0.62)


def range_rank_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1009) / 1009.0).alias("red"))
    medians = spark.createDataFrame([("p", 0.33), ("c", 0.47), ("o", 0.62), ("f", 0.77), ("g", 0.92)], "rank string, median_red double")
    return S.near_ranks(o, medians).select("o_orderkey", "near")


def asof_quote(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return J.as_of(ev.where("event_type <> 'purchase'"), ev.where("event_type = 'purchase'"), "user_id", "ts", "value").select("event_id", "quote")


def semi_anti_existence(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    with_orders = c.join(o.where("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", F.lit("some").alias("kind"))
    return with_orders.unionAll(J.exclude(c, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", F.lit("none").alias("kind")))


def full_outer_merge(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    a = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("negative").alias("note"))
    b = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"), F.lit("large").alias("note")).distinct()
    return J.merge_notes(a, b, "k")


def setops(spark, sf_dir):
    c, s = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    both = lambda df, name: df.select("k", F.lit(name).alias("op"))
    return both(c.union(s).distinct(), "union").unionAll(both(c.intersect(s), "intersect")).unionAll(both(c.exceptAll(s).distinct(), "except all")).unionAll(both(c.subtract(s), "except")).unionAll(J.symmetric_difference(c, s, "k").select("k", F.concat(F.lit("only "), "side").alias("op")))


def rename_ids(spark, sf_dir):
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("old"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("gca"), "s_suppkey")).alias("first"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("uba"), "s_suppkey")).alias("second"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("id"))
    return J.rename(rows, "id", names.withColumn("old", F.col("old").cast("string")))


def cube_grouping_sets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("gid"), F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def percentile_hist(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount")
    bins = rows.select("l_returnflag", F.floor(F.col("l_discount") * 40 + 1e-9).alias("bin"), F.lit(1).alias("one"))
    cut = rows.groupBy("l_returnflag").agg(F.percentile("l_discount", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p"))
    return bins.groupBy("l_returnflag", "bin").agg(F.count("one").alias("n")).join(cut, "l_returnflag").select("l_returnflag", "bin", "n", F.round(F.get("p", F.lit(0)), 6).alias("p10"), F.round(F.get("p", F.lit(1)), 6).alias("p50"), F.round(F.get("p", F.lit(2)), 6).alias("p90"))


def json_props(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return ev.select("event_type", F.from_json("props", "map<string,long>")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("k").alias("k_n"))


def window_analytics(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = read(spark, sf_dir, "events")
    return ev.select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_type").over(w).alias("next_type"), F.rank().over(w).cast("long").alias("rank"), F.ntile(4).over(w).cast("long").alias("quarter"), (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1).cast("long").alias("ordinal"))


def tumbling_events(spark, sf_dir):
    return E.windowed(read(spark, sf_dir, "events"), "1 day").withColumn("total", F.col("total").cast("double"))


def sliding_events(spark, sf_dir):
    return E.windowed(read(spark, sf_dir, "events"), "2 hours", "1 hour").withColumn("total", F.col("total").cast("double"))


def session_events(spark, sf_dir):
    return E.sessions(read(spark, sf_dir, "events"), "6 hours")


def stream_dedup(spark, sf_dir):
    """The first event of every user and type in the stream."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.fields)
    # as a pattern, the path may be a file or a folder of part files
    events = E.stream(spark, f"{sf_dir}/events.parque[t]", fields, 64)
    return E.first_events(events, "user_id", "event_type").select("user_id", "event_type", "event_id")


def minhash_similarity(spark, sf_dir):
    """Every document against all others."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"), F.lit(True).alias("is_query"), F.lit(True).alias("is_ref"))
    return S.similar(docs, 8, 40, 0.5).where("query <> ref AND similarity >= 0.5")


def translation_table(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    d4, d11 = (F.col("o_orderkey") % 101) / 101.0, (F.col("o_orderkey") % 89) / 89.0
    return o.select("o_orderkey", N.translation_table(d4, d11, F.when(F.col("o_orderkey") % 13 == 0, 4)).alias("table"))


def name_checks(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_partkey") % 9 == 0, "").otherwise("s__"), F.when(F.col("p_partkey") % 5 == 0, F.lower("p_name")).otherwise(F.initcap("p_name")), F.when(F.col("p_partkey") % 7 == 0, " cluster 2").when(F.col("p_partkey") % 11 == 0, " sp. X").otherwise(""))
    group = F.when(F.col("p_partkey") % 4 == 0, F.lit("d__X")).when(F.col("p_partkey") % 4 == 1, F.lit("g__")).when(F.col("p_partkey") % 4 == 2, F.lit("Genus")).otherwise("g__Genus")
    return p.select("p_partkey", N.bad_species(name).alias("species"), N.bad_outgroup(group).alias("outgroup"))


QUERIES = {f.__name__: f for f in (
    scan_projection_filter, canonical_id, label_parse, tophit_per_gene_hmm, tophit_per_gene, copy_number_status, copy_number_table, domain_vote, multihit_warning, coding_union,
    batchfile_validate, taxa_filter, mask_project, column_consensus, residue_percent, marker_offsets, column_owner, concatenate_markers, ani_closest, ani_topk_screen, ani_topk_confirm,
    theta_radius_join, related_refs, range_rank_join, asof_quote, semi_anti_existence, full_outer_merge, setops, rename_ids, cube_grouping_sets, percentile_hist, json_props,
    window_analytics, tumbling_events, sliding_events, session_events, stream_dedup, minhash_similarity, translation_table, name_checks,
)}

_HITS = "h AS (SELECT l_orderkey AS gene_id, l_suppkey % 3 AS hmm_id, l_discount AS e_val, l_extendedprice AS bit_score FROM lineitem)"
_STATUS = """r AS (
  SELECT l_orderkey AS genome_id, l_partkey % 12 AS marker_id, l_orderkey * 10 + l_linenumber AS gene_id, l_discount AS e, l_extendedprice AS b, l_returnflag || l_linestatus AS seq
  FROM lineitem
),
o AS (SELECT genome_id, marker_id, count(*) AS n, count(DISTINCT seq) AS k, arg_min(gene_id, (-b, e, gene_id)) AS top FROM r GROUP BY ALL),
st AS (
  SELECT genome_id, marker_id, CASE WHEN n IS NULL THEN 'mis' WHEN n = 1 THEN 'unq' WHEN k = 1 THEN 'muq' ELSE 'mul' END AS status, CASE WHEN n = 1 OR k = 1 THEN top END AS gene_id
  FROM ((SELECT DISTINCT genome_id FROM r) CROSS JOIN (SELECT DISTINCT marker_id FROM r)) LEFT JOIN o USING (genome_id, marker_id)
)"""
_ANI = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
h AS MATERIALIZED (
  SELECT a.vec_id AS query, b.vec_id AS ref, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS ani,
    len(list_filter(range(1, len(a.v) + 1), lambda i: sign(a.v[i]) = sign(b.v[i]))) / len(a.v) AS af
  FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 10 <> 0 AND b.vec_id % 10 = 0
),
rad AS (SELECT vec_id AS ref, 0.1::DOUBLE + (vec_id % 7) * 0.05::DOUBLE AS radius FROM embeddings WHERE vec_id % 10 = 0)"""
_MSA = """t AS (SELECT doc_id, translate(text, ' .' || chr(10) || 'ß', '-*_s') AS text FROM documents WHERE length(text) > 0),
m AS (SELECT doc_id || '-' || b AS id, rpad(substr(text, b * 64 + 1, 64), 64, '-') AS seq FROM (SELECT doc_id, text, unnest(range((length(text) + 63) // 64)) AS b FROM t))"""
_MARK = "k AS (SELECT p_partkey AS marker_id, CAST(p_size AS BIGINT) AS length FROM part),\noff AS (SELECT *, CAST(sum(length) OVER (ORDER BY marker_id) AS BIGINT) AS \"end\" FROM k)"
_KEEP = ", ".join(str(i + 1) for i, m in enumerate(MASK) if m == "1")
_BEST = "(SELECT query, arg_min(ref, (-ani, -af, ref)) AS ref FROM {0} GROUP BY query) JOIN h USING (query, ref)"

SQL = {
    "scan_projection_filter": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity < 10 AND l_discount >= 0.05::DOUBLE",
    "canonical_id": """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'U_' || s_suppkey || '.1' ELSE 'G' || s_suppkey END AS canonical,
  CASE s_suppkey % 3 WHEN 0 THEN 'RS_GCF_' || s_suppkey || '.1' WHEN 1 THEN 'GB_GCA_' || s_suppkey || '.1' ELSE 'U_' || s_suppkey || '.1' END AS prefixed, s_suppkey % 2 = 0 AS is_number,
  s_suppkey % 2 = 0 AND s_acctbal >= 0 AS is_integer FROM supplier""",
    "label_parse": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS support, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS taxon, CASE WHEN p_partkey % 3 = 1 THEN 'x' END AS aux FROM part",
    "tophit_per_gene_hmm": f"WITH {_HITS} SELECT gene_id, hmm_id, e_val, bit_score FROM (SELECT *, row_number() OVER (PARTITION BY gene_id, hmm_id ORDER BY bit_score DESC, e_val) AS rn FROM h) WHERE rn = 1",
    "tophit_per_gene": f"WITH {_HITS} SELECT gene_id, hmm_id, e_val, bit_score FROM (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY bit_score DESC, e_val, hmm_id) AS rn FROM h) WHERE rn = 1",
    "copy_number_status": f"WITH {_STATUS} SELECT * FROM st",
    "copy_number_table": f"WITH {_STATUS} SELECT genome_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}, coalesce(string_agg(CAST(marker_id AS VARCHAR), ',' ORDER BY marker_id) FILTER (status = '{s}'), '') AS list_{s}" for s in ("unq", "mul", "muq", "mis")) + " FROM st GROUP BY genome_id",
    "domain_vote": f"""WITH {_STATUS},
c AS (SELECT genome_id, count(*) FILTER (marker_id < 7) AS n_bacteria, count(*) FILTER (marker_id >= 7) AS n_archaea FROM st WHERE status IN ('unq', 'muq') GROUP BY genome_id)
SELECT genome_id, n_bacteria, n_archaea, CASE WHEN n_bacteria * 100.0 / 7 >= n_archaea * 100.0 / 5 THEN 'bacteria' ELSE 'archaea' END AS domain, abs(n_bacteria * 100.0 / 7 - n_archaea * 100.0 / 5) <= 30 AS unclear FROM c""",
    "multihit_warning": f"WITH {_STATUS} SELECT genome_id, count(*) FILTER (status = 'mul') AS n_mul, count(*) FILTER (status = 'mul') * 100.0::DOUBLE / 12 AS multi_percent FROM st GROUP BY genome_id HAVING count(*) FILTER (status = 'mul') * 100.0 / 12 >= 10",
    "coding_union": """WITH g AS (SELECT user_id AS genome_id, event_type AS contig, event_id % 1000 + 1 AS b, event_id % 1000 + 11 + event_id % 90 AS e FROM events)
SELECT genome_id, contig, count(DISTINCT p) - 1 AS coding_bases FROM (SELECT genome_id, contig, unnest(range(b, e + 1)) AS p FROM g) GROUP BY ALL""",
    "batchfile_validate": "SELECT c_custkey, nullif(concat_ws('; ', CASE WHEN c_custkey % 50 = 0 THEN 'blank id' END, CASE WHEN c_custkey % 50 = 1 OR c_custkey % 50 <> 0 AND regexp_matches(c_name, '[()\\[\\],;= ]') THEN 'illegal id' END, CASE WHEN c_custkey % 20 = 0 THEN 'unknown table' END), '') AS reasons FROM customer",
    "taxa_filter": f"WITH {LINEAGE} SELECT c_custkey AS id, c_name AS seq FROM customer LEFT JOIN lineage ON genome_id = c_custkey WHERE c_custkey % 11 = 0 OR list_contains(taxa, 'p__NATION_1') OR list_contains(taxa, 'd__ASIA')",
    "mask_project": f"WITH {_MSA}, c AS (SELECT id, array_to_string(list_transform([{_KEEP}], lambda i: substr(seq, i, 1)), '') AS seq FROM m) SELECT id, seq, length(replace(seq, '-', '')) >= length(seq) * 0.9::DOUBLE AS kept FROM c",
    "column_consensus": f"""WITH {_MSA},
x AS (SELECT col - 1 AS col, upper(substr(seq, col, 1)) AS aa FROM (SELECT seq, unnest(range(1, 65)) AS col FROM m)),
c AS (SELECT col, aa, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (aa IN ('-', '.', '_', '*')), 0) AS BIGINT) AS n_gaps, coalesce(max(n) FILTER (aa NOT IN ('-', '.', '_', '*')), 0) AS n_top FROM c GROUP BY col)
SELECT CAST(col AS INTEGER) AS col, n_rows, n_gaps, n_top, n_gaps <= 0.5 * n_rows AND n_rows > n_gaps AND n_top / (n_rows - n_gaps) >= 0.05::DOUBLE AND n_top / (n_rows - n_gaps) < 0.95::DOUBLE AS kept FROM p""",
    "residue_percent": "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 100.0::DOUBLE / nullif(length(text), 0) AS percent FROM documents",
    "marker_offsets": f'WITH {_MARK} SELECT marker_id, length, "end" - length AS start, "end" FROM off',
    "column_owner": f'WITH {_MARK} SELECT o_orderkey AS col, marker_id FROM orders JOIN off ON o_orderkey >= "end" - length AND o_orderkey < "end"',
    "concatenate_markers": "WITH k AS (SELECT p_partkey % 12 AS marker_id, max(p_size) % 10 + count(*) % 7 + 1 AS length FROM part GROUP BY ALL) SELECT s_suppkey AS id, string_agg(repeat(CASE WHEN (s_suppkey + marker_id) % 3 <> 0 THEN chr(CAST(65 + marker_id AS INTEGER)) ELSE '-' END, CAST(length AS INTEGER)), '' ORDER BY marker_id) AS seq FROM supplier, k GROUP BY s_suppkey",
    "ani_closest": f"WITH {_ANI}, f AS (SELECT * FROM h WHERE af >= 0.6::DOUBLE), b AS (SELECT * FROM {_BEST.format('f')}) SELECT e.vec_id AS query, b.ref, b.ani, b.af, b.ani >= radius AS within FROM e LEFT JOIN b ON b.query = e.vec_id LEFT JOIN rad ON rad.ref = b.ref WHERE e.vec_id % 10 <> 0",
    "ani_topk_screen": f"WITH {_ANI}, f AS (SELECT h.* FROM h JOIN rad USING (ref) WHERE ani >= radius AND af >= 0.55::DOUBLE) SELECT query, ref, ani, af FROM {_BEST.format('f')}",
    "ani_topk_confirm": f"WITH {_ANI}, f AS (SELECT * FROM h WHERE af >= 0.55::DOUBLE) SELECT query, ref, ani, af FROM {_BEST.format('f')} JOIN rad USING (ref) WHERE ani >= radius",
    "theta_radius_join": f"WITH {_ANI} SELECT query, ref FROM h JOIN rad USING (ref) WHERE ani >= radius",
    "related_refs": f"WITH {_ANI}, f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ani DESC, af DESC, ref) AS rn FROM h WHERE af >= 0.62::DOUBLE) SELECT query, string_agg(CAST(ref AS VARCHAR), '; ' ORDER BY rn) AS related FROM f WHERE rn > 1 GROUP BY query",
    "range_rank_join": """WITH m AS (SELECT * FROM (VALUES ('p', 0.33::DOUBLE), ('c', 0.47), ('o', 0.62), ('f', 0.77), ('g', 0.92)) t(rank, x)), o AS (SELECT o_orderkey, (o_orderkey % 1009) / 1009.0::DOUBLE AS red FROM orders)
SELECT o_orderkey, coalesce(string_agg(rank, '&' ORDER BY abs(red - x), rank) FILTER (abs(red - x) <= 0.1::DOUBLE), '') AS near FROM o, m GROUP BY o_orderkey""",
    "asof_quote": "SELECT e.event_id, q.value AS quote FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') q ON e.user_id = q.user_id AND e.ts >= q.ts",
    "semi_anti_existence": "SELECT c_custkey, 'some' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "full_outer_merge": "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'large;negative' WHEN a.k IS NOT NULL THEN 'negative' ELSE 'large' END AS note FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) b ON a.k = b.k",
    "setops": """WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, 'union' AS op FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT k, 'intersect' FROM (SELECT k FROM c INTERSECT SELECT k FROM s)
UNION ALL SELECT DISTINCT k, 'except all' FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) UNION ALL SELECT k, 'except' FROM (SELECT k FROM c EXCEPT SELECT k FROM s)
UNION ALL SELECT k, 'only left' FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT k, 'only right' FROM (SELECT k FROM s EXCEPT SELECT k FROM c)""",
    "rename_ids": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'gca' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'uba' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS id FROM supplier",
    "cube_grouping_sets": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS gid, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "percentile_hist": """WITH b AS (SELECT l_returnflag, CAST(floor(l_discount * 40 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
q AS (SELECT l_returnflag, round(quantile_cont(l_discount, 0.1), 6) AS p10, round(quantile_cont(l_discount, 0.5), 6) AS p50, round(quantile_cont(l_discount, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL) SELECT * FROM b JOIN q USING (l_returnflag)""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract(props, '$.k')) AS k_n FROM events GROUP BY event_type",
    "window_analytics": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_type) OVER w AS next_type, rank() OVER w AS rank, ntile(4) OVER w AS quarter, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "tumbling_events": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "sliding_events": "SELECT s AS start, s + INTERVAL 2 HOUR AS \"end\", event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL",
    "session_events": """WITH a AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS new FROM events),
b AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_dedup": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "translation_table": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 4 WHEN (o_orderkey % 101) / 101.0::DOUBLE - (o_orderkey % 89) / 89.0::DOUBLE > 0.05 AND (o_orderkey % 101) / 101.0::DOUBLE > 0.7 THEN 4 ELSE 11 END AS \"table\" FROM orders",
    "name_checks": r"""WITH p AS (SELECT p_partkey AS k, p_partkey % 9 <> 0 AS pre, list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))) AS w, p_name FROM part),
n AS (SELECT k, pre, (CASE WHEN k % 5 = 0 THEN lower(p_name) ELSE array_to_string(w, ' ') END) || (CASE WHEN k % 7 = 0 THEN ' cluster 2' WHEN k % 11 = 0 THEN ' sp. X' ELSE '' END) AS bare FROM p)
SELECT k AS p_partkey, CASE WHEN NOT pre THEN 'no species prefix' WHEN len(string_split(bare, ' ')) <= 1 THEN 'no generic name' WHEN contains(bare, ' cluster') THEN 'contains ''cluster'''
  WHEN regexp_matches(bare, '^[a-z]') THEN 'starts in lower case' WHEN contains(lower(bare), 'sp.') THEN 'contains ''sp.''' END AS species,
  CASE k % 4 WHEN 0 THEN 'a domain' WHEN 1 THEN 'too short' WHEN 2 THEN 'no rank prefix' END AS outgroup FROM n""",
}
