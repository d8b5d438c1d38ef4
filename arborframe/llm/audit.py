"""How filters interact: what every order of the same filters removes, at which step and for whom.

A row of a corpus fails a set of filters, its mask. Under an order it is removed at the first step whose filter is in
the mask, and the orders that share this step and what comes before it are those with a common prefix: an interval of
the lexicographic ranks (Lehmer codes) of all orders. So a mask's rows are added where its intervals begin, taken away
where they end, and a running sum along the ranks gives every order's figures without trying any order on any row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, hash128, quoted, sized, stored, table

#: Failure conditions of ``op12_filters``: fewest words, least percentage of distinct words, most percentage of capitals.
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"
BLANKS = " \t\n\x0b\f\r"
#: Tasks that the copies of one text are dealt to.
SALTS = 64
SUMS = ("n", "good", "toxic")


def removals(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """For every mask over ``n`` filters: the intervals (mask, filter, step, first rank, end rank) of its removals."""

    def walk(mask: int, left: list[int], rank: int) -> Iterator[tuple[int, int, int, int, int]]:
        width = factorial(len(left) - 1)
        for i, f in enumerate(left):
            at = rank + i * width
            if mask >> f & 1:
                yield mask, f, n - len(left) + 1, at, at + width
            elif len(left) > 1:
                yield from walk(mask, left[:i] + left[i + 1 :], at)

    for mask in range(1, 1 << n):
        yield from walk(mask, list(range(n)), 0)


def conditions(text: Column) -> list[Column]:
    """Whether a text, null like an empty one, fails A to D. All are functions of the text alone."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    n_chars = F.length(text).cast("long")
    capitals = n_chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n_words < LEAST_WORDS, 100 * n_distinct < LEAST_DISTINCT * n_words, 100 * capitals > MOST_CAPITALS * n_chars, text.rlike(f"[{SYMBOLS}]")]


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` (bit k: the row fails filter k) of every row; texts are read once.

    The last filter fails rows whose text a smaller doc_id has, anywhere in the table. Texts are compared by 128 bits
    of hash; the copies of a text are dealt by a hash of their ids, and the least id of each deal is sent back to it.
    """
    fails = conditions(F.col("text"))
    h1, h2 = hash128(F.coalesce(F.col("text"), F.lit("")))
    held = stored(
        docs.select(
            F.col("doc_id"), F.coalesce(quoted(part).cast("string"), F.lit("")).alias("part"), sum((c.cast("int") * (1 << k) for k, c in enumerate(fails)), F.lit(0)).alias("mask"),
            h1.alias("h1"), h2.alias("h2"), F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    deals = held.where("doc_id IS NOT NULL").groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # at most SALTS deals of a text
    texts = deals.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list("salt").alias("salts"))
    repeated = sized(texts.where("least < most").select("h1", "h2", F.explode("salts").alias("salt"), "least"))
    copies = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return held.join(repeated, ["h1", "h2", "salt"], "left").select("doc_id", "part", (F.col("mask") + copies.cast("int") * (1 << len(fails))).alias("mask"))


def by_mask(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``n`` rows, and those labelled ``good`` and ``toxic``, of every part and mask; an id with several labels has all of them."""
    flags = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")
    )
    zero = F.lit(0).cast("long")
    rows = marked.select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    labelled = marked.join(flags, "doc_id").select("part", "mask", zero.alias("n"), "good", "toxic")
    return rows.unionAll(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in SUMS))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of ``filters`` applied to rows that ``counts`` (part, mask, n, good, toxic) has by failed filters.

    One row per part, order and step: ``kept`` after it, ``removed`` by it, ``redundant`` (fail its filter, gone
    before), ``unique_fails`` (fail no other), ``good_lost``, ``toxic_lost`` and ``shapley`` (removed by this filter,
    summed over all orders). A part has at most 2 ** len(filters) masks and as many rows as orders and steps, whatever
    its size; after one shuffle by part every sum and window finds its rows in place. No counts give no rows.
    """
    spark, k = counts.sparkSession, len(filters)
    orders = ["".join(p) for p in permutations(sorted(filters))]
    if list(filters) != sorted(set(filters)):
        raise ValueError("filters are named by distinct letters in ascending order")
    ends = F.broadcast(spark.createDataFrame(list(removals(k)), "mask int, filter int, step int, begin int, end int"))
    counts = counts.repartition("part")
    zero = F.lit(0).cast("long")
    fails = lambda i: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0))
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"), F.array(*(fails(i) for i in range(k))).alias("fails"),
        F.array(*(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k))).alias("alone"),
    )
    steps = F.array(*(F.lit(s) for s in range(1, k + 1)))
    grid = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank")).select("part", F.explode(steps).alias("step"), "rank", *(zero.alias(c) for c in SUMS))
    at = lambda rank, sign: F.struct(F.col(rank).alias("rank"), *((F.col(c) * sign).alias(c) for c in SUMS))
    added = counts.join(ends, "mask").select("part", "step", F.explode(F.array(at("begin", 1), at("end", -1))).alias("e")).select("part", "step", "e.*")
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    difference = grid.unionByName(added).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in SUMS))
    figures = difference.select("part", "step", "rank", *(F.sum(c).over(along).alias(c) for c in SUMS)).where(F.col("rank") < len(orders))
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    placed = figures.withColumn("filter_order", order).withColumn("own", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("at", F.instr(F.lit(filters), F.col("own")))
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(totals, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(before)).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", F.col("at")) - F.col("n")).alias("redundant"), F.element_at("alone", F.col("at")).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(Window.partitionBy("part", "own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``interactions`` of the five filters over whole ``docs`` (doc_id, text and ``part``) with ``labels`` (doc_id, quality, toxic).

    A null text is empty, a null part the empty string. A null doc_id has no label, is no copy and makes none; rows
    that repeat an id and its text are no copies of each other and count one by one. An empty table gives no rows.
    Other columns are not read.
    """
    return interactions(checkpointed(by_mask(masks(docs, part), labels)))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all 120 orders of the five filters, for every source of ``documents``; see ``audit`` for odd rows."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filters": op12_filters}
SQL = {
    "op12_filters": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (
  SELECT doc_id, part, concat(
    CASE WHEN len(ws) < {LEAST_WORDS} THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[{SYMBOLS}]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w
),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
m AS (
  SELECT part, fails, count(*) AS n, count(good.doc_id) AS good, count(toxic.doc_id) AS toxic
  FROM f LEFT JOIN good ON f.doc_id = good.doc_id LEFT JOIN toxic ON f.doc_id = toxic.doc_id GROUP BY part, fails
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
s AS (SELECT o, step, substr(o, step, 1) AS own, substr(o, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, o, step, own,
    sum(CASE WHEN len(list_intersect(string_split(fails, ''), string_split(before || own, ''))) = 0 OR fails = '' THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, own) AS hit, regexp_matches(fails, '[' || before || '0]') AS gone FROM m, s) GROUP BY part, o, step, own
)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
""",
}
