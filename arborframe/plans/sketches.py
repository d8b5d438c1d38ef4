"""Queries on containment sketches: documents as sequences of letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborframe.operators import sketch as K

from .hierarchy import read

#: Letters of a substring, one of how many hashes is kept, letters of a section, least identity, least aligned fraction.
LETTERS, SCALED, SECTION, ANI, AF = 12, 16, 500, 0.95, 0.5


def sketch_closest(spark, sf_dir):
    """Every twentieth document against all: how many are alike over half of it, and the closest."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"), (F.col("doc_id") % 20 == 0).alias("is_query"), F.lit(True).alias("is_ref"))
    return K.closest(docs, LETTERS, SCALED, SECTION, ANI, AF).select("query", "n_links", "ref", F.round("ani", 6).alias("ani"), F.round("af", 6).alias("af"))


QUERIES = {f.__name__: f for f in (sketch_closest,)}


def _polynomial(base: int) -> str:
    return " + ".join(f"coalesce(lead(u, {j}) OVER w, 0) * {p}" for j, p in enumerate(K.powers(base, LETTERS)))


SQL = {
    "sketch_closest": f"""WITH c AS (
  SELECT doc_id, unnest(l) AS u, generate_subscripts(l, 1) - 1 AS i
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).'), lambda x: CAST(unicode(x) AS BIGINT)) AS l FROM documents WHERE length(text) > 0)
),
h AS (
  SELECT doc_id, i, ({_polynomial(K.BASES[0])}) % {K.PRIME} AS high, ({_polynomial(K.BASES[1])}) % {K.PRIME} AS low
  FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY i = 0 OR lead(u, {LETTERS - 1}) OVER w IS NOT NULL
),
a AS (SELECT doc_id, i, high * 2147483648 + low AS hash, high < {K.PRIME // SCALED} AS small FROM h),
e AS (
  SELECT DISTINCT doc_id, hash, i // {SECTION} AS section FROM a WHERE small
  UNION ALL SELECT doc_id, min(hash), arg_min(i, (hash, i)) // {SECTION} FROM a GROUP BY doc_id HAVING NOT bool_or(small)
),
r AS (SELECT DISTINCT doc_id, hash FROM e),
m AS (SELECT q.doc_id AS q, r.doc_id AS r, section, count(*) AS same FROM e q JOIN r USING (hash) WHERE q.doc_id % 20 = 0 AND q.doc_id <> r.doc_id GROUP BY ALL),
z AS (SELECT q, section, size, sum(size) OVER (PARTITION BY q) AS n FROM (SELECT doc_id AS q, section, count(*) AS size FROM e GROUP BY ALL)),
g AS (SELECT q, r, sum(same) / sum(size) AS share, sum(size) / n AS af FROM m JOIN z USING (q, section) WHERE same / size >= {ANI**LETTERS!r} GROUP BY q, r, n HAVING sum(size) / n >= {AF})
SELECT doc_id AS query, count(r) AS n_links, arg_min(r, (-share, -af, r)) AS ref, round(pow(max(share), {1 / LETTERS!r}), 6) AS ani, round(arg_min(af, (-share, -af, r)), 6) AS af
FROM documents LEFT JOIN g ON q = doc_id WHERE doc_id % 20 = 0 GROUP BY doc_id""",
}
