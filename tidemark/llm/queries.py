"""Registered queries of this package: name -> builder, and SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    centroid_clustering,
    exact_dedup,
    language_id,
    lexical_search,
    license_scan,
    main_text,
    near_dedup,
    nearest,
    packing,
    pii,
    suffix_dedup,
    topk_search,
)
from .common import sf_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(sf_table(spark, sf_dir, "documents"))


@register("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(sf_table(spark, sf_dir, "documents"))


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sf_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@register("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sf_table(spark, sf_dir, "documents"))


@register("op5_topk_search", """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(sf_table(spark, sf_dir, "embeddings"))


@register("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_pages(sf_table(spark, sf_dir, "pages"))


@register("op7_near_dedup")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(sf_table(spark, sf_dir, "documents"))


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(sf_table(spark, sf_dir, "documents"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(sf_table(spark, sf_dir, "documents"))


@register("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(sf_table(spark, sf_dir, "embeddings"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@register("op11_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)""")
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digests(sf_table(spark, sf_dir, "documents"))


def _clustering_sql(rounds: int) -> str:
    """Every vector against every centroid, round by round."""
    steps = ["""
v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", """
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8)"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, k, list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)]) AS d
  FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n
         FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i),
m{r} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (k))""")
    last = f"a{rounds} a JOIN c{rounds} c USING (k)"
    return f"""WITH {','.join(steps)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM {last}"""


@register("op12_centroid_clustering", _clustering_sql(centroid_clustering.ROUNDS))
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(sf_table(spark, sf_dir, "embeddings"))


@register("op13_lexical_search", rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{lexical_search.TERM}') AS ts
  FROM documents WHERE text IS NOT NULL),
z AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM z),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                                                         '{lexical_search.TERM}')) AS t FROM benchmark),
s AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN z USING (r), g GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(sf_table(spark, sf_dir, "documents"), sf_table(spark, sf_dir, "benchmark"))
