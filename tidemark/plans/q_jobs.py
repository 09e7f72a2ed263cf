"""Job-table queries (A7, H1-H11) over jobs derived from ``orders``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import errors as ER
from ..operators import jobs as J
from ..operators import progress as P
from ..operators import reuse as RU
from ..sources import derived as D
from ..streaming.arrivals import shared_folder
from ..sources import tables as T
from . import oracle as O
from .registry import derive, derive_sql, register, ts_sql, ts_text

_AGE = "CAST(o_orderkey % 3600 AS BIGINT)"


def jobs(spark, sf) -> DataFrame:
    j = derive(spark, sf, "orders", D.JOBS + [("age_s", _AGE)])
    upd = F.col("created_at") + F.make_dt_interval(secs=F.col("age_s"))
    return (j.withColumn("updated_at", upd)
            .withColumn("completed_at", F.when(F.col("status") == "completed", upd))
            .withColumn("llms_full_txt_key", F.lit(""))
            .drop("age_s"))


JOBS_SQL = f"""jobs AS (SELECT *, created_at + to_seconds(age_s) AS updated_at,
  CASE WHEN status = 'completed' THEN created_at + to_seconds(age_s) END AS completed_at
  FROM ({derive_sql('orders', D.JOBS + [('age_s', _AGE)])}))"""


@register("config_defaults", f"""WITH {JOBS_SQL},
c AS (SELECT id, config, coalesce(json_extract_string(config, '$.mode'), 'default') AS mode,
  coalesce(TRY_CAST(json_extract(config, '$.crawl.max_urls') AS BIGINT), 50) AS max_urls,
  coalesce(TRY_CAST(json_extract(config, '$.crawl.max_depth') AS BIGINT), 2) AS max_depth,
  coalesce(TRY_CAST(json_extract(config, '$.crawl.crawl_delay_ms') AS BIGINT), 300) AS crawl_delay_ms,
  coalesce(TRY_CAST(json_extract(config, '$.crawl.timeout_seconds') AS BIGINT), 30) AS timeout_seconds,
  coalesce(TRY_CAST(json_extract(config, '$.crawl.respect_robots_txt') AS BOOLEAN), true) AS respect_robots_txt FROM jobs)
SELECT id, mode, max_urls, max_depth, crawl_delay_ms, timeout_seconds, respect_robots_txt,
  CASE WHEN mode NOT IN ('default', 'detailed') THEN 'mode: ''' || mode || ''' is not a valid choice'
       WHEN max_urls < 1 THEN 'max_urls: must be >= 1' WHEN max_urls > 100 THEN 'max_urls: must be <= 100'
       WHEN max_depth < 1 THEN 'max_depth: must be >= 1' WHEN max_depth > 3 THEN 'max_depth: must be <= 3'
       WHEN crawl_delay_ms < 0 THEN 'crawl_delay_ms: must be >= 0'
       WHEN timeout_seconds < 5 THEN 'timeout_seconds: must be >= 5' WHEN timeout_seconds > 60 THEN 'timeout_seconds: must be <= 60'
  END AS reject_reason FROM c""")
def q_config_defaults(spark, sf):
    c = T.parse_config(jobs(spark, sf).select("id", "config"))
    return c.select("id", "mode", "max_urls", "max_depth", "crawl_delay_ms", "timeout_seconds",
                    "respect_robots_txt", "reject_reason")


@register("job_history", f"""WITH {JOBS_SQL}
SELECT user_id, position, id, url, mode, status, {ts_sql('created_at')} AS created_at, {ts_sql('updated_at')} AS updated_at,
  {ts_sql('completed_at')} AS completed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM jobs
  WHERE user_id IS NOT NULL) WHERE position <= 50""")
def q_job_history(spark, sf):
    h = J.job_history(jobs(spark, sf))
    return h.select("user_id", F.col("position").cast("bigint"), "id", "url", "mode", "status",
                    ts_text("created_at").alias("created_at"), ts_text("updated_at").alias("updated_at"),
                    ts_text("completed_at").alias("completed_at"))


@register("job_history_5", f"""WITH {JOBS_SQL}
SELECT user_id, position, id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM jobs
  WHERE user_id IS NOT NULL) WHERE position <= 5""")
def q_job_history_5(spark, sf):
    """A history short enough to leave jobs out."""
    return J.job_history(jobs(spark, sf), 5).select("user_id", F.col("position").cast("bigint"), "id", "status")


@register("job_progress", f"""WITH {JOBS_SQL}, prog AS ({derive_sql('events', D.PROGRESS)}),
l AS (SELECT job_id AS id, arg_max(phase, (ts, event_id)) AS progress_phase, arg_max(message, (ts, event_id)) AS progress_message
      FROM prog GROUP BY job_id)
SELECT j.id, j.status, l.progress_phase, l.progress_message, j.status = 'pending' AND l.progress_phase IS NULL AS waiting
FROM jobs j LEFT JOIN l USING (id)""")
def q_job_progress(spark, sf):
    latest = P.latest_progress(derive(spark, sf, "events", D.PROGRESS))
    s = J.job_snapshots(jobs(spark, sf), latest)
    return s.select("id", "status", "progress_phase", "progress_message",
                    J.is_waiting("status", "progress_phase").alias("waiting"))


_CALLERS = [("request_id", "'q' || CAST(o_orderkey AS STRING)"),
            ("job_id", "CASE WHEN o_orderkey % 10 = 9 THEN 'job-x' ELSE 'job-' END || CAST(o_orderkey AS STRING)"),
            ("caller_user_id", D.case("o_orderkey", ["NULL", "'user-' || CAST(o_custkey AS STRING)",
                                                     "'user-' || CAST(o_custkey + 1 AS STRING)",
                                                     "'user-' || CAST(o_custkey AS STRING)"]))]


@register("job_visible", f"""WITH {JOBS_SQL}, c AS ({derive_sql('orders', _CALLERS)})
SELECT c.request_id, c.job_id, c.caller_user_id,
  j.id IS NOT NULL AND NOT (j.user_id IS NOT NULL AND c.caller_user_id IS NOT NULL AND j.user_id <> c.caller_user_id) AS visible
FROM c LEFT JOIN jobs j ON j.id = c.job_id""")
def q_job_visible(spark, sf):
    return J.visible_jobs(jobs(spark, sf), derive(spark, sf, "orders", _CALLERS))


def _meta_sql(name: str, typ: str = "BIGINT") -> str:
    return (f"CASE WHEN has_result THEN CAST(coalesce(TRY_CAST(json_extract(result_meta, '$.{name}') AS {typ}), 0) AS VARCHAR) END")


def shown_sql(x: str) -> str:
    safe = " OR ".join(f"strpos(lower({x}), {O.q(w)}) > 0" for w in ER.SHOWN_SAFE_SUBSTRINGS)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {safe} THEN left({x}, 300) "
            f"ELSE {O.q(ER.GENERIC_ERROR)} END")


@register("job_snapshot", f"""WITH {JOBS_SQL},
s AS (SELECT *, status = 'completed' AND coalesce(result_llms_txt, '') <> '' AS has_result FROM jobs)
SELECT id, status, has_result, CASE WHEN has_result THEN result_llms_txt END AS llms_txt,
  {_meta_sql('total_pages')} AS total_pages, {_meta_sql('pages_processed')} AS pages_processed,
  {_meta_sql('pages_failed')} AS pages_failed, {_meta_sql('llm_calls_made')} AS llm_calls_made,
  {_meta_sql('llm_cost_usd', 'DOUBLE')} AS llm_cost_usd, {shown_sql('error_message')} AS error
FROM s""")
def q_job_snapshot(spark, sf):
    s = J.job_snapshots(jobs(spark, sf))
    return s.select("id", "status", "has_result", "llms_txt",
                    *[F.col(c).cast("string").alias(c) for c in
                      ("total_pages", "pages_processed", "pages_failed", "llm_calls_made", "llm_cost_usd")],
                    "error")


_ERRS = [("o_orderkey", "o_orderkey"),
         ("exc_type", D.case("o_orderkey", ["'ConnectionError'", "'TimeoutError'", "'SSRFError'", "'ValueError'",
                                            "'KeyError'", "'RateLimitError'", "'OperationalError'",
                                            "'AuthenticationError'", "'ConnectionRefusedError'", "'RuntimeError'",
                                            "NULL"])),
         ("message", D.case("o_orderkey", ["'DNS lookup failed'", "'Read timed out'", "'boom'",
                                           "'OPENAI_API_KEY missing'", "repeat('x', 300) || ' Rate Limit'",
                                           "'Name or service not known'", "NULL", "'Timeout while reading'"])),
         ("soft", "o_orderkey % 23 = 0")]


@register("error_class", f"""SELECT o_orderkey, CASE WHEN soft THEN {O.q(ER.SOFT_TIME_LIMIT_ERROR)}
  WHEN exc_type IN {O.sql_list(ER.WORKER_ERRORS)} THEN CASE exc_type {" ".join(f"WHEN {O.q(k)} THEN {O.q(v)}" for k, v in ER.WORKER_ERRORS.items())} END
  WHEN {" OR ".join(f"strpos(lower(coalesce(message, '')), {O.q(w.lower())}) > 0" for w in ER.WORKER_SAFE_SUBSTRINGS)}
  THEN left(message, 200) ELSE {O.q(ER.GENERIC_ERROR)} END AS error_text
FROM ({derive_sql('orders', _ERRS)})""")
def q_error_class(spark, sf):
    d = derive(spark, sf, "orders", _ERRS)
    return d.select("o_orderkey", ER.worker_error(F.col("exc_type"), F.col("message"), F.col("soft")).alias("error_text"))


@register("error_shown", f"WITH {JOBS_SQL} SELECT id, {shown_sql('error_message')} AS shown FROM jobs")
def q_error_shown(spark, sf):
    return jobs(spark, sf).select("id", ER.shown_error(F.col("error_message")).alias("shown"))


_CODES = [("o_orderkey", "o_orderkey"),
          ("status", D.case("o_orderkey", ["200", "400", "401", "403", "404", "405", "422", "429", "500", "502",
                                           "503", "504", "0", "418"])),
          ("server_msg", "CASE WHEN o_orderkey % 3 = 0 THEN 'Invalid URL ' || CAST(o_orderkey AS STRING) END")]


def _client_sql() -> tuple[str, str]:
    def pick(i):
        parts = [("status = 429", ER.CLIENT_RATE_LIMITED), ("status = 401", ER.CLIENT_UNAUTHORIZED),
                 ("status = 403", ER.CLIENT_FORBIDDEN), ("status = 404", ER.CLIENT_NOT_FOUND)]
        body = " ".join(f"WHEN {c} THEN {O.q(v[i])}" for c, v in parts)
        v422 = f"coalesce(server_msg, {O.q(ER.CLIENT_VALIDATION[0])})" if i == 0 else O.q(ER.CLIENT_VALIDATION[1])
        fb = f"coalesce(server_msg, {O.q(ER.CLIENT_FALLBACK[0])})" if i == 0 else O.q(ER.CLIENT_FALLBACK[1])
        return (f"CASE {body} WHEN status = 422 THEN {v422} WHEN status >= 500 THEN {O.q(ER.CLIENT_SERVER[i])} "
                f"WHEN status = 0 THEN {O.q(ER.CLIENT_NETWORK[i])} ELSE {fb} END")
    return pick(0), pick(1)


_SERVER = ("CASE status " + " ".join(f"WHEN {k} THEN {O.q(v)}" for k, v in ER.SERVER_MESSAGES.items())
           + f" ELSE {O.q(ER.SERVER_MESSAGES[500])} END")


@register("status_message", f"""SELECT o_orderkey, status, {_SERVER} AS server_message,
  {_client_sql()[0]} AS client_message, {_client_sql()[1]} AS client_code FROM ({derive_sql('orders', _CODES)})""")
def q_status_message(spark, sf):
    d = derive(spark, sf, "orders", _CODES)
    ce = ER.client_error(F.col("status"), F.col("server_msg"))
    return d.select("o_orderkey", "status", ER.server_message(F.col("status")).alias("server_message"),
                    ce["message"].alias("client_message"), ce["code"].alias("client_code"))


@register("mode_rename", f"WITH {JOBS_SQL} SELECT id, CASE WHEN mode = 'quick' THEN 'default' ELSE mode END AS mode FROM jobs")
def q_mode_rename(spark, sf):
    return J.rename_mode(jobs(spark, sf)).select("id", "mode")


_STEPS = [("pending", 0), ("extracting", 1), (None, 2)]


def _updates(spark, sf):
    base = jobs(spark, sf).select("id", "created_at", F.col("status").alias("final"))
    parts = []
    for st, k in _STEPS:
        parts.append(base.select("id", (F.lit(st) if st else F.col("final")).alias("status"),
                                 (F.col("created_at") + F.make_dt_interval(mins=F.lit(k))).alias("updated_at")))
    return reduce(DataFrame.unionByName, parts)


_UPSERT_SQL = f"""WITH {JOBS_SQL},
u AS ({" UNION ALL ".join(f"SELECT id, {O.q(st) if st else 'status'} AS status, created_at + INTERVAL {k} MINUTE AS updated_at FROM jobs" for st, k in _STEPS)})
SELECT id, arg_max(status, (updated_at, status)) AS status, {ts_sql('max(updated_at)')} AS updated_at FROM u GROUP BY id"""


@register("job_upsert", _UPSERT_SQL)
def q_job_upsert(spark, sf):
    latest = J.latest_jobs(_updates(spark, sf))
    return latest.select("id", "status", ts_text("updated_at").alias("updated_at"))


@register("job_upsert_stored", _UPSERT_SQL)
def q_job_upsert_stored(spark, sf):
    """The updates reach a stored table in two parts, the later ones first."""
    store = RU.job_store(spark, shared_folder(spark, "job-store"), "id string, status string, updated_at timestamp")
    updates = _updates(spark, sf).select("id", "status", "updated_at")
    late = F.pmod(F.unix_seconds("updated_at"), F.lit(120)) >= 60
    RU.upsert_jobs(store, updates.where(late))
    RU.upsert_jobs(store, updates.where(~late))
    return store.read().select("id", "status", ts_text("updated_at").alias("updated_at"))


@register("progress_pct", f"""SELECT event_id, phase, CAST(CASE phase {" ".join(f"WHEN {O.q(p)} THEN {i * 20.0}" for i, p in enumerate(J.PHASE_ORDER))} ELSE 0.0 END AS DOUBLE) AS pct
FROM ({derive_sql('events', D.PROGRESS)})""")
def q_progress_pct(spark, sf):
    p = derive(spark, sf, "events", D.PROGRESS)
    return p.select("event_id", "phase", J.progress_pct("phase").alias("pct"))


_META_FIELDS = ["total_pages", "pages_processed", "pages_failed", "generation_time_seconds", "llm_calls_made", "llm_cost_usd"]


def _camel(n: str) -> str:
    head, *rest = n.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


@register("camel_keys", f"""WITH {JOBS_SQL}
SELECT id, user_id AS userId, {ts_sql('created_at')} AS createdAt,
  {", ".join(f"CAST(TRY_CAST(json_extract(result_meta, '$.{f}') AS {'DOUBLE' if f in ('generation_time_seconds', 'llm_cost_usd') else 'BIGINT'}) AS VARCHAR) AS {_camel(f)}" for f in _META_FIELDS)}
FROM jobs""")
def q_camel_keys(spark, sf):
    j = jobs(spark, sf).select("id", "user_id", ts_text("created_at").alias("created_at"),
                               J.result_meta().alias("result_meta"))
    c = J.convert_keys(j, "camel")
    return c.select("id", "userId", "createdAt",
                    *[F.col(f"resultMeta.{_camel(f)}").cast("string").alias(_camel(f)) for f in _META_FIELDS])


@register("job_counts", f"WITH {JOBS_SQL} SELECT mode, status, count(*) AS n_jobs FROM jobs GROUP BY ALL")
def q_job_counts(spark, sf):
    return J.job_counts(jobs(spark, sf))
