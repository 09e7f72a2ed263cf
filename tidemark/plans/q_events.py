"""Admission and progress-event queries (A5, I1-I7), batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators import jobs as J
from ..operators import progress as P
from ..session import table
from ..sources import derived as D
from ..sources import tables as TB
from ..streaming import streams as ST
from . import oracle as O
from .q_jobs import JOBS_SQL, jobs
from .registry import derive, derive_sql, register, ts_sql, ts_text

LIMIT = 2          # low limit so the events table exercises rejections
WINDOW_S = 86400   # one day, the product default window
SESSION_GAP_S = 3600

CLOSING_JOB = "(closing)"
_TERM = O.sql_list(J.TERMINAL_STATUSES)


def progress(spark, sf):
    return derive(spark, sf, "events", D.PROGRESS)


def over_slices(df, stem: str, run, tie: str = "event_id", fmt: str = "parquet", before=None):
    """``run(stream, folder)`` while ``df`` arrives in slices of several files, rows up to nine minutes late."""
    folder = ST.shared_folder(df.sparkSession, stem)
    dealt = ST.deal(df, "ts", f"{folder}/in", delay_s=540, tie=tie, fmt=fmt)
    return ST.arrive(dealt, lambda stream: run(stream, f"{folder}/run"), before or (lambda i: None))


def progress_slices(spark, sf, stem: str, run, closing_s: int | None = None, before=None):
    """``over_slices`` for the progress events.

    ``closing_s`` adds one event of a job of its own, that far behind the last one.
    """
    ev = progress(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    if closing_s is not None:
        closing = ev.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(closing_s))).alias("last")) \
            .select(*(F.col("last").alias(c) if c == "ts" else
                      F.lit(CLOSING_JOB if c == "job_id" else None).cast(ev.schema[c].dataType).alias(c) for c in ev.columns))
        ev = ev.unionByName(closing)
    return over_slices(ev, stem, run, before=before)


_PROG = f"prog AS ({derive_sql('events', D.PROGRESS)})"
_REQ = f"req0 AS ({derive_sql('events', D.REQUESTS)})"

# -- I1 -----------------------------------------------------------------------------------
RATE_SQL = f"""WITH RECURSIVE {_REQ},
req AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS i FROM req0),
r AS (
  SELECT key, i, event_id, ts, [ts] AS state, true AS allowed, CAST({LIMIT} - 1 AS BIGINT) AS remaining,
         CAST(NULL AS TIMESTAMP) AS reset_at
  FROM req WHERE i = 1
  UNION ALL
  SELECT q.key, q.i, q.event_id, q.ts,
    CASE WHEN len(f.s) < {LIMIT} THEN CASE WHEN list_contains(f.s, q.ts) THEN f.s ELSE list_append(f.s, q.ts) END ELSE f.s END,
    len(f.s) < {LIMIT},
    CAST(CASE WHEN len(f.s) < {LIMIT} THEN greatest(0, {LIMIT} - len(f.s) - 1) ELSE 0 END AS BIGINT),
    CASE WHEN len(f.s) >= {LIMIT} THEN CASE WHEN len(f.s) > 0 THEN list_min(f.s) ELSE q.ts END + INTERVAL {WINDOW_S} SECOND END
  FROM r JOIN req q ON q.key = r.key AND q.i = r.i + 1,
       LATERAL (SELECT list_filter(r.state, lambda x: x > q.ts - INTERVAL {WINDOW_S} SECOND) AS s) f
)
SELECT event_id, key, {ts_sql('ts')} AS ts, allowed, remaining, {ts_sql('reset_at')} AS reset_at FROM r"""


def _rate_out(df):
    return df.select("event_id", "key", ts_text("ts").alias("ts"), "allowed",
                     F.col("remaining").cast("bigint").alias("remaining"), ts_text("reset_at").alias("reset_at"))


@register("rate_limit", RATE_SQL)
def q_rate_limit(spark, sf):
    req = derive(spark, sf, "events", D.REQUESTS)
    return _rate_out(A.admit(req, limit=LIMIT, window_s=WINDOW_S, key="key", ts="ts", tie="event_id"))


@register("rate_limit_stream", RATE_SQL)
def q_rate_limit_stream(spark, sf):
    req = derive(spark, sf, "events", D.REQUESTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return _rate_out(over_slices(req, "admit", lambda stream, path: ST.admit_stream(stream, LIMIT, WINDOW_S, path)))


# limits per user of one day: 10 for every third user, 25 for the others; and one request a second per domain
MIXED_SQL = RATE_SQL.replace("len(f.s) < {LIMIT}".format(LIMIT=LIMIT), "len(f.s) < q.lim") \
    .replace(f"greatest(0, {LIMIT} - len(f.s) - 1)", "greatest(0, q.lim - len(f.s) - 1)") \
    .replace(f"len(f.s) >= {LIMIT}", "len(f.s) >= q.lim").replace(f"CAST({LIMIT} - 1 AS BIGINT)", "CAST(lim - 1 AS BIGINT)") \
    .replace("SELECT *, row_number()", "SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS lim, row_number()")


@register("rate_limit_mixed", MIXED_SQL)
def q_rate_limit_mixed(spark, sf):
    req = derive(spark, sf, "events", D.REQUESTS)
    req = req.withColumn("lim", F.when(F.col("event_id") % 2 == 0, 1).otherwise(3))
    return _rate_out(A.admit(req, window_s=WINDOW_S, tie="event_id", limit_col="lim"))


@register("rate_limit_domain", RATE_SQL.replace(f"INTERVAL {WINDOW_S} SECOND", "INTERVAL 1 SECOND").replace(
    derive_sql("events", D.REQUESTS), derive_sql("events", D.DOMAIN_REQUESTS)))
def q_rate_limit_domain(spark, sf):
    req = derive(spark, sf, "events", D.DOMAIN_REQUESTS)
    return _rate_out(A.admit(req, limit=LIMIT, window_s=A.DOMAIN_WINDOW_S, tie="event_id"))


# -- A5: progress messages as JSON text, parsed back (bad JSON dropped) ------------------------
_MSG = ("CASE WHEN event_id % 13 = 0 THEN '{not json' ELSE '{\"job_id\": \"job-' || CAST(user_id AS STRING) || "
        "'\", \"phase\": \"' || event_type || '\", \"message\": \"m' || CAST(event_id AS STRING) || "
        "'\", \"completed\": ' || CAST(event_id % 50 AS STRING) || ', \"total\": 50}' END")


@register("progress_parse", f"""SELECT json_extract_string(v, '$.job_id') AS job_id, json_extract_string(v, '$.phase') AS phase,
  json_extract_string(v, '$.message') AS message, CAST(json_extract(v, '$.completed') AS INT) AS completed,
  CAST(json_extract(v, '$.total') AS INT) AS total
FROM (SELECT {_MSG} AS v FROM events) WHERE json_valid(v)""")
def q_progress_parse(spark, sf):
    raw = derive(spark, sf, "events", [("value", _MSG)])
    return TB.parse_progress(raw).select("job_id", "phase", "message", "completed", "total")


# -- I2 ---------------------------------------------------------------------------------------
@register("latest_progress", f"""WITH {_PROG},
m AS (SELECT max(ts) AS as_of FROM prog),
l AS (SELECT job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(phase, (ts, event_id)) AS phase,
             max(ts) AS ts FROM prog GROUP BY job_id)
SELECT job_id, event_id, phase, {ts_sql('ts')} AS ts, ts > (SELECT as_of FROM m) - INTERVAL {P.PROGRESS_TTL_S} SECOND AS live FROM l""")
def q_latest_progress(spark, sf):
    ev = progress(spark, sf)
    lp = P.latest_progress(ev, as_of=ev.agg(F.max("ts")).scalar())
    return lp.select("job_id", "event_id", "phase", ts_text("ts").alias("ts"), "live")


@register("latest_progress_stream", f"""WITH {_PROG}
SELECT job_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(phase, (ts, event_id)) AS phase,
       {ts_sql('max(ts)')} AS ts FROM prog GROUP BY job_id""")
def q_latest_progress_stream(spark, sf):
    out = progress_slices(spark, sf, "latest", ST.latest_progress_stream)
    return out.select("job_id", "event_id", "phase", ts_text("ts").alias("ts"))


# -- I3 -----------------------------------------------------------------------------------------
_ROUTE = f"""{_PROG},
ft AS (SELECT job_id, min((ts, event_id)) FILTER (WHERE phase IN {_TERM}) AS ft FROM prog GROUP BY job_id),
routed AS (SELECT p.*, CASE WHEN p.phase IN {_TERM} AND (p.ts, p.event_id) = f.ft THEN 'complete' ELSE 'progress' END AS kind
           FROM prog p JOIN ft f USING (job_id) WHERE f.ft IS NULL OR (p.ts, p.event_id) <= f.ft)"""


_EVENT_ROUTE = f"""WITH {JOBS_SQL}, {_ROUTE}
SELECT r.job_id, r.event_id, r.phase, {ts_sql('r.ts')} AS ts, r.kind,
       CASE WHEN r.kind = 'complete' THEN j.status END AS job_status
FROM routed r LEFT JOIN jobs j ON j.id = r.job_id"""


@register("event_route", _EVENT_ROUTE)
def q_event_route(spark, sf):
    r = P.route_events(progress(spark, sf), jobs(spark, sf))
    return r.select("job_id", "event_id", "phase", ts_text("ts").alias("ts"), "kind", "job_status")


@register("event_route_stream", _EVENT_ROUTE)
def q_event_route_stream(spark, sf):
    """The job table is read anew in each micro-batch."""
    out = progress_slices(spark, sf, "route", lambda stream, path: ST.route_stream(stream, path, lambda: jobs(spark, sf)))
    return out.select("job_id", "event_id", "phase", ts_text("ts").alias("ts"), "kind", "job_status")


# -- I4 -------------------------------------------------------------------------------------------
_STALLS = f"""WITH {_PROG},
e AS (SELECT job_id, min((ts, event_id)) FILTER (WHERE phase IN ('completed', 'failed', 'cancelled')) AS fin FROM prog GROUP BY job_id),
k AS (SELECT p.job_id, p.ts, p.event_id, e.fin FROM prog p JOIN e USING (job_id) WHERE e.fin IS NULL OR (p.ts, p.event_id) <= e.fin),
n AS (SELECT job_id, ts, fin, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts,
             (SELECT max(ts) + INTERVAL 400 SECOND FROM prog) AS as_of FROM k),
g AS (SELECT job_id, ts, next_ts, epoch_us(coalesce(next_ts, as_of)) - epoch_us(ts) AS gap_us FROM n
      WHERE next_ts IS NOT NULL OR fin IS NULL)
SELECT job_id, {ts_sql('ts')} AS stall_start, {ts_sql('next_ts')} AS stall_end, gap_us FROM g WHERE gap_us >= 300000000"""
STALL_AS_OF_S = 400  # after the last event of the table


def _stall_out(df):
    return df.select("job_id", ts_text("stall_start").alias("stall_start"), ts_text("stall_end").alias("stall_end"),
                     F.col("gap_us").cast("bigint").alias("gap_us"))


@register("stalls", _STALLS)
def q_stalls(spark, sf):
    ev = progress(spark, sf)
    as_of = ev.agg((F.max("ts") + F.make_dt_interval(secs=F.lit(STALL_AS_OF_S))).alias("as_of")).scalar()
    return _stall_out(P.stalls(ev, as_of=as_of))


@register("stalls_stream", _STALLS)
def q_stalls_stream(spark, sf):
    ev = progress(spark, sf)
    as_of = ev.agg(F.max("ts") + F.make_dt_interval(secs=F.lit(STALL_AS_OF_S))).first()[0]
    return _stall_out(progress_slices(spark, sf, "stalls", lambda stream, path: ST.stall_stream(stream, path, as_of=as_of)))


# -- I5 ---------------------------------------------------------------------------------------------
_TIMEOUTS = f"""WITH {_PROG},
a AS (SELECT job_id, min(ts) AS start_ts, min(ts) FILTER (WHERE phase IN {_TERM}) AS terminal_ts,
             arg_min(phase, ts) FILTER (WHERE phase IN {_TERM}) AS terminal_phase FROM prog GROUP BY job_id),
b AS (SELECT *, start_ts + INTERVAL {P.STREAM_TIMEOUT_S} SECOND AS deadline FROM a),
c AS (SELECT *, terminal_ts IS NULL OR terminal_ts > deadline AS timed_out FROM b)
SELECT job_id, {ts_sql('start_ts')} AS start_ts, {ts_sql('deadline')} AS deadline, {ts_sql('terminal_ts')} AS terminal_ts,
  timed_out, CASE WHEN timed_out THEN 'failed' ELSE terminal_phase END AS status,
  CASE WHEN timed_out THEN {O.q(P.TIMEOUT_ERROR)} END AS error_message FROM c"""


@register("job_timeouts", _TIMEOUTS)
def q_job_timeouts(spark, sf):
    return _timeouts_out(P.job_timeouts(progress(spark, sf)))


def _timeouts_out(t):
    return t.select("job_id", ts_text("start_ts").alias("start_ts"), ts_text("deadline").alias("deadline"),
                    ts_text("terminal_ts").alias("terminal_ts"), "timed_out", "status", "error_message")


@register("job_timeouts_stream", _TIMEOUTS)
def q_job_timeouts_stream(spark, sf):
    return _timeouts_out(progress_slices(spark, sf, "timeouts", ST.timeout_stream))


# -- I6 ------------------------------------------------------------------------------------------------
_RECONCILE = f"""WITH {JOBS_SQL}, {_PROG},
l AS (SELECT job_id, arg_max(phase, (ts, event_id)) AS event_phase FROM prog GROUP BY job_id),
j AS (SELECT coalesce(l.job_id, t.id) AS job_id, l.event_phase, t.status AS table_status
      FROM l FULL OUTER JOIN jobs t ON t.id = l.job_id)
SELECT job_id, event_phase, table_status,
  CASE WHEN event_phase IN {_TERM} THEN event_phase WHEN table_status IN {_TERM} THEN table_status
       ELSE coalesce(event_phase, table_status) END AS status,
  CASE WHEN event_phase IN {_TERM} THEN 'event' WHEN table_status IN {_TERM} THEN 'table'
       WHEN event_phase IS NOT NULL THEN 'event' ELSE 'table' END AS source FROM j"""


@register("reconcile", _RECONCILE)
def q_reconcile(spark, sf):
    lp = P.latest_progress(progress(spark, sf))
    return P.reconcile(lp, jobs(spark, sf))


@register("reconcile_stream", _RECONCILE)
def q_reconcile_stream(spark, sf):
    """The job table changes between the micro-batches: each job is first written as pending, then as it ended up."""
    final = jobs(spark, sf).select("id", "status", "created_at", "updated_at")
    first = final.select("id", F.lit("pending").alias("status"), "created_at", (F.col("created_at") - F.expr("INTERVAL 1 SECOND")).alias("updated_at"))
    folder = ST.shared_folder(spark, "job-table")
    table = ST.deal(first.unionByName(final), "updated_at", folder)

    def now(since=None):
        rows = spark.read.schema(table.schema).parquet(table.inbox)
        return J.latest_jobs(rows if since is None else rows.where(F.col("updated_at") >= F.lit(since)), key="id", order="updated_at")

    out = progress_slices(spark, sf, "reconcile", lambda stream, path: ST.reconcile_stream(stream, now, path, since=now), before=table.deliver)
    return out.select("job_id", "event_phase", "table_status", "status", "source")


# -- I7 --------------------------------------------------------------------------------------------------
_PHASES_SQL = """(SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM
        (SELECT unnest(map_keys(h)) AS p, unnest(map_values(h)) AS n FROM (SELECT histogram(phase) AS h))) AS phases"""


def _phases_text():
    """Events per phase as ``phase=n``, in order of the phase."""
    entries = F.transform(F.array_sort(F.map_entries("phases")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(entries, ",").alias("phases")


@register("job_sessions", f"""WITH {_PROG},
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {SESSION_GAP_S * 1000000}
                     THEN 1 ELSE 0 END AS new FROM prog WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM g)
SELECT job_id, session, {ts_sql('min(ts)')} AS session_start, {ts_sql('max(ts)')} AS session_end, count(*) AS n_events,
       count(DISTINCT phase) AS n_phases, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us,
       {_PHASES_SQL}
FROM s GROUP BY job_id, session""")
def q_job_sessions(spark, sf):
    s = P.job_sessions(progress(spark, sf), gap_s=SESSION_GAP_S)
    return s.select("job_id", F.col("session").cast("bigint"), ts_text("session_start").alias("session_start"),
                    ts_text("session_end").alias("session_end"), "n_events", "n_phases",
                    F.col("duration_us").cast("bigint"), _phases_text())


_SESS_STREAM_SQL = f"""WITH {_PROG},
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {SESSION_GAP_S * 1000000}
                     THEN 1 ELSE 0 END AS new FROM prog WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g)
SELECT job_id, {ts_sql('min(ts)')} AS session_start, {ts_sql('max(ts)')} AS session_end, count(*) AS n_events,
       epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, {_PHASES_SQL} FROM s GROUP BY job_id, session"""


@register("job_sessions_stream", _SESS_STREAM_SQL)
def q_job_sessions_stream(spark, sf):
    out = progress_slices(spark, sf, "sessions", lambda stream, path: ST.session_stream(stream, path, SESSION_GAP_S),
                          closing_s=2 * SESSION_GAP_S).filter(F.col("job_id") != CLOSING_JOB)
    return out.select("job_id", ts_text("session_start").alias("session_start"),
                      ts_text("session_end").alias("session_end"), "n_events", "duration_us", _phases_text())


# -- A5 as a stream: JSON lines in several files ---------------------------------------------------------
_LINE = ("CASE WHEN event_id % 13 = 0 THEN '{not json' WHEN event_id % 13 = 1 THEN '{\"phase\": \"pending\"}' "
         "WHEN event_id % 13 = 2 THEN '[\"' || event_type || '\"]' "
         "ELSE '{\"job_id\": \"job-' || CAST(user_id AS STRING) || '\", \"phase\": \"' || event_type || "
         "'\", \"message\": \"m' || CAST(event_id AS STRING) || '\", \"completed\": ' || CAST(event_id % 50 AS STRING) || "
         "', \"total\": 50, \"timestamp\": \"' || {at} || 'Z\"}' END")
_LINE_SPARK = _LINE.replace("{at}", "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")")
_LINE_DUCK = _LINE.replace("{at}", "strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f')")


def _json_slices(spark, sf, stem, run):
    """``run(folder of JSON lines, folder)`` while the messages arrive."""
    lines = table(spark, sf, "events").selectExpr(f"{_LINE_SPARK} AS value", "CAST(ts AS TIMESTAMP) AS ts")
    folder = ST.shared_folder(spark, stem)
    dealt = ST.deal(lines, "ts", f"{folder}/in", delay_s=540, tie="value", fmt="text")
    return ST.arrive(dealt, lambda _: run(dealt.inbox, f"{folder}/run"))


@register("progress_json_stream", f"""WITH m AS (SELECT {_LINE_DUCK} AS v FROM events),
e AS (SELECT json_extract_string(v, '$.job_id') AS job_id, json_extract_string(v, '$.phase') AS phase,
             json_extract_string(v, '$.message') AS message, CAST(json_extract_string(v, '$.timestamp') AS TIMESTAMP) AS ts
      FROM m WHERE json_valid(v) AND json_type(v) = 'OBJECT')
SELECT job_id, arg_max(phase, ts) AS phase, arg_max(message, ts) AS message, {ts_sql('max(ts)')} AS ts
FROM e WHERE job_id IS NOT NULL GROUP BY job_id""")
def q_progress_json_stream(spark, sf):
    """I2 from messages in files (A5): unreadable ones are left to ``progress_quarantine_stream``."""
    out = _json_slices(spark, sf, "messages", lambda source, path: ST.latest_progress_stream(
        TB.progress_events(spark, source, stream=True), path))
    return out.select("job_id", "phase", "message", ts_text("ts").alias("ts"))


@register("progress_quarantine_stream", f"""SELECT v AS line, CASE WHEN NOT json_valid(v) OR json_type(v) <> 'OBJECT'
  THEN 'not a JSON object' ELSE 'no job_id' END AS reason, true AS named
FROM (SELECT {_LINE_DUCK} AS v FROM events)
WHERE NOT json_valid(v) OR json_type(v) <> 'OBJECT' OR json_extract_string(v, '$.job_id') IS NULL""")
def q_progress_quarantine_stream(spark, sf):
    out = _json_slices(spark, sf, "quarantine", lambda source, path: ST.quarantine_stream(spark, source, path))
    return out.select("line", "reason", F.col("file").isNotNull().alias("named"))
