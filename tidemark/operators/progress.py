"""Progress-event analytics, batch form (I2-I7, H9 on events).

Events: ``(job_id, phase, message, ..., ts TIMESTAMP)``.  Every rule that
depends on "now" takes an explicit ``as_of``; nothing calls ``now()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import TERMINAL_STATUSES

PROGRESS_TTL_S = 300
STALL_GAP_S = 300
STREAM_TIMEOUT_S = 300
TIMEOUT_ERROR = "Job timed out after exceeding the maximum allowed duration."


def _secs(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def is_terminal(phase) -> Column:
    p = F.col(phase) if isinstance(phase, str) else phase
    return p.isin(*TERMINAL_STATUSES)


def _event_order(tie: str | None):
    return [F.col("ts")] + ([F.col(tie)] if tie else [])


def latest_progress(events: DataFrame, ttl_s: int = PROGRESS_TTL_S, as_of=None,
                    tie: str | None = "event_id") -> DataFrame:
    """Latest event per job; ``live`` = younger than ``ttl_s`` at ``as_of``.

    With ``as_of`` None every latest event is returned as live.
    """
    cols = [c for c in events.columns if c != "job_id"]
    order = F.struct(*_event_order(tie)) if tie else F.col("ts")
    latest = events.groupBy("job_id").agg(F.max_by(F.struct(*cols), order).alias("_e")).select("job_id", "_e.*")
    if as_of is None:
        return latest.withColumn("live", F.lit(True))
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return latest.withColumn("live", F.col("ts") > as_of_c - _secs(ttl_s))


def route_events(events: DataFrame, jobs: DataFrame | None = None, tie: str | None = "event_id") -> DataFrame:
    """Events up to and including the first terminal one per job.

    ``kind`` = 'complete' for the terminal event (snapshot attached when a
    job table is given), 'progress' before it; nothing after it.  The first
    terminal event is an aggregate joined back (one row per job), not a
    window, so AQE can split a hot job's partition.
    """
    order = F.struct(*_event_order(tie))
    first = events.groupBy("job_id").agg(F.min(F.when(is_terminal("phase"), order)).alias("_ft"))
    staged = events.join(first, "job_id")
    kept = staged.filter(F.col("_ft").isNull() | (order <= F.col("_ft")))
    out = kept.withColumn("kind", F.when(is_terminal("phase") & (order == F.col("_ft")), F.lit("complete"))
                          .otherwise(F.lit("progress"))).drop("_ft")
    if jobs is not None:
        snap = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"))
        out = out.join(snap, "job_id", "left").withColumn(
            "job_status", F.when(F.col("kind") == "complete", F.col("job_status")))
    return out


def consecutive_pairs(events: DataFrame, tie: str | None = "event_id", bucket_s: int = 600) -> DataFrame:
    """Every pair of consecutive events of a job: ``(job_id, ts, next_ts)``.

    Skew-safe: ``lead`` runs inside ``(job, time bucket)`` partitions, and the
    pairs that cross buckets come from a per-bucket summary (first and last
    event of each non-empty bucket, one row per bucket) ordered per job.
    A job with a third of all events is spread over its buckets.
    """
    order = _event_order(tie)
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_s * 1_000_000))
    ev = events.select("job_id", *[c for c in ["ts", tie] if c], bucket.alias("_b"))
    w = Window.partitionBy("job_id", "_b").orderBy(*order)
    inner = (ev.withColumn("next_ts", F.lead("ts").over(w)).filter(F.col("next_ts").isNotNull())
             .select("job_id", "ts", "next_ts"))
    key = F.struct(*order)
    summ = ev.groupBy("job_id", "_b").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    w2 = Window.partitionBy("job_id").orderBy("_b")
    cross = (summ.withColumn("_next", F.lead("_first").over(w2)).filter(F.col("_next").isNotNull())
             .select("job_id", F.col("_last.ts").alias("ts"), F.col("_next.ts").alias("next_ts")))
    return inner.unionByName(cross)


def stalls(events: DataFrame, gap_s: int = STALL_GAP_S, as_of: Column | None = None) -> DataFrame:
    """I4: silences of at least ``gap_s`` of a job that hasn't ended.

    Events after the first terminal one don't count, and a job that ended
    can't stall.  With ``as_of`` a job whose last event lies that far back is
    reported as well, with an open end (``stall_end`` NULL).

    Two events of one bucket as long as the gap are no silence apart, so a
    job's events shrink to one row per bucket (first, last and whether it
    ended; plain numbers, summed in a hash table before the shuffle), and the
    window sees these.  Nothing is joined back: the bucket in which a job ends
    opens no silence, and the later ones are left out.
    """
    gap_us = gap_s * 1_000_000
    seen = events.where("job_id IS NOT NULL").groupBy("job_id", F.floor(_us("ts") / F.lit(gap_us)).alias("_b")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("stall_start"),
        F.coalesce(F.max(is_terminal("phase")), F.lit(False)).alias("_ends"))
    in_order = Window.partitionBy("job_id").orderBy("_b")
    before = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = seen.withColumn("stall_end", F.lead("_first").over(in_order)).withColumn("_ended", F.max("_ends").over(before)) \
        .where(~F.col("_ended"))
    until = F.col("stall_end") if as_of is None else F.coalesce("stall_end", as_of.cast(events.schema["ts"].dataType))
    return rows.select("job_id", "stall_start", "stall_end", (_us(until) - _us("stall_start")).alias("gap_us")) \
        .where(F.col("gap_us") >= gap_us)


def job_timeouts(events: DataFrame, limit_s: int = STREAM_TIMEOUT_S) -> DataFrame:
    """Jobs not terminal ``limit_s`` after their first event become failed.

    A job whose first terminal event arrives in time keeps that status.
    """
    ended = F.when(is_terminal("phase"), F.col("ts"))
    return timed_out(events.groupBy("job_id").agg(
        F.min("ts").alias("start_ts"), F.min(ended).alias("terminal_ts"),
        F.min_by("phase", ended).alias("terminal_phase")), limit_s)


def timed_out(jobs: DataFrame, limit_s: int = STREAM_TIMEOUT_S) -> DataFrame:
    """Verdict on jobs with their ``start_ts``, ``terminal_ts`` and ``terminal_phase``."""
    deadline = F.col("start_ts") + _secs(limit_s)
    late = F.col("terminal_ts").isNull() | (F.col("terminal_ts") > deadline)
    return jobs.select(
        "job_id", "start_ts", deadline.alias("deadline"), "terminal_ts", late.alias("timed_out"),
        F.when(late, F.lit("failed")).otherwise(F.col("terminal_phase")).alias("status"),
        F.when(late, F.lit(TIMEOUT_ERROR)).alias("error_message"))


def reconcile(latest: DataFrame, jobs: DataFrame) -> DataFrame:
    """Event state vs table state; a terminal table status wins over a
    non-terminal event state (the terminal event was lost)."""
    t = jobs.select(F.col("id").alias("job_id"), F.col("status").alias("table_status"))
    e = latest.select("job_id", F.col("phase").alias("event_phase"))
    return resolved(e.join(t, "job_id", "full_outer")).select("job_id", "event_phase", "table_status", "status", "source")


def resolved(states: DataFrame) -> DataFrame:
    """``status`` and its ``source`` from ``event_phase`` and ``table_status``."""
    ev_term = F.coalesce(is_terminal("event_phase"), F.lit(False))
    tb_term = F.coalesce(is_terminal("table_status"), F.lit(False))
    status = (F.when(ev_term, F.col("event_phase"))
              .when(tb_term, F.col("table_status"))
              .otherwise(F.coalesce(F.col("event_phase"), F.col("table_status"))))
    source = (F.when(ev_term, F.lit("event")).when(tb_term, F.lit("table"))
              .when(F.col("event_phase").isNotNull(), F.lit("event")).otherwise(F.lit("table")))
    return states.withColumns({"status": status, "source": source})


def _us(c) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def job_sessions(events: DataFrame, gap_s: int = 3600) -> DataFrame:
    """Sessions of a job (a new session after a silence longer than ``gap_s``).

    Output per session: number (from 1), start, end (last event), duration,
    event count, number of distinct phases and events per phase (a map).

    Time is cut into buckets as long as the gap.  Two events of one bucket
    are always in one session, so a job's events shrink to one row per bucket
    and phase (partial sums before the shuffle); the windows see one row per
    bucket.  The counts by phase merge over the buckets of a session, still
    by job, so they need no exchange of their own.
    """
    gap_us = gap_s * 1_000_000
    by_phase = events.groupBy("job_id", F.floor(_us("ts") / F.lit(gap_us)).alias("_b"), "phase").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    in_order = Window.partitionBy("job_id").orderBy("_b")
    buckets = by_phase.groupBy("job_id", "_b").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.collect_list(F.struct("phase", "n")).alias("counts"))
    silence = _us("first") - _us(F.lag("last").over(in_order))
    opened = buckets.withColumn("_new", F.when(silence <= gap_us, 0).otherwise(1))
    numbered = opened.withColumn("session", F.sum("_new").over(in_order))
    counts = numbered.select("job_id", "session", "first", "last", F.explode("counts").alias("c")) \
        .groupBy("job_id", "session", F.col("c.phase").alias("phase")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("c.n").alias("n"))
    named = F.filter(F.collect_list(F.struct("phase", "n")), lambda c: c["phase"].isNotNull())
    agg = counts.groupBy("job_id", "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("n_events"),
        F.map_from_entries(named).alias("phases"))
    return agg.withColumn("n_phases", F.size("phases").cast("long")) \
        .withColumn("duration_us", _us("session_end") - _us("session_start"))
