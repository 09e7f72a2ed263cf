"""Verdicts that fall due while a stream runs.

State is kept by job in Spark's state store and let go by event-time timers:
a row comes out in the micro-batch in which the low mark passes its moment,
and the job leaves the state with it.  A job that speaks again is taken up
anew.  What is held is thus bounded by the jobs that were active within the
delay and the operator's own limit, not by all jobs ever seen.

Events may come in any order within the delay.  Before they reach the state
they are merged inside the tasks of the source to one row per job (and
stretch of time), so that a job with a third of all events is no Python
group of that size.  Times travel as microseconds, whatever the session's
zone.

The *low mark*, the latest time seen less the delay, is what moments are
compared with.  Spark would drop unseen what is older than its watermark, so
that runs ``GRACE_S`` behind the low mark: an event that comes later than the
delay still reaches its job, where it can move a start or an end that isn't
settled yet.  What is older than that Spark drops and counts.

Each operator returns its *rows so far*, the written rows and what is still
open in the state, in the form of its batch operator.  Events without a time
or job take no part; ``unusable`` gives them as a stream of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import progress as P

DELAY_S = 600
GRACE_S = 86_400
SECOND = 1_000_000


def usable(events: DataFrame) -> DataFrame:
    """Events with job and time; ``us`` is the time in microseconds."""
    return events.where("job_id IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts"))


def unusable(events: DataFrame) -> DataFrame:
    reason = F.when(F.col("job_id").isNull(), F.lit("no job")).otherwise(F.lit("no time"))
    return events.where("job_id IS NULL OR ts IS NULL").withColumn("reason", reason)


def _clocked(merged: DataFrame, last: str, delay_s: int) -> DataFrame:
    """Merged rows with the watermark on the time of their last event."""
    return merged.withColumn("mark", F.timestamp_micros(last)).withWatermark("mark", f"{delay_s + GRACE_S} seconds")


def _low(state: GroupState) -> int:
    """The low mark in microseconds; 0 before anything was seen."""
    ms = state.getCurrentWatermarkMs()
    return (ms + GRACE_S * 1000) * 1000 if ms > 0 else 0


def _wait(state: GroupState, us: int) -> None:
    """Wake up once the low mark has passed ``us`` (or at its next move)."""
    state.setTimeoutTimestamp(max(us // 1000 - GRACE_S * 1000, state.getCurrentWatermarkMs(), 0) + 1)


def run_clock(rows: DataFrame, step: Callable, out: str, state: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Run ``step`` by job over all that is present: rows written so far, and the open state."""
    spark = rows.sparkSession
    query = rows.groupBy("job_id").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout) \
        .writeStream.format("parquet").outputMode("append").option("path", f"{path}/out") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.schema(out).parquet(f"{path}/out"), open_state(spark, path)


def open_state(spark, path: str) -> DataFrame:
    """What the state store holds: job_id and the columns of the state."""
    held = spark.read.format("statestore").load(f"{path}/checkpoint")
    return held.select("key.job_id", "value.groupState.*")


def _whole(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


# -- I2 -----------------------------------------------------------------------
LATEST = "event_id long, phase string, message string, completed int, total int, us long"
LATEST_OUT = f"job_id string, {LATEST}, expired boolean"
_LATEST = [c.split()[0] for c in LATEST.split(", ")]


def _last_of_task(frames: Iterable[pd.DataFrame]):
    for pdf in frames:
        yield pdf.sort_values(["us", "event_id"]).groupby("job_id", sort=False).tail(1)


def _moment(row: dict) -> tuple:
    return row["us"], row["event_id"] is not None, row["event_id"] or 0


def _latest_step(ttl_us: int):
    def step(key, frames, state: GroupState):
        held = dict(zip(_LATEST, state.get, strict=True)) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _row(LATEST_OUT, key, {**held, "expired": True})
            return
        before = held
        for pdf in frames:
            rows = [{c: v if isinstance(v, str) else _whole(v) for c, v in zip(_LATEST, row, strict=True)} for row in _tuples(pdf, _LATEST)]
            newest = max(reversed(rows), key=lambda r: (r["us"], r["event_id"] is None, r["event_id"] or 0))
            if held is None or _moment(newest) > _moment(held):
                held = newest
        state.update(tuple(held[c] for c in _LATEST))
        _wait(state, held["us"] + ttl_us)
        if held is not before:
            yield _row(LATEST_OUT, key, {**held, "expired": False})
    return step


def _tuples(pdf: pd.DataFrame, names: list[str]) -> Iterable[tuple]:
    """Rows as plain tuples: a step runs once per job, on a few rows, where frame operations cost more than the rows."""
    return zip(*(pdf[c].tolist() for c in names), strict=True)


def _row(schema: str, key: tuple, values: dict) -> pd.DataFrame:
    """A frame of one row; columns of objects, as Spark joins the frames of many jobs and then casts to the schema."""
    names = [c.split()[0] for c in schema.split(", ")]
    row = {"job_id": key[0], **values}
    return pd.DataFrame([[row[n] for n in names]], columns=names, dtype=object)


def latest_progress_stream(events: DataFrame, path: str, ttl_s: int = P.PROGRESS_TTL_S, delay_s: int = DELAY_S,
                           live: bool = False) -> DataFrame:
    """Latest event per job, with ``live`` (not yet expired) if asked for.

    A row is written for each job that a micro-batch has news of, and one
    with ``expired`` when the low mark is ``ttl_s`` past its latest event;
    the job then leaves the state.
    """
    merged = usable(events).select("job_id", *_LATEST).mapInPandas(_last_of_task, f"job_id string, {LATEST}")
    rows, _ = run_clock(_clocked(merged, "us", delay_s), _latest_step(ttl_s * SECOND), LATEST_OUT, LATEST, path)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*_LATEST, "expired"), F.struct("us", "event_id", "expired")).alias("e"))
    last = last.select("job_id", "e.*").withColumn("ts", F.timestamp_micros("us")).drop("us")
    return (last.withColumn("live", ~F.col("expired")) if live else last).drop("expired")


# -- I5 -----------------------------------------------------------------------
SPAN = "start_us long, end_us long, phase string"
VERDICT_OUT = f"job_id string, {SPAN}, timed_out boolean"


def _span_of_task(frames: Iterable[pd.DataFrame]):
    for pdf in frames:
        ends = pdf[pdf["phase"].isin(P.TERMINAL_STATUSES)].sort_values("us").groupby("job_id", sort=False).head(1)
        start = pdf.groupby("job_id", as_index=False, sort=False).agg(start_us=("us", "min"), last_us=("us", "max"))
        merged = start.merge(ends[["job_id", "us", "phase"]].rename(columns={"us": "end_us"}), "left", "job_id")
        yield merged.assign(end_us=merged["end_us"].astype("Int64"))[["job_id", "start_us", "end_us", "phase", "last_us"]]


def _verdict_step(limit_us: int):
    def step(key, frames, state: GroupState):
        start, end, phase = state.get if state.exists else (None, None, None)
        if not state.hasTimedOut:
            for pdf in frames:
                for s, e, p in _tuples(pdf, ["start_us", "end_us", "phase"]):
                    s, e = _whole(s), _whole(e)
                    start = s if start is None else min(start, s)
                    if e is not None and (end is None or e < end):
                        end, phase = e, p
            state.update((start, end, phase))
            _wait(state, start + limit_us if end is None else min(end, start + limit_us))
            return
        state.remove()
        yield _row(VERDICT_OUT, key, {"start_us": start, "end_us": end, "phase": phase,
                                      "timed_out": end is None or end > start + limit_us})
    return step


def timeout_stream(events: DataFrame, path: str, limit_s: int = P.STREAM_TIMEOUT_S, delay_s: int = DELAY_S) -> DataFrame:
    """A job's verdict is written when the low mark passes its end or its deadline.

    A job that speaks after its verdict gives another row with a later start
    (to fail a job twice changes nothing); the first start and the first end
    over all rows are the job's.
    """
    merged = usable(events).select("job_id", "us", "phase").mapInPandas(_span_of_task, f"job_id string, {SPAN}, last_us long")
    rows, still = run_clock(_clocked(merged, "last_us", delay_s), _verdict_step(limit_s * SECOND), VERDICT_OUT, SPAN, path)
    spans = rows.select("job_id", "start_us", "end_us", "phase").unionByName(still)
    jobs = spans.groupBy("job_id").agg(F.min("start_us").alias("s"), F.min("end_us").alias("e"),
                                       F.min_by("phase", "end_us").alias("terminal_phase"))
    return P.timed_out(jobs.select("job_id", F.timestamp_micros("s").alias("start_ts"),
                                   F.timestamp_micros("e").alias("terminal_ts"), "terminal_phase"), limit_s)


# -- I4 -----------------------------------------------------------------------
#: Released up to ``last_us`` (null: not heard of yet); ``points`` wait for the low mark.
SILENCE = "last_us long, points array<long>, end_us long"
SILENCE_OUT = "job_id string, us long, kind string"
STRETCH = "job_id string, first_us long, last_us long, end_us long"


def _stretches_of_task(width: int):
    """One row per job and stretch of ``width``: two events of one stretch are no silence apart."""
    def run(frames: Iterable[pd.DataFrame]):
        for pdf in frames:
            ends = pdf["us"].where(pdf["phase"].isin(P.TERMINAL_STATUSES)).astype("Int64")
            pdf = pdf.assign(end_us=ends, part=pdf["us"] // width)
            yield pdf.groupby(["job_id", "part"], as_index=False, sort=False).agg(
                first_us=("us", "min"), last_us=("us", "max"), end_us=("end_us", "min"))[["job_id", "first_us", "last_us", "end_us"]]
    return run


def _silence_step(gap: int):
    def step(key, frames, state: GroupState):
        last, points, end = state.get if state.exists else (None, [], None)
        points, rows = list(points), []
        if not state.hasTimedOut:
            for pdf in frames:
                for a, b, e in _tuples(pdf, ["first_us", "last_us", "end_us"]):
                    points += [int(a), int(b)]
                    e = _whole(e)
                    end = e if end is None else end if e is None else min(end, e)
        low = _low(state)
        by_part: dict[int, tuple[int, int]] = {}
        for p in points:
            if last is None or p > last:  # a late one lies before what is already settled
                a, b = by_part.get(p // gap, (p, p))
                by_part[p // gap] = min(a, p), max(b, p)
        points = sorted({p for ab in by_part.values() for p in ab} | ({end} if end is not None else set()))
        rest = []
        for p in points:
            if p >= low:
                rest.append(p)
                continue
            if last is None:
                rows.append((p, "resumed"))
            elif p - last >= gap:
                rows += [(last, "silent"), (p, "resumed")]
            last = p if last is None else max(p, last)
            if end is not None and p >= end:
                rows.append((p, "ended"))
                break
        if rows and rows[-1][1] == "ended":
            _drop(state)
        else:
            if last is not None and last + gap < low:
                rows.append((last, "silent"))
                last = None
            if last is None and not rest:
                _drop(state)
            else:
                state.update((last, rest, end))
                due = ([rest[0]] if rest else []) + ([last + gap] if last is not None else [])
                _wait(state, min(due))
        if rows:
            yield pd.DataFrame({"job_id": [key[0]] * len(rows), "us": [r[0] for r in rows], "kind": [r[1] for r in rows]})
    return step


def _drop(state: GroupState) -> None:
    if state.exists:
        state.remove()


def stall_stream(events: DataFrame, path: str, gap_s: int = P.STALL_GAP_S, as_of=None, delay_s: int = DELAY_S) -> DataFrame:
    """I4: silences of at least ``gap_s`` of a job that hasn't ended.

    ``silent`` is written when the low mark is ``gap_s`` past a job's last
    event, which lets the job go; ``resumed`` when it is next heard of, and
    ``ended`` with its first terminal event.  What comes after the end counts
    no more.  Silences open at ``as_of`` have no end.
    """
    gap = gap_s * SECOND
    merged = usable(events).select("job_id", "us", "phase").mapInPandas(_stretches_of_task(gap), STRETCH)
    rows, still = run_clock(_clocked(merged, "last_us", delay_s), _silence_step(gap), SILENCE_OUT, SILENCE, path)
    return silences(rows, still, gap_s, as_of)


def silences(rows: DataFrame, still: DataFrame, gap_s: int, as_of=None) -> DataFrame:
    """Silences from the written rows and what is open in the state."""
    waiting = still.select("job_id", F.explode("points").alias("us"), F.lit("resumed").alias("kind"))
    last = still.where("last_us IS NOT NULL").select("job_id", F.col("last_us").alias("us"), F.lit("resumed").alias("kind"))
    ends = rows.where("kind = 'ended'").select("job_id", "us") \
        .unionByName(still.where("end_us IS NOT NULL").select("job_id", F.col("end_us").alias("us"))) \
        .groupBy("job_id").agg(F.min("us").alias("end_us"))
    known = rows.unionByName(waiting).unionByName(last).join(ends, "job_id", "left") \
        .where("end_us IS NULL OR us <= end_us")
    ts = F.timestamp_micros("us")
    marks = known.select("job_id", ts.alias("ts"), F.when(F.col("kind") == "silent", 1).otherwise(0).alias("rank"))
    pairs = P.consecutive_pairs(marks.distinct(), tie="rank", bucket_s=max(1, 2 * gap_s))
    apart = F.unix_micros("next_ts") - F.unix_micros("ts")
    silent = rows.where("kind = 'silent'").select("job_id", ts.alias("ts")) \
        .unionByName(waiting.unionByName(last).select("job_id", ts.alias("ts"))).distinct()
    closed = pairs.join(silent, ["job_id", "ts"], "left_semi").where(apart >= gap_s * SECOND) \
        .select("job_id", F.col("ts").alias("stall_start"), F.col("next_ts").alias("stall_end"), apart.alias("gap_us"))
    if as_of is None:
        return closed
    gap_us = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("stall_start")
    newest = known.groupBy("job_id").agg(F.max("us").alias("us"), F.max("end_us").alias("end_us")).where("end_us IS NULL") \
        .select("job_id", ts.alias("stall_start"), F.lit(None).cast("timestamp").alias("stall_end")) \
        .withColumn("gap_us", gap_us).where(F.col("gap_us") >= gap_s * SECOND)
    return closed.unionByName(newest)
