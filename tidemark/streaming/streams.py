"""Streams whose steps are batch operators (I1, I3, I6, I7) and the ordering buffer before them.

I2, I4 and I5, which wait for moments to pass, live in ``clocks``.

``run_steps`` runs a batch operator over each micro-batch (``foreachBatch``).
Admission and routing depend on the order of events, and no source delivers
them in order: events wait in a buffer until the low mark (the latest time
seen, less ``delay``) has passed them, and a step gets what the mark has
released.  Across micro-batches the steps therefore see events in time order,
whatever order they came in within the delay.  An event from before the mark
comes too late; it is written to the side table ``late`` with its reason, as
are events without a time.

Buffer, mark and state are small tables in the shared folder under the number
of the micro-batch, so a batch that runs again overwrites its own files and
nothing counts twice; copies older than the last two are removed.  The buffer
holds ``delay`` of events, the state what later events can still need.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import admission as A
from ..operators import progress as P
from ..operators.jobs import STATUSES
from ..session import path_exists, remove_path
from ..sources import tables as TB
from ..sources.keyed import KeyedTable
from .arrivals import arrive, deal, file_stream, shared_folder
from .clocks import latest_progress_stream, stall_stream, timeout_stream

__all__ = ["Step", "admit_stream", "arrive", "deal", "file_stream", "late_events", "latest_progress_stream",
           "quarantine_stream", "reconcile_stream",
           "route_stream", "run_steps", "session_stream", "shared_folder", "stall_stream", "timeout_stream"]

WATERMARK = "10 minutes"
DELAY_S = 600
LATE = "reason string, batch int"


class Step(NamedTuple):
    """What a step is given: released events, its state, the output of earlier micro-batches, and the low mark."""
    events: DataFrame
    state: DataFrame
    written: DataFrame
    low_us: int | None


def _stored(spark, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def run_steps(stream: DataFrame, step: Callable[[Step], tuple[DataFrame, DataFrame | None]], out: str, path: str,
              state: str = "none int", ts: str = "ts", delay_s: int = DELAY_S) -> DataFrame:
    """Run ``step`` over all that is present; the output so far.

    ``step`` gives the output rows and the next state.  ``out`` and ``state``
    are schemas.  What still waits in the buffer is decided as it stands, in
    the returned frame only.
    """
    spark = stream.sparkSession
    events = stream.schema
    state_schema, out_schema = T.StructType.fromDDL(state), T.StructType.fromDDL(out)
    with_batch = T.StructType([*out_schema.fields, T.StructField("batch", T.IntegerType())])
    us = F.unix_micros(F.col(ts))

    def at(name: str, batch_id: int) -> str:
        return f"{path}/{name}/{batch_id}"

    def low_of(s, batch_id: int) -> int | None:
        rows = _stored(s, at("low", batch_id), T.StructType.fromDDL("low long")).collect() if batch_id >= 0 else []
        return rows[0].low if rows else None

    def given(s, held: DataFrame, batch_id: int, low: int | None) -> Step:
        written = _stored(s, f"{path}/out", with_batch).where(F.col("batch") < batch_id).drop("batch")
        return Step(held, _stored(s, at("state", batch_id - 1), state_schema), written, low)

    def each(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        low = low_of(s, batch_id - 1)
        batch = batch.persist()
        try:
            high = batch.agg(F.max(us)).first()[0]
            mark = low if high is None else max(high - delay_s * 1_000_000, low if low is not None else high - delay_s * 1_000_000)
            reason = F.when(F.col(ts).isNull(), F.lit("no time"))
            if low is not None:
                reason = reason.when(us < low, F.lit("late"))
            sorted_out = batch.withColumn("reason", reason)
            sorted_out.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            held = sorted_out.where("reason IS NULL").drop("reason").unionByName(_stored(s, at("held", batch_id - 1), events))
            before = (us < mark) if mark is not None else F.lit(False)
            output, after = step(given(s, held.where(before), batch_id, mark))
            output.select(*out_schema.names).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
            if after is not None:
                after.select(*state_schema.names).write.mode("overwrite").parquet(at("state", batch_id))
            held.where(~before).write.mode("overwrite").parquet(at("held", batch_id))
            s.createDataFrame([(mark,)], "low long").write.mode("overwrite").parquet(at("low", batch_id))
        finally:
            batch.unpersist()
        for name in ("state", "held", "low"):
            remove_path(s, at(name, batch_id - 2))

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    last = query.lastProgress.batchId if query.lastProgress is not None else -1
    while last >= 0 and not path_exists(spark, at("low", last)):  # a trigger without data leaves no folder
        last -= 1
    if last < 0:
        return _stored(spark, f"{path}/out", with_batch).drop("batch")
    rest = given(spark, _stored(spark, at("held", last), events), last + 1, low_of(spark, last))
    return rest.written.unionByName(step(rest)[0].select(*out_schema.names))


def late_events(spark, path: str, events: T.StructType) -> DataFrame:
    """Side table of ``run_steps``: events that came too late or without a time, with reason and micro-batch."""
    return _stored(spark, f"{path}/late", T.StructType([*events.fields, *T.StructType.fromDDL(LATE).fields]))


# -- I1 -----------------------------------------------------------------------
ADMIT_OUT = "event_id long, key string, ts timestamp, allowed boolean, remaining long, reset_at timestamp"
ADMIT_STATE = "key string, ts timestamp"


def admit_stream(requests: DataFrame, limit: int, window_s: int, path: str, tie: str = "event_id",
                 delay_s: int = DELAY_S) -> DataFrame:
    """state = the admitted moments that can still count, at most ``limit`` per key of the last window."""
    def step(given: Step):
        out = A.admit(given.events, limit, window_s, tie=tie, earlier=given.state)
        after = A.records_after(out.filter("allowed").select("key", "ts").union(given.state), window_s)
        if given.low_us is not None:
            after = after.where(F.unix_micros("ts") > given.low_us - window_s * 1_000_000)
        return out, after

    return run_steps(requests.select(tie, "key", "ts"), step, ADMIT_OUT, path, ADMIT_STATE, delay_s=delay_s)


# -- I3 -----------------------------------------------------------------------
ROUTE_OUT = "job_id string, event_id long, phase string, ts timestamp, kind string, job_status string"


def route_stream(events: DataFrame, path: str, jobs: Callable[[], DataFrame] | None = None, delay_s: int = DELAY_S) -> DataFrame:
    """Progress rows until a job's first terminal event, then one complete row.

    ``jobs`` reads the job table; it is called anew in each micro-batch, so a
    complete row carries the status that the table has when it is routed.
    Which jobs have ended is known from the complete rows written before.
    """
    def step(given: Step):
        ended = given.written.where("kind = 'complete'").select("job_id")
        routed = P.route_events(given.events.join(ended, "job_id", "left_anti"), jobs() if jobs else None)
        return (routed if jobs else routed.withColumn("job_status", F.lit(None).cast("string"))), None

    routed = run_steps(events, step, ROUTE_OUT, path, delay_s=delay_s)
    return routed if jobs else routed.drop("job_status")


# -- I6 -----------------------------------------------------------------------
RECONCILED = ("job_id string, event_id long, event_phase string, event_ts timestamp, table_status string, "
              "table_ts timestamp, status string, source string")


def reconcile_stream(events: DataFrame, jobs: Callable[[], DataFrame], path: str, buckets: int = 64,
                     since: Callable[[datetime], DataFrame] | None = None) -> DataFrame:
    """I6 over a stream of events and a job table that changes beside it.

    Each micro-batch reads the job table anew, but only the rows updated since
    the newest one seen (``updated_at``); ``since`` reads just these where the
    table can do better than all rows and a filter.  These and the jobs that
    the micro-batch has events of are merged into a stored table with one row
    per job, of which only the touched buckets are rewritten.  A row keeps the
    number of the micro-batch that changed it last; so what changed, written
    as a feed under that number, needs no join.  Returns the table.
    """
    spark = events.sparkSession
    table = KeyedTable(spark, f"{path}/jobs", f"{RECONCILED}, batch long", ("job_id",), buckets)

    def merged(rows: DataFrame) -> DataFrame:
        event, row = F.struct("event_ts", "event_id"), F.col("table_ts")
        # few rows a job: sums before the shuffle would only sort them once more
        one = rows.repartition("job_id").groupBy("job_id").agg(
            F.max_by(F.struct("event_id", "event_phase", "event_ts"), F.when(F.col("event_ts").isNotNull(), event)).alias("e"),
            F.max_by(F.struct("table_status", "table_ts"), row).alias("t"), F.max("batch").alias("batch"))
        return P.resolved(one.select("job_id", "e.*", "t.*", "batch")).select(*table.schema.names)

    def each(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        seen = _stored(s, f"{path}/low/{batch_id - 1}", T.StructType.fromDDL("low timestamp")).collect() if batch_id else []
        mark = seen[0].low if seen else None
        if mark is None:
            fresh = jobs()
        else:
            fresh = since(mark) if since else jobs().where(F.col("updated_at") >= F.lit(mark))
        of_events = P.latest_progress(batch.where("ts IS NOT NULL").select("job_id", "event_id", "phase", "ts")).select(
            "job_id", "event_id", F.col("phase").alias("event_phase"), F.col("ts").alias("event_ts"))
        of_table = fresh.select(F.col("id").alias("job_id"), F.col("status").alias("table_status"),
                                F.col("updated_at").alias("table_ts"))
        rows = of_events.unionByName(of_table, allowMissingColumns=True) \
            .withColumns({c: F.lit(None).cast("string") for c in ("status", "source")}) \
            .withColumn("batch", F.lit(batch_id).cast("long")).persist()
        try:
            table.merge(rows, merged)
            table.read().where((F.col("batch") == batch_id) & F.col("job_id").isNotNull()).drop("batch") \
                .write.mode("overwrite").parquet(f"{path}/feed/batch={batch_id}")
            newest = rows.agg(F.coalesce(F.max("table_ts"), F.lit(mark).cast("timestamp")).alias("low"))
            newest.write.mode("overwrite").parquet(f"{path}/low/{batch_id}")
        finally:
            rows.unpersist()
        remove_path(s, f"{path}/low/{batch_id - 2}")

    query = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return table.read().drop("batch")


# -- I7 -----------------------------------------------------------------------
SESSION_OUT = "job_id string, session_start timestamp, session_end timestamp, n_events long, phases map<string,long>"


def session_stream(events: DataFrame, path: str, gap_s: int = 3600) -> DataFrame:
    """Sessions per job with ``session_window`` (append mode, file sink).

    A silence of exactly ``gap_s`` doesn't end a session, hence the
    microsecond.  A session is written once the watermark has passed it; an
    event far ahead (a closing one) lets go of the last ones.  ``phases``
    counts the events of each job status; other phases count as ``other``.
    """
    spark = events.sparkSession
    names = [*STATUSES, "other"]
    phase = F.when(F.col("phase").isin(*STATUSES), F.col("phase")).otherwise(F.lit("other"))
    counts = [F.count(F.when(phase == n, 1)).alias(f"_n_{n}") for n in names]
    per_phase = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"_n_{n}") for n in names))),
                             lambda _, n: n > 0)
    sessions = events.withWatermark("ts", WATERMARK) \
        .groupBy("job_id", F.session_window("ts", f"{gap_s} seconds 1 microseconds").alias("sw")) \
        .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_events"), *counts) \
        .select("job_id", "session_start", "session_end", "n_events", per_phase.alias("phases"))
    query = sessions.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out") \
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    found = spark.read.schema(SESSION_OUT).parquet(f"{path}/out")
    return found.withColumn("duration_us", F.unix_micros("session_end") - F.unix_micros("session_start"))


# -- A5 -----------------------------------------------------------------------
QUARANTINE = "file string, line string, reason string"


def quarantine_stream(spark, source: str, path: str) -> DataFrame:
    """A5: unreadable messages of a folder of JSON lines, written to a side table of their own."""
    query = TB.unreadable_progress(spark, source, stream=True).writeStream.format("parquet").outputMode("append") \
        .option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.schema(QUARANTINE).parquet(f"{path}/out")
