"""Streams while they run: timers, disorder, late events, a job table that changes, messages in files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import admission as A
from tidemark.operators import progress as P
from tidemark.sources import tables as TB
from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import clocks as CK
from tidemark.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, event_id long, phase string, message string, completed int, total int, ts timestamp"


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def events(spark, rows):
    return spark.createDataFrame([(j, i, p, "m", None, 2, at(s)) for i, (j, s, p) in enumerate(rows)], SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def in_turn(spark, folder, run, batches):
    """``run`` after each list of rows has arrived; what it returned each time."""
    out = []
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out.append(run(ST.file_stream(spark, f"{folder}/in", events(spark, []).schema), f"{folder}/run"))
    return out


def written(spark, folder, schema):
    return spark.read.schema(schema).parquet(f"{folder}/run/out")


def test_timeout_is_written_when_due(spark, tmp_path):
    seen = []

    def run(stream, path):
        ST.timeout_stream(stream, path)
        rows = written(spark, str(tmp_path), CK.VERDICT_OUT).collect()
        seen.append((sorted((r.job_id, r.start_us // CK.SECOND, r.timed_out) for r in rows), CK.open_state(spark, path).count()))

    zero = int(T0.replace(tzinfo=dt.UTC).timestamp())
    in_turn(spark, str(tmp_path), run, [
        [("a", 0, "pending"), ("b", 10, "pending"), ("b", 20, "completed")],
        [("c", 800, "pending")],          # the watermark passes b's end (20), not yet a's deadline (300)
        [("c", 950, "completed")],        # a is due; its row comes in this micro-batch
        [("a", 3000, "failed")],
        [("d", 9000, "pending")]])
    assert seen[0] == ([], 2)
    assert seen[1] == ([("b", zero + 10, False)], 2)
    assert seen[2][0] == [("a", zero, True), ("b", zero + 10, False)]
    assert ("c", zero + 800, False) in seen[3][0]
    assert seen[-1][1] == 1  # only d is open


def test_silence_is_written_when_due(spark, tmp_path):
    seen = []

    def run(stream, path):
        ST.stall_stream(stream, path)
        rows = written(spark, str(tmp_path), CK.SILENCE_OUT).collect()
        seen.append(sorted((r.job_id, r.kind) for r in rows if r.kind != "resumed"))

    in_turn(spark, str(tmp_path), run, [
        [("a", 0, "pending"), ("b", 10, "pending")], [("b", 950, "failed")], [("c", 2000, "pending")], [("a", 5000, "pending")]])
    assert seen == [[], [("a", "silent"), ("b", "silent")], [("a", "silent"), ("b", "ended"), ("b", "silent")],
                    [("a", "silent"), ("b", "ended"), ("b", "silent"), ("c", "silent")]]


def test_latest_expires(spark, tmp_path):
    out = in_turn(spark, str(tmp_path), lambda s, path: ST.latest_progress_stream(s, path, live=True).collect(), [
        [("a", 0, "pending"), ("a", 5, "extracting"), ("b", 100, "pending")], [("c", 950, "pending")], [("a", 960, "completed")]])
    live = [{r.job_id: (r.phase, r.live) for r in rows} for rows in out]
    assert live[0] == {"a": ("extracting", True), "b": ("pending", True)}
    assert live[1] == {"a": ("extracting", False), "b": ("pending", True), "c": ("pending", True)}
    assert live[2]["a"] == ("completed", True)


def shuffled(seed, n=300, span=40_000, jobs="abcdefgh"):
    rnd = random.Random(seed)
    phases = ["pending", "extracting", "enhancing", "generating"] * 6 + ["completed", "failed"]
    rows = [(rnd.choice(jobs), rnd.choice([1, 60, 300]) * rnd.randrange(span // 300), rnd.choice(phases)) for _ in range(n)]
    return sorted(rows, key=lambda r: r[1])


def test_disorder_within_the_delay_changes_nothing(spark, tmp_path):
    ev = events(spark, shuffled(1))
    as_of = at(50_000)

    def over(name, run):
        dealt = ST.deal(ev, "ts", f"{tmp_path}/{name}/in", slices=3, files=2, delay_s=590, tie="event_id")
        return ST.arrive(dealt, lambda s: run(s, f"{tmp_path}/{name}/run"))

    assert same(over("latest", ST.latest_progress_stream), P.latest_progress(ev))
    assert same(over("route", ST.route_stream), P.route_events(ev))
    assert same(over("timeout", ST.timeout_stream), P.job_timeouts(ev))
    assert same(over("stall", lambda s, p: ST.stall_stream(s, p, as_of=as_of)), P.stalls(ev, as_of=F.lit(as_of)))
    req = ev.select("event_id", F.col("job_id").alias("key"), "ts")
    dealt = ST.deal(req, "ts", f"{tmp_path}/admit/in", slices=3, files=2, delay_s=590, tie="event_id")
    got = ST.arrive(dealt, lambda s: ST.admit_stream(s, 3, 1800, f"{tmp_path}/admit/run"))
    assert same(got, A.admit(req, 3, 1800, tie="event_id"))
    for name in ("route", "admit"):
        assert ST.late_events(spark, f"{tmp_path}/{name}/run", ev.schema).count() == 0


def test_late_events_go_to_the_side_table(spark, tmp_path):
    batches = [[("a", 0, "pending"), ("b", 2000, "pending")], [("a", 100, "completed"), ("a", 1500, "extracting"), ("c", None, "pending")],
               [("b", 9000, "completed")]]
    out = in_turn(spark, str(tmp_path), ST.route_stream, batches)
    late = ST.late_events(spark, f"{tmp_path}/run", events(spark, []).schema).collect()
    assert sorted((r.job_id, r.phase, r.reason, r.batch) for r in late) == [("a", "completed", "late", 1), ("c", "pending", "no time", 1)]
    assert sorted((r.job_id, r.kind) for r in out[-1].collect()) == [
        ("a", "progress"), ("a", "progress"), ("b", "complete"), ("b", "progress")]


def test_state_is_bounded_by_open_jobs(spark, tmp_path):
    day = 86_400
    rows = [(f"j{i}", i * day // 4 + s, p) for i in range(360) for s, p in ((0, "pending"), (60, "extracting"), (120, "completed"))]
    rows = [r for r in rows if not (r[0][-1] == "7" and r[2] == "completed")] + [("j5", 89 * day, "pending")]
    rows.sort(key=lambda r: r[1])
    ev = events(spark, rows)
    as_of = at(91 * day)

    def over(name, run):
        dealt = ST.deal(ev, "ts", f"{tmp_path}/{name}/in", slices=3, files=2)
        return ST.arrive(dealt, lambda s: run(s, f"{tmp_path}/{name}/run"))

    assert same(over("timeout", ST.timeout_stream), P.job_timeouts(ev))
    assert same(over("stall", lambda s, p: ST.stall_stream(s, p, as_of=as_of)), P.stalls(ev, as_of=F.lit(as_of)))
    assert same(over("latest", ST.latest_progress_stream), P.latest_progress(ev))
    for name in ("timeout", "stall", "latest"):
        assert CK.open_state(spark, f"{tmp_path}/{name}/run").count() <= 2, name  # of 360 jobs


def test_unusable_events(spark, tmp_path):
    ev = events(spark, [("a", 0, "pending"), ("a", None, "completed"), (None, 5, "pending")])
    assert sorted(r.reason for r in CK.unusable(ev).collect()) == ["no job", "no time"]
    out = in_turn(spark, str(tmp_path), ST.timeout_stream, [[("a", 0, "pending"), ("a", None, "completed"), (None, 5, "pending")], []])
    assert [(r.job_id, r.timed_out) for r in out[-1].collect()] == [("a", True)]


def job_table(spark, rows):
    return spark.createDataFrame([(i, s, at(u)) for i, s, u in rows], "id string, status string, updated_at timestamp")


def test_complete_rows_carry_the_status_of_their_moment(spark, tmp_path):
    tables = iter([[("a", "pending", 0)], [("a", "failed", 900)], [("a", "failed", 900), ("b", "completed", 5000)]])
    now = []

    def run(stream, path):
        now[:] = next(tables)
        return ST.route_stream(stream, path, lambda: job_table(spark, now))

    out = in_turn(spark, str(tmp_path), run, [
        [("a", 0, "pending"), ("a", 10, "completed")], [("b", 1000, "pending")], [("b", 2000, "completed"), ("c", 9000, "pending")]])
    got = {(r.job_id, r.phase): (r.kind, r.job_status) for r in out[-1].collect()}
    assert got[("a", "completed")] == ("complete", "failed")  # released in the second micro-batch
    assert got[("b", "completed")] == ("complete", "completed")
    assert got[("b", "pending")] == ("progress", None)


def test_reconcile_with_a_changing_job_table(spark, tmp_path):
    tables = [[("a", "pending", 0), ("x", "pending", -10)],
              [("a", "cancelled", 500), ("x", "pending", -10), ("b", "pending", 600)],
              [("a", "cancelled", 500), ("x", "failed", 700), ("b", "pending", 600)]]
    batches = [[("a", 0, "pending"), ("a", 3, "extracting")], [("b", 700, "pending")], [("b", 690, "extracting"), ("c", 800, "completed")]]
    now, seen = [], []

    def run(stream, path):
        now[:] = tables[len(seen)]
        out = ST.reconcile_stream(stream, lambda: job_table(spark, now), path, buckets=8)
        rows = [r for rows in batches[:len(seen) + 1] for r in rows]
        ev = spark.createDataFrame([(j, i, p, at(s)) for i, (j, s, p) in enumerate(rows)],
                                   "job_id string, event_id long, phase string, ts timestamp")
        want = P.reconcile(P.latest_progress(ev), job_table(spark, now))
        assert same(out.select("job_id", "event_phase", "table_status", "status", "source"), want)
        seen.append(spark.read.parquet(f"{path}/feed/batch={len(seen)}").select("job_id", "status").collect())

    in_turn(spark, str(tmp_path), run, batches)
    assert sorted(map(tuple, seen[1])) == [("a", "cancelled"), ("b", "pending")]      # lost terminal event found in the table
    assert sorted(map(tuple, seen[2])) == [("b", "pending"), ("c", "completed"), ("x", "failed")]


def test_messages_in_files(spark, tmp_path):
    good = '{"job_id": "a", "phase": "%s", "message": "m", "timestamp": "2024-01-01T00:00:%02dZ"}'
    files = [[good % ("pending", 1), "{not json", ""], [good % ("completed", 9), '["a"]', '{"phase": "pending"}'], [good % ("extracting", 5)]]
    for lines in files:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        latest = ST.latest_progress_stream(TB.progress_events(spark, f"{tmp_path}/in", stream=True), f"{tmp_path}/run")
        bad = ST.quarantine_stream(spark, f"{tmp_path}/in", f"{tmp_path}/bad")
    assert [(r.job_id, r.phase, r.ts) for r in latest.collect()] == [("a", "completed", at(9))]
    rows = bad.collect()
    assert sorted((r.line, r.reason) for r in rows) == [
        ("", "not a JSON object"), ('["a"]', "not a JSON object"), ('{"phase": "pending"}', "no job_id"), ("{not json", "not a JSON object")]
    assert len({r.file for r in rows}) == 2 and all(r.file.endswith(".txt") for r in rows)
    assert TB.read_progress(spark, f"{tmp_path}/in").count() == 3
    assert TB.unreadable_progress(spark, f"{tmp_path}/in").count() == 4


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v long", ("k",), buckets=8)
    newest = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    files = lambda: {r[0] for r in spark.read.parquet(f"{tmp_path}/t/rows").select("_metadata.file_path").distinct().collect()}
    assert table.read().count() == 0 and table.merge(frame([]), newest) == 0
    table.merge(frame([(f"k{i}", 1) for i in range(100)] + [(None, 1)]), newest)
    before = files()
    assert table.merge(frame([("k3", 5), ("k3", 2)]), newest) == 1
    assert len(before - files()) == 1 and len(files()) == 8
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 101 and got["k3"] == 5 and got["k4"] == 1 and got[None] == 1
    table.merge(frame([("k3", 5)]), newest)  # once more: nothing changes
    assert {r.k: r.v for r in table.read().collect()} == got
