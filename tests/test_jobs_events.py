import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import errors as ER
from tidemark.operators import admission as A
from tidemark.operators import jobs as J
from tidemark.operators import progress as P

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _req(spark, rows):
    return spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)],
                                 "event_id long, key string, ts timestamp")


def test_admission_rules(spark):
    rows = [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("a", 86400), ("a", 86400.5)]
    out = {r.event_id: r for r in A.admit(_req(spark, rows), limit=3, window_s=86400, tie="event_id").collect()}
    assert [out[i].allowed for i in range(5)] == [True, True, True, False, False]
    assert [out[i].remaining for i in range(4)] == [2, 1, 0, 0]
    assert out[3].reset_at == T0 + dt.timedelta(seconds=86400)   # oldest + window
    assert out[5].allowed and out[5].remaining == 2              # keys are independent
    assert out[6].allowed and out[6].remaining == 0              # the t=0 request expired (inclusive)
    assert not out[7].allowed                                    # rejected ones never counted


def test_admission_equal_timestamps(spark):
    out = A.admit(_req(spark, [("k", 5), ("k", 5), ("k", 5)]), limit=2, window_s=10, tie="event_id").collect()
    assert [(r.allowed, r.remaining) for r in sorted(out, key=lambda r: r.event_id)] == [(True, 1), (True, 0), (True, 0)]


def _decisions(requests, window):
    """The rule, request by request: (key, seconds, limit) in order."""
    held, out = {}, []
    for key, t, limit in requests:
        live = [x for x in held.get(key, []) if x > t - window]
        ok = len(live) < limit
        out.append((ok, max(0, limit - len(live) - 1) if ok else 0,
                    None if ok else (min(live) if live else t) + window))
        held[key] = sorted({*live, t}) if ok else live
    return out


def test_admission_by_the_rule(spark):
    import random
    rnd = random.Random(3)
    rows = sorted(((rnd.choice("abc"), rnd.choice([0, 5, 100, 3000]) * rnd.randrange(200), rnd.randrange(4))
                   for _ in range(800)), key=lambda r: r[1])
    df = spark.createDataFrame([(i, k, T0 + dt.timedelta(seconds=t), m) for i, (k, t, m) in enumerate(rows)],
                               "event_id long, key string, ts timestamp, lim int")
    for window in (7, 3600, 86400):
        got = A.admit(df, window_s=window, tie="event_id", limit_col="lim").orderBy("event_id").collect()
        want = _decisions(rows, window)
        assert [(r.allowed, r.remaining, None if r.reset_at is None else (r.reset_at - T0).total_seconds()) for r in got] == want


def _in_files(spark, df, path, n):
    """``df`` as ``n`` files in time order, read one by one."""
    from tidemark.streaming import streams as ST
    dealt = ST.deal(df, "ts", path, slices=n, files=1)
    for i in range(n):
        dealt.deliver(i)
    return ST.file_stream(spark, dealt.inbox, df.schema, files=1)


def test_admission_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming import streams as ST
    req = _req(spark, [(f"user:{i % 3}", i * 1000) for i in range(40)])
    got = ST.admit_stream(_in_files(spark, req, f"{tmp_path}/in", 5), 4, 7200, f"{tmp_path}/run").collect()
    exp = A.admit(req, limit=4, window_s=7200, tie="event_id").collect()
    key = lambda r: (r.event_id, r.allowed, r.remaining, r.reset_at)
    assert sorted(map(key, got), key=str) == sorted(map(key, exp), key=str)


def _events(spark, rows):
    return spark.createDataFrame(
        [(j, i, p, "m", 1, 2, T0 + dt.timedelta(seconds=s)) for i, (j, s, p) in enumerate(rows)],
        "job_id string, event_id long, phase string, message string, completed int, total int, ts timestamp")


EVENTS = [("a", 0, "pending"), ("b", 1, "pending"), ("a", 50, "extracting"), ("b", 290, "completed"), ("c", 300, "pending"),
          ("a", 350, "extracting"), ("b", 900, "pending"), ("a", 1000, "failed"), ("a", 5000, "pending"), ("d", 5100, "pending")]


def test_event_streams_over_several_batches(spark, tmp_path):
    from tidemark.streaming import streams as ST
    ev = _events(spark, EVENTS)
    stream = lambda name: _in_files(spark, ev, f"{tmp_path}/{name}-in", 5)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    latest = ST.latest_progress_stream(stream("latest"), f"{tmp_path}/latest")
    assert same(latest, P.latest_progress(ev)) and latest.count() == 4
    assert same(ST.route_stream(stream("route"), f"{tmp_path}/route"), P.route_events(ev))
    assert same(ST.timeout_stream(stream("timeout"), f"{tmp_path}/timeout"), P.job_timeouts(ev))
    as_of = T0 + dt.timedelta(seconds=5400)
    assert same(ST.stall_stream(stream("stall"), f"{tmp_path}/stall", as_of=as_of), P.stalls(ev, as_of=F.lit(as_of)))


def test_event_streams_forget_nothing_over_90_days(spark, tmp_path):
    from tidemark.streaming import streams as ST
    day = 86400
    ev = _events(spark, [("silent", 0, "pending"), ("ended", 60, "pending"), ("ended", 120, "completed"),
                         ("slow", day, "pending"), ("busy", 2 * day, "pending"), ("busy", 45 * day, "extracting"),
                         ("slow", 70 * day, "extracting"), ("ended", 80 * day, "pending"), ("busy", 90 * day, "failed")])
    stream = lambda name: _in_files(spark, ev, f"{tmp_path}/{name}-in", 6)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    as_of = T0 + dt.timedelta(days=91)
    assert same(ST.latest_progress_stream(stream("latest"), f"{tmp_path}/latest"), P.latest_progress(ev))
    assert same(ST.timeout_stream(stream("timeout"), f"{tmp_path}/timeout"), P.job_timeouts(ev))
    assert same(ST.stall_stream(stream("stall"), f"{tmp_path}/stall", as_of=as_of), P.stalls(ev, as_of=F.lit(as_of)))
    assert same(ST.route_stream(stream("route"), f"{tmp_path}/route"), P.route_events(ev))


def test_stalls(spark):
    as_of = T0 + dt.timedelta(seconds=5400)
    got = sorted((r.job_id, (r.stall_start - T0).seconds, r.stall_end and (r.stall_end - T0).seconds)
                 for r in P.stalls(_events(spark, EVENTS), as_of=F.lit(as_of)).collect())
    # b ended at 290, a at 1000: what comes later is no stall; c and d never spoke again
    assert got == [("a", 50, 350), ("a", 350, 1000), ("c", 300, None), ("d", 5100, None)]


def test_worker_and_shown_errors(spark):
    df = spark.createDataFrame([("TimeoutError", "x", False), ("ValueError", "DNS failure", False),
                                ("ValueError", "boom", False), ("KeyError", "x", True)],
                               "t string, m string, soft boolean")
    got = [r.o for r in df.select(ER.worker_error(F.col("t"), F.col("m"), F.col("soft")).alias("o")).collect()]
    assert got == [ER.WORKER_ERRORS["TimeoutError"], "DNS failure", ER.GENERIC_ERROR, ER.SOFT_TIME_LIMIT_ERROR]
    s = spark.createDataFrame([(None,), ("",), ("Rate limit exceeded",), ("Traceback: KeyError",)], "e string")
    assert [r.o for r in s.select(ER.shown_error(F.col("e")).alias("o")).collect()] == \
        [None, None, "Rate limit exceeded", ER.GENERIC_ERROR]


def test_visibility_and_history(spark):
    jobs = spark.createDataFrame([("j1", "u1", T0), ("j2", None, T0), ("j3", "u1", T0 + dt.timedelta(days=1))],
                                 "id string, user_id string, created_at timestamp") \
        .withColumn("url", F.lit("https://x")).withColumn("mode", F.lit("default")).withColumn("status", F.lit("pending")) \
        .withColumn("updated_at", F.col("created_at")).withColumn("completed_at", F.lit(None).cast("timestamp"))
    callers = spark.createDataFrame([("a", "j1", None), ("b", "j1", "u2"), ("c", "j1", "u1"), ("d", "j2", "u2"), ("e", "nope", None)],
                                    "request_id string, job_id string, caller_user_id string")
    vis = {r.request_id: r.visible for r in J.visible_jobs(jobs, callers).collect()}
    assert vis == {"a": True, "b": False, "c": True, "d": True, "e": False}
    hist = J.job_history(jobs, n=1).collect()
    assert [(r.user_id, r.id) for r in hist] == [("u1", "j3")]


def test_progress_pct_and_routing(spark):
    df = spark.createDataFrame([(p,) for p in ["pending", "extracting", "completed", "failed", "weird"]], "p string")
    assert [r.o for r in df.select(J.progress_pct("p").alias("o")).collect()] == [0.0, 40.0, 100.0, 0.0, 0.0]
    ev = spark.createDataFrame([("j", 1, "extracting", T0), ("j", 2, "completed", T0 + dt.timedelta(seconds=5)),
                                ("j", 3, "extracting", T0 + dt.timedelta(seconds=9))],
                               "job_id string, event_id long, phase string, ts timestamp")
    routed = P.route_events(ev).orderBy("event_id").collect()
    assert [(r.event_id, r.kind) for r in routed] == [(1, "progress"), (2, "complete")]
    t = P.job_timeouts(ev, limit_s=3).first()
    assert t.timed_out and t.status == "failed"
    st = P.stalls(ev, gap_s=3).collect()
    assert [r.gap_us for r in st] == [5_000_000]  # the job ended: the later silence is no stall
