"""What reconciling costs as the job table grows: updated rows only, one write, more tasks."""

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.keyed import KeyedTable
from tidemark.streaming import arrivals as AR
from tidemark.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id string, event_id long, phase string, ts timestamp"


def at(s):
    return None if s is None else T0 + dt.timedelta(seconds=s)


def test_reconcile_reads_what_was_updated_and_joins_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "join", lambda *_, **__: 1 / 0)
    tables = [[("a", "pending", 0), ("x", "pending", -10)], [("a", "pending", 0), ("x", "failed", 9)],
              [("a", "pending", 0), ("x", "failed", 9), ("b", "pending", 8)]]
    batches = [[("a", 0, "pending"), (None, 0, "pending")], [("c", 5, "pending"), ("c", None, "failed")], [("a", 7, "completed"), (None, 1, "failed")]]
    read, feeds, seen = [], [], []
    for i, (jobs, events) in enumerate(zip(tables, batches, strict=True)):
        frame = spark.createDataFrame([(j, s, at(u)) for j, s, u in jobs], "id string, status string, updated_at timestamp")

        def whole(frame=frame):
            read.append(None)
            return frame

        def since(mark, frame=frame):
            read.append((mark - T0).total_seconds())
            return frame.where(F.col("updated_at") >= F.lit(mark))

        seen += events
        spark.createDataFrame([(j, n, p, at(s)) for n, (j, s, p) in enumerate(seen)], EVENTS).where(F.col("event_id") >= len(seen) - len(events)) \
            .coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = ST.reconcile_stream(AR.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), whole, f"{tmp_path}/run", 4, since)
        feeds.append(sorted((r.job_id, r.status) for r in spark.read.parquet(f"{tmp_path}/run/feed/batch={i}").collect()))
    assert read == [None, 0, 9]
    assert feeds == [[("a", "pending"), ("x", "pending")], [("a", "pending"), ("c", "pending"), ("x", "failed")],
                     [("a", "completed"), ("x", "failed")]]
    assert out.columns == [f.split()[0] for f in ST.RECONCILED.split(", ")]
    # b came to the table with a moment before the newest one seen
    assert sorted((str(r.job_id), r.event_phase, r.table_status, r.status, r.source) for r in out.collect()) == [
        ("None", "failed", None, "failed", "event"), ("a", "completed", "pending", "completed", "event"), ("c", "pending", None, "pending", "event"),
        ("x", None, "failed", "failed", "table")]


def test_a_merge_writes_its_rows_once(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v long", ("k",), buckets=4)
    newest = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    frame = lambda rows: spark.createDataFrame(rows, "k string, v long")
    table.merge(frame([(f"k{i}", 1) for i in range(50)] + [(None, 1)]), newest)
    written, write = [], type(frame([]).write).parquet
    monkeypatch.setattr(type(frame([]).write), "parquet", lambda self, path, *a, **b: (written.append(path), write(self, path, *a, **b))[1])
    table.merge(table.read().select("k", (F.col("v") + 1).alias("v")).where("k <> 'k7'"), newest)  # reads the buckets that it replaces
    assert written == [f"{tmp_path}/t/rows"]
    assert {r.k: r.v for r in table.read().collect()} == {f"k{i}": 1 if i == 7 else 2 for i in range(50)} | {None: 1}


def test_a_large_table_is_dealt_by_more_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    files = lambda name: AR.deal(df, "ts", f"{tmp_path}/{name}", slices=1, files=2) and \
        spark.read.parquet(f"{tmp_path}/{name}/dealt").select(F.input_file_name()).distinct().count()
    assert files("small") == 2
    monkeypatch.setattr(AR, "ROWS_A_TASK", 100)
    assert files("large") == 10
    assert spark.read.parquet(f"{tmp_path}/large/dealt").select("event_id").distinct().count() == 1000
