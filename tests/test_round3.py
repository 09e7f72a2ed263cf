"""What a task holds: pages parsed in slices, rules tried inside rows, silences from buckets."""

import datetime as dt
import gc
import weakref

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import extract as X
from tidemark.operators import htmltree
from tidemark.operators import progress as P
from tidemark.operators import sections as E
from tidemark.streaming import clocks as CK

T0 = dt.datetime(2024, 1, 1)


def test_rules_of_a_site_travel_in_few_rows(spark):
    rules = [("a", f"n{i}", f"/w{i % 3}" + ("s" if i % 2 else ""), i % 5, i) for i in range(300)] + [("b", "n", "x", None, 0)]
    df = spark.createDataFrame(rules, "site string, name string, pattern string, priority int, position int")
    rows = E.rule_rows(df).collect()
    # six patterns of the words w0, w1, w2, and the ones with an s; one of b without a word
    assert sorted((r.site, r.word, len(r.rules)) for r in rows) == [("a", f"w{i}{s}", 1) for i in range(3) for s in ("", "s")] + [("b", "", 1)]
    many = spark.range(1000).select(F.lit("a").alias("site"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("x"), "id").alias("pattern"),
                                    F.lit(1).alias("priority"), F.col("id").alias("position"))
    sizes = [len(r.rules) for r in E.rule_rows(many, 100).collect()]
    assert sum(sizes) == 1000 and 5 < len(sizes) <= 10
    pages = spark.createDataFrame([("a", "/w1s/x77"), ("a", "/w0"), ("b", "/x"), ("b", "/y"), ("c", "/w0"), ("a", None)], "site string, path string")
    got = {(r.site, r.path): r.section for r in E.match_rules(pages, df.union(many)).collect()}
    # the highest priority, then the lowest position, of all rules whose pattern the path holds
    order = sorted((-(p or 0), i, n, s, w) for s, n, w, p, i in rules + [("a", f"n{i}", f"x{i}", 1, i) for i in range(1000)])
    want = {(s, p): next((n for _, _, n, t, w in order if t == s and w in p), None) for s, p in [("a", "/w1s/x77"), ("a", "/w0"), ("b", "/x"), ("b", "/y")]}
    assert got == {k: v for k, v in want.items() if v}


def test_pages_are_parsed_in_slices():
    texts = ["x" * n for n in (10, 500, 600, 2000, 1)] + [None]
    batch = pa.RecordBatch.from_pydict({"html": pa.array(texts, pa.string()), "k": list(range(6))})
    parts = list(X.slices(batch, "html", 1000))
    assert [p.num_rows for p in parts] == [2, 1, 1, 2]
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))
    assert list(X.slices(batch.slice(0, 0), "html")) == []


def test_trees_go_without_the_collector(monkeypatch):
    class Seen(htmltree.Node):
        __slots__ = ("__weakref__",)

        def __init__(self, *args):
            super().__init__(*args)
            alive.add(self)

    alive = weakref.WeakSet()
    monkeypatch.setattr(htmltree, "Node", Seen)
    gc.disable()
    try:
        page = X.candidates_of("u", "<body><nav><ul><li>menu</li></ul></nav><main><p>" + "word " * 50 + "</p><a href='/a'>b</a></main></body>")
        assert "word word" in page["markdown"] and "menu" not in page["markdown"] and page["links"] == ["/a"]
        assert len(alive) == 0
    finally:
        gc.enable()


def test_silences_need_no_join(spark):
    schema = "job_id string, event_id long, phase string, ts timestamp"
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    rows = [("a", 0, "pending"), ("a", 299, "pending"), ("a", 600, "pending"), ("a", 600, "completed"), ("a", 600, "pending"), ("a", 2000, "pending"),
            ("b", 0, None), ("b", 300, "pending"), ("b", 300, "pending"), (None, 0, "pending"),
            ("c", None, "completed"), ("c", 0, "pending"), ("c", 900, "pending"), ("d", None, "pending"), ("d", 10, "pending"), ("d", 310, "pending")]
    df = spark.createDataFrame([(j, i, p, at(s)) for i, (j, s, p) in enumerate(rows)], schema)
    out = P.stalls(df, as_of=F.lit(at(605)).cast("timestamp"))
    seconds = lambda t: None if t is None else (t - T0).total_seconds()
    got = sorted((r.job_id, seconds(r.stall_start), seconds(r.stall_end) or -1, r.gap_us // 1_000_000) for r in out.collect())
    assert got == [("a", 299, 600, 301), ("b", 0, 300, 300), ("b", 300, -1, 305), ("d", 10, 310, 300)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


class State:
    """A job's state as Spark hands it to a step."""
    hasTimedOut, exists, get = False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentWatermarkMs(self):
        return 0

    def setTimeoutTimestamp(self, ms):
        self.due = ms


def test_steps_of_a_job_take_rows_as_they_are(monkeypatch):
    def no(*_, **__):
        raise AssertionError("a frame operation per job")

    latest = pd.DataFrame({"job_id": ["j"] * 4, "event_id": [1, 2, 4, 3], "phase": ["a", "b", "c", None], "message": [None, "m", "n", "o"],
                           "completed": [1.0, None, 2.0, 3.0], "total": [2] * 4, "us": [4, 3, 9, 9]})
    spans = pd.DataFrame({"start_us": [5, 3], "end_us": [None, 8.0], "phase": [None, "failed"]})
    points = pd.DataFrame({"first_us": [0, 900], "last_us": [10, 950], "end_us": [None, None]})
    for name in ("sort_values", "itertuples", "to_dict"):
        monkeypatch.setattr(pd.DataFrame, name, no)
    monkeypatch.setattr(pd.DataFrame, "__getitem__", lambda self, c, get=pd.DataFrame.__getitem__: no() if isinstance(c, list) else get(self, c))
    state = State()
    rows = list(CK._latest_step(5)(("j",), iter([latest, latest[latest["event_id"] < 3]]), state))
    assert state.get == (4, "c", "n", 2, 2, 9)
    assert [[r[c].tolist()[0] for c in r.columns] for r in rows] == [["j", 4, "c", "n", 2, 2, 9, False]]
    state = State()
    assert list(CK._verdict_step(5)(("j",), iter([spans]), state)) == [] and state.get == (3, 8, "failed")
    state.hasTimedOut = True
    assert [[r[c].tolist()[0] for c in r.columns] for r in CK._verdict_step(5)(("j",), iter([]), state)] == [["j", 3, 8, "failed", False]]
    state = State()
    assert list(CK._silence_step(300)(("j",), iter([points]), state)) == [] and state.get == (None, [0, 10, 900, 950], None)
