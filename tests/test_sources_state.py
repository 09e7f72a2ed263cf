import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import enhance as FE
from tidemark.operators import extract as X
from tidemark.operators import pagestate as PS
from tidemark.operators import sitemaps as SM
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import tables as TB


def test_parse_config_defaults_and_bounds(spark):
    df = spark.createDataFrame([("a", None), ("b", '{"mode": "detailed", "crawl": {"max_urls": 100}}'),
                                ("c", '{"crawl": {"max_urls": 0}}'), ("d", '{"mode": "quick"}'),
                                ("e", '{"crawl": {"max_depth": 4, "timeout_seconds": 5}}'), ("f", "not json")],
                               "id string, config string")
    got = {r.id: (r.mode, r.max_urls, r.max_depth, r.timeout_seconds, r.reject_reason)
           for r in TB.parse_config(df).collect()}
    assert got["a"] == ("default", 50, 2, 30, None)
    assert got["b"] == ("detailed", 100, 2, 30, None)
    assert got["c"][-1] == "max_urls: must be >= 1"
    assert got["d"][-1] == "mode: 'quick' is not a valid choice"
    assert got["e"][-1] == "max_depth: must be <= 3"
    assert got["f"][-1] == "config: not a JSON object"


def test_split_fresh(spark):
    as_of = dt.datetime(2024, 1, 1, 2, 0, 0)
    good = '{"source": "/sitemap.xml", "entries": [{"url": "u", "priority": 0.5}, {"url": "v", "priority": null}]}'
    young = as_of - dt.timedelta(seconds=100)
    rows = [("k1", good, young), ("k2", good, as_of - dt.timedelta(seconds=3600)), ("k3", None, as_of), ("k4", good, None),
            ("k5", '{"source": "robots.txt"}', young)]
    bad = ["not json", '{"entries": [1]}', '{"source": "x", "entries": [1]}', "{}", "[]", '{"source": 1}', "",
           '{"source": "x", "entries": [{"url": 1}]}', '{"source": "x", "entries": [{"url": "u", "priority": [1]}]}',
           '{"source": "x", "entries": null}', '{"source": "x", "entries": {"url": "u"}}']
    rows += [(f"bad{i}", v, young) for i, v in enumerate(bad)]
    fresh, stale = SM.split_fresh(spark.createDataFrame(rows, "key string, value string, parsed_at timestamp"), as_of)
    assert sorted(r.key for r in fresh.collect()) == ["k1", "k5"]
    assert stale.count() == len(rows) - 2


def test_sitemap_candidates(spark):
    robots = spark.createDataFrame([("s", ["https://s/a.xml", "https://s/b.xml"]), ("t", [])],
                                   "site string, sitemap_urls array<string>")
    bases = spark.createDataFrame([("s", "https://s/x"), ("t", "https://t/deep/page?q=1"), ("u", "http://u")],
                                  "site string, base_url string")
    got = sorted((r.site, r.cand_pos, r.sitemap_url) for r in SM.sitemap_candidates(robots, bases).collect())
    assert got == [("s", 0, "https://s/a.xml"), ("s", 1, "https://s/b.xml"),
                   ("t", 0, "https://t/sitemap.xml"), ("t", 1, "https://t/sitemap_index.xml"),
                   ("u", 0, "http://u/sitemap.xml"), ("u", 1, "http://u/sitemap_index.xml")]


def test_write_documents_round_trip(spark):
    import os
    import uuid
    docs = spark.createDataFrame([("s", "# S\n"), ("t", "# T\n")], "site string, doc string")
    metrics = spark.createDataFrame([("s", 3, 2, 1, 4, 0.002), ("t", 1, 1, 0, 3, 0.0015)],
                                    "site string, total_pages long, pages_processed long, pages_failed long, "
                                    "llm_calls_made long, llm_cost_usd double")
    path = os.path.join(ensure_checkpoint_dir(spark), "test-sink", uuid.uuid4().hex)
    TB.write_documents(docs, metrics, path)
    back = {r.site: r.doc for r in spark.read.parquet(f"{path}/docs").collect()}
    meta = {r.site: json.loads(r.meta) for r in spark.read.parquet(f"{path}/meta").collect()}
    assert back == {"s": "# S\n", "t": "# T\n"}
    assert meta["s"] == {"total_pages": 3, "pages_processed": 2, "pages_failed": 1, "llm_calls_made": 4,
                         "llm_cost_usd": 0.002}


def test_run_inference_captures_failures(spark):
    req = spark.createDataFrame([("r1", "hello"), ("r2", "boom"), ("r3", "")], "request_id string, prompt string")

    def fn(rec):
        if rec["prompt"] == "boom":
            raise ValueError("bad input")
        return rec["prompt"].upper()

    got = {r.request_id: (r.reply, r.error) for r in FE.run_inference(req, fn, parallelism=2).collect()}
    assert got["r1"] == ("HELLO", None) and got["r3"] == ("", None)
    assert got["r2"][0] is None and got["r2"][1].startswith("ValueError: bad input")


def _extract(spark, rows, cols="url string, html string"):
    return X.with_content(X.with_csr(X.extract_pages(spark.createDataFrame(rows, cols))))


def test_rerender_merge_rules(spark):
    shell = "<html><head><title>App</title></head><body><div id='root'></div></body></html>"
    full = "<html><head><title>Real</title></head><body><main>" + "<p>Plenty of real text here.</p>" * 10 + "</main></body></html>"
    nf = "<html><head><title>Real</title></head><body><main><p>Page not found</p>" + "<p>filler text here</p>" * 10 + "</main></body></html>"
    fetches = spark.createDataFrame([("u1", 200, "text/html", shell, None), ("u2", 403, "text/html", full, None),
                                     ("u3", 200, "text/html", shell, None), ("u4", 200, "text/html", full, None),
                                     ("u5", 200, "text/html", shell, None)],
                                    "url string, status int, content_type string, html string, error string")
    c = PS.classify_fetch(fetches)
    http = _extract(spark, [(r.url, r.html or "") for r in c.collect()])
    http = http.join(c.select("url", "fetch_status", "error"), "url")
    http = PS.flag_soft_404(http, use_content=False)
    need = sorted(r.url for r in PS.needs_render(http).collect())
    assert need == ["u1", "u2", "u3", "u5"]                      # CSR shells and the 403
    rendered_raw = {"u1": (200, full, None), "u2": (200, full, None), "u3": (0, None, "Timeout"), "u5": (200, nf, None)}
    ok = [(u, h) for u, (s, h, e) in rendered_raw.items() if e is None]
    rex = _extract(spark, ok).withColumn("fetch_status", F.lit(200)).withColumn("error", F.lit(None).cast("string"))
    rex = PS.flag_soft_404(rex, use_content=True)                   # rendered path: content checked too
    failed = spark.createDataFrame([("u3", 0, "Timeout")], "url string, fetch_status int, error string")
    rendered = rex.select("url", "title", "content_text", "fetch_status", "error").unionByName(
        failed.withColumn("title", F.lit(None).cast("string")).withColumn("content_text", F.lit(None).cast("string")))
    merged = {r.url: r for r in PS.merge_rendered(http.select("url", "title", "content_text", "is_js_rendered",
                                                              "fetch_status", "error"), rendered).collect()}
    assert merged["u1"].is_js_rendered and merged["u1"].title == "Real"
    assert merged["u2"].is_js_rendered and merged["u2"].error is None and merged["u2"].fetch_status == 200
    assert merged["u3"].title == "App" and merged["u3"].error is None      # failed render keeps the original
    assert merged["u4"].is_js_rendered is False
    assert merged["u5"].title == "App"                                    # soft-404 render keeps the original
