"""Runs from configuration to document, and the bounded key set that thins the snapshots out."""

import json

from pyspark.sql import functions as F

from tidemark.operators import crawl as C
from tidemark.operators.keyset import KeySet, bits_for
from tidemark.plans import runs as RN
from tidemark.sources import tables as TB

HTML = "<html><head><title>{t}</title></head><body><main><p>{p}</p>{links}</main></body></html>"


def page(title, *links):
    text = f"All about {title}, said in enough words to be taken for content. " * 4
    return HTML.format(t=title, p=text, links="".join(f'<a href="{h}">x</a>' for h in links))


FETCHES = [
    ("https://one.example/", 200, page("One", "/docs/a", "/docs/b", "/login", "/private/x", "/docs/gone")),
    ("https://one.example/docs/a", 200, page("A", "/docs/deep")),
    ("https://one.example/docs/b", 200, page("B")),
    ("https://one.example/docs/deep", 200, page("Deep")),
    ("https://one.example/private/x", 200, page("X")),
    ("https://two.example/", 200, page("Two", "/never")),
    ("https://two.example/p1", 200, page("P1")),
    ("https://two.example/p2", 500, page("P2")),
    ("https://two.example/p3/", 200, page("P3")),
    ("https://other.example/", 200, page("Other")),
]
ROBOTS = [("one.example", "User-agent: *\nDisallow: /private"), ("two.example", "Sitemap: https://two.example/map.xml")]
MAP = "<urlset>" + "".join(f"<url><loc>https://two.example/p{i}</loc></url>" for i in (1, 2, 3, 4)) + "</urlset>"


def run(spark, jobs):
    rows = [(i, u, c if c is None or isinstance(c, str) else json.dumps(c)) for i, u, c in jobs]
    frame = spark.createDataFrame(rows, "id string, url string, config string")
    robots = spark.createDataFrame(ROBOTS, "site string, body string")
    maps = spark.createDataFrame([("https://two.example/map.xml", MAP)], "sitemap_url string, body string")
    fetches = spark.createDataFrame([(u, s, "text/html", h, None) for u, s, h in FETCHES], TB.FETCH_SCHEMA)
    return {r.site: r for r in RN.run_documents(frame, robots, maps, fetches, "tidebot").collect()}


def test_limits_modes_and_faults_by_run(spark):
    crawl = lambda **c: {"crawl": c}
    got = run(spark, [
        ("all", "https://one.example/", None), ("first", "https://one.example/", crawl(max_urls=1)),
        ("two", "https://one.example/", crawl(max_urls=2)), ("flat", "https://one.example/", crawl(max_depth=1)),
        ("map", "https://two.example/", crawl(max_urls=3)), ("full", "https://two.example/", {"mode": "detailed", "crawl": {"max_urls": 100}}),
        ("bad", "https://one.example/", crawl(max_urls=101)), ("ftp", "ftp://one.example/", None),
        ("empty", "https://one.example/private/x", None)])
    numbers = {k: (r.total_pages, r.pages_processed, r.pages_failed) for k, r in got.items()}
    # one.example: the seed, a, b and the missing page, then deep; /login and /private are skipped
    assert numbers["all"] == (5, 4, 1) and numbers["flat"] == (4, 3, 1)
    assert numbers["first"] == (1, 1, 0) and numbers["two"] == (2, 2, 0)
    # two.example: its sitemap's entries only, one answered 500, one has no snapshot
    assert numbers["map"] == (3, 2, 1) and numbers["full"] == (4, 2, 2)
    assert numbers["empty"] == (0, 0, 0) and got["empty"].doc == "# One\n"
    assert got["bad"].reject_reason == "max_urls: must be <= 100" and got["bad"].doc is None
    assert got["ftp"].reject_reason.startswith("URL scheme 'ftp'") and numbers["ftp"] == (0, 0, 0)
    assert "(https://one.example/docs/deep)" in got["all"].doc and "(https://one.example/docs/deep)" not in got["flat"].doc
    assert "/private" not in got["all"].doc and got["first"].doc.count("- [") == 1
    assert "(https://two.example/p3)" in got["map"].doc and "p2" not in got["map"].doc
    assert "### P1\nSource: https://two.example/p1" in got["full"].doc and "All about P3" in got["full"].doc
    assert got["all"].llm_calls_made == len([ln for ln in got["all"].doc.splitlines() if ln.startswith("## ")]) + 2
    assert got["full"].llm_calls_made == 1 + 1 + 2  # a section, the summary, two cleaned pages


def test_crawl_limits_by_site_match_the_arguments(spark):
    links = [(f"https://{s}.example/{i}", p, f"https://{s}.example/{3 * i + p}") for s in "abc" for i in range(1, 30) for p in range(3)]
    links = spark.createDataFrame(links, "url string, pos int, target string")
    limits = {"a": (1, 2), "b": (7, 3), "c": (50, 1)}
    seeds = spark.createDataFrame([(s, f"https://{s}.example/1", None, d, u) for s, (u, d) in limits.items()],
                                  "site string, seed_url string, disallowed array<string>, max_depth int, max_urls int")
    rows = lambda df: sorted((r.site, r["rank"], r.url, r.depth) for r in df.collect())
    got = rows(C.crawl_links(seeds, links))
    for s, (u, d) in limits.items():
        alone = seeds.where(F.col("site") == s).drop("max_depth", "max_urls")
        assert [r for r in got if r[0] == s] == rows(C.crawl_links(alone, links, max_depth=d, max_urls=u))


def test_key_set_keeps_all_its_keys(spark):
    keys = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit(1).alias("v")).union(spark.sql("SELECT NULL, 2"))
    kept = {r.k for r in KeySet(keys, ["k"], bits_for(429)).possible(rows, ["k"]).collect()}
    assert {f"k{i}" for i in range(0, 3000, 7)} <= kept and len(kept) < 600
    full = KeySet(keys, ["k"], 64).possible(rows, ["k"])
    assert full.count() > 2900 and full.columns == ["k", "v"]
    assert KeySet(keys.limit(0), ["k"], 64).possible(rows, ["k"]).count() == 0


def test_html_of_other_pages_is_not_shuffled(spark):
    found = spark.createDataFrame([("r", 1, "https://one.example/")], "site string, rank int, url string")
    fetches = spark.createDataFrame([(u, s, "text/html", h, None) for u, s, h in FETCHES], TB.FETCH_SCHEMA)
    plan = RN.run_pages(found, fetches)._jdf.queryExecution().executedPlan().toString()
    scan_to_extract = plan[plan.index("MapInArrow"):]  # everything below the extraction
    below = scan_to_extract.split("Exchange hashpartitioning")[0]
    assert "BroadcastHashJoin" in below
