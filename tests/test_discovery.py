import random
from collections import deque

from pyspark.sql import functions as F

from tidemark.operators import crawl as C
from tidemark.operators import robots as R
from tidemark.operators import sitemaps as SM


def test_robots_line_machine(spark):
    body = ("# comment\nUser-agent: googlebot\nUser-agent: *\nDisallow: /a\nDisallow:\nCrawl-delay: x\n"
            "Crawl-delay: 2.5\nCrawl-delay: 9\nSitemap: https://s/sm.xml\nUser-agent: other\nDisallow: /b\n"
            "SITEMAP:   https://s/two.xml\nUSER-AGENT: TideBot\ndisallow: /c # keep\n")
    df = spark.createDataFrame([("s", body), ("t", "User-agent: x\nUser-agent: other\nDisallow: /z")], "site string, body string")
    got = {r.site: r for r in R.parse_robots(df, "tidebot").collect()}
    assert got["s"].sitemap_urls == ["https://s/sm.xml", "https://s/two.xml"]
    assert got["s"].disallowed_paths == ["/a", "/c # keep"]
    assert got["s"].crawl_delay == 2.5
    assert got["t"].disallowed_paths == [] and got["t"].crawl_delay is None
    missing = R.robots_for(spark.createDataFrame([("s",), ("u",)], "site string"), df, "tidebot")
    assert {r.site: r.disallowed_paths for r in missing.collect()}["u"] == []


def _doc(kind, items):
    if kind == "index":
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in items) + "</sitemapindex>"
    return "<urlset>" + "".join(f"<url><loc>{u}</loc>" + (f"<priority>{p}</priority>" if p else "") + "</url>"
                                for u, p in items) + "</urlset>"


def test_sitemap_expansion_cap_and_dedup(spark):
    docs = [("r", _doc("index", ["a", "n", "missing", "late"])),
            ("a", _doc("urlset", [("https://x/1", "0.1"), ("https://x/2&amp;q", "bad"), ("ftp://x/f", None)])),
            ("n", _doc("index", ["b", "d1"])),
            ("b", _doc("urlset", [("https://x/1", "0.9"), ("https://x/3", None)])),
            ("d1", _doc("index", ["d2"])), ("d2", _doc("urlset", [("https://x/deep", None)])),
            ("late", _doc("urlset", [("https://x/late", None)]))]
    docs = spark.createDataFrame(docs, "sitemap_url string, body string")
    roots = spark.createDataFrame([("s", 0, "r")], "site string, cand_pos int, sitemap_url string")
    e = SM.expand_indexes(docs, roots, max_entries=3, materialize=False)
    got = [(r.url, r.priority) for r in e.orderBy("ord").collect()]
    # a gives 2 (ftp dropped); n gives b's 2 + nothing from depth 3 -> total 4 >= 3: stop before "late"
    assert got == [("https://x/1", 0.1), ("https://x/2&q", None), ("https://x/1", 0.9), ("https://x/3", None)]
    fs = SM.first_source(e, roots)
    d = SM.dedup_entries(fs, cap=2).orderBy("pos").collect()
    assert [(r.url, r.priority) for r in d] == [("https://x/1", 0.9), ("https://x/2&q", None)]


def test_sitemap_markup(spark):
    body = ("<sm:urlset><!-- <url><loc>https://x/gone</loc></url> --><sm:url><sm:loc> https://x/1?a=1&#38;b=&#x26;c&amp;d&#233; "
            "</sm:loc><sm:priority>&#48;.5</sm:priority></sm:url><url><loc><![CDATA[https://x/&lt;2&gt;]]></loc></url></sm:urlset>")
    docs = spark.createDataFrame([("s", body), ("none", None), ("empty", "")], "sitemap_url string, body string")
    got = [(r.sitemap_url, r.pos, r.url, r.priority) for r in SM.parse_urlsets(docs).collect()]
    assert got == [("s", 0, "https://x/1?a=1&b=&c&dé", 0.5), ("s", 1, "https://x/<2>", None)]


def _py_bfs(seed, graph, skip, max_depth, max_urls):
    visited, out, q = set(), [], deque([(seed, 0)])
    while q and len(out) < max_urls:
        u, d = q.popleft()
        if u in visited:
            continue
        visited.add(u)
        if skip(u):
            continue
        out.append((u, d))
        if d < max_depth:
            for v in graph.get(u, []):
                if v not in visited:
                    q.append((v, d + 1))
    return out


def test_bfs_matches_queue_model(spark):
    rnd = random.Random(7)
    seeds, links, expected = [], [], {}
    for s in range(25):
        site = f"s{s}.example"
        n = rnd.randint(1, 12)
        nodes = [f"https://{site}/n/{i}" for i in range(n)] + [f"https://{site}/login/x", f"https://{site}/f.pdf"]
        graph = {}
        for u in nodes[:n]:
            graph[u] = [rnd.choice(nodes) for _ in range(rnd.randint(0, 4))]
        for u, vs in graph.items():
            links += [(u, i, v) for i, v in enumerate(vs)]
        max_urls = rnd.choice([1, 3, 50])
        seeds.append((site, nodes[0], ["/n/7"]))
        skip = lambda u: "/login" in u or u.endswith(".pdf") or "/n/7" in u
        expected[site] = _py_bfs(nodes[0], graph, skip, 2, max_urls)
        seeds[-1] = seeds[-1] + (max_urls,)
    ldf = spark.createDataFrame(links, "url string, pos int, target string")
    for cap in (1, 3, 50):
        sdf = spark.createDataFrame([s[:3] for s in seeds if s[3] == cap], "site string, seed_url string, disallowed array<string>")
        if sdf.count() == 0:
            continue
        out = C.crawl_links(sdf, ldf, max_depth=2, max_urls=cap, checkpoint=False).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.site, r.rank)):
            got.setdefault(r.site, []).append((r.url, r.depth))
        for s in seeds:
            if s[3] == cap:
                assert got.get(s[0], []) == expected[s[0]], s[0]


def test_page_links(spark):
    ex = spark.createDataFrame([("https://www.s.com/a/b", ["c", "/d/", "https://s.com/e#x", "https://o.com/f",
                                                           "/g.PDF", "mailto:x@y", "/c", "/c"])],
                               "url string, links array<string>")
    got = [r.target for r in C.page_links(ex, keys=()).orderBy("pos").collect()]
    assert got == ["https://www.s.com/a/c", "https://www.s.com/d", "https://s.com/e", "https://www.s.com/c",
                   "https://www.s.com/c"]


def test_number_within_matches_row_number(spark):
    from pyspark.sql import Window

    from tidemark.operators.numbering import number_within
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7 + (i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, o long")
    got = {(r.key, r.o): r.r for r in number_within(df, "key", "o", "r", chunk=16).collect()}
    exp = {(r.key, r.o): r.x for r in df.withColumn("x", F.row_number().over(Window.partitionBy("key").orderBy("o"))).collect()}
    assert got == exp
