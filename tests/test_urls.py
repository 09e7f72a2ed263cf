from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import validate as V

URLS = [
    "https://Example.com/Docs/a;p?q=1#frag", "HTTP://www.x.org", "http://x.org/a/b/", "ftp://h/p;x",
    "https://user:pw@h.example:8080/docs/1", "//h/x", "blog.x.com/en/1", "mailto:a@b", "  https://x.com/a ",
    "https://x.com/a;b/c;d?e#f", "https://x.com/?q=1", "https://x.com/a b/ü", "https:rel", "",
    "https://x.com/a//b///",
]
HREFS = ["x", "../x", "./y/", "?q=1", "#f", "//o.example/p", "/root/a/./b/../c", "", "http://abs/z",
         "mailto:a@b", "../../../..", ".", "..", "g;p?y#s", "a//b/../c", "https:rel", "/"]
BASES = ["https://m.example.net/en/98", "http://x.example.com/de/83?page=2&ref=x",
         "https://x.example.org/en/7/", "https://x.example.org/a/b/c.html#top"]


def test_split_matches_urlparse(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows = df.select("url", U.url_parts(F.col("url")).alias("p")).collect()
    for r in rows:
        exp = urlparse(r.url)
        got = r.p
        assert (got.scheme, got.netloc, got.path, got.params, got.query, got.fragment) == \
            (exp.scheme, exp.netloc, exp.path, exp.params, exp.query, exp.fragment), r.url


def _py_normalize(url):
    p = urlparse(url)
    path = p.path.rstrip("/") or "/"
    out = f"{p.scheme}://{p.netloc}{path}"
    return out + (f"?{p.query}" if p.query else "")


def test_normalize_matches_python(spark):
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    for r in df.select("url", U.normalize_url(F.col("url")).alias("n")).collect():
        assert r.n == _py_normalize(r.url), r.url


def test_resolve_matches_urljoin(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "base string, href string")
    out = U.resolve_links(df, "base", "href", "t").collect()
    for r in out:
        assert r.t == urljoin(r.base, r.href), (r.base, r.href)
        exp = urlparse(urljoin(r.base, r.href))
        assert (r.t_scheme, r.t_netloc, r.t_path, r.t_query) == (exp.scheme, exp.netloc, exp.path, exp.query)


def test_site_key_and_skips(spark):
    df = spark.createDataFrame([("https://www.x.com/accounting",), ("https://WWW.x.com/a.PDF",),
                                ("https://blog.x.com/y",)], "url string")
    r = df.select(U.site_key(F.col("url")).alias("s"), U.is_asset(U.url_path(F.col("url"))).alias("a"),
                  U.is_account_path(U.url_path(F.col("url"))).alias("w")).collect()
    assert [x.s for x in r] == ["x.com", "WWW.x.com", "blog.x.com"]
    assert [x.a for x in r] == [False, True, False]
    assert [x.w for x in r] == [True, False, False]  # substring: /accounting is skipped


def test_validation_reasons(spark):
    cases = [("https://example.com/page", None), ("ftp://example.com/f", "URL scheme 'ftp' is not allowed. Use http or https."),
             ("file:///etc/passwd", "URL scheme 'file' is not allowed. Use http or https."),
             ("https://", "URL has no hostname"), ("https://x.com/" + "a" * 2048,
                                                   "URL exceeds maximum length of 2048 characters")]
    df = spark.createDataFrame([(u,) for u, _ in cases], "url string")
    got = [r.r for r in df.select(U.url_reject_reason(F.col("url")).alias("r")).collect()]
    assert got == [e for _, e in cases]


def test_blocked_hosts(spark):
    urls = spark.createDataFrame([(h,) for h in ["pub", "lo", "ten", "s172", "s192", "meta", "cgn", "gone"]], "host string")
    dns = spark.createDataFrame([("pub", "93.184.216.34"), ("lo", "127.0.0.1"), ("ten", "10.0.0.1"),
                                 ("s172", "172.16.0.1"), ("s192", "192.168.1.1"), ("meta", "169.254.169.254"),
                                 ("cgn", "100.64.0.1")], "host string, ip string")
    got = {r.host: r.reject_reason for r in V.flag_blocked_hosts(urls, dns).collect()}
    assert got["pub"] is None and got["cgn"] is None
    assert got["lo"] == "URL resolves to blocked IP range (127.0.0.0/8)"
    assert got["meta"] == "URL resolves to blocked IP range (169.254.0.0/16)"
    assert got["gone"] == "Could not resolve hostname 'gone'"


def test_small_url_functions(spark):
    df = spark.createDataFrame([(" example.com ", "https://www.blog.www.x.com/a", "https://www.my-site.co.uk/",
                                 " 1.2.3.4 , 10.0.0.1", None)], "a string, b string, c string, fwd string, remote string")
    r = df.select(U.ensure_scheme(F.col("a")).alias("a"), U.display_domain(F.col("b")).alias("b"),
                  U.site_name(F.col("c")).alias("c"), U.client_ip(F.col("fwd"), F.col("remote")).alias("ip"),
                  U.client_ip(F.lit(None).cast("string"), F.col("remote")).alias("ip2")).first()
    assert r.a == "https://example.com"
    assert r.b == "blog.www.x.com"
    assert r.c == "my-site".title() == "My-Site"
    assert r.ip == "1.2.3.4" and r.ip2 == "unknown"


def test_drop_disallowed_prefix_join(spark):
    urls = spark.createDataFrame([("s", "https://s/private/a"), ("s", "https://s/pub"), ("t", "https://t/private")],
                                 "site string, url string")
    rules = spark.createDataFrame([("s", "/priv"), ("s", ""), ("s", "/priv")], "site string, prefix string")
    got = sorted(r.url for r in V.drop_disallowed(urls, rules).collect())
    assert got == ["https://s/pub", "https://t/private"]
