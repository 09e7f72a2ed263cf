"""Property tests: native column rules vs the plain-Python rule they restate."""

from urllib.parse import urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import urls as U

SEG = st.text(alphabet="abcXYZ019-_.;~%", min_size=0, max_size=6)
URL = st.builds(
    lambda scheme, host, segs, q, frag: (
        (f"{scheme}://" if scheme else "") + host + "/" + "/".join(segs)
        + (f"?{q}" if q is not None else "") + (f"#{frag}" if frag is not None else "")),
    st.sampled_from(["http", "https", "HTTP", "ftp", ""]),
    st.sampled_from(["www.x.com", "x.com", "a.b.example:8080", "u:p@h.io", ""]),
    st.lists(SEG, max_size=4),
    st.one_of(st.none(), st.text(alphabet="a=&1", max_size=5)),
    st.one_of(st.none(), st.text(alphabet="ab#", max_size=3)),
)
WORD = st.text(alphabet="abcXYZ019-_ éß", min_size=0, max_size=10)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(URL, min_size=60, max_size=60))
def test_url_parts_and_normalize_match_urllib(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select("url", U.url_parts(F.col("url")).alias("p"), U.normalize_url(F.col("url")).alias("n")).collect()
    for r in rows:
        e = urlparse(r.url)
        assert (r.p.scheme, r.p.netloc, r.p.path, r.p.params, r.p.query, r.p.fragment) == tuple(e), r.url
        path = e.path.rstrip("/") or "/"
        assert r.n == f"{e.scheme}://{e.netloc}{path}" + (f"?{e.query}" if e.query else ""), r.url


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORD, min_size=60, max_size=60))
def test_python_title_matches_str_title(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.t for r in df.select(U.python_title(F.col("w")).alias("t")).collect()]
    # 'ß'.title() is 'Ss' in Python; Spark upper-cases to 'SS': compare on words without it
    exp = [w.title() for w in words]
    for g, e, w in zip(got, exp, words):
        if "ß" not in w:
            assert g == e, w
