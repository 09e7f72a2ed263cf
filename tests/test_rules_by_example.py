"""Rules with fixed lists, by examples written down here.

The SQL oracles take their lists from the modules under test; these
examples don't.
"""

from pyspark.sql import functions as F

from tidemark.functions import errors as ER
from tidemark.functions import text as tx
from tidemark.functions import urls as U
from tidemark.operators import assemble as G
from tidemark.operators import pagestate as PS
from tidemark.operators import sections as E
from tidemark.operators import validate as V


def _each(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sections_by_path(spark):
    want = {
        "/docs/a": "Documentation", "/doc": "Documentation", "/x/manual/": "Documentation", "/api": "API Reference",
        "/v1/endpoints": "API Reference", "/sdk/x": "API Reference", "/guide/a": "Guides", "/tutorials": "Guides",
        "/getting-started/": "Guides", "/how-to/x": "Guides", "/blog": "Blog", "/news/1": "Blog", "/article/": "Blog",
        "/products/x": "Features", "/platform": "Features", "/careers": "About", "/case-studies/a": "About", "/team": "About",
        "/webinar/1": "Resources", "/research": "Resources", "/plans": "Pricing", "/terms-of-service": "Optional",
        "/privacy": "Optional", "/cookie-policy": "Optional", "/gdpr": "Optional", "/": "Pages", "/my-topic/x": "My Topic",
        "/documentary": "Documentary", "/apis/x": "Apis", "/docs/api": "Documentation",
    }
    got = _each(spark, [f"https://s.com{p}" for p in want], E.match_section)
    assert got == list(want.values())


def test_excluded_paths(spark):
    want = {"/login": True, "/sign-in/x": True, "/signup": True, "/register/": True, "/auth/x": True, "/404": True, "/error": True,
            "/password-reset": True, "/forgot_password": True, "/unsubscribe": True, "/welcome": True, "/logins": False,
            "/errors": False, "/author": False, "/x": False}
    assert _each(spark, [f"https://s.com{p}" for p in want], E.is_excluded) == list(want.values())


def test_skipped_urls(spark):
    assets = {"/a.PNG": True, "/a.pdf": True, "/a.woff2": True, "/feed.xml": True, "/a.atom": True, "/a.html": False, "/png": False}
    assert _each(spark, list(assets), U.is_asset) == list(assets.values())
    words = {"/my/Account": True, "/cart": True, "/oauth2": True, "/administrator": True, "/accounting": True, "/about": False}
    assert _each(spark, list(words), U.is_account_path) == list(words.values())


def test_error_pages(spark):
    want = {"Page Not Found": True, "Error 404": True, "Just a moment...": True, "Access Denied": True, "Forbidden": True,
            "This page could not be found": True, "Internal Server Error": True, "It has been moved": True,
            "We couldn't find it": True, "Found pages": False, "All good": False, "": False}
    assert _each(spark, list(want), lambda c: PS.soft_404_hit(c, F.lit(""))) == list(want.values())


def test_boilerplate_lines(spark):
    want = {"Learn more": True, "GET STARTED.": True, "[Sign up](/x)": True, "Acme Logo": True, "## Trusted by teams": True,
            "Used by 100": True, "Talk to sales..": True, "Learn more about it": False, "[Docs](/x)": False, "Logo": False, "": False}
    assert _each(spark, list(want), tx.is_boilerplate_line) == list(want.values())


def test_blocked_networks(spark):
    want = {"127.0.0.1": "127.0.0.0/8", "10.255.255.255": "10.0.0.0/8", "172.16.0.0": "172.16.0.0/12", "172.31.255.255": "172.16.0.0/12",
            "172.32.0.0": None, "192.168.1.1": "192.168.0.0/16", "169.254.169.254": "169.254.0.0/16", "8.8.8.8": None, "0.0.0.0": None,
            "100.64.0.1": None, "::1": "::1/128", "fd00::1": "fd00::/8", "FE80::1": "fe80::/10", "febf::1": "fe80::/10", "fec0::1": None,
            "2001:db8::1": None, None: None}
    assert _each(spark, list(want), V.blocked_network) == list(want.values())


def test_error_texts(spark):
    shown = {"Rate limit exceeded": True, "Service unavailable": True, "API key not set": True, "Too Many requests": True,
             "KeyError: x": False, "psycopg2.OperationalError": False}
    got = _each(spark, list(shown), ER.shown_error)
    assert [g == s for g, s in zip(got, shown, strict=True)] == list(shown.values())
    assert {g for g, ok in zip(got, shown.values(), strict=True) if not ok} == {"Something went wrong during generation. Please try again."}
    df = spark.createDataFrame([(404,), (429,), (418,)], "s int")
    assert [r.m for r in df.select(ER.server_message("s").alias("m")).collect()] == [
        "The requested resource was not found.", "Too many requests. Please wait a moment and try again.",
        "Something went wrong on our end. Please try again later."]
    df = spark.createDataFrame([(422, "bad url"), (0, None), (503, "x"), (409, None)], "s int, m string")
    assert [r.c for r in df.select(ER.client_error("s", "m")["code"].alias("c")).collect()] == [
        "VALIDATION_ERROR", "NETWORK_ERROR", "SERVER_ERROR", "UNKNOWN"]


def test_section_order(spark):
    names = ["Zoo", "Optional", "Pages", "Blog", "Alpha", "Documentation", "Guides", "API Reference", "Pricing"]
    df = spark.createDataFrame([(n,) for n in names], "s string").orderBy(G.section_sort_key("s"))
    assert [r.s for r in df.collect()] == ["Documentation", "API Reference", "Guides", "Blog", "Pricing", "Pages", "Alpha", "Zoo",
                                           "Optional"]


def test_checkpoint_folder_is_required_on_a_cluster():
    import pytest

    from tidemark.session import ensure_checkpoint_dir

    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

        def getConf(self):
            return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context()})())
