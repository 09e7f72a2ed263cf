"""Inputs derived from the driver tables for operators whose natural input
(robots files, sitemaps, link graphs, job rows, progress events, model
replies) is not among them.

Each derivation is a list of ``(alias, expression)`` written in the SQL
subset shared by Spark and DuckDB (``||``, ``CASE``, ``%``, ``instr``,
``substr``, ``replace``, ``repeat``, ``regexp_extract``, casts to STRING,
no backslashes), applied with ``selectExpr`` on the Spark side and as a
plain ``SELECT`` in the DuckDB oracle, so both engines see the same rows.
All derivations are row-wise (no aggregation), so they grow with the
tables and never gather a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NL = "chr(10)"
S = "CAST(page_id AS STRING)"
HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
ORIGIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
NOQ = "regexp_extract(url, '^[^?#]*', 0)"
AFTER_SCHEME = "substr(url, instr(url, '://') + 3)"
SITE = f"CASE WHEN substr({HOST}, 1, 4) = 'www.' THEN substr({HOST}, 5) ELSE {HOST} END"


def case(sel: str, options: list[str]) -> str:
    parts = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {sel} % {len(options)} {parts} END"


def apply(df: DataFrame, exprs: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for a, e in exprs])


def sql(table: str, exprs: list[tuple[str, str]], where: str | None = None) -> str:
    cols = ", ".join(f"{e} AS {a}" for a, e in exprs)
    return f"SELECT {cols} FROM {table}" + (f" WHERE {where}" if where else "")


# -- URL variants (B1-B11) ---------------------------------------------------------
URL_VARIANT = case("page_id", [
    "url",
    "replace(url, '://', '://www.')",
    "'HTTPS://' || " + AFTER_SCHEME,
    NOQ + " || ';jsessionid=' || " + S,
    "'ftp://' || " + AFTER_SCHEME,
    NOQ + " || '/'",
    NOQ + " || '//#frag'",
    AFTER_SCHEME,
    "'  ' || url || ' '",
    "'https://www.' || " + SITE + " || '/account/login'",
    ORIGIN + " || '/static/app.JS'",
    "'https://user:pw@' || " + SITE + " || ':8080/docs/' || " + S,
    "'https://www.' || " + SITE + " || '?q=' || " + S,
    ORIGIN + " || '/accounting/reports'",
    "url || '?' || repeat('a', 2100)",
    "'mailto:team@' || " + SITE,
    "'//' || " + SITE + " || '/x'",
])
URL_VARIANTS = [("page_id", "page_id"), ("url", URL_VARIANT)]

# -- Section paths (E1-E5): a path word per page ------------------------------------
SECTION_WORDS = ["'docs'", "'documentation'", "'api'", "'v2/api'", "'reference'", "'guides'",
                 "'tutorial'", "'getting-started'", "'blog'", "'news'", "'posts'", "'features'",
                 "'solutions'", "'about'", "'careers'", "'case-studies'", "'resources'", "'events'",
                 "'pricing'", "'plans'", "'legal'", "'privacy-policy'", "'terms-of-service'",
                 "'cookies'", "'login'", "'sign-in'", "'404'", "'en'", "'fr'", "'my-topic'", "'x_y'",
                 "'DOCS'", "'optional'", "'pages'", "'accounting'", "'3d-x9'", "'learn'"]
SECTION_URL = ("'https://' || " + SITE + " || '/' || " + case("page_id", SECTION_WORDS)
               + " || CASE WHEN page_id % 41 = 0 THEN '' ELSE '/' || " + S + " END")
SECTION_PAGES = [("page_id", "page_id"), ("site", SITE), ("url", SECTION_URL)]

# -- robots.txt bodies (C1, A2): one body per page ----------------------------------
ROBOTS_BODY = " || ".join([
    case("page_id", ["'User-agent: *'", "'User-agent: otherbot'", "'# header comment'",
                     "'USER-AGENT: TideBot'", "'Sitemap: https://' || " + SITE + " || '/s' || " + S + " || '/a.xml'"]),
    NL,
    "'Disallow: /' || " + case("page_id", ["'en'", "'fr/private'", "''", "'de'", "'es '"]),
    NL,
    case("page_id", ["'Crawl-delay: 2.5'", "'crawl-delay: x'", "'Crawl-delay: 10'", "''", "'Crawl-delay: 3.'", "'Crawl-delay:7'"]),
    NL,
    case("page_id", ["'User-agent: otherbot'", "'User-agent: *'", "'   '", "'Disallow: /tmp # note'"]),
    NL,
    "'Disallow: /admin'",
    NL,
    case("page_id", ["'Crawl-delay: 4'", "'Sitemap: https://' || " + SITE + " || '/s' || " + S + " || '/b.xml'",
                     "'Disallow:'", "'sitemap:   '", "'User-agent: tidebot'", "'Allow: /x'", "'Disallow: /p' || " + S]),
])
ROBOTS = [("page_id", "page_id"), ("site", SITE),
          ("body", f"CASE WHEN page_id % 29 = 7 THEN NULL ELSE {ROBOTS_BODY} END")]

# -- sitemap documents (C2-C5): a small family of documents per page ----------------
SM_BASE = "'https://' || " + SITE + " || '/s' || " + S
PRIORITY = "CAST(page_id % 10 AS STRING)"
XML_URL = "replace(url, '&', '&amp;')"


def _entry(loc: str, prio: str | None) -> str:
    p = f" || '<priority>' || {prio} || '</priority>'" if prio else ""
    return f"'<url><loc>' || {loc} || '</loc>'{p} || '</url>'"


def _index(children: list[str]) -> str:
    kids = " || ".join(f"'<sitemap><loc>' || {c} || '</loc></sitemap>'" for c in children)
    return f"'<?xml version=\"1.0\"?><sitemapindex>' || {kids} || '</sitemapindex>'"


def _urlset(entries: list[str]) -> str:
    return "'<?xml version=\"1.0\"?><urlset>' || " + " || ".join(entries) + " || '</urlset>'"


SITEMAP_DOCS = {
    # root index -> a.xml (url set), nested.xml (index) and a missing document
    "index": (SM_BASE + " || '/sitemap_index.xml'",
              _index([SM_BASE + " || '/a.xml'", SM_BASE + " || '/nested.xml'", SM_BASE + " || '/missing.xml'"])),
    "a": (SM_BASE + " || '/a.xml'",
          _urlset([_entry(XML_URL, "'0.' || " + PRIORITY),
                   _entry("'  ' || " + ORIGIN + " || '/p/' || " + S + " || '?a=1&amp;b=2  '", "'high'"),
                   _entry("'ftp://' || " + SITE + " || '/f'", None),
                   "'<url><priority>0.3</priority></url>'"])),
    "nested": (SM_BASE + " || '/nested.xml'",
               _index([SM_BASE + " || '/b.xml'", SM_BASE + " || '/deep1.xml'"])),
    "b": (SM_BASE + " || '/b.xml'",
          _urlset([_entry(XML_URL, "'0.9'"), _entry(ORIGIN + " || '/b/' || " + S, "' 1.0 '")])
          + " || CASE WHEN page_id % 5 = 0 THEN '<url><loc>' || " + ORIGIN + " || '/cut' ELSE '' END"),
    "deep1": (SM_BASE + " || '/deep1.xml'", _index([SM_BASE + " || '/deep2.xml'"])),
    "deep2": (SM_BASE + " || '/deep2.xml'", _index([SM_BASE + " || '/deep3.xml'"])),
    "deep3": (SM_BASE + " || '/deep3.xml'", _urlset([_entry(ORIGIN + " || '/deep'", None)])),
    "plain": (SM_BASE + " || '/sitemap.xml'",
              _urlset([_entry(ORIGIN + " || '/plain/' || " + S, "'0.5'"), _entry(XML_URL, None)])),
}


def sitemap_doc_exprs(kind: str) -> list[tuple[str, str]]:
    u, b = SITEMAP_DOCS[kind]
    return [("sitemap_url", u), ("body", b)]


# which pages have which documents ("plain" only for every third page)
SITEMAP_DOC_WHERE = {"plain": "page_id % 3 = 0"}

# candidate lists per (site, page_id): robots-listed, or the two defaults
CANDIDATES = [
    [("cand_pos", "0"), ("sitemap_url", SM_BASE + " || '/sitemap.xml'")],
    [("cand_pos", "1"), ("sitemap_url", SM_BASE + " || '/sitemap_index.xml'")],
]
CANDIDATE_KEYS = [("site", SITE), ("page_id", "page_id")]

# -- link graph for the crawl (C7) -------------------------------------------------
# Within a site pages are numbered r = 1..n by page_id; page r links to 2r,
# 2r+1 (as paths), back to 1, and to an asset; the URL of page r is
# https://site/n/<r>.  Skip rules hit r % 9 == 4 (account word) pages.
def _node(r: str) -> str:
    return (f"'https://' || site || CASE WHEN ({r}) % 9 = 4 THEN '/login/' ELSE '/n/' END "
            f"|| CAST({r} AS STRING)")


LINK_EXPRS = [
    [("url", _node("r")), ("pos", "0"), ("target", _node("2 * r"))],
    [("url", _node("r")), ("pos", "1"), ("target", _node("2 * r + 1"))],
    [("url", _node("r")), ("pos", "2"), ("target", _node("1"))],
    [("url", _node("r")), ("pos", "3"), ("target", "'https://' || site || '/n/' || CAST(r AS STRING) || '/doc.pdf'")],
    [("url", _node("r")), ("pos", "4"), ("target", _node("r + 5"))],
]

# -- jobs from orders (H*) --------------------------------------------------------------
JOB_STATUS = ("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN "
              "CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'failed' END ELSE "
              + case("o_orderkey", ["'pending'", "'discovering'", "'extracting'", "'enhancing'", "'generating'"])
              + " END")
JOB_ERRORS = ["'Rate limit exceeded for host'", "'Traceback (most recent call last): KeyError'",
              "'Request timed out after 30s'", "'Invalid API KEY provided'", "''",
              "'Service Unavailable (503)'", "'Job timed out after exceeding the maximum allowed duration.'",
              "'psycopg2.OperationalError: connection refused'"]
JOBS = [
    ("id", "'job-' || CAST(o_orderkey AS STRING)"),
    ("user_id", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'user-' || CAST(o_custkey AS STRING) END"),
    ("url", "'https://site' || CAST(o_custkey % 97 AS STRING) || '.example.com/'"),
    ("mode", case("o_orderkey", ["'default'", "'detailed'", "'quick'", "'default'"])),
    ("status", JOB_STATUS),
    ("config", "'{\"crawl\": {\"max_urls\": ' || CAST(o_orderkey % 120 AS STRING) || '"
               + "' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ', \"max_depth\": ' || CAST(o_orderkey % 5 AS STRING) "
               + "WHEN 2 THEN ', \"respect_robots_txt\": false' ELSE ', \"timeout_seconds\": ' || CAST(o_orderkey % 70 AS STRING) END || '}}'"),
    ("result_llms_txt", "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 <> 0 THEN '# Site ' || CAST(o_custkey AS STRING) || chr(10) END"),
    ("result_meta", "CASE WHEN o_orderstatus = 'F' THEN " + case("o_orderkey", [
        "'{\"total_pages\": ' || CAST(o_orderkey % 50 AS STRING) || ', \"pages_processed\": ' || CAST(o_orderkey % 40 AS STRING) || ', \"pages_failed\": 2, \"llm_calls_made\": 7, \"llm_cost_usd\": 0.0035}'",
        "'{\"total_pages\": 3}'",
        "NULL",
    ]) + " END"),
    ("error_message", "CASE WHEN o_orderstatus = 'P' THEN " + case("o_orderkey", JOB_ERRORS) + " ELSE '' END"),
    ("ip_address", "'10.0.' || CAST(o_custkey % 256 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING)"),
    ("created_at", "CAST(o_orderdate AS TIMESTAMP)"),
]

# -- progress events from events (I*) ----------------------------------------------------
PHASE = ("CASE event_type WHEN 'view' THEN 'discovering' WHEN 'click' THEN 'extracting' "
         "WHEN 'signup' THEN 'enhancing' "
         "WHEN 'purchase' THEN CASE WHEN value >= 200 THEN 'completed' ELSE 'generating' END "
         "ELSE CASE WHEN value >= 200 THEN 'failed' ELSE 'pending' END END")
PROGRESS = [
    ("event_id", "event_id"),
    ("job_id", "'job-' || CAST(user_id AS STRING)"),
    ("phase", PHASE),
    ("message", "event_type || ' #' || CAST(event_id AS STRING)"),
    ("completed", "CAST(event_id % 50 AS INT)"),
    ("total", "50"),
    ("ts", "CAST(ts AS TIMESTAMP)"),
]
REQUESTS = [
    ("event_id", "event_id"),
    ("key", "'user:' || CAST(user_id AS STRING)"),
    ("ts", "CAST(ts AS TIMESTAMP)"),
]

# requests per domain at seconds that many share
DOMAIN_REQUESTS = [
    ("event_id", "event_id"),
    ("key", "'domain:site' || CAST(user_id % 7 AS STRING) || '.example.com'"),
    ("ts", "CAST(ts AS TIMESTAMP)"),
]

# -- documents with boilerplate lines (D8-D10, D12, F5) ------------------------------------
BOILER_HEAD = case("doc_id", [
    "'Learn more.' || chr(10) || 'Acme Logo' || chr(10)",
    "'[Sign up](/signup)' || chr(10) || chr(10) || chr(10) || chr(10)",
    "'## Trusted by teams everywhere' || chr(10) || '[edit]' || chr(10)",
    "'  GET STARTED  ' || chr(10) || 'Read more...' || chr(10)",
    "'Relied on by many' || chr(10) || '[Docs](/docs)' || chr(10)",
    "''",
    "'Used by: nobody' || chr(10) || 'Widget-Co Logo  ' || chr(10) || '  [edit]  ' || chr(10)",
])
BOILER_TAIL = case("doc_id", [
    "chr(10) || 'Contact us'", "''", "chr(10) || chr(10) || chr(10) || 'See all stories.'",
    "'   ' || chr(10) || 'page not found here'", "chr(10) || '[Try it free](https://x.io) '",
])
DOC_TEXT = [("doc_id", "doc_id"), ("text", BOILER_HEAD + " || text || " + BOILER_TAIL)]

# -- fetches and rendered snapshots (D11-D13) ----------------------------------------------
FETCHES = [
    ("page_id", "page_id"), ("url", "url"),
    ("status", case("page_id", ["200", "200", "404", "403", "429", "200", "200", "500", "200"])),
    ("content_type", case("page_id", ["'text/html; charset=utf-8'", "'application/json'", "'text/html'",
                                      "'application/json'", "'text/html'", "'text/html'", "NULL",
                                      "'text/html'", "'TEXT/HTML'"])),
    ("html", "html"),
    ("error", "CASE WHEN page_id % 9 = 6 THEN 'ConnectTimeout: timed out' END"),
]
