"""Page extraction and page-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract as X
from ..operators import pagestate as PS
from ..session import cut_lineage, table
from ..sources import derived as D
from . import oracle as O
from .registry import derive, derive_sql, register

S = D.S

# -- D3: meta tags injected into the head --------------------------------------------
_METAS = D.case("page_id", [
    "'<meta property=\"og:title\" content=\"OG T' || " + S + " || '\"><meta property=\"og:description\" content=\"OG D' || " + S
    + " || '\"><meta property=\"og:type\" content=\"article\"><meta property=\"og:image\" content=\"/i/' || " + S + " || '.png\">'",
    "'<meta name=\"og:title\" content=\"Name T\"><meta name=\"description\" content=\"  Meta description ' || " + S + " || '  \">'",
    "'<meta property=\"og:title\" content=\"\"><meta name=\"og:title\" content=\"fallback\">'",
    "'<meta property=\"og:description\" content=\"   \">'",
    "''",
    "'<meta name=\"description\" content=\"\"><meta property=\"og:description\" content=\"OG only ' || " + S + " || '\">'",
])
_META_PAGES = [("page_id", "page_id"), ("url", "url"), ("html", "replace(html, '<head>', '<head>' || " + _METAS + ")")]


def _meta_sql(value: str, attr: str = "property") -> str:
    def one(a):
        tag = f'<meta {a}="{value}"'
        content = f"regexp_extract(html, {O.q(tag + ' content=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1)"
        return tag, content
    t1, c1 = one(attr)
    t2, c2 = one("name")
    pick = lambda c: f"CASE WHEN {c} = '' THEN NULL ELSE {O.py_strip(c)} END"
    return (f"(CASE WHEN strpos(html, {O.q(t1)}) > 0 THEN {pick(c1)} "
            f"WHEN strpos(html, {O.q(t2)}) > 0 THEN {pick(c2)} END)")


def _desc_sql() -> str:
    d = _meta_sql("description", "name")
    og = _meta_sql("og:description")
    return (f"(CASE WHEN coalesce({d}, '') <> '' THEN left({d}, 500) "
            f"WHEN coalesce({og}, '') <> '' THEN left({og}, 500) ELSE description END)")


@register("page_og", f"""WITH {O.extracted_pages_sql().replace('FROM pages', 'FROM (' + derive_sql('pages', _META_PAGES) + ')')}
SELECT page_id, title, {_desc_sql()} AS description, {_meta_sql('og:title')} AS og_title,
  {_meta_sql('og:description')} AS og_description, {_meta_sql('og:type')} AS og_type, {_meta_sql('og:image')} AS og_image
FROM rk JOIN ex0 USING (site, page_id, rank, url)""")
def q_page_og(spark, sf):
    p = derive(spark, sf, "pages", _META_PAGES)
    ex = X.extract_pages(p)
    return ex.select("page_id", "title", "description", "og_title", "og_description", "og_type", "og_image")


# -- D4: CSR shells --------------------------------------------------------------------
_SHELL = D.case("page_id", [
    "html",
    "'<html><head><title>T' || " + S + " || '</title></head><body><div id=\"root\"></div><script src=\"a.js\"></script></body></html>'",
    "'<html><head><title>T</title><meta name=\"description\" content=\"D\"></head><body><div id=\"__next\"><p>short</p></div></body></html>'",
    "'<html><body><noscript>Enable JS ' || " + S + " || '</noscript><div>x</div><div>y</div></body></html>'",
    "'<html><head><title>No body</title></head></html>'",
    "'<html><body><div>tiny</div><script>var x = 1;</script></body></html>'",
    "'<html><body><div>a</div><p>b</p></body></html>'",
    "'<html><body><div id=\"app\">' || repeat('word ', 20) || '</div></body></html>'",
])
SHELL_PAGES = [("page_id", "page_id"), ("url", "url"), ("html", _SHELL)]


def csr_sql(h: str = "html") -> str:
    """CSR rule over simple markup (flat bodies), restated with regexes."""
    body = (f"CASE WHEN strpos({h}, '<body') > 0 THEN substr({h}, strpos({h}, '<body'), "
            f"CASE WHEN strpos({h}, '</body>') > 0 THEN strpos({h}, '</body>') - strpos({h}, '<body') "
            f"ELSE length({h}) END) END")
    nos = f"regexp_replace(regexp_replace(regexp_replace({body}, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
    tlen = f"length({O.html_text(nos)})"
    title = f"regexp_extract({h}, '(?s)<title>(.*?)</title>', 1)"
    desc = f"regexp_extract({h}, '<meta name=\"description\" content=\"([^\"]*)\"', 1)"
    meta = f"({title} <> '' AND {desc} <> '')"
    root = f"regexp_extract({h}, '(?s)<div id=\"(?:root|app)\">(.*?)</div>', 1)"
    kids = f"len(regexp_extract_all(regexp_replace({body}, '^<body[^>]*>', ''), '<(?:div|p|noscript|span|main|section|article|nav|ul|header|footer|h1)[ >]'))"
    return (f"(CASE WHEN strpos({h}, '<body') = 0 THEN true WHEN {tlen} > 200 THEN false "
            f"WHEN strpos({h}, '<div id=\"__next\"') > 0 AND {meta} THEN false "
            f"WHEN regexp_matches({h}, '<div id=\"(?:root|app)\">') AND length({O.html_text(root)}) < 50 THEN true "
            f"WHEN strpos({h}, '<noscript') > 0 AND {tlen} < 100 THEN true "
            f"WHEN {kids} <= 1 AND {tlen} < 50 THEN true ELSE false END)")


@register("csr_flags", f"SELECT page_id, {csr_sql()} AS is_js_rendered FROM ({derive_sql('pages', SHELL_PAGES)})")
def q_csr_flags(spark, sf):
    ex = X.with_csr(X.extract_pages(derive(spark, sf, "pages", SHELL_PAGES)))
    return ex.select("page_id", "is_js_rendered")


# -- D6/D7: main text (contract is ours: rows only) ---------------------------------------
@register("main_text")
def q_main_text(spark, sf):
    ex = X.with_content(X.extract_pages(table(spark, sf, "pages").select("page_id", "url", "html")))
    return ex.select("page_id", "content_text", F.length("content_text").alias("content_chars"))


# -- D8-D10 on documents with boilerplate lines ----------------------------------------------
_DOCS = f"({derive_sql('documents', D.DOC_TEXT)})"
_CTA_LIST = O.sql_list(tx.CTA_PHRASES)


def _clean_sql(t: str) -> str:
    x = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?m)[ \\t]+$', '', 'g')"
    x = f"regexp_replace({x}, '(?mi)^\\s*\\[edit\\]\\s*$', '', 'g')"
    return O.py_strip(x)


def _boiler_sql(t: str) -> str:
    strip = O.py_strip("ln")
    low = f"regexp_replace(lower({strip}), '[.]+$', '')"
    link = f"regexp_replace({O.py_strip(f'lower(regexp_extract({strip}, {O.q(tx.CTA_LINK_RE)}, 1))')}, '[.]+$', '')"
    logo = O.q(r"(?i)^[\pL\pN_\s.&'-]+\s+Logo\s*$")
    social = O.q(r"(?i)^#{0,3}\s*(used|trusted|loved|relied on|chosen|preferred) by\b")
    drop = (f"({strip} <> '' AND ({low} IN {_CTA_LIST} OR (regexp_matches({strip}, {O.q(tx.CTA_LINK_RE)}) AND {link} IN {_CTA_LIST}) "
            f"OR regexp_matches({strip}, {logo}) OR regexp_matches({strip}, {social})))")
    kept = f"array_to_string(list_filter(string_split({t}, chr(10)), lambda ln: NOT {drop}), chr(10))"
    return O.py_strip(f"regexp_replace({kept}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _cap_sql(t: str) -> str:
    cut = f"regexp_replace(left({t}, 5000), '\\n[^\\n]*$', '')"
    return O.py_strip(f"CASE WHEN length({t}) > 5000 THEN {cut} ELSE {t} END")


@register("md_clean", f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM {_DOCS}")
def q_md_clean(spark, sf):
    d = derive(spark, sf, "documents", D.DOC_TEXT)
    return d.select("doc_id", tx.clean_markdown(F.col("text")).alias("cleaned"))


@register("boilerplate_lines", f"SELECT doc_id, {_boiler_sql(_clean_sql('text'))} AS text FROM {_DOCS}")
def q_boilerplate_lines(spark, sf):
    d = derive(spark, sf, "documents", D.DOC_TEXT)
    return d.select("doc_id", tx.strip_boilerplate(tx.clean_markdown(F.col("text"))).alias("text"))


@register("content_cap", f"SELECT doc_id, {_cap_sql('text')} AS capped, length({_cap_sql('text')}) AS n FROM {_DOCS}")
def q_content_cap(spark, sf):
    d = derive(spark, sf, "documents", D.DOC_TEXT)
    c = tx.cap_text(F.col("text"))
    return d.select("doc_id", c.alias("capped"), F.length(c).cast("bigint").alias("n"))


# -- D11 -------------------------------------------------------------------------------------
_FETCH_SQL = f"""SELECT page_id, url,
  CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE status END AS INT) AS fetch_status,
  CASE WHEN error IS NOT NULL THEN error
       WHEN strpos(coalesce(content_type, ''), 'text/html') = 0 THEN 'Non-HTML content type: ' || coalesce(content_type, '')
       WHEN status >= 400 THEN 'HTTP ' || CAST(status AS VARCHAR) END AS error
FROM ({derive_sql('pages', D.FETCHES)})"""


@register("fetch_class", _FETCH_SQL)
def q_fetch_class(spark, sf):
    c = PS.classify_fetch(derive(spark, sf, "pages", D.FETCHES))
    return c.select("page_id", "url", "fetch_status", "error")


# -- D12 on documents: title = first line, description = second line -------------------
_SOFT = [("doc_id", "doc_id"), ("title", "split_part(text, chr(10), 1)"),
         ("description", "split_part(text, chr(10), 2)"), ("content", "text")]
_P = O.q(O.SOFT404_SQL_RE)


@register("soft_404", f"""SELECT doc_id,
  regexp_matches(lower(trim(title)), {_P}) OR regexp_matches(lower(trim(description)), {_P}) AS http_hit,
  regexp_matches(lower(trim(title)), {_P}) OR regexp_matches(lower(trim(description)), {_P})
    OR regexp_matches(lower(left(content, 500)), {_P}) AS rendered_hit
FROM ({derive_sql('documents', D.DOC_TEXT)}) d, LATERAL (SELECT split_part(d.text, chr(10), 1) AS title,
  split_part(d.text, chr(10), 2) AS description, d.text AS content)""")
def q_soft_404(spark, sf):
    d = derive(spark, sf, "documents", D.DOC_TEXT)
    t, de = (F.split_part(F.col("text"), F.lit("\n"), F.lit(i)) for i in (1, 2))
    return d.select("doc_id", PS.soft_404_hit(t, de).alias("http_hit"),
                    PS.soft_404_hit(t, de, F.col("text")).alias("rendered_hit"))


# -- D13: re-render merge over fetches with CSR shells and blocked statuses -------------------
_SHELL_FETCH = "'<html><head><title>App</title></head><body><div id=\"root\"></div></body></html>'"
_FETCHES = [(a, f"CASE WHEN page_id % 9 = 5 THEN {_SHELL_FETCH} ELSE html END" if a == "html" else e)
            for a, e in D.FETCHES]
_RENDERED = [("url", "url"),
             ("status", "CASE WHEN page_id % 4 = 1 THEN 0 ELSE 200 END"),
             ("html", "CASE WHEN page_id % 4 = 2 THEN replace(html, '<title>', '<title>Not Found: ') ELSE html END"),
             ("error", "CASE WHEN page_id % 4 = 1 THEN 'Timeout 30000ms exceeded' END")]


_PAGE_COLS = ["title", "description", "content_text"]


def _cleared(extracted, bad):
    """Rows with an error keep only url, status and error."""
    return extracted.withColumns({c: F.when(~bad, F.col(c)) for c in _PAGE_COLS})


def _http_rows(spark, sf):
    c = PS.classify_fetch(derive(spark, sf, "pages", _FETCHES))
    ex = X.extract_pages(c.select("page_id", "url", "html", "fetch_status", "error"))
    bad = F.col("error").isNotNull()
    ex = _cleared(X.with_content(X.with_csr(ex)), bad).withColumn("is_js_rendered", F.col("is_js_rendered") & ~bad)
    ex = PS.flag_soft_404(ex, use_content=False)
    return ex.select("page_id", "url", *_PAGE_COLS, "is_js_rendered", "fetch_status", "error")


def _rendered_rows(spark, sf, need):
    r = derive(spark, sf, "pages", _RENDERED).join(need.select("url"), "url", "left_semi")
    failed = F.col("error").isNotNull()
    r = r.select("url", F.when(~failed, F.col("html")).alias("html"), F.col("status").alias("fetch_status"), "error")
    ex = PS.flag_soft_404(_cleared(X.with_content(X.extract_pages(r)), failed), use_content=True)
    return ex.select("url", *_PAGE_COLS, "fetch_status", "error")


def _soft(cols) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(coalesce({c}, '')), {_P})" for c in cols) + ")"


_ART = "left(" + O.html_text("substr(html, strpos(html, '<article>'))") + ", 500)"
_RERENDER_SQL = f"""
WITH f AS ({derive_sql('pages', _FETCHES)}),
c AS (SELECT page_id, url, html, CAST(CASE WHEN error IS NOT NULL THEN 0 ELSE status END AS INT) AS fetch_status,
        CASE WHEN error IS NOT NULL THEN error
             WHEN strpos(coalesce(content_type, ''), 'text/html') = 0 THEN 'Non-HTML content type: ' || coalesce(content_type, '')
             WHEN status >= 400 THEN 'HTTP ' || CAST(status AS VARCHAR) END AS error FROM f),
h AS (SELECT page_id, url, fetch_status, error,
        CASE WHEN error IS NULL THEN {O.title_sql()} END AS title,
        CASE WHEN error IS NULL THEN {O.first_p_desc_sql()} END AS description,
        CASE WHEN error IS NULL THEN {csr_sql()} ELSE false END AS csr FROM c),
h2 AS (SELECT *, error IS NULL AND {_soft(['trim(title)', 'trim(description)'])} AS s404 FROM h),
http AS (SELECT page_id, url, fetch_status, CASE WHEN s404 THEN {O.q(PS.SOFT_404_HTTP)} ELSE error END AS error,
           CASE WHEN s404 THEN NULL ELSE title END AS title, csr AND NOT s404 AS is_js_rendered FROM h2),
need AS (SELECT url FROM http WHERE (is_js_rendered AND error IS NULL) OR fetch_status IN (403, 429)),
r AS (SELECT x.* FROM ({derive_sql('pages', _RENDERED)}) x WHERE x.url IN (SELECT url FROM need)),
rx AS (SELECT url, status, {O.title_sql()} AS title, {O.first_p_desc_sql()} AS description, {_ART} AS content
       FROM r WHERE error IS NULL),
rendered AS (
  SELECT url, status AS fetch_status,
         CASE WHEN {_soft(['trim(title)', 'trim(description)', 'content'])} THEN {O.q(PS.SOFT_404_RENDERED)} END AS error,
         CASE WHEN {_soft(['trim(title)', 'trim(description)', 'content'])} THEN NULL ELSE title END AS title FROM rx
  UNION ALL SELECT url, status, error, NULL FROM r WHERE error IS NOT NULL),
j AS (SELECT h.*, rd.url AS r_url, rd.fetch_status AS r_status, rd.error AS r_error, rd.title AS r_title,
        (h.url IN (SELECT url FROM need)) AND rd.url IS NOT NULL AND rd.error IS NULL AS take
      FROM http h LEFT JOIN rendered rd ON rd.url = h.url)
SELECT page_id, url, CASE WHEN take THEN r_status ELSE fetch_status END AS fetch_status,
  CASE WHEN take THEN true ELSE is_js_rendered END AS is_js_rendered,
  CASE WHEN take THEN r_error ELSE error END AS error, CASE WHEN take THEN r_title ELSE title END AS title
FROM j"""


@register("rerender_merge", _RERENDER_SQL)
def q_rerender_merge(spark, sf):
    http = cut_lineage(_http_rows(spark, sf))  # read for the need and for the merge
    need = PS.needs_render(http)
    merged = PS.merge_rendered(http, _rendered_rows(spark, sf, need))
    return merged.select("page_id", "url", "fetch_status", "is_js_rendered", "error", "title")


# -- A6: document sink, written to the shared checkpoint area and read back -----------------------
def _sink_sql() -> str:
    from . import q_site
    return (f"SELECT idx.site, idx.doc, m.meta FROM ({O.index_doc_sql()}) idx "
            f"JOIN ({q_site.RUN_META_SQL}) m USING (site)")


@register("docs_sink", _sink_sql())
def q_docs_sink(spark, sf):
    import uuid

    from ..operators import assemble as G
    from ..operators import sections as E
    from ..session import ensure_checkpoint_dir
    from ..sources import tables as TB
    from . import site_docs as SD

    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    docs = SD.index_of(pages, ex)
    metrics = G.run_metrics(ex, E.categorize(ex), None, "default")
    path = f"{ensure_checkpoint_dir(spark)}/documents-{uuid.uuid4().hex}"
    TB.write_documents(docs, metrics, path)
    back = spark.read.parquet(f"{path}/docs").join(spark.read.parquet(f"{path}/meta"), "site")
    return back.select("site", "doc", "meta")
