"""Enhancement queries (F1-F11): request building, reply parsing, merge, fallbacks.

Replies are derived from the tables (deterministic JSON text with the
failure shapes a model call produces: bad JSON, fences, empty, nulls); they
stand in for the output of ``run_inference``, which is exercised on its own
with a local, clearly labelled test callable (``llm_stage``).
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import enhance as FE
from ..operators import sections as E
from ..session import cut_lineage, table
from ..sources import derived as D
from . import oracle as O
from . import site_docs as SD
from .registry import derive, derive_sql, register

S = D.S
CONTENT = "'Content of page ' || " + S + " || '. ' || repeat('lorem ipsum ', CAST((page_id * 4) % 900 AS INT))"
TITLE = D.case("page_id", ["'Page ' || " + S, "''", "'  '", "NULL"])
OG_TITLE = "CASE WHEN page_id % 3 = 0 THEN 'OG ' || " + S + " END"
DESC = D.case("page_id", ["'About page ' || " + S, "NULL", "''"])
OG_DESC = "CASE WHEN page_id % 5 = 0 THEN 'OG desc ' || " + S + " END"
ERROR = "CASE WHEN page_id % 13 = 0 THEN 'HTTP 500' END"
EN_PAGES = D.SECTION_PAGES + [("title", TITLE), ("og_title", OG_TITLE), ("description", DESC),
                              ("og_description", OG_DESC), ("content_text", CONTENT), ("error", ERROR)]
SEP = "\u001f"


def en_pages(spark, sf):
    """Pages with their order in the site (that of ``page_id``)."""
    return derive(spark, sf, "pages", EN_PAGES).withColumn("rank", F.col("page_id"))


def categorized(spark, sf):
    return E.categorize(en_pages(spark, sf))


_EN_SQL = f"""ex AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank
                    FROM ({derive_sql('pages', EN_PAGES)})),
{O.categorized_sql()},
catk AS (SELECT *, row_number() OVER (PARTITION BY site, section
                   ORDER BY moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank) AS i FROM cat)"""


@register("section_requests", f"""WITH {_EN_SQL}
SELECT site || chr(31) || section AS request_id, site, section,
  string_agg(format('Page {{}}:' || chr(10) || 'URL: {{}}' || chr(10) || 'Content: {{}}', i, url, left(coalesce(content_text, ''), 500)),
             chr(10) || chr(10) ORDER BY i) AS pages_block,
  count(*) AS n_pages, CAST(greatest(300, count(*) * 60) AS INT) AS max_tokens
FROM catk GROUP BY site, section""")
def q_section_requests(spark, sf):
    return FE.section_requests(categorized(spark, sf))


@register("section_request_parts", f"""WITH {_EN_SQL},
b AS (SELECT site || chr(31) || section AS request_id, i, (i - 1) // 2 AS part,
        format('Page {{}}:' || chr(10) || 'URL: {{}}' || chr(10) || 'Content: {{}}', i, url, left(coalesce(content_text, ''), 500)) AS block FROM catk)
SELECT request_id, CAST(part AS INT) AS part, string_agg(block, chr(10) || chr(10) ORDER BY i) AS pages_block, count(*) AS n_pages
FROM b GROUP BY request_id, part""")
def q_section_request_parts(spark, sf):
    return FE.section_request_parts(categorized(spark, sf), pages_per_part=2)


# -- F2: replies per page -----------------------------------------------------------------
_REPLY = D.case("page_id", [
    "'{\"pages\": [{\"url\": \"' || url || '\", \"title\": \"T' || " + S + " || '\", \"description\": \"D' || " + S + " || '\"}]}'",
    "'{\"pages\": [{\"url\": \"u1\", \"title\": \"a\"}, {\"url\": \"u1\", \"title\": \"b\", \"description\": \"\"}]}'",
    "'{\"pages\": [{\"title\": \"no url\"}]}'",
    "'{\"pages\": [{\"url\": \"' || url || '\", \"title\": null}]}'",
    "'not json'",
    "'```json' || chr(10) || '{\"pages\": []}' || chr(10) || '```'",
    "''",
    "'{\"other\": 1}'",
    "'[1, 2]'",
])
_REPLIES = [("request_id", "'r' || " + S),
            ("reply", f"CASE WHEN page_id % 11 = 10 THEN NULL ELSE {_REPLY} END"),
            ("error", "CASE WHEN page_id % 11 = 10 THEN 'RateLimitError: slow down' END")]


def _parse_sql(src: str) -> str:
    return f"""
r00 AS (SELECT request_id, coalesce(nullif(reply, ''), '{{}}') AS raw, error FROM {src}),
r0 AS (SELECT request_id, CASE WHEN json_valid(raw) THEN raw END AS rp, error FROM r00),
r1 AS (SELECT *, coalesce(error IS NULL AND json_type(rp) = 'OBJECT'
                 AND coalesce(json_type(rp, '$.pages') <> 'NULL', true), false) AS ok FROM r0),
ents AS (SELECT request_id, generate_subscripts(es, 1) AS pos, unnest(es) AS e
         FROM (SELECT request_id, CASE WHEN json_type(rp, '$.pages') = 'ARRAY'
                      THEN json_extract(rp, '$.pages[*]') ELSE [] END AS es FROM r1 WHERE ok)),
withurl AS (SELECT request_id, pos, e, json_extract_string(e, '$.url') AS url FROM ents
            WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.url') IS NOT NULL AND json_type(e, '$.url') <> 'NULL'),
lastu AS (SELECT request_id, url, arg_max(e, pos) AS e FROM withurl GROUP BY ALL),
parsed AS (SELECT r1.request_id, NOT r1.ok AS request_failed, l.url,
             json_type(l.e, '$.title') IS NOT NULL AS has_title, json_extract_string(l.e, '$.title') AS r_title,
             json_type(l.e, '$.description') IS NOT NULL AS has_description,
             json_extract_string(l.e, '$.description') AS r_description
           FROM r1 LEFT JOIN lastu l USING (request_id))"""


@register("response_parse", f"""WITH rep AS ({derive_sql('pages', _REPLIES)}), {_parse_sql('rep')}
SELECT request_id, request_failed, url, url IS NOT NULL AND has_title AS has_title, r_title,
       url IS NOT NULL AND has_description AS has_description, r_description FROM parsed""")
def q_response_parse(spark, sf):
    p = FE.parse_section_replies(derive(spark, sf, "pages", _REPLIES))
    return p.withColumn("has_title", F.coalesce("has_title", F.lit(False))) \
            .withColumn("has_description", F.coalesce("has_description", F.lit(False)))


# -- F3/F4: replies per section -------------------------------------------------------------
def _entry_sql() -> str:
    return ("'{\"url\": \"' || url || '\", \"title\": ' || CASE WHEN page_id % 17 = 1 THEN 'null' "
            "ELSE '\"E' || CAST(page_id AS VARCHAR) || '\"' END || "
            "CASE WHEN page_id % 4 = 0 THEN '' ELSE ', \"description\": \"ED' || CAST(page_id AS VARCHAR) || '\"' END || '}'")


_KIND = "length(section) % 4"
_SEC_REPLIES_SQL = f"""sec_rep AS (
  SELECT site || chr(31) || section AS request_id,
    CASE WHEN {_KIND} = 0 THEN 'not json'
         ELSE '{{"pages": [' || coalesce(string_agg({_entry_sql()}, ', ' ORDER BY page_id) FILTER (WHERE page_id % 3 <> 0), '') || ']}}' END AS reply,
    CASE WHEN {_KIND} = 3 AND min(page_id) % 2 = 0 THEN 'APIError: 500' END AS error
  FROM cat GROUP BY site, section)"""


def section_replies(cat):
    entry = F.concat(F.lit('{"url": "'), F.col("url"), F.lit('", "title": '),
                     F.when(F.col("page_id") % 17 == 1, F.lit("null"))
                     .otherwise(F.concat(F.lit('"E'), F.col("page_id").cast("string"), F.lit('"'))),
                     F.when(F.col("page_id") % 4 == 0, F.lit(""))
                     .otherwise(F.concat(F.lit(', "description": "ED'), F.col("page_id").cast("string"), F.lit('"'))),
                     F.lit("}"))
    kind = F.length("section") % 4
    agg = cat.groupBy("site", "section").agg(
        F.array_sort(F.collect_list(F.when(F.col("page_id") % 3 != 0, F.struct("page_id", entry.alias("e"))))).alias("_e"),
        F.min("page_id").alias("_m"))
    return agg.select(
        FE.section_request_id("site", "section").alias("request_id"),
        F.when(kind == 0, F.lit("not json")).otherwise(
            F.concat(F.lit('{"pages": ['), F.array_join(F.transform("_e", lambda x: x["e"]), ", "), F.lit("]}"))).alias("reply"),
        F.when((kind == 3) & (F.col("_m") % 2 == 0), F.lit("APIError: 500")).alias("error"))


_MERGE_SQL = f"""WITH {_EN_SQL}, {_SEC_REPLIES_SQL}, {_parse_sql('sec_rep')},
j AS (SELECT c.*, p.request_failed, m.url AS m_url, m.has_title, m.r_title, m.has_description, m.r_description
      FROM cat c LEFT JOIN (SELECT DISTINCT request_id, request_failed FROM parsed) p ON p.request_id = c.site || chr(31) || c.section
      LEFT JOIN (SELECT * FROM parsed WHERE url IS NOT NULL) m ON m.request_id = c.site || chr(31) || c.section AND m.url = c.url),
b AS (SELECT *, coalesce(request_failed, true) OR coalesce(bool_or(m_url IS NOT NULL AND ((has_title AND r_title IS NULL)
        OR (has_description AND r_description IS NULL))) OVER (PARTITION BY site, section), false) AS bad FROM j)
SELECT site, section, url,
  CASE WHEN NOT bad AND m_url IS NOT NULL THEN CASE WHEN has_title THEN r_title ELSE coalesce(nullif(title, ''), 'Untitled') END
       ELSE coalesce(nullif(title, ''), nullif(og_title, ''), 'Untitled') END AS title,
  CASE WHEN NOT bad AND m_url IS NOT NULL THEN CASE WHEN has_description THEN r_description ELSE '' END
       ELSE coalesce(nullif(description, ''), nullif(og_description, ''), '') END AS description,
  CASE WHEN bad THEN 'fallback' ELSE 'model' END AS source
FROM b"""


def _merged(spark, sf):
    cat = cut_lineage(categorized(spark, sf).drop("content_text"))  # read for the replies and for the merge
    parsed = FE.parse_section_replies(section_replies(cat))
    return FE.merge_enhanced(cat, parsed)


@register("enhance_merge", _MERGE_SQL)
def q_enhance_merge(spark, sf):
    return _merged(spark, sf).select("site", "section", "url", "title", "description", "source")


@register("section_fallback", f"SELECT DISTINCT site, section, source FROM ({_MERGE_SQL})")
def q_section_fallback(spark, sf):
    return _merged(spark, sf).select("site", "section", "source").distinct()


# -- F5-F7 ----------------------------------------------------------------------------------
_CLEAN_REQ = f"""SELECT url AS request_id, site, url, coalesce(nullif(title, ''), nullif(og_title, ''), 'Untitled') AS title,
  left(content_text, {FE.CLEAN_CONTENT_CAP}) AS content, length(content_text) AS raw_chars
FROM ({derive_sql('pages', EN_PAGES)})
WHERE error IS NULL AND coalesce(content_text, '') <> ''"""


@register("clean_requests", _CLEAN_REQ)
def q_clean_requests(spark, sf):
    r = FE.clean_requests(en_pages(spark, sf))
    return r.select("request_id", "site", "url", "title", "content",
                    F.length("raw_content").cast("bigint").alias("raw_chars"))


_FENCED = D.case("page_id", [
    "'```markdown' || chr(10) || 'Hello ' || " + S + " || chr(10) || '```'",
    "'  plain text ' || " + S + " || '  '",
    "''",
    "'```' || chr(10) || 'no closing ' || " + S,
    "'```py' || chr(10) || 'a' || chr(10) || '```  '",
    "NULL",
    "'```'",
])
_FENCE_ROWS = [("page_id", "page_id"), ("reply", _FENCED), ("original", "'orig ' || " + S)]


def _fence_sql(reply: str, original: str, newline: bool = False) -> str:
    base = O.py_strip(f"CASE WHEN {reply} IS NULL OR {reply} = '' THEN {original} ELSE {reply} END")
    no_first = f"regexp_replace({base}, '^[^\\n]*(\\n|$)', '')"
    no_last = f"regexp_replace({no_first}, '(^|\\n)[ \\t\\x0B\\f\\r]*```[ \\t\\x0B\\f\\r]*$', '')"
    out = O.py_strip(f"CASE WHEN starts_with({base}, '```') THEN {no_last} ELSE {base} END")
    return f"{out} || chr(10)" if newline else out


@register("fence_strip", f"""SELECT page_id, {_fence_sql('reply', 'original')} AS cleaned,
  {_fence_sql('reply', 'original', True)} AS polished FROM ({derive_sql('pages', _FENCE_ROWS)})""")
def q_fence_strip(spark, sf):
    d = derive(spark, sf, "pages", _FENCE_ROWS)
    return d.select("page_id", tx.strip_fence(F.col("reply"), F.col("original")).alias("cleaned"),
                    tx.strip_fence(F.col("reply"), F.col("original"), add_newline=True).alias("polished"))


_CLEAN_REPLIES = [("request_id", "url"),
                  ("reply", "CASE WHEN page_id % 4 = 1 THEN NULL ELSE " + _FENCED + " END"),
                  ("error", "CASE WHEN page_id % 4 = 1 THEN 'TimeoutError' END")]


@register("attach_clean", f"""WITH {_EN_SQL},
req AS ({_CLEAN_REQ.replace('length(content_text) AS raw_chars', 'content_text AS raw_content')}),
rep AS ({derive_sql('pages', _CLEAN_REPLIES)}),
cl AS (SELECT req.site, req.url, CASE WHEN rep.reply IS NULL AND rep.error IS NOT NULL THEN req.raw_content
                                      ELSE {_fence_sql('rep.reply', 'req.raw_content')} END AS cleaned
       FROM req LEFT JOIN rep USING (request_id))
SELECT c.site, c.url, cl.cleaned AS content_text FROM cat c LEFT JOIN cl USING (site, url)""")
def q_attach_clean(spark, sf):
    pages = en_pages(spark, sf)
    req = FE.clean_requests(pages)
    cleaned = FE.cleaned_from_replies(req, derive(spark, sf, "pages", _CLEAN_REPLIES))
    enhanced = FE.merge_enhanced(E.categorize(pages), None)
    return FE.attach_cleaned(enhanced, cleaned).select("site", "url", "content_text")


# -- F9 / F10 on the site documents ---------------------------------------------------------------
_SUM_KIND = "length(site) % 5"
_SUM_SQL = f"""sum_rep AS (SELECT site, CASE {_SUM_KIND}
    WHEN 0 THEN '{{"description": "Summary of ' || site || '", "notes": ["first note", "  ", "second"]}}'
    WHEN 1 THEN '{{"description": null, "notes": "x"}}'
    WHEN 2 THEN 'bad json'
    WHEN 3 THEN '{{"notes": []}}' END AS reply,
  CASE WHEN {_SUM_KIND} = 4 THEN 'RateLimitError' END AS error FROM sites)"""


def summary_replies(sites):
    k = F.length("site") % 5
    reply = (F.when(k == 0, F.concat(F.lit('{"description": "Summary of '), F.col("site"),
                                     F.lit('", "notes": ["first note", "  ", "second"]}')))
             .when(k == 1, F.lit('{"description": null, "notes": "x"}'))
             .when(k == 2, F.lit("bad json"))
             .when(k == 3, F.lit('{"notes": []}')))
    return sites.select(F.col("site").alias("request_id"), reply.alias("reply"),
                        F.when(k == 4, F.lit("RateLimitError")).alias("error"))


@register("site_summary", f"""WITH {O.extracted_pages_sql()}, {O.site_info_sql()}, {_SUM_SQL},
hc AS (SELECT h.site, h.first_rank IS NOT NULL
          OR coalesce((SELECT y.has_content FROM ex y WHERE y.site = h.site AND y.rank = h.home_rank), false) AS has_home
        FROM home h)
SELECT s.site,
  CASE WHEN hc.has_home AND r.error IS NULL AND coalesce(json_type(r.vj) = 'OBJECT', false)
       THEN json_extract_string(r.vj, '$.description') ELSE s.description END AS description,
  CASE WHEN hc.has_home AND r.error IS NULL AND coalesce(json_type(r.vj) = 'OBJECT', false)
            AND coalesce(json_type(r.vj, '$.notes') = 'ARRAY', false)
       THEN nullif(array_to_string(list_filter(CAST(json_extract_string(r.vj, '$.notes[*]') AS VARCHAR[]),
                                               lambda n: n IS NOT NULL AND trim(n) <> ''), chr(10)), '') END AS notes
FROM sites s JOIN hc USING (site)
LEFT JOIN (SELECT site, error, CASE WHEN json_valid(reply) THEN reply END AS vj FROM sum_rep) r USING (site)""")
def q_site_summary(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    home = FE.pick_homepage(ex, SD.seeds_for(SD.site_pages(pages)))
    info = FE.site_info(home, summary_replies(home.select("site")))
    return info.select("site", "description", F.nullif(F.array_join("notes", "\n"), F.lit("")).alias("notes"))


_POLISH_KIND = "length(site) % 3"


@register("polish_merge", f"""WITH idx AS ({O.index_doc_sql()}),
rep AS (SELECT site, CASE {_POLISH_KIND} WHEN 0 THEN '```markdown' || chr(10) || '# Polished ' || site || chr(10) || '```'
                               WHEN 1 THEN '' END AS reply,
               CASE WHEN {_POLISH_KIND} = 2 THEN 'TimeoutError' END AS error FROM idx)
SELECT site, CASE WHEN reply IS NOT NULL AND error IS NULL THEN {_fence_sql('reply', 'doc', True)} ELSE doc END AS doc
FROM idx JOIN rep USING (site)""")
def q_polish_merge(spark, sf):
    docs = SD.index_documents(table(spark, sf, "pages"))
    k = F.length("site") % 3
    replies = docs.select(F.col("site").alias("request_id"),
                          F.when(k == 0, F.concat(F.lit("```markdown\n# Polished "), F.col("site"), F.lit("\n```")))
                          .when(k == 1, F.lit("")).alias("reply"),
                          F.when(k == 2, F.lit("TimeoutError")).alias("error"))
    return FE.merge_polished(docs, replies)


# -- F11 ---------------------------------------------------------------------------------------------
def outline_reply(request: dict) -> str:
    """Local test callable (not a model): lists the request's URLs with a
    title taken from the URL path, as JSON in the section-reply shape."""
    urls = [ln[5:] for ln in (request.get("pages_block") or "").split("\n") if ln.startswith("URL: ")]
    if any("/404" in u for u in urls):
        raise RuntimeError("refused")
    return json.dumps({"pages": [{"url": u, "title": u.rsplit("/", 1)[-1], "description": ""} for u in urls]})


_LLM_SQL = f"""WITH {_EN_SQL},
req AS (SELECT site || chr(31) || section AS request_id,
          bool_or(strpos(url, '/404') > 0) AS refused,
          '{{"pages": [' || string_agg('{{"url": "' || url || '", "title": "' || regexp_extract(url, '[^/]*$', 0)
                                       || '", "description": ""}}', ', ' ORDER BY i) || ']}}' AS body
        FROM catk GROUP BY site, section)
SELECT request_id, CASE WHEN refused THEN NULL ELSE body END AS reply,
       CASE WHEN refused THEN 'RuntimeError: refused' END AS error FROM req"""


@register("llm_stage", _LLM_SQL)
def q_llm_stage(spark, sf):
    req = FE.section_requests(categorized(spark, sf))
    return FE.run_inference(req, outline_reply, parallelism=8, prompt_cols=["pages_block"])


# -- G6 over derived pages with known content (value-checked form of full_doc) -------------------
def _full_sql() -> str:
    title = "coalesce(nullif(title, ''), nullif(og_title, ''), 'Untitled')"
    desc = "coalesce(nullif(description, ''), nullif(og_description, ''), '')"
    body = f"coalesce(nullif(content_text, ''), nullif({desc}, ''), '(No content available)')"
    piece = f"'### ' || {title} || chr(10) || 'Source: ' || url || chr(10) || chr(10) || {body} || chr(10) || chr(10) || '---' || chr(10)"
    order = "moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank"
    return f"""WITH {_EN_SQL},
blocks AS (SELECT site, section, '## ' || section || chr(10) || chr(10) || string_agg({piece}, chr(10) ORDER BY {order}) || chr(10) AS block
           FROM cat GROUP BY site, section),
body AS (SELECT site, string_agg(block, chr(10) ORDER BY {O.section_key_sql('section')}) AS body FROM blocks GROUP BY site),
sites AS (SELECT DISTINCT site FROM ex)
SELECT s.site, {O.py_strip(f"'# ' || {O.site_name_sql(chr(39) + 'https://' + chr(39) + ' || s.site')} || chr(10) || chr(10) || coalesce(b.body, '')")} || chr(10) AS doc
FROM sites s LEFT JOIN body b USING (site)"""


@register("full_doc_derived", _full_sql())
def q_full_doc_derived(spark, sf):
    from ..functions import urls as U
    from ..operators import assemble as G

    pages = en_pages(spark, sf)
    enhanced = FE.merge_enhanced(E.categorize(pages), None)
    sites = pages.select("site").distinct().select(
        "site", U.site_name(F.concat(F.lit("https://"), F.col("site"))).alias("name"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("array<string>").alias("notes"))
    return G.build_full(sites, enhanced)


# -- detailed mode: parts of the full text, entries without a limit, metrics ------------------------
_TITLE_SQL = "coalesce(nullif(title, ''), nullif(og_title, ''), 'Untitled')"
_DESC_SQL = "coalesce(nullif(description, ''), nullif(og_description, ''), '')"
_PIECE_SQL = (f"'### ' || {_TITLE_SQL} || chr(10) || 'Source: ' || url || chr(10) || chr(10) || coalesce(nullif(content_text, ''), "
              f"nullif({_DESC_SQL}, ''), '(No content available)') || chr(10) || chr(10) || '---' || chr(10)")


@register("full_doc_parts", f"""WITH {_EN_SQL},
p AS (SELECT site, section, (i - 1) // 2 AS part, i, {_PIECE_SQL} AS piece FROM catk)
SELECT site, section, CAST(part AS INT) AS part,
  CASE WHEN part = 0 THEN '## ' || section || chr(10) || chr(10) ELSE '' END || string_agg(piece, chr(10) ORDER BY i) AS text
FROM p GROUP BY site, section, part""")
def q_full_doc_parts(spark, sf):
    from ..operators import assemble as G

    return G.full_parts(FE.merge_enhanced(categorized(spark, sf), None), pages_per_part=2)


@register("section_entries", f"""WITH {_EN_SQL}
SELECT site, section, section = 'Optional' AS is_optional, CAST(i AS INT) AS entry_pos, {_TITLE_SQL} AS title, url,
  nullif({_DESC_SQL}, '') AS description FROM catk""")
def q_section_entries(spark, sf):
    from ..operators import assemble as G

    return G.section_entries(FE.merge_enhanced(categorized(spark, sf), None))


@register("run_metrics_detailed", f"""WITH {_EN_SQL},
pm AS (SELECT site, count(*) AS total_pages, count(*) FILTER (WHERE error IS NULL) AS pages_processed,
              count(*) FILTER (WHERE error IS NOT NULL) AS pages_failed FROM ex GROUP BY site),
sm AS (SELECT site, count(DISTINCT section) AS n FROM cat GROUP BY site),
cm AS (SELECT site, count(*) AS n FROM ({_CLEAN_REQ}) GROUP BY site),
m AS (SELECT pm.*, CAST(coalesce(sm.n, 0) + 1 + coalesce(cm.n, 0) AS BIGINT) AS llm_calls_made
      FROM pm LEFT JOIN sm USING (site) LEFT JOIN cm USING (site))
SELECT site, total_pages, pages_processed, pages_failed, llm_calls_made, llm_calls_made * 500 / 1000000.0 AS llm_cost_usd FROM m""")
def q_run_metrics_detailed(spark, sf):
    from ..operators import assemble as G

    pages = en_pages(spark, sf)
    return G.run_metrics(pages, E.categorize(pages), FE.clean_requests(pages), "detailed")


@register("summary_requests", f"""WITH {O.extracted_pages_sql()}, {O.site_info_sql()},
c AS (SELECT h.site, s.name, h.seed_url AS url FROM home h JOIN sites s USING (site)
      WHERE h.first_rank IS NOT NULL
         OR coalesce((SELECT y.has_content FROM ex y WHERE y.site = h.site AND y.rank = h.home_rank), false))
SELECT site AS request_id, url, name FROM c""")
def q_summary_requests(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    home = FE.pick_homepage(ex, SD.seeds_for(SD.site_pages(pages)))
    names = SD.site_infos(ex, SD.seeds_for(SD.site_pages(pages))).select("site", "name")
    return FE.summary_requests(home, ex, names).select("request_id", "url", "name")
