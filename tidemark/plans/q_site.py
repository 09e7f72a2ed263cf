"""Per-site document queries over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import assemble as G
from ..operators import enhance as FE
from ..operators import sections as E
from ..session import table
from ..sources.tables import run_meta_json
from . import oracle as O
from . import site_docs as SD
from .registry import register

_EX = O.extracted_pages_sql()


@register("index_doc", O.index_doc_sql())
def q_index_doc(spark, sf):
    return SD.index_documents(table(spark, sf, "pages"))


@register("scan_pages", f"SELECT page_id, {O.u_site('url')} AS site, url, length(html) AS html_chars FROM pages")
def q_scan_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.site_key(F.col("url")).alias("site"), "url",
                    F.length("html").cast("bigint").alias("html_chars"))


@register("page_title", f"WITH {O.extracted_pages_sql()} SELECT page_id, title FROM ex0")
def q_page_title(spark, sf):
    ex = SD.extracted_pages(table(spark, sf, "pages"), materialize=False)
    return ex.select("page_id", "title")


@register("page_description", f"WITH {O.extracted_pages_sql()} SELECT page_id, description FROM ex0")
def q_page_description(spark, sf):
    ex = SD.extracted_pages(table(spark, sf, "pages"), materialize=False)
    return ex.select("page_id", "description")


_SITE_SQL = f"WITH {_EX}, {O.site_info_sql()}"


@register("homepage_pick", _SITE_SQL + " SELECT site, name, description AS fallback_description FROM sites")
def q_homepage_pick(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    s = SD.site_infos(ex, SD.seeds_for(SD.site_pages(pages)))
    return s.select("site", "name", F.col("description").alias("fallback_description"))


@register("display_fields", f"""WITH {_EX}
SELECT page_id, coalesce(nullif(title, ''), nullif(regexp_extract(url, '[^/]*$', 0), ''), 'Untitled') AS title,
       nullif(description, '') AS description FROM ex""")
def q_display_fields(spark, sf):
    ex = SD.extracted_pages(table(spark, sf, "pages"))
    return G.display_fields(ex).select("page_id", "title", "description")


_METRICS_SQL = f"""WITH {_EX}, {O.categorized_sql()},
pm AS (SELECT site, count(*) AS total_pages, count(*) FILTER (WHERE error IS NULL) AS pages_processed,
              count(*) FILTER (WHERE error IS NOT NULL) AS pages_failed FROM ex GROUP BY site),
sm AS (SELECT site, count(DISTINCT section) AS n_sections FROM cat GROUP BY site),
m AS (SELECT pm.site, pm.total_pages, pm.pages_processed, pm.pages_failed,
             CAST(coalesce(sm.n_sections, 0) + 2 AS BIGINT) AS llm_calls_made
      FROM pm LEFT JOIN sm USING (site))"""


@register("run_metrics", _METRICS_SQL + """
SELECT site, total_pages, pages_processed, pages_failed, llm_calls_made,
       llm_calls_made * 500 / 1000000.0 AS llm_cost_usd FROM m""")
def q_run_metrics(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    return G.run_metrics(ex, E.categorize(ex), None, "default")


RUN_META_SQL = _METRICS_SQL + """
SELECT site, '{"total_pages":' || total_pages || ',"pages_processed":' || pages_processed
  || ',"pages_failed":' || pages_failed || ',"llm_calls_made":' || llm_calls_made
  || ',"llm_cost_usd":' || CAST(llm_calls_made * 500 / 1000000.0 AS VARCHAR) || '}' AS meta FROM m"""


@register("run_meta_json", RUN_META_SQL)
def q_run_meta_json(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    m = G.run_metrics(ex, E.categorize(ex), None, "default")
    return m.select("site", run_meta_json(m).alias("meta"))


@register("full_doc")
def q_full_doc(spark, sf):
    return SD.full_documents(table(spark, sf, "pages"))


_STRUCT_SQL = f"""WITH {_EX}, {O.categorized_sql()},
enh AS (
  SELECT site, section, url, coalesce(nullif(title, ''), 'Untitled') AS title,
    nullif(coalesce(nullif(description, ''), ''), '') AS description,
    row_number() OVER (PARTITION BY site, section
                       ORDER BY moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank) - 1 AS entry_pos
  FROM cat
)
SELECT site, CAST(dense_rank() OVER (PARTITION BY site ORDER BY {O.section_key_sql('section')}) - 1 AS INT) AS section_pos,
       section, section = 'Optional' AS is_optional, CAST(entry_pos AS INT) AS entry_pos, title, url, description
FROM enh WHERE entry_pos < 5"""


@register("index_struct", _STRUCT_SQL)
def q_index_struct(spark, sf):
    pages = table(spark, sf, "pages")
    ex = SD.extracted_pages(pages)
    enhanced = FE.merge_enhanced(E.categorize(ex), None)
    s = G.build_sections(enhanced, 5)
    sec = s.select("site", F.posexplode("sections").alias("section_pos", "s"))
    return sec.select("site", "section_pos", F.col("s.name").alias("section"), F.col("s.is_optional").alias("is_optional"),
                      F.posexplode("s.entries").alias("entry_pos", "e")).select(
        "site", "section_pos", "section", "is_optional", "entry_pos",
        F.col("e.title").alias("title"), F.col("e.url").alias("url"), F.col("e.description").alias("description"))
