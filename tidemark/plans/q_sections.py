"""Categorization and ordering queries (E1-E5, G1, G3) over derived section paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assemble as G
from ..operators import sections as E
from ..operators.numbering import number_within
from ..sources import derived as D
from . import oracle as O
from .registry import derive, derive_sql, register

# user-supplied rules replacing the defaults (E2 custom)
CUSTOM_RULES = (
    E.Rule("Docs", (r"/docs?(/|$)", r"/learn(/|$)"), 5),
    E.Rule("Money", (r"/pricing(/|$)", r"/plans?(/|$)"), 7),
    E.Rule("Legal", (r"/legal(/|$)", r"/privacy"), 1),
)

_SP = f"({derive_sql('pages', D.SECTION_PAGES)})"
_PATH = f"lower({O.u_path('url')})"


def pages(spark, sf):
    """Section pages with their rank inside the site (numbered without a task per site)."""
    return number_within(derive(spark, sf, "pages", D.SECTION_PAGES), "site", "page_id", "rank")


@register("exclude_pages", f"SELECT page_id, url, regexp_matches({_PATH}, {O.q(O.EXCLUDE_SQL_RE)}) AS excluded FROM {_SP}")
def q_exclude_pages(spark, sf):
    return derive(spark, sf, "pages", D.SECTION_PAGES).select("page_id", "url", E.is_excluded(F.col("url")).alias("excluded"))


@register("url_section", f"SELECT page_id, url, {O.rule_case(_PATH)} AS section FROM {_SP}")
def q_url_section(spark, sf):
    p = derive(spark, sf, "pages", D.SECTION_PAGES)
    return E.with_section(p).select("page_id", "url", "section")


@register("url_section_custom", f"SELECT page_id, url, {O.rule_case(_PATH, CUSTOM_RULES)} AS section FROM {_SP}")
def q_url_section_custom(spark, sf):
    p = derive(spark, sf, "pages", D.SECTION_PAGES)
    return E.with_section(p, CUSTOM_RULES).select("page_id", "url", "section")


_FIRST = f"regexp_extract({_PATH}, '^/*([^/]+)', 1)"


@register("fallback_section", f"""SELECT page_id, {_PATH} AS path,
  CASE WHEN {_FIRST} = '' THEN 'Pages' ELSE {O.py_title(f"translate({_FIRST}, '-_', '  ')")} END AS fallback FROM {_SP}""")
def q_fallback_section(spark, sf):
    p = derive(spark, sf, "pages", D.SECTION_PAGES)
    path = E.lower_path(F.col("url"))
    return p.select("page_id", path.alias("path"), E.fallback_section(path).alias("fallback"))


_CAT_SQL = f"""WITH ex AS (SELECT site, page_id, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank,
                           CAST(NULL AS VARCHAR) AS error FROM {_SP}),
{O.categorized_sql()}"""


@register("sections_final", _CAT_SQL + """
SELECT site, page_id, section, moved, CASE WHEN moved THEN first_rank ELSE 0 END AS first_rank, rank FROM cat""")
def q_sections_final(spark, sf):
    c = E.categorize(pages(spark, sf))
    return c.select("site", "page_id", "section", F.col("sec_order.moved").cast("boolean").alias("moved"),
                    F.col("sec_order.first").cast("bigint").alias("first_rank"), F.col("rank").cast("bigint").alias("rank"))


@register("section_sizes", _CAT_SQL + " SELECT site, section, count(*) AS n_pages FROM cat GROUP BY ALL")
def q_section_sizes(spark, sf):
    return E.section_sizes(E.categorize(pages(spark, sf)))


@register("section_order", _CAT_SQL + f"""
SELECT site, section, CAST(dense_rank() OVER (PARTITION BY site ORDER BY {O.section_key_sql('section')}) AS INT) AS section_pos
FROM (SELECT DISTINCT site, section FROM cat)""")
def q_section_order(spark, sf):
    c = E.categorize(pages(spark, sf)).select("site", "section").distinct()
    w = Window.partitionBy("site").orderBy(G.section_sort_key("section"))
    return c.withColumn("section_pos", F.dense_rank().over(w).cast("int"))


@register("topk_section", _CAT_SQL + """
SELECT site, section, page_id, pos FROM (
  SELECT site, section, page_id, row_number() OVER (PARTITION BY site, section
         ORDER BY moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank) AS pos FROM cat) WHERE pos <= 5""")
def q_topk_section(spark, sf):
    c = E.categorize(pages(spark, sf))
    top = G.top_per_section(c, 5)
    w = Window.partitionBy("site", "section").orderBy("sec_order")
    return top.withColumn("pos", F.row_number().over(w)).select("site", "section", "page_id", F.col("pos").cast("bigint"))


# E2 and E4 with a table of rules by site: three pages in four give their site a rule
_RULE_WHERE = "page_id % 4 <> 0 AND length(url) % 5 <> 0"
_RULES = [("site", D.SITE), ("name", "'Zone ' || CAST(page_id % 6 AS STRING)"), ("pattern", D.case("page_id", [
    "'/docs?(/|$)'", "'/api(/|$)'", "'/(blog|news|posts)(/|$)'", "'/my-'", "'/[0-9]+$'", "'^/en(/|$)'", "'/3d|/x_y'", "'/LEARN(/|$)'",
    "'/pric[a-z]+/'", "'/tutorials?(/|$)'", "'/v2/api'", "'s/'", "'/sol+utions'"])),
    ("priority", "page_id % 4"), ("position", "page_id")]
_RULES_CTE = f"""r AS ({derive_sql('pages', _RULES, _RULE_WHERE)}),
p AS (SELECT site, page_id, url, {_PATH} AS path, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank FROM {_SP}),
own AS (SELECT DISTINCT site, true AS own FROM r),
m AS (SELECT p.site, p.page_id, arg_min(r.name, (-r.priority, r.position)) AS name FROM p JOIN r USING (site)
      WHERE regexp_matches(p.path, r.pattern, 'i') GROUP BY p.site, p.page_id),
s AS (SELECT p.*, own, CASE WHEN m.name IS NOT NULL THEN m.name WHEN own THEN
        CASE WHEN {_FIRST} = '' THEN 'Pages' ELSE {O.py_title(f"translate({_FIRST}, '-_', '  ')")} END
        ELSE {O.rule_case(_PATH)} END AS section FROM p LEFT JOIN m USING (site, page_id) LEFT JOIN own USING (site)),
t AS (SELECT s.*, CASE WHEN own THEN EXISTS (SELECT 1 FROM r WHERE r.site = s.site AND r.name = s.section)
        ELSE s.section IN {O.sql_list([r.name for r in E.DEFAULT_RULES])} END AS is_rule FROM s)"""


@register("url_section_rules", f"WITH {_RULES_CTE} SELECT page_id, site, url, section, is_rule FROM t")
def q_url_section_rules(spark, sf):
    rules = derive(spark, sf, "pages", _RULES, _RULE_WHERE)
    p = derive(spark, sf, "pages", D.SECTION_PAGES)
    return E.with_site_sections(p, rules).select("page_id", "site", "url", "section", "is_rule")


@register("sections_final_rules", f"""WITH {_RULES_CTE},
n AS (SELECT *, count(*) OVER (PARTITION BY site, section) AS n FROM t)
SELECT site, page_id, CASE WHEN NOT is_rule AND n < 2 THEN 'Pages' ELSE section END AS section FROM n""")
def q_sections_final_rules(spark, sf):
    rules = derive(spark, sf, "pages", _RULES, _RULE_WHERE)
    return E.consolidate(E.with_site_sections(pages(spark, sf), rules)).select("site", "page_id", "section")
