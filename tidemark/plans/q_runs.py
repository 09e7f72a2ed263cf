"""Runs from configuration to document (A1-A4, A7, C1-C8, G3, G4, G7), from tables read by their loaders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import table
from ..sources import derived as D
from ..sources import tables as TB
from ..streaming.arrivals import shared_folder
from . import oracle as O
from . import q_discovery as QD
from . import runs as RN
from .registry import register

# one run per site, with limits of 1, 3 and 100 pages, and 101, which is refused
_RUN_CONFIG = ("'{\"crawl\": {\"max_urls\": ' || CASE page_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '3' WHEN 2 THEN '100' ELSE '101' END "
               "|| ', \"max_depth\": ' || CAST(1 + page_id % 3 AS STRING) || '}}'")
_RUN_JOBS = [("id", "'run-' || CAST(page_id AS STRING)"), ("url", "url"), ("config", _RUN_CONFIG)]
_NORM = QD.norm_sql
_LISTED = "string_split(sitemap_urls, chr(10))"
_RUN_EX = O.extracted_pages_sql().split("ex0 AS", 1)[1].replace("FROM rk)", "FROM rkk)") \
    .replace("AS description FROM", "AS description, html IS NULL AS nf FROM") \
    .replace("CASE WHEN s404 THEN", f"CASE WHEN nf THEN {O.q(RN.NOT_FETCHED)} WHEN s404 THEN", 3) \
    .replace(f"CASE WHEN nf THEN {O.q(RN.NOT_FETCHED)} WHEN s404 THEN NULL", "CASE WHEN s404 THEN NULL") \
    .replace("NOT s404 AS has_content", "NOT s404 AND NOT nf AS has_content")
_RUN_SITE = ("home AS" + O.site_info_sql().split("home AS", 1)[1]).replace("JOIN seeds s USING (site)", "JOIN good s USING (site)") \
    .replace("SELECT h.site, ", "SELECT g.site, ").replace("h.seed_url", "g.seed_url").replace("FROM home h\n", "FROM good g LEFT JOIN home h USING (site)\n")
_RUN_INDEX = "enh AS" + O.index_doc_sql().split("enh AS", 1)[1].rsplit("SELECT s.site,", 1)[0]
_RUN_DOC = "SELECT s.site," + O.index_doc_sql().rsplit("SELECT s.site,", 1)[1]
_RUN_SQL = f"""WITH {QD.robots_sql()},
fp AS (SELECT {O.u_site('url')} AS host, min(page_id) AS page_id FROM pages GROUP BY 1),
jobs AS (SELECT 'run-' || CAST(page_id AS VARCHAR) AS site, fp.host, p.page_id, p.url AS seed_url,
         CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 100 ELSE 101 END AS max_urls, 1 + page_id % 3 AS max_depth
         FROM fp JOIN pages p USING (page_id)),
good AS (SELECT jobs.*, coalesce(rr.sitemap_urls, '') AS sitemap_urls, coalesce(rr.disallowed_paths, '') AS disallowed_paths
         FROM jobs LEFT JOIN rr ON rr.page_id = jobs.page_id WHERE max_urls <= 100),
lims AS (SELECT site AS lim_site, max_urls, max_depth FROM good),
kind AS (SELECT site, seed_url, page_id, CASE WHEN sitemap_urls <> '' THEN right({_LISTED}[1], 5) END AS doc FROM good),
sm AS (SELECT site, 1 AS rank, seed_url AS url FROM kind WHERE doc IS NOT NULL
       UNION ALL SELECT site, 2, regexp_extract(seed_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) ||
         CASE WHEN doc = 'a.xml' THEN '/p/' || page_id || '?a=1&b=2' ELSE '/b/' || page_id END FROM kind WHERE doc IS NOT NULL),
links AS (SELECT {_NORM('p.url')} AS url, pl.pos, pl.target FROM ({QD.PAGE_LINKS_SQL}) pl JOIN pages p USING (page_id)),
seeds AS (SELECT site, {_NORM("seed_url")} AS url FROM kind WHERE doc IS NULL),
dis AS (SELECT site, unnest(string_split(disallowed_paths, chr(10))) AS prefix FROM good WHERE disallowed_paths <> ''),
{{crawl}},
cl AS (SELECT * FROM crawled WHERE depth <= (SELECT max_depth FROM lims WHERE lim_site = site)),
found AS (SELECT site, rank, url FROM (SELECT * FROM sm UNION ALL SELECT site, rank, url FROM cl)
          WHERE rank <= (SELECT max_urls FROM lims WHERE lim_site = site)),
snap AS (SELECT *, {_NORM('url')} AS nurl FROM pages),
snap1 AS (SELECT nurl, arg_min(html, url) AS html FROM snap GROUP BY nurl),
rkk AS (SELECT f.site, f.rank AS page_id, f.rank, f.url, s.html FROM found f LEFT JOIN snap1 s ON s.nurl = {_NORM('f.url')}),
ex0 AS{_RUN_EX}, {O.categorized_sql()},
{_RUN_SITE},
{_RUN_INDEX},
pm AS (SELECT site, count(*) AS total_pages, count(*) FILTER (WHERE error IS NULL) AS pages_processed,
              count(*) FILTER (WHERE error IS NOT NULL) AS pages_failed FROM ex GROUP BY site),
n AS (SELECT site, count(DISTINCT section) AS n FROM cat GROUP BY site),
docs AS ({_RUN_DOC})
SELECT jobs.site AS id, CASE WHEN jobs.max_urls > 100 THEN 'max_urls: must be <= 100' END AS reject_reason, doc,
       coalesce(total_pages, 0) AS total_pages, coalesce(pages_processed, 0) AS pages_processed,
       coalesce(pages_failed, 0) AS pages_failed, CASE WHEN doc IS NOT NULL THEN CAST(coalesce(n.n, 0) + 2 AS BIGINT) ELSE 0 END AS llm_calls_made
FROM jobs LEFT JOIN docs USING (site) LEFT JOIN pm USING (site) LEFT JOIN n USING (site)""".replace(
    "{crawl}", QD.crawl_levels_sql(3, "(SELECT max_urls FROM lims WHERE lim_site = site)", "(SELECT host FROM good g WHERE g.site = {t}.site)"))


def _written(df, stem: str) -> str:
    """Write a table to the shared folder; the query starts from its loader."""
    path = shared_folder(df.sparkSession, stem)
    df.write.parquet(path)
    return path


def run_inputs(spark, sf):
    """Job, robots, sitemap and fetch tables of one run per site: the jobs of the sites' first pages."""
    pages = table(spark, sf, "pages")
    first = pages.groupBy(U.site_key(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id")).select("page_id")
    jobs = D.apply(pages.join(first, "page_id"), _RUN_JOBS)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in TB.JOB_SCHEMA if f.name not in jobs.columns]
    robots = D.apply(pages.join(first, "page_id"), D.ROBOTS).select("site", "body").where("body IS NOT NULL")
    docs = [D.apply(pages, D.sitemap_doc_exprs(kind)) for kind in D.SITEMAP_DOCS]
    return (TB.load_jobs(spark, _written(jobs.select("*", *empty), "jobs")),
            TB.load_robots(spark, _written(robots, "robots")),
            TB.load_sitemaps(spark, _written(reduce(DataFrame.union, docs), "sitemaps")),
            TB.load_fetches(spark, _written(TB.pages_as_fetches(pages).drop("page_id"), "fetches")))


@register("run_documents", _RUN_SQL)
def q_run_documents(spark, sf):
    out = RN.run_documents(*run_inputs(spark, sf), QD.AGENT)
    return out.select(F.col("site").alias("id"), "reject_reason", "doc", "total_pages", "pages_processed", "pages_failed", "llm_calls_made")
