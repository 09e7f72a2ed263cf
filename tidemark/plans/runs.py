"""Runs from their configuration to their documents.

A run is a row of the job table: id, url, config.  Its limits and its mode
are columns all the way:

1. The configuration is checked; a run with a fault gets no document but its
   reason.
2. Discovery: robots, then sitemap entries, and a crawl for runs whose site
   publishes none.  Each run stops at its own ``max_urls`` and ``max_depth``.
3. Snapshots are read for the discovered URLs only.  A bounded set of their
   hashes thins the table out inside its scan, what is left is extracted
   there, and an exact join follows: no ``html`` is shuffled.  A URL without a
   snapshot is a failed page.
4. Sections, then the index document, or in detailed mode the full one (a run
   has at most 100 pages), and the metrics.

The key of a run is called ``site`` in the operators' frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import assemble as G
from ..operators import crawl as C
from ..operators import enhance as FE
from ..operators import extract as X
from ..operators import pagestate as PS
from ..operators import robots as R
from ..operators import sections as E
from ..operators import sitemaps as SM
from ..operators.keyset import KeySet, bits_for
from ..session import cut_lineage
from ..sources import tables as TB

NOT_FETCHED = "Not fetched"
TOP_K = 5
PAGE_COLUMNS = ("title", "description", "og_title", "og_description", "content_text", "is_js_rendered", "error")


def planned(jobs: DataFrame) -> DataFrame:
    """(site = job id, seed_url, host, mode, max_urls, max_depth, reject_reason) of each job."""
    checked = TB.parse_config(jobs.select(F.col("id").alias("site"), F.col("url").alias("seed_url"), "config"))
    return checked.select("site", "seed_url", U.site_key(F.col("seed_url")).alias("host"), "mode",
                          F.col("max_urls").cast("int").alias("max_urls"), F.col("max_depth").cast("int").alias("max_depth"),
                          F.coalesce("reject_reason", U.url_reject_reason(F.col("seed_url"))).alias("reject_reason"))


def discovered(runs: DataFrame, robots: DataFrame, sitemaps: DataFrame, fetches: DataFrame, agent: str) -> DataFrame:
    """(site, rank, url, depth, source) of each run's pages, within its own limits."""
    rules = R.robots_for(runs.select(F.col("host").alias("site")), robots, agent) \
        .select(F.col("site").alias("host"), "sitemap_urls", "disallowed_paths")
    known = runs.join(rules, "host")
    candidates = SM.sitemap_candidates(known.select("site", "sitemap_urls"),
                                       known.select("site", F.col("seed_url").alias("base_url")))
    listed = SM.first_source(SM.expand_indexes(sitemaps, candidates), candidates)
    entries = cut_lineage(SM.dedup_entries(listed).select("site", "pos", "url"))
    crawls = cut_lineage(known.join(entries.select("site").distinct(), "site", "left_anti"))
    hosts = KeySet(crawls, ["host"], bits_for(crawls.count()))
    read = PS.classify_fetch(hosts.possible(fetches.withColumn("_host", U.site_key(F.col("url"))), ["_host"]))
    links = C.page_links(X.extract_pages(read.where("error IS NULL").select("url", "html")), keys=()) \
        .withColumn("url", U.normalize_url(F.col("url")))
    crawled = C.crawl_links(crawls.select("site", "seed_url", F.col("disallowed_paths").alias("disallowed"),
                                          "max_depth", "max_urls"), links)
    return C.discover(entries, crawled, TB.CONFIG_BOUNDS["max_urls"][1], runs.select("site", "max_urls"))


def run_pages(found: DataFrame, fetches: DataFrame) -> DataFrame:
    """Discovered pages with what their snapshot says; ``error`` where there is none to be had."""
    found = found.withColumn("_key", U.normalize_url(F.col("url")))
    wanted = KeySet(found, ["_key"], bits_for(found.count()))
    kept = wanted.possible(fetches.withColumn("_key", U.normalize_url(F.col("url"))), ["_key"])
    read = PS.classify_fetch(kept).select("_key", "fetch_status", "error", "url", "html")
    ex = PS.flag_soft_404(X.with_content(X.with_csr(X.extract_pages(read))), use_content=False)
    # of several snapshots of a URL the one whose own URL sorts first
    one = ex.groupBy("_key").agg(F.min_by(F.struct(*PAGE_COLUMNS), F.struct("url", "title", "error")).alias("p"))
    joined = found.join(one, "_key", "left")
    return joined.select("site", "rank", "url", *(F.col(f"p.{c}").alias(c) for c in PAGE_COLUMNS if c != "error"),
                         F.when(F.col("p").isNull(), F.lit(NOT_FETCHED)).otherwise(F.col("p.error")).alias("error"))


def run_documents(jobs: DataFrame, robots: DataFrame, sitemaps: DataFrame, fetches: DataFrame, agent: str) -> DataFrame:
    """Per job: mode, doc, metrics, and the reason of a rejected one."""
    runs = cut_lineage(planned(jobs))
    good = runs.where("reject_reason IS NULL")
    found = cut_lineage(discovered(good, robots, sitemaps, fetches, agent))
    pages = cut_lineage(run_pages(found, fetches))
    parts = []
    for mode in TB.MODES:
        of_mode = good.where(F.col("mode") == mode).select("site", "seed_url")
        mine = pages.join(of_mode.select("site"), "site", "left_semi")
        sections = E.categorize(mine)
        home = FE.pick_homepage(mine, of_mode).select("site", F.col("fallback_description").alias("description"))
        sites = of_mode.join(home, "site", "left").select(
            "site", U.site_name(F.col("seed_url")).alias("name"), F.col("seed_url").alias("url"), "description",
            F.lit(None).cast("array<string>").alias("notes"))
        enhanced = FE.merge_enhanced(sections, None)
        requests = FE.clean_requests(mine)
        if mode == "detailed":
            docs = G.build_full(sites, FE.attach_cleaned(enhanced, FE.cleaned_from_replies(requests, None)))
        else:
            docs = G.build_index(sites, enhanced, TOP_K)
        metrics = of_mode.select("site").join(G.run_metrics(mine, sections, requests, mode), "site", "left")
        calls = F.coalesce("llm_calls_made", F.lit(1 if mode == "detailed" else 2).cast("long"))  # a run without pages
        parts.append(docs.join(metrics.withColumn("llm_calls_made", calls).withColumn(
            "llm_cost_usd", calls * G.COST_PER_CALL_MICRO_USD / 1e6), "site"))
    written = parts[0].unionByName(parts[1])
    return runs.select("site", "mode", "reject_reason").join(written, "site", "left") \
        .fillna(0, ["total_pages", "pages_processed", "pages_failed", "llm_calls_made", "llm_cost_usd"])
