"""Per-site document plan: snapshots -> extraction -> sections -> documents.

1. ``extract_pages`` runs once per page inside the scan's tasks (Arrow
   batches, no shuffle of ``html``); its narrow result is checkpointed once
   and feeds every consumer.
2. Pages keep the order of ``page_id``, which serves as their rank; no row
   numbers, so a site with a third of all pages is never sorted in one task.
3. Later steps aggregate by ``(site, section)`` with partial sums, or rank
   with a map-side group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import assemble as G
from ..operators import enhance as FE
from ..operators import extract as X
from ..operators import pagestate as PS
from ..operators import sections as E
from ..session import cut_lineage

DEFAULT_TOP_K = 5


def site_pages(pages: DataFrame) -> DataFrame:
    """Driver ``pages`` table -> ``(site, page_id, url, html)``."""
    return pages.select(U.site_key(F.col("url")).alias("site"), "page_id", "url", "html")


def extracted_pages(pages: DataFrame, materialize: bool = True) -> DataFrame:
    """Extracted pages with content, CSR flag and HTTP-path soft-404 errors.

    The result feeds several consumers (sections, site info, metrics), so it
    is materialized once with a reliable checkpoint: the Python extraction
    runs exactly once per page and the lineage is cut (executor loss after
    this point re-reads the checkpoint, not the HTML).
    """
    ex = X.with_content(X.with_csr(X.extract_pages(site_pages(pages))))
    ex = ex.withColumn("fetch_status", F.lit(200)).withColumn("error", F.lit(None).cast("string"))
    ex = PS.flag_soft_404(ex, use_content=False).withColumn("rank", F.col("page_id")).drop("markdown")
    return cut_lineage(ex) if materialize else ex


def seeds_for(pages: DataFrame) -> DataFrame:
    """Seed URL per site for the snapshot table: root of the site's first page."""
    first = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("_u"))
    return first.select("site", F.concat(U.url_scheme(F.col("_u")), F.lit("://"),
                                         U.url_netloc(F.col("_u")), F.lit("/")).alias("seed_url"))


def site_infos(extracted: DataFrame, seeds: DataFrame) -> DataFrame:
    """SiteInfo per site with the fallback description (no model reply)."""
    home = FE.pick_homepage(extracted, seeds)
    return home.select("site", U.site_name(F.col("seed_url")).alias("name"),
                       F.col("seed_url").alias("url"),
                       F.col("fallback_description").alias("description"),
                       F.lit(None).cast("array<string>").alias("notes"))


def index_documents(pages: DataFrame, k: int = DEFAULT_TOP_K, section_replies: DataFrame | None = None) -> DataFrame:
    """Flagship: one llms.txt index per site (default mode, no polish reply)."""
    return index_of(pages, extracted_pages(pages), k, section_replies)


def index_of(pages: DataFrame, extracted: DataFrame, k: int = DEFAULT_TOP_K,
             section_replies: DataFrame | None = None) -> DataFrame:
    """The index documents of pages that are extracted already."""
    enhanced = FE.merge_enhanced(E.categorize(extracted), section_replies)
    return G.build_index(site_infos(extracted, seeds_for(site_pages(pages))), enhanced, k)


def full_documents(pages: DataFrame) -> DataFrame:
    """Full document per site (detailed mode, cleaning replies absent -> raw content)."""
    ex = extracted_pages(pages)
    cat = E.categorize(ex)
    enhanced = FE.attach_cleaned(FE.merge_enhanced(cat, None), None)
    sites = site_infos(ex, seeds_for(site_pages(pages)))
    return G.build_full(sites, enhanced)
