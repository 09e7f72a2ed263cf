"""Link graph and breadth-first discovery.

The crawl is level-synchronous: a FIFO queue visits level by level, and
inside a level in (parent visit order, link position) order, a URL at its
first queue position.  So each level is one join ``frontier x links``, an
anti join against everything already popped, ``min((parent_rank, pos))``
per URL and a rank.  Skipped URLs are marked visited but neither emitted
nor expanded; the ``max_urls`` cap counts emitted URLs across levels.
Depth is at most 3, so the plan has at most four levels; each level is
checkpointed to keep lineage short and to survive executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_lineage

DEFAULT_MAX_DEPTH = 2
DEFAULT_MAX_URLS = 50


def page_links(extracted: DataFrame, keys=("site",)) -> DataFrame:
    """Every ``<a href>`` in document order, resolved, same site, http(s),
    no asset suffix, normalized; duplicates kept.

    Input: ``keys..., url, links`` (from extraction).  Output
    ``keys..., url, pos, target``.
    """
    keys = [k for k in keys if k != "url"]
    ex = extracted.select(*keys, "url", F.posexplode("links").alias("pos", "href"))
    staged = U.resolve_links(ex, "url", "href", "_abs")
    path = F.col("_abs_path")
    ok = ((U.strip_www(F.col("_abs_netloc")) == U.strip_www(U.url_netloc(F.col("url"))))
          & F.col("_abs_scheme").isin("http", "https")
          & ~U.is_asset(path))
    norm_path = F.regexp_replace(path, r"/+$", "")
    norm = F.concat(F.col("_abs_scheme"), F.lit("://"), F.col("_abs_netloc"),
                    F.when(norm_path == "", F.lit("/")).otherwise(norm_path),
                    F.when(F.col("_abs_query") != "", F.concat(F.lit("?"), F.col("_abs_query"))).otherwise(F.lit("")))
    return staged.filter(ok).select(*keys, "url", "pos", norm.alias("target"))


def _skip(url_col, base_netloc_col, disallowed_col):
    path = U.url_path(url_col)
    return ((U.strip_www(U.url_netloc(url_col)) != U.strip_www(base_netloc_col))
            | U.is_asset(path) | U.is_account_path(path) | U.is_disallowed(path, disallowed_col))


def crawl_links(seeds: DataFrame, links: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH,
                max_urls: int = DEFAULT_MAX_URLS, checkpoint: bool = True) -> DataFrame:
    """Breadth-first discovery per site.

    ``seeds(site, seed_url, disallowed ARRAY<STRING>)``; ``links(url, pos,
    target)`` keyed by the *normalized* page URL (a missing page has no
    links).  Output ``(site, rank, url, depth, source='crawl')``.

    Columns ``max_depth`` and ``max_urls`` of the seeds set a site's own
    limits; a site goes on to the next level only below its depth and while
    it has room.  The arguments hold where there is no such column.
    """
    own = [c for c in ("max_depth", "max_urls") if c in seeds.columns]
    if own:
        seeds = seeds.withColumns({c: F.col(c).cast("int") if c in own else F.lit(v)
                                   for c, v in (("max_depth", max_depth), ("max_urls", max_urls))})
        most = seeds.agg(F.max("max_depth").alias("depth"), F.max("max_urls").alias("urls")).first()
        max_depth, max_urls = most.depth or 0, most.urls or 0
    limits = seeds.select("site", F.col("max_depth").alias("_most_depth"), F.col("max_urls").alias("_most_urls")) if own else None
    if checkpoint:
        # the link table is read once per level: materialize it once
        links = cut_lineage(links.select("url", "pos", "target"))
    base = seeds.select("site", U.url_netloc(F.col("seed_url")).alias("base_netloc"),
                        F.coalesce(F.col("disallowed"), F.array().cast("array<string>")).alias("disallowed"))
    lvl = seeds.select("site", U.normalize_url(F.col("seed_url")).alias("url"))
    lvl = (lvl.join(base, "site")
           .withColumn("skip", _skip(F.col("url"), F.col("base_netloc"), F.col("disallowed")))
           .withColumn("order", F.struct(F.lit(0).alias("parent_rank"), F.lit(0).alias("pos")))
           .select("site", "url", "skip", "order"))
    emitted_all = None
    visited = None
    frontier = None
    for depth in range(0, max_depth + 1):
        if depth > 0:
            # candidates from last level's emitted parents (all had depth < max_depth)
            cand = (frontier.join(links, frontier["url"] == links["url"])
                    .select(frontier["site"], F.col("parent_rank"), F.col("pos"),
                            F.col("target").alias("url")))
            cand = cand.join(visited, ["site", "url"], "left_anti")
            lvl = (cand.groupBy("site", "url").agg(F.min(F.struct("parent_rank", "pos")).alias("o"))
                   .join(base, "site")
                   .withColumn("skip", _skip(F.col("url"), F.col("base_netloc"), F.col("disallowed")))
                   .withColumn("order", F.col("o"))
                   .select("site", "url", "skip", "order"))
        if checkpoint:
            # one materialized table per level: everything popped at this level
            # (skipped ones included); visited = union of the levels so far
            lvl = cut_lineage(lvl)
        seen = lvl.select("site", "url")
        visited = seen if visited is None else visited.unionByName(seen)
        w = Window.partitionBy("site").orderBy("order", "url")
        # row_number <= max_urls first: Spark plans a map-side WindowGroupLimit,
        # so a hot site never ships more than max_urls candidates per task
        ranked = (lvl.filter(~F.col("skip")).withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= max_urls))
        if emitted_all is not None:
            counts = emitted_all.groupBy("site").agg(F.max("rank").alias("_prev"))
            ranked = (ranked.join(counts, "site", "left")
                      .withColumn("rank", F.col("rank") + F.coalesce(F.col("_prev"), F.lit(0))).drop("_prev"))
        emitted = ranked.filter(F.col("rank") <= max_urls).select(
            "site", "rank", "url", F.lit(depth).alias("depth"))
        goes_on = emitted
        if limits is not None:
            emitted = emitted.join(limits, "site").filter((F.col("rank") <= F.col("_most_urls")) & (F.col("depth") <= F.col("_most_depth")))
            emitted = cut_lineage(emitted) if checkpoint else emitted
            full = emitted.filter(F.col("rank") >= F.col("_most_urls")).select("site").distinct()
            goes_on = emitted.filter(F.col("depth") < F.col("_most_depth")).join(full, "site", "left_anti")
            emitted = emitted.select("site", "rank", "url", "depth")
        emitted_all = emitted if emitted_all is None else emitted_all.unionByName(emitted)
        frontier = goes_on.select("site", "url", F.col("rank").alias("parent_rank"))
    return emitted_all.withColumn("source", F.lit("crawl"))


def discover(entries: DataFrame, crawled: DataFrame, max_urls: int = DEFAULT_MAX_URLS,
             limits: DataFrame | None = None) -> DataFrame:
    """Sitemap entries when a site has any, else the crawl; first ``max_urls``.

    ``limits(site, max_urls)`` sets a site's own limit, at most ``max_urls``.

    ``entries(site, pos, url)`` (deduplicated sitemap), ``crawled(site, rank,
    url, depth)``.  Sitemap pages get no skip/disallow/same-site filter.
    """
    sm = entries.filter(F.col("url").isNotNull()).select(
        "site", F.col("pos").alias("rank"), "url", F.lit(0).alias("depth"), F.lit("sitemap").alias("source"))
    cr = crawled.join(sm.select("site").distinct(), "site", "left_anti").select(
        "site", "rank", "url", "depth", F.lit("crawl").alias("source"))
    both = sm.unionByName(cr)
    w = Window.partitionBy("site").orderBy("rank")
    first = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_urls)
    if limits is None:
        return first
    return first.join(limits.select("site", F.col("max_urls").alias("_most")), "site") \
        .filter(F.col("rank") <= F.col("_most")).drop("_most")
