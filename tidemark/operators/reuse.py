"""Work kept across runs (C9, H8): parsed sitemaps and the newest state of jobs.

What was worked out is kept by key in a ``KeyedTable``.  A run reads the
buckets that its keys fall into, takes what is young and readable, works out
the rest, and replaces the buckets it touched; the others stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.keyed import KeyedTable
from .jobs import latest_jobs
from .keyset import KeySet, bits_for
from .sitemaps import CACHE_TTL_S, MAX_DEPTH, dedup_entries, expand_indexes, first_source, parse_documents, split_fresh

CACHED = "source string, entries array<struct<url: string, priority: double>>"
BUCKETS = 64


class Sitemaps(NamedTuple):
    """Entries of all keys with ``reused``, and how many keys were taken over and parsed."""
    entries: DataFrame
    reused: int
    parsed: int
    documents: int


def sitemap_store(spark: SparkSession, path: str, keys: dict[str, str], buckets: int = BUCKETS) -> KeyedTable:
    """Store of parsed sitemaps for keys given as name -> type."""
    columns = ", ".join(f"{n} {t}" for n, t in keys.items())
    return KeyedTable(spark, path, f"{columns}, value string, parsed_at timestamp", tuple(keys), buckets)


def encoded(entries: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys..., value): the entries of a key (at most those of a sitemap) as the text that is kept."""
    listed = entries.groupBy(*keys).agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.when(
        F.col("url").isNotNull(), F.struct("pos", "url", "priority")))).alias("e"))
    value = F.struct("source", F.transform("e", lambda e: F.struct(e["url"].alias("url"), e["priority"].alias("priority"))).alias("entries"))
    return listed.select(*keys, F.to_json(value).alias("value"))


def decoded(stored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    read = stored.select(*keys, F.from_json("value", CACHED).alias("v"))
    return read.select(*keys, F.col("v.source").alias("source"), F.posexplode("v.entries").alias("pos", "e")) \
        .select(*keys, "source", (F.col("pos") + 1).alias("pos"), "e.url", "e.priority")


def reachable(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """The documents that the roots lead to, level by level, and possibly a few others.

    Each level is thinned out by a bounded set of its addresses inside the
    scan of the documents; only indexes are looked into.
    """
    wanted = cut_lineage(roots.select("sitemap_url").distinct())
    level = wanted
    for _ in range(MAX_DEPTH - 1):
        found = KeySet(level, ["sitemap_url"], bits_for(level.count())).possible(docs, ["sitemap_url"])
        children = parse_documents(found).select(F.explode("children").alias("c")).select(F.col("c.child_url").alias("sitemap_url"))
        level = cut_lineage(children.distinct().join(wanted, "sitemap_url", "left_anti"))
        wanted = cut_lineage(wanted.union(level))
    return KeySet(wanted, ["sitemap_url"], bits_for(wanted.count())).possible(docs, ["sitemap_url"])


def refresh_sitemaps(store: KeyedTable, candidates: DataFrame, docs: DataFrame, as_of, ttl_s: int = CACHE_TTL_S) -> Sitemaps:
    """C9 over a store: entries of all keys of ``candidates``; only stale, unreadable and new keys are parsed.

    ``candidates(keys..., cand_pos, sitemap_url)``, ``docs(sitemap_url, body)``.
    """
    keys = store.keys
    known = candidates.select(*keys).distinct()
    stored = cut_lineage(store.near(known).join(known, list(keys), "left_semi"))
    fresh, _ = split_fresh(stored, as_of, ttl_s)
    fresh = cut_lineage(fresh)
    missing = cut_lineage(candidates.join(fresh.select(*keys), list(keys), "left_anti"))
    needed = cut_lineage(reachable(docs, missing))
    found = first_source(expand_indexes(needed, missing, keys), missing, keys)
    entries = cut_lineage(dedup_entries(found, keys))
    # a key without any entry is kept too, so that it isn't parsed again
    empty = missing.select(*keys).distinct().join(entries.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit("sitemap").alias("source"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("double").alias("priority"))
    rows = encoded(entries.unionByName(empty), keys).withColumn("parsed_at", F.lit(as_of).cast("timestamp"))
    store.merge(rows, lambda both: both.groupBy(*keys).agg(F.max_by(F.struct("value", "parsed_at"), "parsed_at").alias("r"))
                .select(*keys, "r.value", "r.parsed_at"))
    out = decoded(fresh, keys).withColumn("reused", F.lit(True)).unionByName(entries.withColumn("reused", F.lit(False)))
    return Sitemaps(out, fresh.count(), missing.select(*keys).distinct().count(), needed.count())


def job_store(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, schema, ("id",), buckets)


def upsert_jobs(store: KeyedTable, updates: DataFrame, order: str = "updated_at") -> int:
    """H8 over a store: the newest state of each job; gives the number of buckets that were replaced."""
    return store.merge(updates, lambda rows: latest_jobs(rows, "id", order))
