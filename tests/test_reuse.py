"""Parsed sitemaps and job states kept across runs."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import reuse as RU
from tidemark.operators import sitemaps as SM

T0 = dt.datetime(2024, 1, 1)


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc><priority>0.{i}</priority></url>" for i, u in enumerate(urls)) + "</urlset>"


def index(*maps):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{m}</loc></sitemap>" for m in maps) + "</sitemapindex>"


def tables(spark, bodies, sites):
    docs = spark.createDataFrame(list(bodies.items()), "sitemap_url string, body string")
    rows = [(s, i, f"https://{s}/{n}.xml") for s in sites for i, n in enumerate(("map", "second"))]
    return spark.createDataFrame(rows, "site string, cand_pos int, sitemap_url string"), docs


def rows_of(entries):
    return sorted((r.site, r.source, r.pos, r.url, r.priority) for r in entries.collect())


def full(cands, docs):
    found = SM.first_source(SM.expand_indexes(docs, cands), cands)
    return rows_of(SM.dedup_entries(found))


def test_second_run_parses_stale_and_unreadable_keys_only(spark, tmp_path):
    sites = ["a", "b", "c", "d", "none"]
    bodies = {"https://a/map.xml": urlset("https://a/1", "https://a/2", "https://a/1"),
              "https://b/map.xml": index("https://b/x.xml", "https://b/y.xml"), "https://b/x.xml": urlset("https://b/1"),
              "https://b/y.xml": index("https://b/z.xml"), "https://b/z.xml": urlset("https://b/2"),
              "https://c/second.xml": urlset("https://c/1"), "https://d/map.xml": urlset("https://d/1"),
              "https://unrelated/map.xml": urlset("https://u/1")}
    cands, docs = tables(spark, bodies, sites)
    store = RU.sitemap_store(spark, f"{tmp_path}/store", {"site": "string"}, buckets=4)
    first = RU.refresh_sitemaps(store, cands, docs, T0)
    assert (first.reused, first.parsed, first.documents) == (0, 5, 7)
    assert rows_of(first.entries) == full(cands, docs)

    half = T0 + dt.timedelta(minutes=30)
    again = RU.refresh_sitemaps(store, cands, docs, half)
    assert (again.reused, again.parsed, again.documents) == (5, 0, 0)
    assert rows_of(again.entries) == full(cands, docs) and {r.reused for r in again.entries.collect()} == {True}

    # c is damaged, d is new to the store's bucket mates, b's documents change but b is still young
    worn = store.read().where("site = 'c'").withColumn("value", F.lit("{")).withColumn("parsed_at", F.lit(half).cast("timestamp"))
    store.merge(worn, lambda both: both.groupBy("site").agg(F.max_by(F.struct("value", "parsed_at"), "parsed_at").alias("r")).select("site", "r.*"))
    changed = {**bodies, "https://b/x.xml": urlset("https://b/new"), "https://c/second.xml": urlset("https://c/new")}
    cands2, docs2 = tables(spark, changed, [*sites, "e"])
    third = RU.refresh_sitemaps(store, cands2, docs2, half)
    got = rows_of(third.entries)
    assert (third.reused, third.parsed) == (4, 2)
    assert ("c", "https://c/second.xml", 1, "https://c/new", 0.0) in got
    assert ("b", "https://b/map.xml", 1, "https://b/1", 0.0) in got

    late = RU.refresh_sitemaps(store, cands2, docs2, T0 + dt.timedelta(hours=1))  # exactly the time to live: stale
    assert (late.reused, late.parsed) == (2, 4)  # c and e were parsed at half past
    later = RU.refresh_sitemaps(store, cands2, docs2, T0 + dt.timedelta(hours=9))
    assert later.reused == 0 and rows_of(later.entries) == full(cands2, docs2)


def test_job_states_are_upserted(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame([(i, s, T0 + dt.timedelta(minutes=m)) for i, s, m in rows],
                                               "id string, status string, updated_at timestamp")
    store = RU.job_store(spark, f"{tmp_path}/jobs", "id string, status string, updated_at timestamp", buckets=8)
    RU.upsert_jobs(store, frame([(f"j{i}", "pending", i) for i in range(40)]))
    assert RU.upsert_jobs(store, frame([("j1", "completed", 90), ("j1", "failed", 60)])) == 1
    assert RU.upsert_jobs(store, frame([("j1", "pending", 2), ("new", "pending", 1)])) <= 2
    got = {r.id: r.status for r in store.read().collect()}
    assert len(got) == 41 and got["j1"] == "completed" and got["new"] == "pending"
