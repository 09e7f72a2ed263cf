"""Sitemaps (C2-C5, C9): url sets, index expansion, first source, dedup, freshness.

XML is read with anchored regular expressions (``regexp_extract_all`` +
``posexplode``), which tolerate truncated or malformed documents the way a
recovering parser does; ``xpath()`` would throw on them.  Index expansion
is three fixed self-joins (depth 0, 1, 2 are read; depth 3 is empty), with
a running-sum window for the "stop after 500" rule.  Every step is keyed,
so the work is spread over keys and bounded per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ENTRIES = 500
MAX_DEPTH = 3
CACHE_TTL_S = 3600

# a tag may carry a namespace prefix
_NS = r"(?:[A-Za-z_][\w.-]*:)?"
URL_BLOCK_RE = rf"(?s)<{_NS}url(?:\s[^>]*)?>(.*?)(?:</{_NS}url>|$)"
SITEMAP_BLOCK_RE = rf"(?s)<{_NS}sitemap(?:\s[^>]*)?>(.*?)(?:</{_NS}sitemap>|$)"
LOC_RE = rf"(?s)<{_NS}loc(?:\s[^>]*)?>(.*?)</{_NS}loc>"
PRIORITY_RE = rf"(?s)<{_NS}priority(?:\s[^>]*)?>(.*?)</{_NS}priority>"
INDEX_RE = rf"<{_NS}sitemapindex[\s>/]"


def xml_text(c: Column) -> Column:
    """Element text: CDATA markers dropped, named and numeric references decoded."""
    t = F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", "")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    refs = F.filter(F.regexp_extract_all(t, F.lit("&#(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)),
                    lambda r: ~F.lower(r).isin("38", "x26"))
    code = lambda r: F.when(r.startswith("x"), F.lpad(F.substring(r, 2, 6), 8, "0")) \
        .otherwise(F.lpad(F.hex(r.cast("long")), 8, "0"))
    t = F.when(t.contains("&#"), F.aggregate(refs, t, lambda acc, r: F.replace(
        acc, F.concat(F.lit("&#"), r, F.lit(";")), F.decode(F.unhex(code(r)), "UTF-32")))).otherwise(t)
    return F.regexp_replace(t, "&(?:amp|#38|#[xX]26);", "&")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_index(body) -> Column:
    return F.coalesce(body, F.lit("")).rlike(INDEX_RE)


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs(sitemap_url, body)`` -> ``(sitemap_url, idx, entries, children)``.

    All of it is decided inside the row: ``entries`` are the ``(url,
    priority)`` of a url set whose ``<loc>`` starts with http:// or https://
    (an invalid priority is NULL), ``children`` the ``(child_pos, child_url)``
    of an index.  Commented-out elements don't count.
    """
    staged = docs.select("sitemap_url", F.regexp_replace("body", r"(?s)<!--.*?-->", "").alias("_b"))
    staged = staged.withColumn("idx", is_index(F.col("_b")))

    def text(block, rx):
        return F.when(block.rlike(rx), _strip(xml_text(F.regexp_extract(block, rx, 1))))

    def blocks(rx):
        return F.regexp_extract_all("_b", F.lit(rx), F.lit(1))

    entries = F.filter(
        F.transform(blocks(URL_BLOCK_RE), lambda x: F.struct(
            text(x, LOC_RE).alias("url"), text(x, PRIORITY_RE).try_cast("double").alias("priority"))),
        lambda e: e["url"].startswith("http://") | e["url"].startswith("https://"))
    children = F.filter(
        F.transform(blocks(SITEMAP_BLOCK_RE), lambda x, i: F.struct(
            i.alias("child_pos"), text(x, LOC_RE).alias("child_url"),
            xml_text(F.regexp_extract(x, LOC_RE, 1)).alias("raw"))),
        lambda c: c["child_url"].isNotNull() & (c["raw"] != ""))
    return staged.select("sitemap_url", "idx", F.when(~F.col("idx"), entries).alias("entries"),
                         F.when(F.col("idx"), children).alias("children"))


def _entries(parsed: DataFrame) -> DataFrame:
    return parsed.select("sitemap_url", F.posexplode("entries").alias("pos", "e")) \
        .select("sitemap_url", "pos", "e.url", "e.priority")


def parse_urlsets(docs: DataFrame) -> DataFrame:
    """``docs(sitemap_url, body)`` -> ``(sitemap_url, pos, url, priority)``; no shuffle."""
    return _entries(parse_documents(docs))


def _kept_children(children: DataFrame, counts: DataFrame, keys: list, max_entries: int) -> DataFrame:
    """Stop rule: keep a child while the entries before it stay below ``max_entries``."""
    w = Window.partitionBy(*keys).orderBy("child_pos").rowsBetween(Window.unboundedPreceding, -1)
    c = children.join(counts, keys + ["child_pos"], "left").fillna(0, ["n"])
    return (c.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
            .filter(F.col("_before") < max_entries).drop("_before"))


def expand_indexes(docs: DataFrame, roots: DataFrame, keys=("site",),
                   max_entries: int = MAX_ENTRIES, materialize: bool = True) -> DataFrame:
    """Entries reachable from each root, depth-first in order.

    ``roots(keys..., cand_pos, sitemap_url)``; output
    ``(keys..., cand_pos, ord ARRAY<INT>, url, priority)`` where ``ord`` is
    the path of positions (child, grandchild, entry).  Depth 3 is not read.
    """
    keys = list(keys)
    k = keys + ["cand_pos"]
    # read by all depths: parsed once
    parsed = parse_documents(docs)
    parsed = cut_lineage(parsed) if materialize else parsed
    urls, bodies = _entries(parsed), parsed.select("sitemap_url", "idx")
    kids = parsed.select(F.col("sitemap_url").alias("parent_url"), F.explode("children").alias("c")) \
        .select("parent_url", "c.child_pos", "c.child_url")

    # depth 0
    r0 = roots.join(bodies, "sitemap_url")
    e0 = (r0.filter(~F.col("idx")).join(urls, "sitemap_url")
          .select(*k, F.array(F.col("pos")).alias("ord"), "url", "priority"))
    # depth 1 children of root indexes
    c1 = (r0.filter(F.col("idx")).join(kids, F.col("sitemap_url") == F.col("parent_url"))
          .select(*k, F.col("child_pos").alias("p1"), F.col("child_url").alias("u1")))
    c1b = c1.join(bodies, c1["u1"] == bodies["sitemap_url"], "left").drop("sitemap_url")
    # depth 2 children of depth-1 indexes
    c2 = (c1b.filter(F.col("idx")).drop("idx")
          .join(kids, F.col("u1") == F.col("parent_url"))
          .select(*k, "p1", F.col("child_pos").alias("p2"), F.col("child_url").alias("u2")))
    e2 = (c2.join(urls, c2["u2"] == urls["sitemap_url"])
          .select(*k, "p1", "p2", "pos", "url", "priority"))
    # stop rule inside depth-1 indexes (grandchildren are url sets or empty)
    n2 = e2.groupBy(*k, "p1", F.col("p2").alias("child_pos")).agg(F.count(F.lit(1)).alias("n"))
    kept2 = _kept_children(c2.withColumnRenamed("p2", "child_pos"), n2, k + ["p1"], max_entries)
    e2k = e2.join(kept2.select(*k, "p1", F.col("child_pos").alias("p2")), k + ["p1", "p2"])
    # entries of depth-1 url sets
    e1 = (c1b.filter(~F.col("idx")).join(urls, c1b["u1"] == urls["sitemap_url"])
          .select(*k, "p1", "pos", "url", "priority"))
    n1 = (e1.groupBy(*k, "p1").agg(F.count(F.lit(1)).alias("n"))
          .unionByName(e2k.groupBy(*k, "p1").agg(F.count(F.lit(1)).alias("n")))
          .withColumnRenamed("p1", "child_pos"))
    kept1 = _kept_children(c1.withColumnRenamed("p1", "child_pos"), n1, k, max_entries) \
        .select(*k, F.col("child_pos").alias("p1"))
    out1 = e1.join(kept1, k + ["p1"]).select(*k, F.array("p1", "pos").alias("ord"), "url", "priority")
    out2 = e2k.join(kept1, k + ["p1"]).select(*k, F.array("p1", "p2", "pos").alias("ord"), "url", "priority")
    return e0.unionByName(out1).unionByName(out2)


def first_source(entries: DataFrame, candidates: DataFrame, keys=("site",), materialize: bool = True) -> DataFrame:
    """C4: per key, the first candidate (by ``cand_pos``) that yields entries.

    Output ``(keys..., source, ord, url, priority)``; keys whose candidates
    all yield nothing get one row with ``source = 'sitemap'`` and NULL url.
    """
    keys = list(keys)
    if materialize:
        # read twice below (per-key minimum, then the join back): expand once
        entries = cut_lineage(entries)
    first = entries.groupBy(*keys).agg(F.min("cand_pos").alias("cand_pos"))
    chosen = (entries.join(first, keys + ["cand_pos"])
              .join(candidates.select(*keys, "cand_pos", F.col("sitemap_url").alias("source")),
                    keys + ["cand_pos"]))
    empty = (candidates.select(*keys).distinct().join(first, keys, "left_anti")
             .select(*keys, F.lit("sitemap").alias("source"), F.lit(None).cast("array<int>").alias("ord"),
                     F.lit(None).cast("string").alias("url"), F.lit(None).cast("double").alias("priority")))
    return chosen.select(*keys, "source", "ord", "url", "priority").unionByName(empty)


def dedup_entries(entries: DataFrame, keys=("site",), cap: int = MAX_ENTRIES) -> DataFrame:
    """One entry per url at its first position with the last priority; first ``cap``.

    Output ``(keys..., source, pos, url, priority)`` with ``pos`` from 1.
    """
    keys = list(keys)
    e = entries.filter(F.col("url").isNotNull())
    d = e.groupBy(*keys, "source", "url").agg(F.min("ord").alias("ord"),
                                               F.max_by("priority", "ord").alias("priority"))
    w = Window.partitionBy(*keys).orderBy("ord")
    return (d.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap)
            .select(*keys, "source", "pos", "url", "priority"))


def sitemap_candidates(robots_parsed: DataFrame, bases: DataFrame, keys=("site",)) -> DataFrame:
    """Candidate sitemap URLs: robots-listed ones, else /sitemap.xml then /sitemap_index.xml."""
    keys = list(keys)
    j = bases.join(robots_parsed.select(*keys, "sitemap_urls"), keys, "left")
    root = F.concat(F.regexp_extract("base_url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    defaults = F.array(F.concat(root, F.lit("/sitemap.xml")), F.concat(root, F.lit("/sitemap_index.xml")))
    lst = F.when(F.size(F.coalesce("sitemap_urls", F.array())) > 0, F.col("sitemap_urls")).otherwise(defaults)
    return j.select(*keys, F.posexplode(lst).alias("cand_pos", "sitemap_url"))


def is_readable(value) -> Column:
    """A cached result can be read back: a JSON object with a text ``source``
    and, where there are ``entries``, a list of objects with a text ``url``
    and a number or nothing as ``priority``."""
    v = F.try_parse_json(value)

    def kind(part, path):
        return F.schema_of_variant(F.try_variant_get(part, path, "variant"))

    number = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"
    entry_ok = F.forall(
        F.try_variant_get(v, "$.entries", "array<variant>"),
        lambda e: F.coalesce((kind(e, "$.url") == "STRING") & F.coalesce(kind(e, "$.priority"), F.lit("VOID"))
                             .rlike(number), F.lit(False)))
    entries = kind(v, "$.entries")
    return F.coalesce((kind(v, "$.source") == "STRING")
                      & (entries.isNull() | (entries.startswith("ARRAY") & F.coalesce(entry_ok, F.lit(False)))),
                      F.lit(False))


def split_fresh(parsed: DataFrame, as_of, ttl_s: int = CACHE_TTL_S):
    """(fresh rows to reuse, keys to recompute).  ``as_of`` is explicit;
    a value that can't be read is computed again."""
    as_of_c = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    young = F.coalesce(F.col("parsed_at") > as_of_c - F.make_dt_interval(secs=F.lit(ttl_s)), F.lit(False))
    ok = young & is_readable(F.col("value"))
    return parsed.filter(ok), parsed.filter(~ok)
