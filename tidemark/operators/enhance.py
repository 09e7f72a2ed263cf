"""Model-assisted enhancement as batch data work.

The remote model call is a plug-in callable applied by ``run_inference``;
everything around it (request building, reply parsing, merge, fallback) is
relational.  Without a plug-in, rows carry the labelled fallback
(``source = 'fallback'``); a stub is never presented as model output.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .assemble import positions

UNTITLED = "Untitled"
SECTION_CONTENT_BUDGET = 500
CLEAN_CONTENT_CAP = 6000  # 2 x 3000 characters of raw content


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def section_request_id(site, section) -> Column:
    return F.concat_ws("\u001f", F.col(site), F.col(section))


def section_requests(pages: DataFrame, budget: int = SECTION_CONTENT_BUDGET) -> DataFrame:
    """one request per (site, section); pages numbered from 1 in order.

    Each block reads ``Page i:\\nURL: u\\nContent: first budget chars``;
    blocks are joined by a blank line; ``max_tokens = max(300, 60 * n)``.
    One text per section: for sections known to be small; otherwise see
    ``section_request_parts``.
    """
    numbered, block = _request_blocks(pages, budget)
    return (numbered.groupBy("site", "section")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), block.alias("b")))).alias("_b"),
                 F.count(F.lit(1)).alias("n_pages"))
            .select(section_request_id("site", "section").alias("request_id"), "site", "section",
                    F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("pages_block"),
                    "n_pages",
                    F.greatest(F.lit(300), F.col("n_pages") * 60).cast("int").alias("max_tokens")))


def _request_blocks(pages: DataFrame, budget: int) -> tuple[DataFrame, Column]:
    block = F.format_string("Page %d:\nURL: %s\nContent: %s", F.col("_i"), F.col("url"),
                            F.substring(F.coalesce(F.col("content_text"), F.lit("")), 1, budget))
    return positions(pages, "_i"), block


def section_request_parts(pages: DataFrame, budget: int = SECTION_CONTENT_BUDGET, pages_per_part: int = 50) -> DataFrame:
    """F1 as ordered parts of at most ``pages_per_part`` pages: request_id, part, pages_block, n_pages.

    The parts joined by a blank line are the request's ``pages_block``.
    """
    numbered, block = _request_blocks(pages, budget)
    part = F.floor((F.col("_i") - 1) / F.lit(pages_per_part)).cast("int")
    return (numbered.withColumn("part", part).groupBy("site", "section", "part")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), block.alias("b")))).alias("_b"),
                 F.count(F.lit(1)).alias("n_pages"))
            .select(section_request_id("site", "section").alias("request_id"), "part",
                    F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("pages_block"), "n_pages"))


_ENTRY = T.MapType(T.StringType(), T.StringType())


def parse_section_replies(replies: DataFrame) -> DataFrame:
    """``replies(request_id, reply, error)`` -> one row per replied url.

    An empty reply reads as ``{}``.  A request fails when the call failed,
    the reply is not a JSON object, or ``pages`` is JSON null.  Entries
    without ``url`` are ignored; duplicate urls: the last entry wins.
    Output: request_id, request_failed, url, has_title, r_title,
    has_description, r_description (present-but-null fields are judged in F3/F4).
    """
    rp = F.coalesce(F.nullif(F.col("reply"), F.lit("")), F.lit("{}"))
    top = F.from_json(rp, T.MapType(T.StringType(), T.StringType()))
    staged = replies.withColumn("_m", top).withColumn("_rp", rp)
    is_obj = F.col("_m").isNotNull() & F.col("_rp").rlike(r"^\s*\{")
    pages_null = F.map_contains_key(F.col("_m"), "pages") & F.col("_m")["pages"].isNull()
    ok = F.col("error").isNull() & is_obj & ~F.coalesce(pages_null, F.lit(False))
    staged = staged.withColumn("request_failed", ~F.coalesce(ok, F.lit(False)))
    pages_txt = F.col("_m")["pages"]
    arr = F.when(F.coalesce(pages_txt.rlike(r"^\s*\["), F.lit(False)),
                 F.from_json(pages_txt, T.ArrayType(_ENTRY)))
    failed = staged.select("request_id", "request_failed")
    entries = (staged.filter(~F.col("request_failed"))
               .select("request_id", F.posexplode(F.coalesce(arr, F.array().cast(T.ArrayType(_ENTRY))))
                       .alias("pos", "e"))
               .filter(F.col("e").isNotNull() & F.map_contains_key("e", "url") & F.col("e")["url"].isNotNull()))
    last = (entries.groupBy("request_id", F.col("e")["url"].alias("url"))
            .agg(F.max_by("e", "pos").alias("e")))
    out = last.select("request_id", "url",
                      F.map_contains_key("e", "title").alias("has_title"), F.col("e")["title"].alias("r_title"),
                      F.map_contains_key("e", "description").alias("has_description"),
                      F.col("e")["description"].alias("r_description"))
    return out.join(failed, "request_id", "right").select(
        "request_id", "request_failed", "url", "has_title", "r_title", "has_description", "r_description")


def merge_enhanced(pages: DataFrame, parsed: DataFrame | None) -> DataFrame:
    """F3 + F4: enhanced title/description per page, page order kept.

    Matched url: reply title (absent -> page title or 'Untitled'), reply
    description (absent -> '').  Unmatched: title, og title, 'Untitled';
    description, og description, ''.  Any failure in a section (call/parse
    error, or a present-but-null field of a matched entry) sends the whole
    section to the fallback.
    """
    fb_title = F.coalesce(_blank(F.col("title")), _blank(F.col("og_title")), F.lit(UNTITLED))
    fb_desc = F.coalesce(_blank(F.col("description")), _blank(F.col("og_description")), F.lit(""))
    if parsed is None:
        return (pages.withColumn("title", fb_title).withColumn("description", fb_desc)
                .withColumn("source", F.lit("fallback")))
    req = section_request_id("site", "section")
    per_req = parsed.select("request_id", "request_failed").distinct()
    matched = parsed.filter(F.col("url").isNotNull()).drop("request_failed")
    j = (pages.withColumn("request_id", req)
         .join(per_req, "request_id", "left")
         .join(matched, ["request_id", "url"], "left"))
    hit = F.col("has_title").isNotNull()
    bad_entry = hit & ((F.col("has_title") & F.col("r_title").isNull())
                       | (F.col("has_description") & F.col("r_description").isNull()))
    # one failing entry fails the section: an aggregate joined back, not a window
    bad = (j.groupBy("site", "section").agg(F.max(bad_entry.cast("int")).cast("boolean").alias("_any_bad")))
    j = j.join(bad, ["site", "section"])
    section_bad = F.coalesce(F.col("request_failed"), F.lit(True)) | F.coalesce(F.col("_any_bad"), F.lit(False))
    m_title = F.when(F.col("has_title"), F.col("r_title")).otherwise(
        F.coalesce(_blank(F.col("title")), F.lit(UNTITLED)))
    m_desc = F.when(F.col("has_description"), F.col("r_description")).otherwise(F.lit(""))
    return (j.withColumn("_bad", section_bad)
            .withColumn("source", F.when(F.col("_bad"), F.lit("fallback")).otherwise(F.lit("model")))
            .withColumn("_t", F.when(~F.col("_bad") & hit, m_title).otherwise(fb_title))
            .withColumn("_d", F.when(~F.col("_bad") & hit, m_desc).otherwise(fb_desc))
            .drop("title", "description", "request_id", "request_failed", "has_title", "r_title",
                  "has_description", "r_description", "_bad", "_any_bad")
            .withColumnRenamed("_t", "title").withColumnRenamed("_d", "description"))


def clean_requests(pages: DataFrame, cap: int = CLEAN_CONTENT_CAP) -> DataFrame:
    """one cleaning request per page with content (error-free pages;
    excluded-by-path pages are cleaned too), content cut at ``cap``."""
    title = F.coalesce(_blank(F.col("title")), _blank(F.col("og_title")), F.lit(UNTITLED))
    return (pages.filter(F.col("error").isNull() & (F.coalesce(F.col("content_text"), F.lit("")) != ""))
            .select(F.col("url").alias("request_id"), "site", "url", title.alias("title"),
                    F.substring("content_text", 1, cap).alias("content"),
                    F.col("content_text").alias("raw_content")))


def cleaned_from_replies(requests: DataFrame, replies: DataFrame | None) -> DataFrame:
    """F6 + F7 input: cleaned text per url; failed call -> raw content."""
    if replies is None:
        return requests.select("site", "url", F.col("raw_content").alias("cleaned"))
    j = requests.join(replies, "request_id", "left")
    cleaned = F.when(F.col("reply").isNull() & F.col("error").isNotNull(), F.col("raw_content")) \
        .otherwise(tx.strip_fence(F.col("reply"), F.col("raw_content")))
    return j.select("site", "url", cleaned.alias("cleaned"))


def attach_cleaned(enhanced: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """content of enhanced pages = cleaned text by url (no cleaned text -> NULL;
    a failed cleaning call already fell back to the raw content)."""
    if cleaned is None:
        return enhanced
    return (enhanced.join(cleaned, ["site", "url"], "left")
            .withColumn("content_text", F.col("cleaned")).drop("cleaned"))


def pick_homepage(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """F8: homepage choice and fallback description per site.

    First page equal to the seed (trailing '/' stripped); if none or its
    content is empty, the first page with content; its description (or og
    description) is the fallback.  With no content anywhere the homepage's
    own description stays.  Only ``(rank, has content, description)``
    travels through the per-site aggregate; the content itself is joined
    back for the one chosen page when a summary request is built.
    """
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    p = pages.join(seeds, "site")
    is_home = strip(F.col("url")) == strip(F.col("seed_url"))
    has_content = F.coalesce(F.col("content_text"), F.lit("")) != ""
    desc = F.coalesce(_blank(F.col("description")), _blank(F.col("og_description")))
    agg = p.groupBy("site", "seed_url").agg(
        F.min_by(F.struct(has_content.alias("c"), desc.alias("d"), F.col("rank").alias("r")),
                 F.when(is_home, F.col("rank"))).alias("home"),
        F.min_by(F.struct(desc.alias("d"), F.col("rank").alias("r")),
                 F.when(has_content, F.col("rank"))).alias("first"))
    use_first = (F.col("home").isNull() | ~F.col("home.c")) & F.col("first").isNotNull()
    return agg.select(
        "site", "seed_url",
        F.when(use_first, F.col("first.r")).otherwise(F.col("home.r")).alias("homepage_rank"),
        (use_first | F.coalesce(F.col("home.c"), F.lit(False))).alias("has_homepage_content"),
        F.when(use_first, F.col("first.d")).otherwise(F.col("home.d")).alias("fallback_description"))


def summary_requests(home: DataFrame, pages: DataFrame, names: DataFrame, cap: int = CLEAN_CONTENT_CAP) -> DataFrame:
    """F9 request side: one request per site with homepage content (cut at ``cap``).

    ``names(site, name)``; the content of the single chosen page is joined
    back by ``(site, rank)``.
    """
    h = home.filter(F.col("has_homepage_content")).join(names, "site")
    content = pages.select("site", F.col("rank").alias("homepage_rank"), "content_text")
    return (h.join(content, ["site", "homepage_rank"])
            .select(F.col("site").alias("request_id"), "site", F.col("seed_url").alias("url"), "name",
                    F.substring("content_text", 1, cap).alias("content")))


_SUMMARY = T.StructType([T.StructField("description", T.StringType()),
                         T.StructField("notes", T.StringType())])


def site_info(home: DataFrame, replies: DataFrame | None) -> DataFrame:
    """description and notes from the summary reply; failure or no
    content -> fallback description, no notes.  ``notes`` must be a JSON
    list; non-blank strings kept; empty -> NULL."""
    base = home.select("site", "seed_url", "has_homepage_content", "fallback_description")
    if replies is None:
        return base.select("site", "seed_url", F.col("fallback_description").alias("description"),
                           F.lit(None).cast("array<string>").alias("notes"),
                           F.lit("fallback").alias("source"))
    j = base.join(replies.withColumnRenamed("request_id", "site"), "site", "left")
    p = F.from_json(F.col("reply"), _SUMMARY)
    ok = F.col("has_homepage_content") & F.col("error").isNull() & p.isNotNull() \
        & F.col("reply").rlike(r"^\s*\{")
    raw_notes = F.from_json(p["notes"], "array<string>")
    notes_ok = F.coalesce(p["notes"], F.lit("")).rlike(r"^\s*\[")
    notes = F.filter(F.when(notes_ok, raw_notes), lambda n: n.isNotNull() & (tx.py_strip(n) != ""))
    notes = F.when(F.size(notes) > 0, notes)
    return j.select("site", "seed_url",
                    F.when(ok, p["description"]).otherwise(F.col("fallback_description")).alias("description"),
                    F.when(ok, notes).alias("notes"),
                    F.when(ok, F.lit("model")).otherwise(F.lit("fallback")).alias("source"))


def merge_polished(docs: DataFrame, replies: DataFrame | None) -> DataFrame:
    """polished text when the call succeeded, else the unpolished doc."""
    if replies is None:
        return docs
    j = docs.join(replies.withColumnRenamed("request_id", "site"), "site", "left")
    good = F.col("reply").isNotNull() & F.col("error").isNull()
    return j.select("site", F.when(good, tx.strip_fence(F.col("reply"), F.col("doc"), add_newline=True))
                    .otherwise(F.col("doc")).alias("doc"))


INFERENCE_SCHEMA = "request_id string, reply string, error string"


def run_inference(requests: DataFrame, fn: Callable[[dict], str], parallelism: int,
                  prompt_cols: list[str] | None = None) -> DataFrame:
    """apply a user callable to every request row.

    ``parallelism`` partitions bound the number of concurrent calls (the
    reference ran 1 thread per section, 5 for cleaning).  A failing call is
    captured per row in ``error``; the stage never fails as a whole.
    """
    cols = ["request_id"] + (prompt_cols or [c for c in requests.columns if c != "request_id"])

    def apply(batches):
        for pdf in batches:
            replies, errors = [], []
            for rec in pdf.to_dict("records"):
                try:
                    replies.append(fn(rec))
                    errors.append(None)
                except Exception as exc:  # captured per request
                    replies.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}"[:500])
            yield pd.DataFrame({"request_id": pdf["request_id"], "reply": replies, "error": errors})

    return (requests.select(*cols).repartition(parallelism, "request_id")
            .mapInPandas(apply, INFERENCE_SCHEMA))
