"""Assembly of per-site documents.

The index keeps ``k`` entries per section, so its collects are bounded by the
sections of a site.  Whatever grows with a site comes as rows: entries with
their position (``section_entries``), full text as ordered parts of a bounded
number of pages (``full_parts``).  ``build_sections`` without ``k`` and
``build_full`` put a whole site into one value; they are for sites that the
caller knows to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_by

# Preferred section order; others follow A-Z, Optional last.
PREFERRED_ORDER = ["Documentation", "API Reference", "Guides", "Features", "Blog",
                   "Resources", "About", "Pricing", "Pages"]
OPTIONAL = "Optional"
NO_CONTENT = "(No content available)"
UNTITLED = "Untitled"
COST_PER_CALL_MICRO_USD = 500  # 0.0005 USD


def section_sort_key(section) -> Column:
    """G1: struct(class, preferred position, name) giving the section order."""
    s = F.col(section) if isinstance(section, str) else section
    pref = F.array_position(F.array(*[F.lit(n) for n in PREFERRED_ORDER]), s)
    cls = F.when(pref > 0, 0).when(s == OPTIONAL, 2).otherwise(1)
    return F.struct(cls.alias("cls"), pref.cast("int").alias("pref"),
                    F.encode(s, "UTF-8").alias("name"))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_fields(pages: DataFrame) -> DataFrame:
    """title/description for raw (not enhanced) pages."""
    last_seg = F.element_at(F.split(F.col("url"), "/"), -1)
    return (pages
            .withColumn("title", F.coalesce(_blank(F.col("title")), _blank(F.col("og_title")),
                                            _blank(last_seg), F.lit(UNTITLED)))
            .withColumn("description", F.coalesce(_blank(F.col("description")),
                                                  _blank(F.col("og_description")))))


def top_per_section(pages: DataFrame, k: int | None) -> DataFrame:
    """First ``k`` pages per (site, section) by ``sec_order``; None/0 = all."""
    if not k:
        return pages
    w = Window.partitionBy("site", "section").orderBy("sec_order")
    return pages.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def _header_lines(sites: DataFrame) -> DataFrame:
    """Header lines per site: '# name', '> description', '- note' each + blanks."""
    desc = _blank(F.col("description"))
    notes = F.coalesce(F.col("notes"), F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("# "), F.col("name")), F.lit("")),
        F.when(desc.isNotNull(), F.array(F.concat(F.lit("> "), desc), F.lit("")))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.size(notes) > 0,
               F.concat(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), F.array(F.lit(""))))
        .otherwise(F.array().cast("array<string>")))
    return sites.select("site", lines.alias("header"))


def _finish(text: Column) -> Column:
    # Python: "\n".join(lines).strip() + "\n"
    return F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def _entry_line(title: Column, url: Column, desc: Column) -> Column:
    d = _blank(desc)
    base = F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"))
    return F.when(d.isNotNull(), F.concat(base, F.lit(": "), d)).otherwise(base)


def _assemble(sites: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join per-site header lines with section blocks sorted by G1."""
    per_site = blocks.groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct(section_sort_key("section").alias("k"),
                                             F.col("block")))).alias("_blocks"))
    joined = _header_lines(sites).join(per_site, "site", "left")
    body = F.array_join(F.transform(F.coalesce(F.col("_blocks"), F.array()), lambda b: b["block"]), "\n")
    text = F.concat(F.array_join(F.col("header"), "\n"), F.lit("\n"), body)
    return joined.select("site", _finish(text).alias("doc"))


def build_index(sites: DataFrame, pages: DataFrame, k: int | None = 5) -> DataFrame:
    """One llms.txt index per site.

    ``sites``: site, name, description, notes.  ``pages``: site, section,
    sec_order, url, title, description (already display-ready).
    """
    top = top_per_section(pages, k)
    line = _entry_line(F.col("title"), F.col("url"), F.col("description"))
    blocks = (top.groupBy("site", "section")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("sec_order").alias("o"),
                                                         line.alias("l")))).alias("_e"))
              .select("site", "section",
                      F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"),
                               F.array_join(F.transform("_e", lambda e: e["l"]), "\n"),
                               F.lit("\n")).alias("block")))
    return _assemble(sites, blocks)


def build_sections(pages: DataFrame, k: int | None = 5) -> DataFrame:
    """Structured sections (nested array) with ``is_optional``, per site."""
    top = top_per_section(pages, k)
    entries = (top.groupBy("site", "section")
               .agg(F.array_sort(F.collect_list(F.struct(
                   F.col("sec_order").alias("o"),
                   F.struct(F.col("title"), F.col("url"), _blank(F.col("description")).alias("description"))
                   .alias("e")))).alias("_e"))
               .select("site", F.struct(section_sort_key("section").alias("k"),
                                        F.struct(F.col("section").alias("name"),
                                                 F.transform("_e", lambda e: e["e"]).alias("entries"),
                                                 (F.col("section") == OPTIONAL).alias("is_optional"))
                                        .alias("s")).alias("sec")))
    return entries.groupBy("site").agg(
        F.transform(F.array_sort(F.collect_list("sec")), lambda x: x["s"]).alias("sections"))


def positions(pages: DataFrame, out: str = "pos", chunk: int = 1 << 16) -> DataFrame:
    """``out`` = 1, 2, ... per (site, section) by ``sec_order``, without a task per section."""
    o = F.col("sec_order")
    lead = F.when(o["moved"] == 1, o["first"]).otherwise(o["rank"])
    step = F.struct(o["moved"].alias("m"), F.floor(lead / F.lit(chunk)).alias("c"))
    return number_by(pages, ["site", "section"], step, ["sec_order"], out)


def section_entries(pages: DataFrame) -> DataFrame:
    """G5 without a limit, as rows: every entry with its position in its section."""
    return positions(pages, "entry_pos").select(
        "site", "section", (F.col("section") == OPTIONAL).alias("is_optional"), "entry_pos", "title", "url",
        _blank(F.col("description")).alias("description"))


def _full_piece() -> Column:
    body = F.coalesce(_blank(F.col("content_text")), _blank(F.col("description")), F.lit(NO_CONTENT))
    return F.concat(F.lit("### "), F.col("title"), F.lit("\nSource: "), F.col("url"), F.lit("\n\n"), body,
                    F.lit("\n\n---\n"))


def full_parts(pages: DataFrame, pages_per_part: int = 50) -> DataFrame:
    """G6 as ordered parts ``(site, section, part, text)`` of at most ``pages_per_part`` pages.

    The parts of a section, joined by a line feed, are its block of the full
    document; the first one carries the heading.
    """
    numbered = positions(pages).withColumn("part", F.floor((F.col("pos") - 1) / F.lit(pages_per_part)).cast("int"))
    parts = numbered.groupBy("site", "section", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", _full_piece().alias("piece")))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda x: x["piece"]), "\n")
    head = F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"))
    return parts.select("site", "section", "part", F.when(F.col("part") == 0, F.concat(head, text)).otherwise(text).alias("text"))


def build_full(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """G6 as one text per (small) site: per page H3, source, content or description, rule."""
    piece = _full_piece()
    blocks = (pages.groupBy("site", "section")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("sec_order").alias("o"),
                                                         piece.alias("l")))).alias("_e"))
              .select("site", "section",
                      F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"),
                               F.array_join(F.transform("_e", lambda e: e["l"]), "\n"),
                               F.lit("\n")).alias("block")))
    return _assemble(sites, blocks)


def run_metrics(extracted: DataFrame, categorized: DataFrame, cleaned: DataFrame | None,
                mode: str = "default") -> DataFrame:
    """Per-site page counts, model calls and cost.

    calls = non-empty sections + 1 summary + (cleaned pages in detailed mode,
    else 1 polish, counted even when polishing failed); cost in micro-USD and
    USD from one integer multiplication.
    """
    pages = extracted.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.col("error").isNull()).alias("pages_processed"),
        F.count_if(F.col("error").isNotNull()).alias("pages_failed"))
    secs = categorized.groupBy("site").agg(F.countDistinct("section").alias("n_sections"))
    out = pages.join(secs, "site", "left").fillna(0, ["n_sections"])
    if mode == "detailed":
        cl = cleaned.groupBy("site").agg(F.count(F.lit(1)).alias("n_cleaned"))
        out = out.join(cl, "site", "left").fillna(0, ["n_cleaned"])
        extra = F.col("n_cleaned")
    else:
        extra = F.lit(1)
    calls = (F.col("n_sections") + 1 + extra).cast("bigint")
    return (out.withColumn("llm_calls_made", calls)
            .withColumn("llm_cost_usd", calls * COST_PER_CALL_MICRO_USD / 1e6)
            .select("site", F.col("total_pages").cast("bigint"), F.col("pages_processed").cast("bigint"),
                    F.col("pages_failed").cast("bigint"), "llm_calls_made", "llm_cost_usd"))
