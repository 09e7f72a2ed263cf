"""Categorization of pages into sections.

Rules are data.  A list of ``Rule`` (name, patterns, priority) that holds for
all sites compiles into one ``CASE WHEN path RLIKE ...`` in priority order, so
matching is a pure projection (no join, no shuffle).  A *table* of rules by
site is indexed by the literal words that its patterns begin with, so a path
meets only the rules of its site of which it holds the first word
(``match_rules``).  Consolidation (E4) is an aggregate by ``(site, section)``
joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[str, ...]
    priority: int = 0


# Default section rules (segment patterns on the lower-cased path).
DEFAULT_RULES = (
    Rule("Documentation", (r"/docs?(/|$)", r"/documentation(/|$)", r"/manual(/|$)"), 10),
    Rule("API Reference", (r"/api(/|$)", r"/reference(/|$)", r"/sdk(/|$)", r"/endpoints?(/|$)"), 9),
    Rule("Guides", (r"/guides?(/|$)", r"/tutorials?(/|$)", r"/learn(/|$)", r"/how-to(/|$)",
                    r"/getting-started(/|$)"), 8),
    Rule("Blog", (r"/blog(/|$)", r"/posts?(/|$)", r"/articles?(/|$)", r"/news(/|$)"), 7),
    Rule("Features", (r"/features?(/|$)", r"/products?(/|$)", r"/solutions?(/|$)",
                      r"/platform(/|$)", r"/capabilities(/|$)"), 6),
    Rule("About", (r"/about(/|$)", r"/team(/|$)", r"/careers?(/|$)", r"/contact(/|$)",
                   r"/company(/|$)", r"/customers?(/|$)", r"/case-stud(y|ies)(/|$)"), 5),
    Rule("Resources", (r"/resources?(/|$)", r"/research(/|$)", r"/reports?(/|$)",
                       r"/webinars?(/|$)", r"/events?(/|$)", r"/whitepapers?(/|$)"), 4),
    Rule("Pricing", (r"/pricing(/|$)", r"/plans?(/|$)"), 3),
    Rule("Optional", (r"/legal(/|$)", r"/privacy[-_]?policy(/|$)", r"/privacy(/|$)",
                      r"/terms[-_]?(of[-_]?service|of[-_]?use)?(/|$)", r"/cookies?[-_]?policy(/|$)",
                      r"/cookies?(/|$)", r"/tos(/|$)", r"/disclaimer(/|$)", r"/gdpr(/|$)",
                      r"/imprint(/|$)", r"/accessibility(/|$)"), 1),
)
# Auth / utility paths excluded from every document.
EXCLUDE_PATTERNS = (r"/login(/|$)", r"/signin(/|$)", r"/sign-in(/|$)", r"/signup(/|$)",
                    r"/sign-up(/|$)", r"/register(/|$)", r"/auth(/|$)", r"/welcome(/|$)",
                    r"/password[-_]?reset(/|$)", r"/forgot[-_]?password(/|$)",
                    r"/unsubscribe(/|$)", r"/404(/|$)", r"/error(/|$)")
CATCH_ALL = "Pages"
OPTIONAL = "Optional"
MIN_SECTION_SIZE = 2

EXCLUDE_RE = "(?iu)(" + "|".join(EXCLUDE_PATTERNS) + ")"


def rule_regex(rule: Rule) -> str:
    return "(?iu)(" + "|".join(rule.patterns) + ")"


def _ordered(rules) -> list[Rule]:
    # stable sort by descending priority keeps list order among equals
    return sorted(rules, key=lambda r: -r.priority)


def lower_path(url) -> Column:
    return F.lower(U.url_path(url))


def fallback_section(path) -> Column:
    """First non-empty segment, '-'/'_' -> space, Python title case; none -> Pages."""
    p = F.col(path) if isinstance(path, str) else path
    first = F.regexp_extract(p, r"^/*([^/]+)", 1)
    name = U.python_title(F.translate(first, "-_", "  "))
    return F.when(first == "", F.lit(CATCH_ALL)).otherwise(name)


def match_section(url, rules=DEFAULT_RULES, path=None) -> Column:
    """E2 + E3: rule section in priority order, else the fallback name.

    ``path`` may be a precomputed lower-cased path column (computed once
    instead of once per rule branch).
    """
    path = lower_path(url) if path is None else path
    expr = None
    for rule in _ordered(rules):
        cond = path.rlike(rule_regex(rule))
        expr = F.when(cond, F.lit(rule.name)) if expr is None else expr.when(cond, F.lit(rule.name))
    fb = fallback_section(path)
    return fb if expr is None else expr.otherwise(fb)


def is_excluded(url) -> Column:
    return lower_path(url).rlike(EXCLUDE_RE)


def drop_excluded(pages: DataFrame) -> DataFrame:
    """Error rows and auth/utility paths are removed."""
    err = F.col("error").isNull() if "error" in pages.columns else F.lit(True)
    staged = pages.withColumn("_lpath", lower_path(F.col("url")))
    return staged.filter(err & ~F.col("_lpath").rlike(EXCLUDE_RE)).drop("_lpath")


def with_section(pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Add ``section`` (raw, before consolidation)."""
    staged = pages.withColumn("_lpath", lower_path(F.col("url")))
    return staged.withColumn("section", match_section(F.col("url"), rules, F.col("_lpath"))).drop("_lpath")


#: What a path must hold after a slash for the pattern to match: letters and the like that no quantifier follows.
_LITERAL = r"^/((?:[A-Za-z0-9_~%-](?![?*{+]))*)"


def rule_word(pattern) -> Column:
    """Literal text, lower-cased, that begins a segment of every path the pattern matches; '' if it names none.

    Only patterns that begin with a slash and have no alternative outside
    brackets name one.
    """
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    bare = F.regexp_replace(p, r"\\.", "")  # escaped characters
    for _ in range(3):  # brackets in brackets
        bare = F.regexp_replace(bare, r"\([^()]*\)|\[[^\]]*\]", "")
    plain = ~bare.contains("|") & ~bare.contains("(") & ~p.contains("\\Q")
    return F.when(plain, F.lower(F.regexp_extract(p, _LITERAL, 1))).otherwise(F.lit(""))


def rule_index(rules: DataFrame) -> DataFrame:
    """(site, word, pattern, rank, name) from ``rules(site, name, pattern, priority, position)``.

    Rules are tried by descending priority, equal ones in order of position.
    """
    rank = F.struct((-F.coalesce("priority", F.lit(0))).alias("priority"), "position", "name")
    return rules.where("site IS NOT NULL AND pattern IS NOT NULL AND name IS NOT NULL") \
        .select("site", rule_word("pattern").alias("word"), "pattern", rank.alias("rank"))


#: Rules of a site and word that travel in one row.
RULES_A_ROW = 256


def rule_rows(rules: DataFrame, most: int = RULES_A_ROW) -> DataFrame:
    """(site, word, rules): the index in rows of about ``most`` rules ``struct(rank, pattern)``.

    Of rules of a site with the same pattern only the first can win, so the
    others are left out.
    """
    index = rule_index(rules).groupBy("site", "word", "pattern").agg(F.min("rank").alias("rank"))
    sizes = index.groupBy("site", "word").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("_rows"))
    dealt = index.join(sizes, ["site", "word"]).withColumn("_row", F.expr("pmod(xxhash64(pattern), _rows)"))
    return dealt.groupBy("site", "word", "_row").agg(F.collect_list(F.struct("rank", "pattern")).alias("rules")).drop("_row")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, path, section): the first of its site's rules that matches each distinct lower-cased path.

    ``pages(site, path)``.  A segment of the path expands into its beginnings
    of the lengths that occur among its site's words and meets the rules by
    ``(site, word)``; patterns that name no word are tried on every path of
    their site.  Rules come many to a row and are tried inside it, so what is
    sorted and sent is a row per path and word, not one per path and rule.
    Paths that no rule matches have no row.
    """
    index = rule_rows(rules)
    lengths = index.select("site", F.length("word").alias("_n")).distinct()
    paths = pages.select("site", "path").where("path IS NOT NULL").distinct()
    segments = F.array_distinct(F.concat(F.array(F.lit("")), F.slice(F.split("path", "/"), 2, 1 << 20)))
    words = paths.join(lengths, "site") \
        .withColumn("word", F.explode(F.array_distinct(F.transform(segments, lambda s: F.substring(s, F.lit(1), F.col("_n")))))) \
        .where(F.length("word") == F.col("_n"))
    met = words.select("site", "path", "word").join(index, ["site", "word"])
    first = F.expr("array_min(filter(rules, r -> path RLIKE concat('(?iu)', r.pattern))).rank")
    hit = met.select("site", "path", first.alias("rank")).where("rank IS NOT NULL")
    return hit.groupBy("site", "path").agg(F.min("rank").alias("rank")).select("site", "path", F.col("rank.name").alias("section"))


def with_site_sections(pages: DataFrame, rules: DataFrame, default=DEFAULT_RULES) -> DataFrame:
    """E2 with a rules table: ``section`` and ``is_rule`` (a rule of the page's site bears that name).

    Sites that have rules of their own use these alone, the others ``default``.
    """
    staged = pages.withColumn("path", lower_path(F.col("url")))
    own = rules.select("site").where("site IS NOT NULL").distinct().withColumn("_own", F.lit(True))
    names = rules.select("site", F.col("name").alias("section")).where("site IS NOT NULL AND section IS NOT NULL") \
        .distinct().withColumn("_named", F.lit(True))
    found = match_rules(staged, rules).withColumnRenamed("section", "_found")
    joined = staged.join(found, ["site", "path"], "left").join(own, "site", "left")
    section = F.coalesce("_found", F.when(F.col("_own"), fallback_section("path")).otherwise(match_section(None, default, F.col("path"))))
    named = joined.withColumn("section", section).join(names, ["site", "section"], "left")
    is_rule = F.when(F.col("_own"), F.coalesce("_named", F.lit(False))).otherwise(F.col("section").isin([r.name for r in default]))
    return named.withColumn("is_rule", is_rule).drop("path", "_found", "_own", "_named")


def consolidate(pages: DataFrame, rules=DEFAULT_RULES, min_size: int = MIN_SECTION_SIZE) -> DataFrame:
    """Small non-rule sections move to ``Pages``.

    A column ``is_rule`` says which sections are rules'; else the names of ``rules`` do.

    Input: ``site, rank, section, ...``.  Output adds ``section`` (final) and
    ``sec_order`` = (moved, first rank of the original section, rank), the
    order of pages inside the final section.
    """
    names = [r.name for r in rules]
    # per-section size and first rank as an aggregate joined back (not a window):
    # partial aggregation, and AQE can split a hot section's join partition
    stats = pages.groupBy("site", "section").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    staged = pages.join(stats, ["site", "section"])
    is_rule = F.col("is_rule") if "is_rule" in pages.columns else F.col("section").isin(names)
    moved = ~is_rule & (F.col("_n") < min_size)
    return (staged
            .withColumn("_moved", moved)
            .withColumn("section", F.when(moved, F.lit(CATCH_ALL)).otherwise(F.col("section")))
            .withColumn("sec_order", F.struct(F.col("_moved").cast("int").alias("moved"),
                                              F.when(F.col("_moved"), F.col("_first"))
                                              .otherwise(F.lit(0)).alias("first"),
                                              F.col("rank").alias("rank")))
            .drop("_n", "_first", "_moved"))


def categorize(pages: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Excluded rows dropped, final section and in-section order added."""
    return consolidate(with_section(drop_excluded(pages), rules), rules)


def section_sizes(categorized: DataFrame) -> DataFrame:
    """E5: pages per final section."""
    return categorized.groupBy("site", "section").agg(F.count(F.lit(1)).alias("n_pages"))
