"""robots.txt rules (C1) as a line machine inside the row.

A body is split into its lines and folded: the state is whether the last
``User-agent`` line applies to us, the sitemap lines (global) and, while it
applies, the disallowed paths and the first valid crawl delay.  One row in,
one row out: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Python ``str.splitlines`` boundaries.
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SITEMAP_RE = r"(?iU)^Sitemap:\s*(.+)$"
AGENT_RE = r"(?iU)^User-agent:\s*(.+)$"
DISALLOW_RE = r"(?iU)^Disallow:\s*(.*)$"
DELAY_RE = r"(?iU)^Crawl-delay:\s*(\d+\.?\d*)$"


def parse_robots(robots: DataFrame, agent: str, keys=("site",)) -> DataFrame:
    """``robots(keys..., body)`` -> ``keys, sitemap_urls, crawl_delay, disallowed_paths``.

    ``agent`` is our own bot token (lower case); ``*`` always applies.  Each
    ``User-agent`` line overwrites the decision, so for stacked agents only
    the last one counts.  Blank and comment lines are skipped, inline comments
    are not stripped.
    """
    texts = F.array().cast("array<string>")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("body"), F.lit("")), LINE_BREAKS), py_strip),
                     lambda ln: (ln != "") & ~ln.startswith("#"))

    def value(ln, rx):
        return F.when(ln.rlike(rx), py_strip(F.regexp_extract(ln, rx, 1)))

    read = F.transform(lines, lambda ln: F.struct(
        value(ln, SITEMAP_RE).alias("sitemap"), F.lower(value(ln, AGENT_RE)).alias("agent"),
        value(ln, DISALLOW_RE).alias("path"), value(ln, DELAY_RE).cast("double").alias("delay")))

    def step(state, ln):
        def add(name, item, when):
            return F.when(when & (item != ""), F.concat(state[name], F.array(item))).otherwise(state[name]).alias(name)

        is_sitemap, is_agent = ln["sitemap"].isNotNull(), ln["agent"].isNotNull()
        rule = state["applies"] & ~is_sitemap & ~is_agent
        return F.struct(
            F.when(is_agent & ~is_sitemap, ln["agent"].isin("*", agent.lower())).otherwise(state["applies"]).alias("applies"),
            add("sitemaps", ln["sitemap"], is_sitemap), add("paths", ln["path"], rule),
            F.when(rule & ln["path"].isNull() & state["delay"].isNull(), ln["delay"]).otherwise(state["delay"]).alias("delay"))

    start = F.struct(F.lit(False).alias("applies"), texts.alias("sitemaps"), texts.alias("paths"),
                     F.lit(None).cast("double").alias("delay"))
    found = robots.select(*keys, read.alias("_lines")).select(*keys, F.aggregate("_lines", start, step).alias("_r"))
    return found.select(*keys, F.col("_r.sitemaps").alias("sitemap_urls"), F.col("_r.delay").alias("crawl_delay"),
                        F.col("_r.paths").alias("disallowed_paths"))


def robots_for(sites: DataFrame, robots: DataFrame, agent: str, keys=("site",)) -> DataFrame:
    """A2 + C1: every key of ``sites`` gets a result; a missing body -> empty result."""
    parsed = parse_robots(robots, agent, keys)
    empty = F.array().cast("array<string>")
    return (sites.select(*keys).distinct().join(parsed, list(keys), "left")
            .select(*keys, F.coalesce("sitemap_urls", empty).alias("sitemap_urls"), "crawl_delay",
                    F.coalesce("disallowed_paths", empty).alias("disallowed_paths")))
