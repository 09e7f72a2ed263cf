"""Discovery queries (A2, C1-C10) over inputs derived from ``pages``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import extract as X
from ..operators import reuse as RU
from ..operators import robots as R
from ..operators import sitemaps as SM
from ..session import table
from ..sources import derived as D
from ..streaming.arrivals import shared_folder
from . import oracle as O
from .q_pages import SHELL_PAGES
from .q_urls import PAGE_LINKS_SQL
from .registry import derive, derive_sql, lines_text, register

AGENT = "tidebot"
KEYS = ("site", "page_id")
BASE_TS = "2024-01-01 00:00:00"
AS_OF = "2024-01-01 03:00:00"
LATER_TS = "2024-01-01 00:30:00"  # within the time to live of what was parsed at BASE_TS


# -- robots ---------------------------------------------------------------------
def _robots(spark, sf) -> DataFrame:
    return derive(spark, sf, "pages", D.ROBOTS).filter(F.col("body").isNotNull())


_LB = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
_SM_RE = O.q(r"(?i)^sitemap:\s*(.+)$")
_UA_RE = O.q(r"(?i)^user-agent:\s*(.+)$")
_DIS_RE = O.q(r"(?i)^disallow:\s*(.*)$")
_DEL_RE = O.q(r"(?i)^crawl-delay:\s*(\d+\.?\d*)$")
_RULE = "applies AND NOT is_sm AND NOT is_agent"


def robots_sql(where_body: str = "body IS NOT NULL") -> str:
    return f"""
rb AS (SELECT * FROM ({derive_sql('pages', D.ROBOTS)}) WHERE {where_body}),
rl AS (SELECT site, page_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS raw
       FROM (SELECT site, page_id, string_split_regex(body, {_LB}) AS ls FROM rb)),
rs AS (SELECT site, page_id, pos, {O.py_strip('raw')} AS line FROM rl),
rf AS (SELECT *, regexp_matches(line, {_SM_RE}) AS is_sm FROM rs WHERE line <> '' AND NOT starts_with(line, '#')),
rk AS (SELECT *, NOT is_sm AND regexp_matches(line, {_UA_RE}) AS is_agent FROM rf),
ra AS (SELECT *, coalesce(last_value(CASE WHEN is_agent THEN lower({O.py_strip(f"regexp_extract(line, {_UA_RE}, 1)")}) IN ('*', '{AGENT}') END
                   IGNORE NULLS) OVER (PARTITION BY site, page_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS applies FROM rk),
rr AS (SELECT site, page_id,
  coalesce(array_to_string(list({O.py_strip(f"regexp_extract(line, {_SM_RE}, 1)")} ORDER BY pos) FILTER (WHERE is_sm), chr(10)), '') AS sitemap_urls,
  arg_min(TRY_CAST(regexp_extract(line, {_DEL_RE}, 1) AS DOUBLE), pos)
    FILTER (WHERE {_RULE} AND NOT regexp_matches(line, {_DIS_RE}) AND regexp_matches(line, {_DEL_RE})) AS crawl_delay,
  coalesce(array_to_string(list({O.py_strip(f"regexp_extract(line, {_DIS_RE}, 1)")} ORDER BY pos)
    FILTER (WHERE {_RULE} AND regexp_matches(line, {_DIS_RE}) AND {O.py_strip(f"regexp_extract(line, {_DIS_RE}, 1)")} <> ''), chr(10)), '') AS disallowed_paths
  FROM ra GROUP BY site, page_id)"""


@register("robots_rules", f"WITH {robots_sql()} SELECT * FROM rr")
def q_robots_rules(spark, sf):
    r = R.parse_robots(_robots(spark, sf), AGENT, KEYS)
    return r.select(*KEYS, lines_text("sitemap_urls").alias("sitemap_urls"), "crawl_delay",
                    lines_text("disallowed_paths").alias("disallowed_paths"))


@register("robots_missing", f"""WITH {robots_sql()},
k AS (SELECT {D.SITE} AS site, page_id FROM pages)
SELECT k.site, k.page_id, coalesce(rr.sitemap_urls, '') AS sitemap_urls, rr.crawl_delay,
       coalesce(rr.disallowed_paths, '') AS disallowed_paths
FROM k LEFT JOIN rr USING (site, page_id)""")
def q_robots_missing(spark, sf):
    keys = derive(spark, sf, "pages", [("site", D.SITE), ("page_id", "page_id")])
    r = R.robots_for(keys, _robots(spark, sf), AGENT, KEYS)
    return r.select(*KEYS, lines_text("sitemap_urls").alias("sitemap_urls"), "crawl_delay",
                    lines_text("disallowed_paths").alias("disallowed_paths"))


# -- sitemaps ---------------------------------------------------------------------
def _docs(spark, sf) -> DataFrame:
    """All documents of a page from one scan."""
    structs = []
    for kind in D.SITEMAP_DOCS:
        one = "named_struct(" + ", ".join(f"'{a}', {e}" for a, e in D.sitemap_doc_exprs(kind)) + ")"
        where = D.SITEMAP_DOC_WHERE.get(kind)
        structs.append(f"CASE WHEN {where} THEN {one} END" if where else one)
    docs = table(spark, sf, "pages").selectExpr(f"explode(array({', '.join(structs)})) AS d")
    return docs.filter("d IS NOT NULL").select("d.*")


def _docs_sql() -> str:
    return " UNION ALL ".join(derive_sql("pages", D.sitemap_doc_exprs(k), D.SITEMAP_DOC_WHERE.get(k))
                              for k in D.SITEMAP_DOCS)


def _xml_text(x: str) -> str:
    t = f"regexp_replace({x}, '<!\\[CDATA\\[|\\]\\]>', '', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        t = f"replace({t}, {O.q(ent)}, {O.q(ch)})"
    return f"replace({t}, '&amp;', '&')"


def sitemap_sql() -> str:
    loc = f"regexp_extract(blk, {O.q(SM.LOC_RE)}, 1)"
    pr = f"regexp_extract(blk, {O.q(SM.PRIORITY_RE)}, 1)"
    return f"""
docs AS ({_docs_sql()}),
bodies AS (SELECT sitemap_url, regexp_matches(body, {O.q(SM.INDEX_RE)}) AS idx FROM docs),
ub AS (SELECT sitemap_url, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS blk
       FROM (SELECT sitemap_url, regexp_extract_all(body, {O.q(SM.URL_BLOCK_RE)}, 1) AS b
             FROM docs WHERE NOT regexp_matches(body, {O.q(SM.INDEX_RE)}))),
ue AS (SELECT sitemap_url, pos,
         CASE WHEN regexp_matches(blk, {O.q(SM.LOC_RE)}) THEN {O.py_strip(_xml_text(loc))} END AS url,
         TRY_CAST(CASE WHEN regexp_matches(blk, {O.q(SM.PRIORITY_RE)}) THEN {O.py_strip(_xml_text(pr))} END AS DOUBLE) AS priority
       FROM ub),
urls AS (SELECT sitemap_url, row_number() OVER (PARTITION BY sitemap_url ORDER BY pos) - 1 AS pos, url, priority
         FROM ue WHERE starts_with(url, 'http://') OR starts_with(url, 'https://')),
kb AS (SELECT sitemap_url AS parent_url, generate_subscripts(b, 1) - 1 AS child_pos, unnest(b) AS blk
       FROM (SELECT sitemap_url, regexp_extract_all(body, {O.q(SM.SITEMAP_BLOCK_RE)}, 1) AS b
             FROM docs WHERE regexp_matches(body, {O.q(SM.INDEX_RE)}))),
kids AS (SELECT parent_url, child_pos, {O.py_strip(_xml_text(loc))} AS child_url FROM kb
         WHERE regexp_matches(blk, {O.q(SM.LOC_RE)}) AND {_xml_text(loc)} <> '')"""


def expand_sql(roots: str) -> str:
    k = "site, page_id, cand_pos"
    return f"""
roots AS ({roots}),
r0 AS (SELECT roots.*, bodies.idx FROM roots JOIN bodies USING (sitemap_url)),
e0 AS (SELECT {k}, [pos] AS ord, url, priority FROM r0 JOIN urls USING (sitemap_url) WHERE NOT idx),
c1 AS (SELECT {k}, child_pos AS p1, child_url AS u1 FROM r0 JOIN kids ON r0.sitemap_url = kids.parent_url WHERE r0.idx),
c1b AS (SELECT c1.*, b.idx FROM c1 LEFT JOIN bodies b ON c1.u1 = b.sitemap_url),
c2 AS (SELECT {k}, p1, child_pos AS p2, child_url AS u2 FROM c1b JOIN kids ON c1b.u1 = kids.parent_url WHERE c1b.idx),
e2 AS (SELECT {k}, p1, p2, pos, url, priority FROM c2 JOIN urls ON c2.u2 = urls.sitemap_url),
n2 AS (SELECT {k}, p1, p2, count(*) AS n FROM e2 GROUP BY ALL),
kept2 AS (SELECT {k}, p1, p2 FROM (
  SELECT c2.*, coalesce(sum(coalesce(n2.n, 0)) OVER (PARTITION BY c2.site, c2.page_id, c2.cand_pos, c2.p1 ORDER BY c2.p2
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c2 LEFT JOIN n2 USING ({k}, p1, p2)) WHERE before < {SM.MAX_ENTRIES}),
e2k AS (SELECT e2.* FROM e2 JOIN kept2 USING ({k}, p1, p2)),
e1 AS (SELECT {k}, p1, pos, url, priority FROM c1b JOIN urls ON c1b.u1 = urls.sitemap_url WHERE NOT c1b.idx),
n1 AS (SELECT {k}, p1, count(*) AS n FROM e1 GROUP BY ALL UNION ALL SELECT {k}, p1, count(*) AS n FROM e2k GROUP BY ALL),
kept1 AS (SELECT {k}, p1 FROM (
  SELECT c1.*, coalesce(sum(coalesce(n1.n, 0)) OVER (PARTITION BY c1.site, c1.page_id, c1.cand_pos ORDER BY c1.p1
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c1 LEFT JOIN n1 USING ({k}, p1)) WHERE before < {SM.MAX_ENTRIES}),
expanded AS (
  SELECT * FROM e0
  UNION ALL SELECT {k}, [p1, pos] AS ord, url, priority FROM e1 JOIN kept1 USING ({k}, p1)
  UNION ALL SELECT {k}, [p1, p2, pos] AS ord, url, priority FROM e2k JOIN kept1 USING ({k}, p1))"""


def _roots(spark, sf, cands) -> DataFrame:
    """The candidates of a page from one scan."""
    rows = ", ".join("named_struct(" + ", ".join(f"'{a}', {e}" for a, e in c) + ")" for c in cands)
    keys = [f"{e} AS {a}" for a, e in D.CANDIDATE_KEYS]
    return table(spark, sf, "pages").selectExpr(*keys, f"inline(array({rows}))") \
        .withColumn("cand_pos", F.col("cand_pos").cast("int"))


def _roots_sql(cands) -> str:
    return " UNION ALL ".join(derive_sql("pages", D.CANDIDATE_KEYS + c) for c in cands)


def _ord_text(c="ord"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",")


@register("sitemap_urls", f"WITH {sitemap_sql()} SELECT sitemap_url, pos, url, priority FROM urls")
def q_sitemap_urls(spark, sf):
    return SM.parse_urlsets(_docs(spark, sf)).select("sitemap_url", F.col("pos").cast("bigint").alias("pos"),
                                                     "url", "priority")


_INDEX_ROOT = [D.CANDIDATES[1]]


@register("sitemap_index", f"""WITH {sitemap_sql()}, {expand_sql(_roots_sql(_INDEX_ROOT))}
SELECT site, page_id, array_to_string(ord, ',') AS ord, url, priority FROM expanded""")
def q_sitemap_index(spark, sf):
    e = SM.expand_indexes(_docs(spark, sf), _roots(spark, sf, _INDEX_ROOT), KEYS)
    return e.select(*KEYS, _ord_text().alias("ord"), "url", "priority")


_FIRST_SQL = f"""WITH {sitemap_sql()}, {expand_sql(_roots_sql(D.CANDIDATES))},
firstc AS (SELECT site, page_id, min(cand_pos) AS cand_pos FROM expanded GROUP BY ALL),
chosen AS (SELECT e.*, r.sitemap_url AS source FROM expanded e JOIN firstc USING (site, page_id, cand_pos)
           JOIN roots r USING (site, page_id, cand_pos)),
allkeys AS (SELECT DISTINCT site, page_id FROM roots)"""


@register("sitemap_source", _FIRST_SQL + """
SELECT k.site, k.page_id, coalesce(c.source, 'sitemap') AS source, count(c.url) AS n_entries
FROM allkeys k LEFT JOIN chosen c USING (site, page_id) GROUP BY ALL""")
def q_sitemap_source(spark, sf):
    docs = _docs(spark, sf)
    cands = _roots(spark, sf, D.CANDIDATES)
    fs = SM.first_source(SM.expand_indexes(docs, cands, KEYS), cands, KEYS)
    return fs.groupBy(*KEYS, "source").agg(F.count("url").alias("n_entries"))


# -- C4 with the candidates that robots files list ---------------------------------
_BASES = D.CANDIDATE_KEYS + [("base_url", "url")]
_ROBOT_CANDS = f"""cand0 AS (SELECT b.site, b.page_id, coalesce(rr.sitemap_urls, '') AS listed,
    regexp_extract(b.base_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) AS root
  FROM ({derive_sql('pages', _BASES)}) b LEFT JOIN rr USING (site, page_id)),
candl AS (SELECT site, page_id, CASE WHEN listed <> '' THEN string_split(listed, chr(10))
    ELSE [root || '/sitemap.xml', root || '/sitemap_index.xml'] END AS l FROM cand0),
cands AS (SELECT site, page_id, generate_subscripts(l, 1) - 1 AS cand_pos, unnest(l) AS sitemap_url FROM candl)"""


@register("sitemap_robots", f"""WITH {robots_sql()}, {_ROBOT_CANDS}, {sitemap_sql()},
{expand_sql("SELECT site, page_id, cand_pos, sitemap_url FROM cands")},
firstc AS (SELECT site, page_id, min(cand_pos) AS cand_pos FROM expanded GROUP BY ALL),
chosen AS (SELECT e.*, r.sitemap_url AS source FROM expanded e JOIN firstc USING (site, page_id, cand_pos)
           JOIN roots r USING (site, page_id, cand_pos)),
allkeys AS (SELECT DISTINCT site, page_id FROM roots)
SELECT k.site, k.page_id, coalesce(c.source, 'sitemap') AS source, count(c.url) AS n_entries
FROM allkeys k LEFT JOIN chosen c USING (site, page_id) GROUP BY ALL""")
def q_sitemap_robots(spark, sf):
    parsed = R.parse_robots(_robots(spark, sf), AGENT, KEYS)
    cands = SM.sitemap_candidates(parsed, derive(spark, sf, "pages", _BASES), KEYS)
    fs = SM.first_source(SM.expand_indexes(_docs(spark, sf), cands, KEYS), cands, KEYS)
    return fs.groupBy(*KEYS, "source").agg(F.count("url").alias("n_entries"))


_DEDUP_SQL = _FIRST_SQL + f""",
dd AS (SELECT site, page_id, url, min(ord) AS ord, arg_max(priority, ord) AS priority FROM chosen GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY site, page_id ORDER BY ord) AS pos FROM dd)"""


@register("sitemap_dedup", _DEDUP_SQL + f"""
SELECT site, page_id, pos, url, priority FROM ranked WHERE pos <= {SM.MAX_ENTRIES}""")
def q_sitemap_dedup(spark, sf):
    return _dedup(spark, sf).select(*KEYS, F.col("pos").cast("bigint").alias("pos"), "url", "priority")


def _dedup(spark, sf):
    docs = _docs(spark, sf)
    cands = _roots(spark, sf, D.CANDIDATES)
    fs = SM.first_source(SM.expand_indexes(docs, cands, KEYS), cands, KEYS)
    return SM.dedup_entries(fs, KEYS)


# -- crawl -------------------------------------------------------------------------
_NODES = [("site", D.SITE), ("page_id", "page_id")]


def _graph(spark, sf):
    from ..operators.numbering import number_within

    nodes = number_within(derive(spark, sf, "pages", _NODES), "site", "page_id", "r")
    links = reduce(DataFrame.unionByName, [D.apply(nodes, e) for e in D.LINK_EXPRS]) \
        .withColumn("pos", F.col("pos").cast("int"))
    n = nodes.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    seeds = n.select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/n/1")).alias("seed_url"),
                     F.when(F.col("n") % 4 == 0, F.array(F.lit("/n/3"), F.lit("/n")))
                     .otherwise(F.array(F.lit("/n/3"))).alias("disallowed"))
    return seeds, links


def _graph_sql() -> str:
    links = " UNION ALL ".join(D.sql("nodes", e) for e in D.LINK_EXPRS)
    return f"""
nodes AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS r
          FROM ({derive_sql('pages', _NODES)})),
links AS ({links}),
seeds AS (SELECT site, 'https://' || site || '/n/1' AS url, count(*) AS n FROM nodes GROUP BY site),
dis AS (SELECT site, '/n/3' AS prefix FROM seeds UNION ALL SELECT site, '/n' FROM seeds WHERE n % 4 = 0)"""


def _skip_sql(t: str, host: str = "{t}.site") -> str:
    path = O.u_path(f"{t}.url")
    asset = O.q("(?i)[.](" + "|".join(U.ASSET_SUFFIXES) + ")$")
    acct = O.q("(?i)(" + "|".join(U.ACCOUNT_WORDS) + ")")
    return (f"({O.u_site(f'{t}.url')} <> {host.format(t=t)} OR regexp_matches({path}, {asset}) OR regexp_matches({path}, {acct}) "
            f"OR EXISTS (SELECT 1 FROM dis WHERE dis.site = {t}.site AND starts_with({path}, dis.prefix)))")


def crawl_levels_sql(depth: int, max_urls: str | int, host: str = "{t}.site") -> str:
    """The crawl level by level over ``seeds``, ``links`` and ``dis``; ``max_urls`` and ``host`` may be expressions."""
    def level(d: int) -> str:
        emitted = " UNION ALL ".join(f"SELECT site FROM l{i}_e" for i in range(d))
        popped = " UNION ALL ".join(f"SELECT site, url FROM l{i}_s" for i in range(d))
        return f"""
cv{d} AS ({popped}),
cn{d} AS (SELECT site, count(*) AS n FROM ({emitted}) GROUP BY site),
l{d}_c AS (SELECT e.site, e.rank AS parent_rank, l.pos, l.target AS url
           FROM l{d - 1}_e e JOIN links l ON l.url = e.url),
l{d}_m AS (SELECT site, url, min((parent_rank, pos)) AS o FROM l{d}_c c
           WHERE NOT EXISTS (SELECT 1 FROM cv{d} v WHERE v.site = c.site AND v.url = c.url) GROUP BY site, url),
l{d}_s AS (SELECT m.*, {_skip_sql('m', host)} AS skip FROM l{d}_m m),
l{d}_e AS (SELECT site, url, {d} AS depth, rank FROM (
  SELECT s.site, s.url, row_number() OVER (PARTITION BY s.site ORDER BY s.o, s.url) + coalesce(p.n, 0) AS rank
  FROM l{d}_s s LEFT JOIN cn{d} p USING (site) WHERE NOT s.skip) WHERE rank <= {max_urls})"""
    levels = ",".join(level(d) for d in range(1, depth + 1))
    return f"""l0_s AS (SELECT s.site, s.url, {_skip_sql('s', host)} AS skip FROM seeds s),
l0_e AS (SELECT site, url, 0 AS depth, 1 AS rank FROM l0_s WHERE NOT skip),{levels},
crawled AS ({" UNION ALL ".join(f"SELECT * FROM l{d}_e" for d in range(depth + 1))})"""


def crawl_sql(max_urls: int = 50, graph: str | None = None) -> str:
    return f"{graph or _graph_sql()},\n{crawl_levels_sql(2, max_urls)}"


def _crawl_out(out):
    return out.select("site", F.col("rank").cast("int").alias("rank"), "url", F.col("depth").cast("int").alias("depth"))


@register("crawl_graph", f"WITH {crawl_sql()} SELECT site, CAST(rank AS INT) AS rank, url, depth FROM crawled")
def q_crawl_graph(spark, sf):
    """A made-up deeper graph: several levels, skipped and repeated URLs."""
    seeds, links = _graph(spark, sf)
    return _crawl_out(C.crawl_links(seeds, links, max_depth=2, max_urls=50))


# the links of the pages themselves, from the first page of each site
def _site_graph(spark, sf):
    pages = table(spark, sf, "pages")
    links = C.page_links(X.extract_pages(pages.select("url", "html")), keys=()) \
        .withColumn("url", U.normalize_url(F.col("url")))
    sites = pages.select(U.site_key(F.col("url")).alias("site"), "page_id", "url")
    seeds = sites.groupBy("site").agg(F.min_by("url", "page_id").alias("seed_url")) \
        .withColumn("disallowed", F.array(F.lit("/an"), F.lit("/de")))
    return seeds, links


def norm_sql(u: str) -> str:
    path = f"regexp_replace({O.u_path(u)}, '/+$', '')"
    return (f"{O.u_scheme(u)} || '://' || {O.u_netloc(u)} || CASE WHEN {path} = '' THEN '/' ELSE {path} END "
            f"|| CASE WHEN {O.u_query(u)} <> '' THEN '?' || {O.u_query(u)} ELSE '' END")


_SITE_GRAPH_SQL = f"""pl AS ({PAGE_LINKS_SQL}),
links AS (SELECT {norm_sql('p.url')} AS url, pl.pos, pl.target FROM pl JOIN pages p USING (page_id)),
first_page AS (SELECT {O.u_site('url')} AS site, arg_min(url, page_id) AS first_url FROM pages GROUP BY 1),
seeds AS (SELECT site, {norm_sql('first_url')} AS url FROM first_page),
dis AS (SELECT site, '/an' AS prefix FROM seeds UNION ALL SELECT site, '/de' FROM seeds)"""


@register("crawl_bfs", f"WITH {crawl_sql(graph=_SITE_GRAPH_SQL)} SELECT site, CAST(rank AS INT) AS rank, url, depth FROM crawled")
def q_crawl_bfs(spark, sf):
    return _crawl_out(C.crawl_links(*_site_graph(spark, sf), max_depth=2, max_urls=50))


# a limit that bites: three pages per site
@register("crawl_capped", f"WITH {crawl_sql(3, _SITE_GRAPH_SQL)} SELECT site, CAST(rank AS INT) AS rank, url, depth FROM crawled")
def q_crawl_capped(spark, sf):
    return _crawl_out(C.crawl_links(*_site_graph(spark, sf), max_depth=2, max_urls=3))


# every sitemap entry of a site; sites whose name has a length divisible by 3 publish none
_HAS_SITEMAP = "length(site) % 3 <> 0"


@register("discover", f"""WITH {_DEDUP_SQL.removeprefix('WITH ')}, {crawl_sql(graph=_SITE_GRAPH_SQL)},
se AS (SELECT site, url, list_concat([page_id], ord) AS ord, priority FROM chosen WHERE {_HAS_SITEMAP}),
sd AS (SELECT site, url, min(ord) AS ord FROM se GROUP BY site, url),
sm AS (SELECT * FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY ord) AS rank, url, 0 AS depth,
                             'sitemap' AS source FROM sd) WHERE rank <= 500),
both_ AS (SELECT * FROM sm UNION ALL
          SELECT site, rank, url, depth, 'crawl' AS source FROM crawled WHERE site NOT IN (SELECT site FROM sm))
SELECT site, CAST(rank AS INT) AS rank, url, CAST(depth AS INT) AS depth, source FROM (
  SELECT site, row_number() OVER (PARTITION BY site ORDER BY rank) AS rank, url, depth, source FROM both_)
WHERE rank <= 50""")
def q_discover(spark, sf):
    cands = _roots(spark, sf, D.CANDIDATES)
    found = SM.first_source(SM.expand_indexes(_docs(spark, sf), cands, KEYS), cands, KEYS).filter(_HAS_SITEMAP)
    entries = SM.dedup_entries(found.select(
        "site", F.lit("sitemap").alias("source"), "url", "priority",
        F.concat(F.array(F.col("page_id").cast("int")), "ord").alias("ord")), ("site",))
    crawled = C.crawl_links(*_site_graph(spark, sf), max_depth=2, max_urls=50)
    out = C.discover(entries.select("site", "pos", "url"), crawled, 50)
    return out.select("site", F.col("rank").cast("int").alias("rank"), "url",
                      F.col("depth").cast("int").alias("depth"), "source")


# -- C5 where the limit bites: at most three entries of a key --------------------------
@register("sitemap_capped", _DEDUP_SQL + " SELECT site, page_id, pos, url, priority FROM ranked WHERE pos <= 3")
def q_sitemap_capped(spark, sf):
    cands = _roots(spark, sf, D.CANDIDATES)
    fs = SM.first_source(SM.expand_indexes(_docs(spark, sf), cands, KEYS), cands, KEYS)
    return SM.dedup_entries(fs, KEYS, cap=3).select(*KEYS, F.col("pos").cast("bigint").alias("pos"), "url", "priority")


# -- C9 freshness --------------------------------------------------------------------
_CACHE_VALUE = D.case("page_id", [
    "'{\"source\": \"/sitemap.xml\", \"entries\": []}'", "'not json'", "NULL", "'{\"source\": \"x\", \"entries\": [1]}'",
    "'{\"source\": \"robots.txt\", \"entries\": [{\"url\": \"' || url || '\", \"priority\": 0.5}, {\"url\": \"u\"}]}'",
    "'{\"entries\": []}'", "'{\"source\": \"x\", \"entries\": [{\"priority\": 1}]}'", "'{\"source\": 5}'", "'{\"source\": \"y\"}'",
    "'[1, 2]'", "'{\"source\": \"z\", \"entries\": null}'"])


@register("sitemap_fresh", f"""WITH c AS (SELECT 'sitemap:' || url AS key, page_id, {_CACHE_VALUE} AS value FROM pages),
j AS (SELECT *, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM c),
k AS (SELECT *, json_type(v, '$.source') = 'VARCHAR' AND (NOT coalesce(json_exists(v, '$.entries'), false)
        OR (json_type(v, '$.entries') = 'ARRAY' AND len(list_filter(json_extract(v, '$.entries[*]'),
            lambda e: coalesce(json_type(e, '$.url'), '') <> 'VARCHAR')) = 0)) AS readable FROM j)
SELECT key, coalesce(readable, false)
  AND TIMESTAMP '{BASE_TS}' + to_minutes(CAST(page_id AS BIGINT)) > TIMESTAMP '{AS_OF}' - INTERVAL 3600 SECOND AS fresh FROM k""")
def q_sitemap_fresh(spark, sf):
    p = derive(spark, sf, "pages", [("key", "'sitemap:' || url"), ("value", _CACHE_VALUE), ("page_id", "page_id")])
    p = p.withColumn("parsed_at", F.lit(BASE_TS).cast("timestamp") + F.make_dt_interval(mins=F.col("page_id").cast("int")))
    fresh, stale = SM.split_fresh(p, AS_OF)
    return (fresh.select("key", F.lit(True).alias("fresh"))
            .unionByName(stale.select("key", F.lit(False).alias("fresh"))))


# -- C10 -------------------------------------------------------------------------------
def _body_sql() -> str:
    body = "substr(html, strpos(html, '<body'), CASE WHEN strpos(html, '</body>') > 0 THEN strpos(html, '</body>') - strpos(html, '<body') ELSE length(html) END)"
    clean = f"regexp_replace(regexp_replace(regexp_replace({body}, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
    return clean


@register("csr_crawl", f"""WITH p AS ({derive_sql('pages', SHELL_PAGES)}),
m AS (SELECT page_id, strpos(html, '<body') > 0 AS has_body, length({O.html_text(_body_sql())}) AS body_text_len,
        len(regexp_extract_all({_body_sql()}, '<a\\s[^>]*href')) AS body_link_count FROM p)
SELECT page_id, CASE WHEN has_body THEN body_text_len ELSE -1 END AS body_text_len,
  CASE WHEN has_body THEN body_link_count ELSE -1 END AS body_link_count,
  has_body AND body_link_count < 3 AND body_text_len < 500 AS needs_render FROM m""")
def q_csr_crawl(spark, sf):
    ex = X.crawl_needs_render(X.extract_pages(derive(spark, sf, "pages", SHELL_PAGES)))
    return ex.select("page_id", *(F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c)
                                  for c in ("body_text_len", "body_link_count")), "needs_render")


# -- C9 over a store: the second run parses only what is stale or unreadable ---------------
@register("sitemap_reuse", _DEDUP_SQL + f"""
SELECT site, page_id, pos, url, priority, page_id % 3 <> 0 AND page_id % 5 <> 0 AS reused FROM ranked WHERE pos <= {SM.MAX_ENTRIES}""")
def q_sitemap_reuse(spark, sf):
    """One run fills the store; some of what it kept grows old or is damaged; the result is the next run's."""
    store = RU.sitemap_store(spark, shared_folder(spark, "sitemap-store"), {"site": "string", "page_id": "bigint"})
    docs, cands = _docs(spark, sf), _roots(spark, sf, D.CANDIDATES)
    RU.refresh_sitemaps(store, cands, docs, BASE_TS)
    kept = store.read()
    old = F.when(F.col("page_id") % 3 == 0, F.lit(BASE_TS).cast("timestamp") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("parsed_at"))
    worn = kept.select(*KEYS, F.when(F.col("page_id") % 5 == 0, F.lit("not json")).otherwise(F.col("value")).alias("value"), old.alias("parsed_at"))
    store.merge(worn, lambda both: both.groupBy(*KEYS).agg(F.max_by(F.struct("value", "parsed_at"), F.struct(
        F.col("parsed_at") < F.lit(BASE_TS).cast("timestamp"), F.col("value") == "not json")).alias("r")).select(*KEYS, "r.*"))
    second = RU.refresh_sitemaps(store, cands, docs, LATER_TS)
    return second.entries.select(*KEYS, F.col("pos").cast("bigint").alias("pos"), "url", "priority", "reused")
