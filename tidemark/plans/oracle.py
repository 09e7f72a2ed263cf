"""DuckDB reference SQL for the registered queries.

The SQL restates each operator's rule (RE2 regex, list lambdas, window
functions) over the same parquet tables.  Regular expressions, phrases and
fixed lists come from the modules under test, so the SQL checks the plans
around them, not these constants; tests by example check those.  Reusable
pieces are plain SQL macros/CTE texts kept here.
"""

from __future__ import annotations

from ..functions import urls as U
from ..operators import assemble as G
from ..operators import pagestate as PS
from ..operators import sections as E

NL = "chr(10)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# -- URL pieces (RE2) ----------------------------------------------------------
URL_RE = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def u_scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, {q(URL_RE)}, 1))"


def u_netloc(x: str) -> str:
    return f"regexp_extract({x}, {q(URL_RE)}, 2)"


def u_path(x: str) -> str:
    raw = f"regexp_extract({x}, {q(URL_RE)}, 3)"
    return (f"(CASE WHEN {u_scheme(x)} IN {sql_list(U.PARAM_SCHEMES)} "
            f"THEN regexp_replace({raw}, ';[^/]*$', '') ELSE {raw} END)")


def u_query(x: str) -> str:
    return f"regexp_extract({x}, {q(URL_RE)}, 4)"


def u_site(x: str) -> str:
    return f"regexp_replace({u_netloc(x)}, '^www\\.', '')"


def py_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '(\\pL+|\\PL+)'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def unescape(x: str) -> str:
    t = x
    for ent, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " ")):
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return f"regexp_replace({t}, '&amp;?', '&', 'g')"


def html_text(x: str) -> str:
    """Text of an HTML fragment: tags removed, strings stripped and joined."""
    return py_strip(unescape(f"regexp_replace({x}, '\\s*<[^>]*>\\s*', '', 'g')"))


def site_name_sql(url: str) -> str:
    net = f"replace({u_netloc(url)}, 'www.', '')"
    return py_title(f"split_part({net}, '.', 1)")


def rule_case(path: str, rules=E.DEFAULT_RULES) -> str:
    parts = []
    for r in sorted(rules, key=lambda r: -r.priority):
        rx = "(" + "|".join(r.patterns) + ")"
        parts.append(f"WHEN regexp_matches({path}, {q(rx)}) THEN {q(r.name)}")
    first = f"regexp_extract({path}, '^/*([^/]+)', 1)"
    fb = f"(CASE WHEN {first} = '' THEN 'Pages' ELSE {py_title(f'translate({first}, {q(chr(45) + chr(95))}, {q(chr(32) + chr(32))})')} END)"
    return "(CASE " + " ".join(parts) + f" ELSE {fb} END)"


EXCLUDE_SQL_RE = "(" + "|".join(E.EXCLUDE_PATTERNS) + ")"
SOFT404_SQL_RE = "(" + "|".join(PS.SOFT_404_PHRASES) + ")"


def section_key_sql(sec: str) -> str:
    pref = "[" + ", ".join(q(n) for n in G.PREFERRED_ORDER) + "]"
    p = f"list_position({pref}, {sec})"
    return (f"(CASE WHEN {p} IS NOT NULL THEN 0 WHEN {sec} = 'Optional' THEN 2 ELSE 1 END), "
            f"coalesce({p}, 0), {sec}")


def title_sql(h: str = "html") -> str:
    raw_title = f"regexp_extract({h}, '(?s)<title>(.*?)</title>', 1)"
    h1 = f"regexp_extract({h}, '(?s)<h1>(.*?)</h1>', 1)"
    return (f"(CASE WHEN {raw_title} <> '' THEN {py_strip(unescape(raw_title))} "
            f"WHEN strpos({h}, '<h1>') > 0 THEN {html_text(h1)} END)")


def first_p_desc_sql(h: str = "html") -> str:
    first_p = f"substr({h}, strpos({h}, '<p>'))"
    close_p = f"strpos({first_p}, '</p>')"
    close_art = f"strpos({first_p}, '</article>')"
    inner = f"substr({first_p}, 1, {close_p} - 1)"
    to_article = (f"(CASE WHEN {close_art} > 0 THEN substr({first_p}, 1, {close_art} - 1) "
                  f"ELSE {first_p} END)")
    seg = (f"(CASE WHEN strpos({h}, '<p>') = 0 THEN NULL "
           f"WHEN {close_p} = 0 OR ({close_art} > 0 AND {close_art} < {close_p}) THEN {to_article} "
           f"WHEN strpos(substr({inner}, 4), '<p>') > 0 THEN {to_article} ELSE {inner} END)")
    ptext = html_text(seg)
    return f"(CASE WHEN length({ptext}) > 20 THEN left({ptext}, 500) END)"


def extracted_pages_sql() -> str:
    """CTE chain: pages with title, description, error (HTTP-path soft-404)."""
    first_p = "substr(html, strpos(html, '<p>'))"
    close_p = f"strpos({first_p}, '</p>')"
    close_art = f"strpos({first_p}, '</article>')"
    inner = f"substr({first_p}, 1, {close_p} - 1)"
    to_article = (f"(CASE WHEN {close_art} > 0 THEN substr({first_p}, 1, {close_art} - 1) "
                  f"ELSE {first_p} END)")
    # an unclosed first <p> (no </p> before the article ends, or another <p>
    # opened inside it) holds everything up to the end of the article
    seg = (f"(CASE WHEN strpos(html, '<p>') = 0 THEN NULL "
           f"WHEN {close_p} = 0 OR ({close_art} > 0 AND {close_art} < {close_p}) THEN {to_article} "
           f"WHEN strpos(substr({inner}, 4), '<p>') > 0 THEN {to_article} ELSE {inner} END)")
    raw_title = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    h1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
    title = (f"(CASE WHEN {raw_title} <> '' THEN {py_strip(unescape(raw_title))} "
             f"WHEN strpos(html, '<h1>') > 0 THEN {html_text(h1)} END)")
    ptext = html_text(seg)
    desc = f"(CASE WHEN length({ptext}) > 20 THEN left({ptext}, 500) END)"
    return f"""
pg AS (SELECT page_id, url, html, {u_site('url')} AS site FROM pages),
rk AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rank FROM pg),
ex0 AS (SELECT site, page_id, rank, url, {title} AS title, {desc} AS description FROM rk),
ex AS (
  SELECT site, page_id, rank, url,
    CASE WHEN s404 THEN NULL ELSE title END AS title,
    CASE WHEN s404 THEN NULL ELSE description END AS description,
    CASE WHEN s404 THEN {q(PS.SOFT_404_HTTP)} END AS error,
    NOT s404 AS has_content
  FROM (SELECT *, (regexp_matches(lower(coalesce(title, '')), {q(SOFT404_SQL_RE)})
                   OR regexp_matches(lower(coalesce(description, '')), {q(SOFT404_SQL_RE)})) AS s404
        FROM ex0)
)"""


def categorized_sql() -> str:
    path = f"lower({u_path('url')})"
    return f"""
cat0 AS (
  SELECT *, {rule_case(path)} AS section0 FROM ex
  WHERE error IS NULL AND NOT regexp_matches({path}, {q(EXCLUDE_SQL_RE)})
),
cat1 AS (
  SELECT *, count(*) OVER (PARTITION BY site, section0) AS n_sec,
         min(rank) OVER (PARTITION BY site, section0) AS first_rank FROM cat0
),
cat AS (
  SELECT *,
    (section0 NOT IN {sql_list([r.name for r in E.DEFAULT_RULES])} AND n_sec < 2) AS moved,
    CASE WHEN section0 NOT IN {sql_list([r.name for r in E.DEFAULT_RULES])} AND n_sec < 2
         THEN 'Pages' ELSE section0 END AS section
  FROM cat1
)"""


def site_info_sql() -> str:
    return f"""
seeds AS (
  SELECT site, {u_scheme('u')} || '://' || {u_netloc('u')} || '/' AS seed_url
  FROM (SELECT site, arg_min(url, page_id) AS u FROM pg GROUP BY site)
),
home AS (
  SELECT e.site, s.seed_url,
    arg_min(e.rank, e.rank) FILTER (WHERE rtrim(e.url, '/') = rtrim(s.seed_url, '/')) AS home_rank,
    arg_min(e.rank, e.rank) FILTER (WHERE e.has_content) AS first_rank
  FROM ex e JOIN seeds s USING (site) GROUP BY e.site, s.seed_url
),
sites AS (
  SELECT h.site, {site_name_sql('h.seed_url')} AS name,
    (SELECT nullif(description, '') FROM ex x WHERE x.site = h.site AND x.rank =
       CASE WHEN (h.home_rank IS NULL OR NOT (SELECT has_content FROM ex y WHERE y.site = h.site AND y.rank = h.home_rank))
                 AND h.first_rank IS NOT NULL THEN h.first_rank ELSE h.home_rank END) AS description
  FROM home h
)"""


def index_doc_sql(k: int = 5) -> str:
    entry = ("'- [' || title || '](' || url || ')' || "
             "CASE WHEN description <> '' THEN ': ' || description ELSE '' END")
    return f"""
WITH {extracted_pages_sql()},
{categorized_sql()},
{site_info_sql()},
enh AS (
  SELECT site, section, url, moved, first_rank, rank,
    coalesce(nullif(title, ''), 'Untitled') AS title,
    coalesce(nullif(description, ''), '') AS description,
    row_number() OVER (PARTITION BY site, section
                       ORDER BY moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank) AS rn
  FROM cat
),
blocks AS (
  SELECT site, section,
    '## ' || section || {NL} || {NL} ||
      string_agg({entry}, {NL} ORDER BY moved, CASE WHEN moved THEN first_rank ELSE 0 END, rank)
      || {NL} AS block
  FROM enh WHERE rn <= {k} GROUP BY site, section
),
body AS (
  SELECT site, string_agg(block, {NL} ORDER BY {section_key_sql('section')}) AS body
  FROM blocks GROUP BY site
)
SELECT s.site,
  {py_strip(f"'# ' || s.name || {NL} || {NL} || CASE WHEN s.description IS NOT NULL THEN '> ' || s.description || {NL} || {NL} ELSE '' END || coalesce(b.body, '')")} || {NL} AS doc
FROM sites s LEFT JOIN body b USING (site)
"""
