"""URL function queries (B1-B13) over URL variants derived from ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import crawl as C
from ..operators import extract as X
from ..session import table
from ..sources import derived as D
from ..operators import validate as V
from . import oracle as O
from .registry import derive, derive_sql, register

_V = f"({derive_sql('pages', D.URL_VARIANTS)}) v"
# RE2 host name: authority without userinfo and port, lower-cased
_NET = O.u_netloc("url")
_HOST = (f"lower(CASE WHEN starts_with(regexp_replace({_NET}, '^.*@', ''), '[') "
         f"THEN regexp_extract(regexp_replace({_NET}, '^.*@', ''), '^\\[([^\\]]*)\\]', 1) "
         f"ELSE regexp_replace(regexp_replace({_NET}, '^.*@', ''), ':[^:]*$', '') END)")
_CLEAN = "regexp_replace(regexp_replace(url, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '')"


def _c(expr: str) -> str:
    """Apply an URL expression to the cleaned URL (leading blanks removed)."""
    return expr.replace("url", _CLEAN)


def variants(spark, sf):
    return derive(spark, sf, "pages", D.URL_VARIANTS)


@register("url_split", f"""SELECT page_id, url, {_c(O.u_scheme('url'))} AS scheme, {_c(O.u_netloc('url'))} AS netloc,
  {_c(O.u_path('url'))} AS path,
  CASE WHEN {_c(O.u_scheme('url'))} IN {O.sql_list(U.PARAM_SCHEMES)}
       THEN regexp_extract(regexp_extract({_CLEAN}, {O.q(O.URL_RE)}, 3), ';([^/]*)$', 1) ELSE '' END AS params,
  {_c(O.u_query('url'))} AS query, regexp_extract({_CLEAN}, {O.q(O.URL_RE)}, 5) AS fragment FROM {_V}""")
def q_url_split(spark, sf):
    v = variants(spark, sf)
    return v.select("page_id", "url", U.url_parts(F.col("url")).alias("p")).select("page_id", "url", "p.*")


_NORM_PATH = f"regexp_replace({_c(O.u_path('url'))}, '/+$', '')"


@register("url_normalize", f"""SELECT page_id, url,
  {_c(O.u_scheme('url'))} || '://' || {_c(O.u_netloc('url'))} ||
  CASE WHEN {_NORM_PATH} = '' THEN '/' ELSE {_NORM_PATH} END ||
  CASE WHEN {_c(O.u_query('url'))} <> '' THEN '?' || {_c(O.u_query('url'))} ELSE '' END AS normalized FROM {_V}""")
def q_url_normalize(spark, sf):
    return variants(spark, sf).select("page_id", "url", U.normalize_url(F.col("url")).alias("normalized"))


@register("site_counts", f"SELECT {O.u_site('url')} AS site, count(*) AS n_pages FROM pages GROUP BY 1")
def q_site_counts(spark, sf):
    return (table(spark, sf, "pages").groupBy(U.site_key(F.col("url")).alias("site"))
            .agg(F.count(F.lit(1)).alias("n_pages")))


@register("skip_urls", f"""SELECT page_id, url,
  regexp_matches({_c(O.u_path('url'))}, {O.q('(?i)[.](' + '|'.join(U.ASSET_SUFFIXES) + ')$')}) AS is_asset,
  regexp_matches({_c(O.u_path('url'))}, {O.q('(?i)(' + '|'.join(U.ACCOUNT_WORDS) + ')')}) AS is_account
  FROM {_V}""")
def q_skip_urls(spark, sf):
    v = variants(spark, sf)
    path = U.url_path(F.col("url"))
    return v.select("page_id", "url", U.is_asset(path).alias("is_asset"), U.is_account_path(path).alias("is_account"))


# Disallow prefixes per site derived from pages (first path segment of every 5th page)
_RULE_EXPRS = [("site", D.SITE), ("prefix", "'/' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*/([^/?#]*)', 1)")]


@register("disallow_filter", f"""
WITH rules AS (SELECT DISTINCT site, prefix FROM ({derive_sql('pages', _RULE_EXPRS, 'page_id % 5 = 0')})),
p AS (SELECT page_id, url, {O.u_site('url')} AS site, {O.u_path('url')} AS path FROM pages)
SELECT page_id, url FROM p
WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.site = p.site AND starts_with(p.path, r.prefix))""")
def q_disallow_filter(spark, sf):
    pages = table(spark, sf, "pages")
    rules = derive(spark, sf, "pages", _RULE_EXPRS, "page_id % 5 = 0")
    urls = pages.select("page_id", "url", U.site_key(F.col("url")).alias("site"))
    return V.drop_disallowed(urls, rules).select("page_id", "url")


_REASON = (f"CASE WHEN length(url) > {U.MAX_URL_LENGTH} THEN 'URL exceeds maximum length of {U.MAX_URL_LENGTH} characters' "
           f"WHEN {_c(O.u_scheme('url'))} NOT IN ('http', 'https') THEN 'URL scheme ''' || {_c(O.u_scheme('url'))} || ''' is not allowed. Use http or https.' "
           f"WHEN {_c(_HOST)} = '' THEN 'URL has no hostname' END")


@register("url_validate", f"SELECT page_id, url, {_REASON} AS reject_reason FROM {_V}")
def q_url_validate(spark, sf):
    return variants(spark, sf).select("page_id", "url", U.url_reject_reason(F.col("url")).alias("reject_reason"))


# Host per page, resolved through a derived dns table
_DNS_IP = D.case("page_id", ["'93.184.216.34'", "'127.0.0.1'", "'10.1.2.3'", "'172.16.5.4'", "'192.168.1.1'",
                             "'169.254.169.254'", "'100.64.0.1'", "'172.32.0.1'", "'8.8.8.8'", "'::1'", "'fd12:3456::1'", "'FE80::1'", "'2001:db8::1'", "NULL"])
_HOSTS = [("page_id", "page_id"), ("url", "'https://h' || CAST(page_id AS STRING) || '.' || " + D.SITE + " || '/'"),
          ("host", "'h' || CAST(page_id AS STRING) || '.' || " + D.SITE)]
_DNS = [("host", "'h' || CAST(page_id AS STRING) || '.' || " + D.SITE), ("ip", _DNS_IP)]
_CIDR_VALUES = ", ".join(f"({i}, '{c}', {lo}, {hi})" for i, (c, lo, hi) in enumerate(V.BLOCKED_V4))


@register("blocked_hosts", f"""
WITH u AS ({derive_sql('pages', _HOSTS)}),
d AS ({derive_sql('pages', _DNS, 'page_id % 10 <> 9')}),
c(pos, cidr, lo, hi) AS (VALUES {_CIDR_VALUES}),
j AS (SELECT u.page_id, u.host, d.ip,
        CASE WHEN regexp_matches(d.ip, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')
             THEN CAST(split_part(d.ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(d.ip, '.', 2) AS BIGINT) * 65536
                + CAST(split_part(d.ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(d.ip, '.', 4) AS BIGINT) END AS n
      FROM u LEFT JOIN d USING (host))
SELECT page_id, host, ip,
  CASE WHEN ip IS NULL THEN 'Could not resolve hostname ''' || host || ''''
       WHEN ip = '::1' THEN 'URL resolves to blocked IP range (::1/128)'
       WHEN lower(ip) LIKE 'fd12:%' THEN 'URL resolves to blocked IP range (fd00::/8)'
       WHEN lower(ip) LIKE 'fe80:%' THEN 'URL resolves to blocked IP range (fe80::/10)'
       ELSE (SELECT 'URL resolves to blocked IP range (' || cidr || ')' FROM c WHERE j.n BETWEEN c.lo AND c.hi
             ORDER BY pos LIMIT 1) END AS reject_reason
FROM j""")
def q_blocked_hosts(spark, sf):
    urls = derive(spark, sf, "pages", _HOSTS)
    dns = derive(spark, sf, "pages", _DNS, "page_id % 10 <> 9")
    out = V.flag_blocked_hosts(urls, dns)
    return out.select("page_id", "host", "ip", "reject_reason")


@register("ensure_scheme", f"""SELECT page_id, url,
  CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url)
       ELSE 'https://' || trim(url) END AS normalized FROM {_V}""")
def q_ensure_scheme(spark, sf):
    return variants(spark, sf).select("page_id", "url", U.ensure_scheme(F.col("url")).alias("normalized"))


_TRIM = "trim(url)"
_T_SCHEME = O.u_scheme(_TRIM)
_T_HOST = _HOST.replace("url", _TRIM)


@register("display_domain", f"""SELECT page_id, url,
  CASE WHEN {_T_SCHEME} <> '' AND ({_T_SCHEME} NOT IN {O.sql_list(U.SPECIAL_SCHEMES)} OR {_T_HOST} <> '')
       THEN regexp_replace({_T_HOST}, 'www[.]', '') ELSE url END AS domain FROM {_V}""")
def q_display_domain(spark, sf):
    return variants(spark, sf).select("page_id", "url", U.display_domain(F.col("url")).alias("domain"))


@register("site_name", f"""SELECT page_id, url, {O.site_name_sql(_CLEAN)} AS name FROM {_V}""")
def q_site_name(spark, sf):
    return variants(spark, sf).select("page_id", "url", U.site_name(F.col("url")).alias("name"))


_FWD = [("page_id", "page_id"),
        ("fwd", D.case("page_id", ["NULL", "''", "' 1.2.3.4 , 10.0.0.1'", "'5.6.7.8'", "'  '"])),
        ("remote", "CASE WHEN page_id % 3 = 0 THEN NULL ELSE '9.9.9.' || CAST(page_id % 256 AS STRING) END")]


@register("client_ip", f"""SELECT page_id,
  CASE WHEN fwd IS NOT NULL AND fwd <> '' THEN trim(split_part(fwd, ',', 1)) ELSE coalesce(remote, 'unknown') END AS client_ip
  FROM ({derive_sql('pages', _FWD)})""")
def q_client_ip(spark, sf):
    d = derive(spark, sf, "pages", _FWD)
    return d.select("page_id", U.client_ip(F.col("fwd"), F.col("remote")).alias("client_ip"))


# Hrefs of several forms resolved against the page URL
_HREFS = [("page_id", "page_id"), ("base", "url"),
          ("href", D.case("page_id", ["'x'", "'../x'", "'./y/'", "'?q=1'", "'#f'", "'//other.example/p'",
                                      "'/root/a/./b/../c'", "''", "'http://abs.example/z'", "'mailto:a@b'",
                                      "'../../../..'", "'.'", "'..'", "'g;p?y#s'", "'a//b/../c'",
                                      "'https:rel'", "'/'"]))]


def _unparse_sql(sc, net, path, par, q, frag) -> str:
    p = f"({path} || CASE WHEN {par} <> '' THEN ';' || {par} ELSE '' END)"
    p2 = (f"(CASE WHEN {net} <> '' THEN '//' || {net} || CASE WHEN {p} <> '' AND NOT starts_with({p}, '/') THEN '/' ELSE '' END || {p} "
          f"WHEN starts_with({p}, '//') THEN '//' || {p} "
          f"WHEN {sc} <> '' AND {sc} IN {O.sql_list(U.NETLOC_SCHEMES)} AND ({p} = '' OR starts_with({p}, '/')) THEN '//' || {p} "
          f"ELSE {p} END)")
    return (f"(CASE WHEN {sc} <> '' THEN {sc} || ':' || {p2} ELSE {p2} END "
            f"|| CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END || CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END)")


def _parts_sql(x: str, pre: str) -> str:
    c = f"regexp_replace({x}, '^[\\x00-\\x20]+|[\\t\\r\\n]', '', 'g')"
    raw = f"regexp_extract({c}, {O.q(O.URL_RE)}, 3)"
    sc = f"lower(regexp_extract({c}, {O.q(O.URL_RE)}, 1))"
    par_ok = f"{sc} IN {O.sql_list(U.PARAM_SCHEMES)}"
    return (f"{sc} AS {pre}s, regexp_extract({c}, {O.q(O.URL_RE)}, 2) AS {pre}n, "
            f"CASE WHEN {par_ok} THEN regexp_replace({raw}, ';[^/]*$', '') ELSE {raw} END AS {pre}p, "
            f"CASE WHEN {par_ok} THEN regexp_extract({raw}, ';([^/]*)$', 1) ELSE '' END AS {pre}par, "
            f"regexp_extract({c}, {O.q(O.URL_RE)}, 4) AS {pre}q, regexp_extract({c}, {O.q(O.URL_RE)}, 5) AS {pre}f")


_JOIN_SQL = f"""
WITH d AS ({derive_sql('pages', _HREFS)}),
p AS (SELECT *, {_parts_sql('base', '_b')}, {_parts_sql('href', '_h')} FROM d),
q AS (SELECT *, CASE WHEN _hs = '' THEN _bs ELSE _hs END AS hs2,
             CASE WHEN (CASE WHEN _hs = '' THEN _bs ELSE _hs END) IN {O.sql_list(U.NETLOC_SCHEMES)} AND _hn = '' THEN _bn ELSE _hn END AS net
      FROM p),
r AS (SELECT *,
  CASE WHEN starts_with(_hp, '/') THEN string_split(_hp, '/')
       ELSE (SELECT CASE WHEN len(z) > 2 THEN list_concat(z[1:1], list_filter(z[2:len(z) - 1], lambda e: e <> ''), z[len(z):len(z)]) ELSE z END
             FROM (SELECT list_concat(CASE WHEN string_split(_bp, '/')[-1] <> '' THEN string_split(_bp, '/')[1:len(string_split(_bp, '/')) - 1]
                                           ELSE string_split(_bp, '/') END, string_split(_hp, '/')) AS z)) END AS segs
  FROM q),
s AS (SELECT *, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(segs, lambda e: [e])),
                  lambda acc, x: CASE WHEN x[1] = '..' THEN (CASE WHEN len(acc) = 0 THEN acc ELSE acc[1:len(acc) - 1] END)
                                      WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END) AS popped FROM r),
t AS (SELECT *, array_to_string(CASE WHEN segs[-1] IN ('.', '..') THEN list_append(popped, '') ELSE popped END, '/') AS j0 FROM s),
u AS (SELECT *, CASE WHEN j0 = '' THEN '/' ELSE j0 END AS joined,
        coalesce(base, '') = '' AS base_missing, coalesce(href, '') = '' AS href_missing,
        hs2 <> _bs OR hs2 NOT IN {O.sql_list(U.RELATIVE_SCHEMES)} AS as_is,
        hs2 IN {O.sql_list(U.NETLOC_SCHEMES)} AND _hn <> '' AS with_net,
        _hp = '' AND _hpar = '' AS no_path FROM t)
SELECT page_id, base, href,
  CASE WHEN base_missing THEN href WHEN href_missing THEN base WHEN as_is THEN href
       WHEN with_net THEN {_unparse_sql('hs2', '_hn', '_hp', '_hpar', '_hq', '_hf')}
       WHEN no_path THEN {_unparse_sql('hs2', 'net', '_bp', '_bpar', "CASE WHEN _hq <> '' THEN _hq ELSE _bq END", '_hf')}
       ELSE {_unparse_sql('hs2', 'net', 'joined', '_hpar', '_hq', '_hf')} END AS target,
  CASE WHEN base_missing OR as_is THEN _hs WHEN href_missing THEN _bs ELSE hs2 END AS target_scheme,
  CASE WHEN base_missing OR as_is THEN _hn WHEN href_missing THEN _bn WHEN with_net THEN _hn ELSE net END AS target_netloc,
  CASE WHEN base_missing OR as_is OR with_net THEN _hp WHEN href_missing OR no_path THEN _bp ELSE joined END AS target_path,
  CASE WHEN base_missing OR as_is OR with_net THEN _hq WHEN href_missing THEN _bq
       WHEN no_path THEN CASE WHEN _hq <> '' THEN _hq ELSE _bq END ELSE _hq END AS target_query
FROM u"""


@register("link_targets", _JOIN_SQL)
def q_link_targets(spark, sf):
    d = derive(spark, sf, "pages", _HREFS)
    return U.resolve_links(d, "base", "href", "target").select(
        "page_id", "base", "href", "target", "target_scheme", "target_netloc", "target_path", "target_query")


_ABS = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || " + O.unescape("href")
_ABS_PATH = O.u_path("abs")
_NP = f"regexp_replace({_ABS_PATH}, '/+$', '')"
PAGE_LINKS_SQL = f"""
WITH l AS (SELECT page_id, url, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href
           FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)),
r AS (SELECT page_id, pos, {_ABS} AS abs FROM l WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))
SELECT page_id, pos, {O.u_scheme('abs')} || '://' || {O.u_netloc('abs')} || CASE WHEN {_NP} = '' THEN '/' ELSE {_NP} END
  || CASE WHEN {O.u_query('abs')} <> '' THEN '?' || {O.u_query('abs')} ELSE '' END AS target
FROM r WHERE NOT regexp_matches({_ABS_PATH}, {O.q('(?i)[.](' + '|'.join(U.ASSET_SUFFIXES) + ')$')})"""


@register("page_links", PAGE_LINKS_SQL)
def q_page_links(spark, sf):
    pages = table(spark, sf, "pages")
    ex = X.extract_pages(pages.select("page_id", "url", "html"))
    return C.page_links(ex, keys=("page_id",)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "target")


# B8 against a table of networks: one network per order, IPv4 and IPv6, in the order of their keys
_O = "o_orderkey"
_NETWORKS = [("position", _O), ("cidr", D.case(_O, [
    f"CAST({_O} % 223 + 1 AS STRING) || '.' || CAST({_O} * 7 % 256 AS STRING) || '.' || CAST({_O} * 3 % 256 AS STRING) || '.0/' || CAST(8 + {_O} % 17 AS STRING)",
    f"'10.' || CAST({_O} % 256 AS STRING) || '.' || CAST({_O} * 5 % 256 AS STRING) || '.' || CAST({_O} % 251 AS STRING) || '/' || CAST(12 + {_O} % 21 AS STRING)",
    f"'2001:' || CAST({_O} % 50 AS STRING) || ':' || CAST({_O} % 9 AS STRING) || '::/' || CAST(16 * (2 + {_O} % 2) AS STRING)",
]))]
_ADDRESSES = [("host", "'h' || CAST(page_id AS STRING) || '.' || " + D.SITE), ("ip", D.case("page_id", [
    "CAST(page_id % 223 + 1 AS STRING) || '.' || CAST(page_id * 7 % 256 AS STRING) || '.' || CAST(page_id * 3 % 256 AS STRING) || '.9'",
    "'10.' || CAST(page_id % 256 AS STRING) || '.' || CAST(page_id * 11 % 256 AS STRING) || '.' || CAST(page_id % 256 AS STRING)",
    "'2001:' || CAST(page_id % 60 AS STRING) || ':' || CAST(page_id % 11 AS STRING) || '::' || CAST(page_id % 13 + 1 AS STRING)",
    "'240.0.0.' || CAST(page_id % 256 AS STRING)",
    "NULL",
]))]


def _v4_sql(x: str) -> str:
    part = [f"CAST(split_part({x}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return f"({part[0]} * 16777216 + {part[1]} * 65536 + {part[2]} * 256 + {part[3]})"


@register("blocked_networks", f"""
WITH u AS ({derive_sql('pages', _HOSTS)}), d AS ({derive_sql('pages', _ADDRESSES)}), n AS ({derive_sql('orders', _NETWORKS)}),
n4 AS (SELECT position, cidr, {_v4_sql("split_part(cidr, '/', 1)")} AS a, CAST(split_part(cidr, '/', 2) AS INT) AS len
       FROM n WHERE NOT contains(cidr, ':')),
r4 AS (SELECT position, cidr, a - a % (1::BIGINT << (32 - len)) AS lo, a - a % (1::BIGINT << (32 - len)) + (1::BIGINT << (32 - len)) - 1 AS hi FROM n4),
d4 AS (SELECT host, {_v4_sql('ip')} AS n FROM d WHERE NOT contains(ip, ':')),
n6 AS (SELECT position, cidr, split_part(cidr, ':', 2) AS g2, split_part(cidr, ':', 3) AS g3, split_part(cidr, '/', 2) = '48' AS long FROM n WHERE contains(cidr, ':')),
d6 AS (SELECT host, split_part(ip, ':', 2) AS g2, split_part(ip, ':', 3) AS g3 FROM d WHERE contains(ip, ':')),
hit AS (SELECT host, position, cidr FROM d4 JOIN r4 ON n BETWEEN lo AND hi
        UNION ALL SELECT host, position, cidr FROM d6 JOIN n6 ON d6.g2 = n6.g2 AND (NOT long OR d6.g3 = n6.g3)),
f AS (SELECT host, arg_min(cidr, position) AS cidr FROM hit GROUP BY host)
SELECT page_id, host, ip, CASE WHEN ip IS NULL THEN 'Could not resolve hostname ''' || host || ''''
  WHEN cidr IS NOT NULL THEN 'URL resolves to blocked IP range (' || cidr || ')' END AS reject_reason
FROM u LEFT JOIN d USING (host) LEFT JOIN f USING (host)""")
def q_blocked_networks(spark, sf):
    networks = derive(spark, sf, "orders", _NETWORKS)
    out = V.flag_blocked_hosts(derive(spark, sf, "pages", _HOSTS), derive(spark, sf, "pages", _ADDRESSES), networks)
    return out.select("page_id", "host", "ip", "reject_reason")
