"""URL column functions (scalar, JVM-side, codegen friendly).

All functions take and return ``Column`` objects.  The split follows the
generic URI shape (scheme, authority, path, query, fragment) with the
behaviour of Python's ``urllib.parse``: scheme lower-cased, authority case
kept, no percent decoding, ``;params`` split off the last path segment for
the schemes that use parameters, malformed input still split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the behaviour being reproduced).
# Schemes whose last path segment carries ``;params``.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
                 "rtsp", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
# Schemes for which relative references are resolved.
RELATIVE_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file",
                    "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu",
                    "sftp", "svn", "svn+ssh", "ws", "wss"]
# Schemes that carry an authority part.
NETLOC_SCHEMES = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais",
                  "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
                  "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
                  "git+ssh", "ws", "wss", "itms-services"]
# Static, media and feed suffixes that are never pages.
ASSET_SUFFIXES = ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "pdf", "zip",
                  "tar", "gz", "mp3", "mp4", "avi", "mov", "woff", "woff2", "ttf",
                  "eot", "css", "js", "xml", "rss", "atom"]
# Account / commerce words; a path *containing* one is skipped.
ACCOUNT_WORDS = ["login", "signin", "signup", "register", "logout", "admin", "cart",
                 "checkout", "account", "password", "oauth"]
# Schemes that require a host in a browser URL parser.
SPECIAL_SCHEMES = ["http", "https", "ws", "wss", "ftp"]
MAX_URL_LENGTH = 2048

# scheme ':' ; '//' authority ; path ; '?' query ; '#' fragment
_URL_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
ASSET_RE = r"(?i)\.(" + "|".join(ASSET_SUFFIXES) + r")$"
ACCOUNT_RE = r"(?i)(" + "|".join(ACCOUNT_WORDS) + r")"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _clean(url: Column) -> Column:
    # urllib drops tab/CR/LF anywhere and leading C0 controls / spaces.
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _group(url: Column, idx: int) -> Column:
    return F.regexp_extract(_clean(url), _URL_RE, idx)


def url_scheme(url) -> Column:
    return F.lower(_group(_c(url), 1))


def url_netloc(url) -> Column:
    return _group(_c(url), 2)


def _raw_path(url) -> Column:
    return _group(_c(url), 3)


def url_path(url) -> Column:
    """Path without ``;params`` of the last segment (for parameter schemes)."""
    raw = _raw_path(url)
    return F.when(url_scheme(url).isin(PARAM_SCHEMES), F.regexp_replace(raw, r";[^/]*$", "")).otherwise(raw)


def url_params(url) -> Column:
    raw = _raw_path(url)
    return F.when(url_scheme(url).isin(PARAM_SCHEMES),
                  F.regexp_extract(raw, r";([^/]*)$", 1)).otherwise(F.lit(""))


def url_query(url) -> Column:
    return _group(_c(url), 4)


def url_fragment(url) -> Column:
    return _group(_c(url), 5)


def url_parts(url) -> Column:
    """B1: struct(scheme, netloc, path, params, query, fragment)."""
    u = _c(url)
    return F.struct(url_scheme(u).alias("scheme"), url_netloc(u).alias("netloc"),
                    url_path(u).alias("path"), url_params(u).alias("params"),
                    url_query(u).alias("query"), url_fragment(u).alias("fragment"))


def url_hostname(url) -> Column:
    """Host name: authority without userinfo and port, lower-cased; '' if none."""
    net = url_netloc(url)
    host = F.regexp_replace(net, r"^.*@", "")
    host = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)) \
        .otherwise(F.regexp_replace(host, r":[^:]*$", ""))
    return F.lower(host)


def normalize_url(url) -> Column:
    """B2: drop fragment and params, strip trailing '/', keep a non-empty query."""
    u = _c(url)
    path = F.regexp_replace(url_path(u), r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    q = url_query(u)
    base = F.concat(url_scheme(u), F.lit("://"), url_netloc(u), path)
    return F.when(q != "", F.concat(base, F.lit("?"), q)).otherwise(base)


def strip_www(netloc) -> Column:
    """One leading ``www.`` removed (case-sensitive)."""
    return F.regexp_replace(_c(netloc), r"^www\.", "")


def site_key(url) -> Column:
    """The site of a URL = netloc without one leading ``www.``."""
    return strip_www(url_netloc(url))


def is_asset(path) -> Column:
    """Path ends in a static/media/feed suffix (case-insensitive)."""
    return _c(path).rlike(ASSET_RE)


def is_account_path(path) -> Column:
    """Path contains an account/commerce word anywhere (so /accounting too)."""
    return _c(path).rlike(ACCOUNT_RE)


def is_disallowed(path, disallowed) -> Column:
    """Plain prefix test against an ARRAY<STRING> of disallowed paths."""
    p = _c(path)
    return F.coalesce(F.exists(_c(disallowed), lambda d: p.startswith(d)), F.lit(False))


def url_reject_reason(url) -> Column:
    """First failing validation rule, or NULL when the URL is acceptable."""
    u = _c(url)
    scheme = url_scheme(u)
    return (F.when(F.length(u) > MAX_URL_LENGTH,
                   F.lit(f"URL exceeds maximum length of {MAX_URL_LENGTH} characters"))
            .when(~scheme.isin("http", "https"),
                  F.concat(F.lit("URL scheme '"), scheme, F.lit("' is not allowed. Use http or https.")))
            .when(url_hostname(u) == "", F.lit("URL has no hostname")))


def ipv4_to_long(ip) -> Column:
    """Dotted quad -> BIGINT, NULL when not a valid IPv4 address."""
    s = _c(ip)
    parts = F.split(s, r"\.")
    ok = s.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    nums = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    valid = ok & nums[0].between(0, 255) & nums[1].between(0, 255) & nums[2].between(0, 255) & nums[3].between(0, 255)
    value = nums[0] * 16777216 + nums[1] * 65536 + nums[2] * 256 + nums[3]
    return F.when(valid, value)


def ensure_scheme(url) -> Column:
    """Trim; prefix https:// unless already http(s)."""
    t = F.trim(_c(url))
    return F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("https://"), t))


def display_domain(url) -> Column:
    """Host name with the first ``www.`` (anywhere) removed; unparsable -> input.

    Parsable = a scheme is present and, for the web schemes, a host too.
    """
    u = _c(url)
    t = F.trim(u)
    scheme = url_scheme(t)
    host = url_hostname(t)
    ok = (scheme != "") & (~scheme.isin(SPECIAL_SCHEMES) | (host != ""))
    return F.when(ok, F.regexp_replace(host, r"^(.*?)www\.", "$1")).otherwise(u)


def site_name(url) -> Column:
    """Netloc with every ``www.`` removed, text before the first dot, title-cased."""
    net = F.replace(url_netloc(url), F.lit("www."), F.lit(""))
    return python_title(F.substring_index(net, ".", 1))


def python_title(s) -> Column:
    """Python ``str.title``: a cased run restarts after every non-letter."""
    runs = F.regexp_extract_all(_c(s), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.lower(F.substring(r, 2, 1 << 30)))), "")


def client_ip(forwarded, remote) -> Column:
    """First forwarded-for entry (trimmed), else remote address, else 'unknown'."""
    fwd = _c(forwarded)
    first = F.trim(F.substring_index(fwd, ",", 1))
    return F.when(fwd.isNotNull() & (fwd != ""), first).otherwise(F.coalesce(_c(remote), F.lit("unknown")))


def resolve_links(df, base: str, href: str, out: str = "resolved"):
    """Add ``out`` = ``href`` resolved against ``base`` like ``urljoin``.

    A DataFrame step rather than one Column: the parts of both URLs are
    computed once into struct columns and the resolution reads their
    fields, which keeps the generated code small.
    """
    # flat columns (not a struct): each part is computed once, and Catalyst
    # will not inline a non-trivial expression that is referenced many times
    staged = df
    for pre, src in (("_b", base), ("_h", href)):
        # clean once, extract the raw groups from the cleaned column, and reuse
        # the scheme for the params rule: small expressions, small generated code
        cl = pre + "cl"
        staged = staged.withColumn(cl, _clean(F.col(src)))
        g = lambda i: F.regexp_extract(F.col(cl), _URL_RE, i)
        staged = (staged.withColumn(pre + "s", F.lower(g(1))).withColumn(pre + "n", g(2))
                  .withColumn(pre + "raw", g(3)).withColumn(pre + "q", g(4)).withColumn(pre + "f", g(5)))
        params_ok = F.col(pre + "s").isin(PARAM_SCHEMES)
        staged = (staged.withColumn(pre + "p", F.when(params_ok, F.regexp_replace(F.col(pre + "raw"), r";[^/]*$", ""))
                                    .otherwise(F.col(pre + "raw")))
                  .withColumn(pre + "par", F.when(params_ok, F.regexp_extract(F.col(pre + "raw"), r";([^/]*)$", 1))
                              .otherwise(F.lit(""))))
    b, h = F.col(base), F.col(href)
    bs, bn, bp, bpar, bq = F.col("_bs"), F.col("_bn"), F.col("_bp"), F.col("_bpar"), F.col("_bq")
    hs = F.when(F.col("_hs") == "", bs).otherwise(F.col("_hs"))
    hn, hp, hpar, hq, hf = F.col("_hn"), F.col("_hp"), F.col("_hpar"), F.col("_hq"), F.col("_hf")
    staged = staged.withColumn("_hs2", hs)
    hs = F.col("_hs2")
    netloc = F.when(hs.isin(NETLOC_SCHEMES) & (hn == ""), bn).otherwise(hn)
    base_dir = F.split(bp, "/")
    base_dir = F.when(F.element_at(base_dir, -1) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(base_dir)
    rel = F.concat(base_dir, F.split(hp, "/"))
    staged = staged.withColumn("_rel", rel)
    rel, n = F.col("_rel"), F.size(F.col("_rel"))
    rel = F.when(n > 2, F.concat(F.slice(rel, 1, 1),
                                 F.filter(F.slice(rel, 2, F.greatest(n - 2, F.lit(1))), lambda x: x != ""),
                                 F.slice(rel, -1, 1))).otherwise(rel)
    segs = F.when(hp.startswith("/"), F.split(hp, "/")).otherwise(rel)
    staged = staged.withColumn("_segs", segs)
    popped = F.aggregate(
        F.col("_segs"), F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))))
    staged = staged.withColumn("_pop", popped)
    last = F.element_at(F.col("_segs"), -1)
    dots = F.when(last.isin(".", ".."), F.concat(F.col("_pop"), F.array(F.lit("")))).otherwise(F.col("_pop"))
    staged = staged.withColumn("_j0", F.array_join(dots, "/"))
    staged = staged.withColumn("_joined", F.when(F.col("_j0") == "", F.lit("/")).otherwise(F.col("_j0")))
    staged = staged.withColumn("_net", netloc)

    def unparse(scheme, net, path, params, query, frag):
        p = F.when(params != "", F.concat(path, F.lit(";"), params)).otherwise(path)
        p = (F.when(net != "", F.concat(F.lit("//"), net,
                                        F.when((p != "") & ~p.startswith("/"), F.lit("/")).otherwise(F.lit("")), p))
             .when(p.startswith("//"), F.concat(F.lit("//"), p))
             .when((scheme != "") & scheme.isin(NETLOC_SCHEMES) & ((p == "") | p.startswith("/")),
                   F.concat(F.lit("//"), p))
             .otherwise(p))
        o = F.when(scheme != "", F.concat(scheme, F.lit(":"), p)).otherwise(p)
        o = F.when(query != "", F.concat(o, F.lit("?"), query)).otherwise(o)
        return F.when(frag != "", F.concat(o, F.lit("#"), frag)).otherwise(o)

    no_path = (hp == "") & (hpar == "")
    base_missing = b.isNull() | (b == "")
    href_missing = h.isNull() | (h == "")
    as_is = (hs != bs) | ~hs.isin(RELATIVE_SCHEMES)
    with_net = hs.isin(NETLOC_SCHEMES) & (hn != "")
    result = (
        F.when(base_missing, h)
        .when(href_missing, b)
        .when(as_is, h)
        .when(with_net, unparse(hs, hn, hp, hpar, hq, hf))
        .when(no_path, unparse(hs, F.col("_net"), bp, bpar, F.when(hq != "", hq).otherwise(bq), hf))
        .otherwise(unparse(hs, F.col("_net"), F.col("_joined"), hpar, hq, hf))
    )
    # parts of the result, taken from the branch (no re-parsing of the result)
    href_parts = (F.col("_hs"), hn, hp, hq)
    base_parts = (bs, bn, bp, bq)
    branches = [(base_missing, href_parts), (href_missing, base_parts), (as_is, href_parts),
                (with_net, (hs, hn, hp, hq)),
                (no_path, (hs, F.col("_net"), bp, F.when(hq != "", hq).otherwise(bq)))]
    other = (hs, F.col("_net"), F.col("_joined"), hq)
    for i, name in enumerate(("scheme", "netloc", "path", "query")):
        expr = None
        for cond, parts in branches:
            expr = F.when(cond, parts[i]) if expr is None else expr.when(cond, parts[i])
        staged = staged.withColumn(f"{out}_{name}", expr.otherwise(other[i]))
    tmp = ["_bcl", "_braw", "_hcl", "_hraw",
           "_bs", "_bn", "_bp", "_bpar", "_bq", "_bf", "_hs", "_hn", "_hp", "_hpar", "_hq", "_hf",
           "_hs2", "_rel", "_segs", "_pop", "_j0", "_joined", "_net"]
    return staged.withColumn(out, result).drop(*tmp)
