"""URL admission checks (B6 at scale, B7, B8).

* ``drop_disallowed``: robots prefixes as an equi-join.  A URL path expands
  into its prefixes of the lengths that occur among its site's rules and is
  semi-joined on ``(site, prefix)`` with the distinct rule table, so a
  site with many rules never turns into a per-row theta join.
* ``flag_blocked_hosts``: host -> IPv4 through a ``dns(host, ip)`` table
  (left join; missing = cannot resolve), then one CASE over the fixed
  blocked-network lists.
* ``match_networks``: the same against a *table* of networks, IPv4 and IPv6.
  An address expands into its prefixes of the lengths that occur in the table
  and meets the networks by equality; no range is ever compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as AD
from ..functions import urls as U

# Blocked IPv4 networks (CIDR, first address, last address), in order.
BLOCKED_V4 = [
    ("127.0.0.0/8", 2130706432, 2147483647),
    ("10.0.0.0/8", 167772160, 184549375),
    ("172.16.0.0/12", 2886729728, 2887778303),
    ("192.168.0.0/16", 3232235520, 3232301055),
    ("169.254.0.0/16", 2851995648, 2852061183),
]
# Blocked IPv6 networks, as text rules (resolution is IPv4-only).
BLOCKED_V6 = [("::1/128", r"^::1$"), ("fd00::/8", r"(?i)^fd[0-9a-f]{0,2}:"), ("fe80::/10", r"(?i)^fe[89ab][0-9a-f]?:")]


def drop_disallowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop URLs whose path starts with one of their site's prefixes.

    ``urls(site, url, ...)``, ``rules(site, prefix)``; plain string prefix,
    no wildcards, no Allow lines; empty prefixes never match.
    """
    r = rules.filter(F.col("prefix").isNotNull() & (F.col("prefix") != "")).select("site", "prefix").distinct()
    lengths = r.select("site", F.length("prefix").alias("_n")).distinct()
    staged = urls.select("site", "url", U.url_path(F.col("url")).alias("_path")).join(lengths, "site")
    pref = staged.filter(F.length("_path") >= F.col("_n")).select(
        "site", "url", F.substring("_path", F.lit(1), F.col("_n")).alias("prefix"))
    hit = pref.join(r, ["site", "prefix"], "left_semi").select("site", "url").distinct()
    return urls.join(hit, ["site", "url"], "left_anti")


def blocked_network(ip) -> Column:
    """First blocked network in list order that holds the address, else NULL."""
    n = U.ipv4_to_long(ip)
    out = None
    for cidr, low, high in BLOCKED_V4:
        out = (F if out is None else out).when(n.between(low, high), F.lit(cidr))
    for cidr, rx in BLOCKED_V6:
        out = out.when(ip.rlike(rx), F.lit(cidr))
    return out


#: Networks this short number at most 2 ** (SHORT_BITS + 1) a family, so they may be broadcast.
SHORT_BITS = 12


def network_index(networks: DataFrame) -> DataFrame:
    """(family, n, prefix, position, cidr): first network in list order of each distinct prefix.

    ``networks(position, cidr)``; host bits are cut off.  Rows that are no
    network are left out (``invalid_networks`` gives them).
    """
    bits = networks.select("position", "cidr", AD.network(F.col("cidr")).alias("net")).select("position", "cidr", "net.*")
    return bits.where("prefix IS NOT NULL").groupBy("family", "prefix") \
        .agg(F.min(F.struct("position", "cidr")).alias("e")) \
        .select("family", F.length("prefix").alias("n"), "prefix", "e.position", "e.cidr")


def invalid_networks(networks: DataFrame) -> DataFrame:
    return networks.where(AD.network(F.col("cidr"))["prefix"].isNull())


def match_networks(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """(ip, position, cidr): first network in list order that holds each distinct address of ``addresses(ip)``.

    Short networks, which many addresses share, are few and broadcast; an
    address meets the others through its prefixes of the lengths that occur
    (at most 162, both families together).  Addresses in no network have no row.
    """
    index = network_index(networks)
    lengths = index.select("family", "n").distinct()
    bits = addresses.select("ip").distinct().select("ip", AD.address_bits(F.col("ip")).alias("_bits")).where("_bits IS NOT NULL")
    cut = bits.withColumn("family", AD.family(F.col("_bits"))).join(F.broadcast(lengths), "family") \
        .select("ip", "family", "n", F.expr("substring(_bits, 1, n)").alias("prefix"))
    short, key = F.col("n") <= SHORT_BITS, ["family", "n", "prefix"]
    hits = cut.where(short).join(F.broadcast(index.where(short)), key).select("ip", "position", "cidr").unionByName(
        cut.where(~short).join(index.where(~short), key).select("ip", "position", "cidr"))
    return hits.groupBy("ip").agg(F.min(F.struct("position", "cidr")).alias("e")).select("ip", "e.position", "e.cidr")


def flag_blocked_hosts(urls: DataFrame, dns: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """``urls(host, ...)`` + ``dns(host, ip)`` -> ``ip``, ``reject_reason``.

    First matching network in list order wins.  ``networks(position, cidr)``
    names them; without it they are the fixed ones, where 0/8, 100.64/10 and
    multicast are not blocked.
    """
    j = urls.join(dns.select("host", "ip"), "host", "left")
    if networks is None:
        j = j.withColumn("_cidr", blocked_network(F.col("ip")))
    else:
        j = j.join(match_networks(dns, networks).select("ip", F.col("cidr").alias("_cidr")), "ip", "left")
    reason = (F.when(F.col("ip").isNull(), F.concat(F.lit("Could not resolve hostname '"), F.col("host"), F.lit("'")))
              .when(F.col("_cidr").isNotNull(),
                    F.concat(F.lit("URL resolves to blocked IP range ("), F.col("_cidr"), F.lit(")"))))
    return j.withColumn("reject_reason", reason).drop("_cidr")
