"""Networks and section rules as tables, against Python's own modules."""

import ipaddress
import random
import re

from pyspark.sql import functions as F

from tidemark.functions import addresses as AD
from tidemark.operators import sections as E
from tidemark.operators import validate as V

ADDRESSES = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "", "x", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
             "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "1::2::3", ":1::2", "1:::2", "fe80::1%eth0", "FE80::ABCD", "::ffff:10.0.0.1",
             "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.256", "12345::", "g::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "0.0.0.0",
             "255.255.255.255", None, "1.2.3.4 ", "::1.2.3.4", "2001:db8::10.0.0.1"]


def number(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_address_bits_match_python(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    for r in df.select("ip", AD.address_bits(F.col("ip")).alias("bits")).collect():
        want = number(r.ip) if r.ip is not None else None
        assert r.bits == (None if want is None else format(int(want), f"0{want.max_prefixlen}b")), r.ip


def random_networks(rnd, n):
    out = []
    for i in range(n):
        if rnd.random() < 0.5:
            out.append((i, f"10.{rnd.randrange(8)}.{rnd.randrange(4)}.{rnd.randrange(256)}/{rnd.choice([0, 4, 8, 13, 16, 22, 24, 31, 32])}"))
        else:
            out.append((i, f"2001:{rnd.randrange(4):x}:{rnd.randrange(4):x}::{rnd.randrange(9)}/{rnd.choice([3, 16, 30, 33, 48, 127, 128])}"))
    return out


def test_networks_match_python(spark):
    rnd = random.Random(5)
    nets = random_networks(rnd, 60)
    nets = [(i, c) for i, c in nets if not c.endswith(("/0", "/3", "/4")) or i > 50]
    bad = [(100, "10.0.0.0/33"), (101, "nonsense"), (102, "10.0.0.0/"), (103, None), (104, "10.0.0.0/8/8")]
    bare = [(105, "203.0.113.9"), (106, "2001:db9::7")]
    ips = [f"10.{rnd.randrange(8)}.{rnd.randrange(4)}.{rnd.randrange(256)}" for _ in range(200)]
    ips += [f"2001:{rnd.randrange(5):x}:{rnd.randrange(5):x}::{rnd.randrange(9)}" for _ in range(200)]
    ips += ["::ffff:10.0.0.1", "9.9.9.9", "203.0.113.9", "2001:db9:0::7", "none", None]
    table = spark.createDataFrame([*nets, *bad, *bare], "position int, cidr string")
    got = {r.ip: r.cidr for r in V.match_networks(spark.createDataFrame([(i,) for i in ips], "ip string"), table).collect()}
    for ip in set(ips):
        address = number(ip) if ip else None
        want = None
        if address is not None:
            want = next((c for _, c in [*nets, *bare] if address in ipaddress.ip_network(c, strict=False)), None)
        assert got.get(ip) == want, ip
    assert {r.position for r in V.invalid_networks(table).collect()} == {100, 101, 102, 103, 104}


def test_networks_meet_addresses_by_equality(spark):
    table = spark.createDataFrame(random_networks(random.Random(1), 30), "position int, cidr string")
    urls = spark.createDataFrame([("h", 1), ("g", 2), ("n", 3)], "host string, k int")
    dns = spark.createDataFrame([("h", "10.1.1.1"), ("g", "2001:1:1::1"), ("n", None)], "host string, ip string")
    out = V.flag_blocked_hosts(urls, dns, table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    fixed = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(V.BLOCKED_V4 + V.BLOCKED_V6)], "position int, cidr string")
    same = spark.createDataFrame([(f"h{i}", ip) for i, ip in enumerate(
        ["127.0.0.1", "10.1.2.3", "172.31.255.255", "172.32.0.1", "192.168.0.0", "169.254.169.254", "8.8.8.8", "::1", "fd12::1", "FE80::1", "fec0::1"])],
        "host string, ip string")
    hosts = same.select("host")
    a = V.flag_blocked_hosts(hosts, same).select("host", "reject_reason").collect()
    b = V.flag_blocked_hosts(hosts, same, fixed).select("host", "reject_reason").collect()
    assert sorted(a) == sorted(b)


WORDS = {r"/docs?(/|$)": "doc", r"/case-stud(y|ies)(/|$)": "case-stud", r"/docs|/api": "", r"docs": "", r"^/docs": "", r"/?docs": "",
         r"/(docs|api)": "", r"/LEARN": "learn", r"/a\(b|c\)": "", r"/x[|]y": "x", r"/foo{2}": "fo", r"/foo+": "fo", r"/a.b": "a",
         r"/x\d+": "x", r"/privacy[-_]?policy(/|$)": "privacy", r"/": "", r"": "", r"/v2/api": "v2"}


def test_rule_words(spark):
    df = spark.createDataFrame([(p,) for p in WORDS], "pattern string")
    assert {r.pattern: r.w for r in df.select("pattern", E.rule_word("pattern").alias("w")).collect()} == WORDS


def test_site_rules_match_python(spark):
    rnd = random.Random(3)
    sites = [f"s{i}" for i in range(6)]
    rules = [(rnd.choice(sites[:5]), f"N{rnd.randrange(5)}", rnd.choice(list(WORDS)), rnd.choice([None, 1, 2, 2, 9]), i) for i in range(60)]
    segments = ["doc", "docs", "Docs", "api", "case-study", "learn", "privacy-policy", "fooo", "foo", "x5", "xy", "a(b", "v2", "ab", "axb", ""]
    urls = [(rnd.choice(sites), i, "https://h/" + "/".join(rnd.choices(segments, k=rnd.randrange(4)))) for i in range(400)]
    pages = spark.createDataFrame([*urls, (None, 900, "https://h/docs"), ("s0", 901, "https://h")], "site string, rank int, url string")
    table = spark.createDataFrame([*rules, (None, "x", "/", 1, 0), ("s0", "x", None, 1, 0)],
                                  "site string, name string, pattern string, priority int, position int")
    out = E.with_site_sections(pages, table)
    default = {r["rank"]: r.section for r in E.with_section(pages).collect()}
    for r in out.collect():
        own = sorted(((-(p or 0), at, n, w) for s, n, w, p, at in rules if s == r.site))
        path = r.url[len("https://h"):].lower()
        if not own:
            assert r.section == default[r["rank"]]
            continue
        hit = next((n for _, _, n, w in own if re.search(w, path, re.IGNORECASE)), None)
        if hit is not None:
            assert r.section == hit, (r, own)
        assert r.is_rule == (r.section in {n for _, _, n, _ in own})
    assert out.count() == pages.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
