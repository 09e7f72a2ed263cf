"""IP addresses and networks as strings of bits.

A prefix of the bits is a network, so "address in network" is an equality of
two strings: 32 characters for IPv4, 128 for IPv6.  Text that is no address
gives NULL.  An IPv4 part has no leading zeros; an IPv6 address may be
shortened by ``::``, end in an IPv4 address or carry a zone (``%eth0``).  The
families never match each other, mapped addresses included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_PART}(\.{_PART}){{3}}"
_GROUP = "^[0-9A-Fa-f]{1,4}$"


def _binary(number: Column, base: int, width: int) -> Column:
    return F.lpad(F.conv(number, base, 2), width, "0")


def _groups(half: Column) -> Column:
    """16-bit groups of one side of ``::``, which may be empty."""
    return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once; plain nesting would repeat it wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(octets: Column, i: int) -> Column:
    """Two octets of an IPv4 address as one 16-bit group."""
    return F.lower(F.hex(F.get(octets, F.lit(i)).cast("int") * 256 + F.get(octets, F.lit(i + 1)).cast("int")))


def _grouped(text: Column) -> Column:
    """The text with an IPv4 address at its end turned into groups."""
    def with_tail(tail: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        turned = _let(F.split(tail, r"\."), lambda o: F.concat(head, _pair(o, 0), F.lit(":"), _pair(o, 2)))
        return F.when(tail == "", text).otherwise(turned)

    return _let(F.regexp_extract(text, rf":({_V4})$", 1), with_tail)


def _joined(halves: Column) -> Column:
    """Bits of the groups on both sides of ``::`` (or of the only side)."""
    def bits(sides: Column) -> Column:
        left, right, n = sides["left"], sides["right"], sides["n"]
        known = F.size(left) + F.size(right)
        whole = F.when(n == 1, known == 8).otherwise((n == 2) & (known < 8))
        groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - known, F.lit(0))), right)
        good = whole & F.forall(groups, lambda g: g.rlike(_GROUP))
        return F.when(good, F.array_join(F.transform(groups, lambda g: _binary(g, 16, 16)), ""))

    return _let(F.struct(_groups(halves[0]).alias("left"), _groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right"),
                         F.size(halves).alias("n")), bits)


def v4_bits(ip: Column) -> Column:
    parts = F.transform(F.split(ip, r"\."), lambda p: _binary(p, 10, 8))
    return F.when(ip.rlike(f"^{_V4}$"), F.array_join(parts, ""))


def v6_bits(ip: Column) -> Column:
    text = _let(F.regexp_replace(ip, "%[^%]+$", ""), _grouped)
    return F.when(ip.contains(":"), _let(F.split(text, "::", -1), _joined))


def address_bits(ip: Column) -> Column:
    return F.coalesce(v4_bits(ip), v6_bits(ip))


def network(cidr: Column) -> Column:
    """(family, prefix) of a network: its leading bits; host bits are cut off, a bare address is a network of one."""
    given = F.regexp_extract(cidr, r"^[^/]+/([0-9]{1,3})$", 1)

    def cut(bits: Column) -> Column:
        n = F.when(~cidr.contains("/"), F.length(bits)).when(given != "", given.cast("int"))
        prefix = F.when(n <= F.length(bits), F.substring(bits, F.lit(1), n))
        return F.struct(family(bits).alias("family"), prefix.alias("prefix"))

    return _let(address_bits(F.split_part(cidr, F.lit("/"), F.lit(1))), cut)


def family(bits: Column) -> Column:
    """4 or 6, of the bits of an address."""
    return F.when(F.length(bits) == 32, 4).when(F.length(bits) == 128, 6)
