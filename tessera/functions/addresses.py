"""Network addresses as column expressions: parsing, canonical text, and whether they are public."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that are not public (first address, prefix length).
RESERVED_IPV4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
RESERVED_IPV6 = (
    ("::", 128), ("::1", 128), ("::", 96), ("64:ff9b::", 96), ("64:ff9b:1::", 48), ("100::", 64), ("2001::", 23),
    ("2001:2::", 48), ("2001:20::", 28), ("2001:db8::", 32), ("3fff::", 20), ("2002::", 16), ("fc00::", 7),
    ("fec0::", 10), ("fe80::", 10), ("ff00::", 8),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used; the plan holds it once, too."""
    return F.transform(F.array(value), use)[0]


def ipv4_number(text: Column) -> Column:
    def count(t: Column) -> Column:
        parts = F.transform(F.split(t, r"\."), lambda p: p.try_cast("long"))
        whole = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: F.when((n >= 0) & (p <= 255), n * 256 + p).otherwise(F.lit(-1).cast("long")))
        return F.when(t.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$"), let(whole, lambda n: F.when(n >= 0, n)))

    return let(text, count)


def _public_ipv4(number: Column) -> Column:
    low = {first: int(ipaddress.IPv4Address(first)) for first, _ in RESERVED_IPV4}
    return ~reduce(lambda a, b: a | b, [number.between(low[first], low[first] + (1 << (32 - bits)) - 1) for first, bits in RESERVED_IPV4])


def public_ipv4(text: Column) -> Column:
    return let(ipv4_number(text), lambda n: n.isNotNull() & _public_ipv4(n))


def ipv6_groups(text: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, which may end in a dotted IPv4 one; NULL if it is none."""
    none = F.expr("cast(array() as array<string>)")

    def side(t: Column) -> Column:
        return F.when(t == "", none).otherwise(F.split(t, ":"))

    def hexed(t: Column) -> Column:
        def with_tail(tail: Column) -> Column:
            head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
            return let(ipv4_number(tail), lambda n: F.concat(head, F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))

        return F.when(F.contains(t, F.lit(".")), let(F.regexp_extract(t, r":([0-9.]*\.[0-9.]*)$", 1), with_tail)).otherwise(t)

    def joined(halves: Column) -> Column:
        packed = F.size(halves) == 2
        sides = F.struct(side(F.get(halves, F.lit(0))).alias("left"), F.when(packed, side(F.get(halves, F.lit(1)))).otherwise(none).alias("right"))

        def filled(s: Column) -> Column:
            missing = 8 - F.size(s["left"]) - F.size(s["right"])
            sound = (F.size(halves) <= 2) & F.when(packed, missing >= 1).otherwise(missing == 0)
            return F.when(sound, F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"]))

        return let(sides, filled)

    def read(t: Column) -> Column:
        groups = let(F.split(hexed(t), "::"), joined)
        numbers = F.transform(groups, lambda g: F.when(g.rlike("^[0-9a-fA-F]{1,4}$"), F.conv(g, 16, 10).cast("int")))
        return F.when(t.rlike("^[0-9a-fA-F:.]{1,64}$"), let(numbers, lambda x: F.when(F.forall(x, lambda g: g.isNotNull()), x)))

    return let(text, read)


def ipv6_text(text: Column) -> Column:
    """Canonical text of an IPv6 address: lower-case groups, the first longest run of zero groups as ``::``."""

    def write(groups: Column) -> Column:
        # zeros from each place on, last place first
        runs = F.aggregate(F.reverse(groups), F.expr("cast(array() as array<int>)"), lambda acc, g: F.concat(F.array(F.when(g == 0, F.coalesce(F.get(acc, F.lit(0)), F.lit(0)) + 1).otherwise(0)), acc))
        best = let(runs, lambda r: F.struct(F.array_max(r).alias("n"), (F.array_position(r, F.array_max(r)) - 1).cast("int").alias("at")))

        def joined(b: Column) -> Column:
            hexed = F.transform(groups, lambda g: F.lower(F.hex(g)))
            short = F.concat(F.array_join(F.slice(hexed, F.lit(1), b["at"]), ":"), F.lit("::"), F.array_join(F.slice(hexed, b["at"] + b["n"] + 1, F.lit(8) - b["at"] - b["n"]), ":"))
            return F.when(b["n"] >= 2, short).otherwise(F.array_join(hexed, ":"))

        return F.when(groups.isNotNull(), let(best, joined))

    return let(ipv6_groups(text), write)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _in_ipv6_range(x: Column, first: str, bits: int) -> Column:
    """Whether an address (hi, lo: its halves) begins with the first ``bits`` bits of another."""
    hi, lo = divmod(int(ipaddress.IPv6Address(first)), 1 << 64)
    if bits <= 64:
        return F.shiftrightunsigned(x["hi"], 64 - bits) == _signed(hi >> (64 - bits)) if bits < 64 else x["hi"] == _signed(hi)
    return (x["hi"] == _signed(hi)) & (F.shiftrightunsigned(x["lo"], 128 - bits) == _signed(lo >> (128 - bits)) if bits < 128 else x["lo"] == _signed(lo))


def public_ipv6(text: Column) -> Column:
    """Whether an IPv6 address is public; a mapped IPv4 address goes by the IPv4 ranges."""

    def half(groups: Column, start: int) -> Column:
        return F.aggregate(F.slice(groups, start, 4), F.lit(0).cast("long"), lambda n, g: F.shiftleft(n, 16).bitwiseOR(g.cast("long")))

    def judge(x: Column) -> Column:
        denied = reduce(lambda a, b: a | b, [_in_ipv6_range(x, first, bits) for first, bits in RESERVED_IPV6])
        mapped = _in_ipv6_range(x, "::ffff:0:0", 96)
        return F.when(mapped, let(x["lo"].bitwiseAND(F.lit(0xFFFFFFFF)), _public_ipv4)).otherwise(~denied)

    both = let(ipv6_groups(text), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))
    return F.coalesce(let(both, lambda x: F.when(x.isNotNull(), judge(x))), F.lit(False))


def public_address(text: Column) -> Column:
    """Whether a text is a public IPv4 or IPv6 address; what is no address is not public."""
    return F.coalesce(let(text, lambda t: let(ipv4_number(t), lambda n: F.when(n.isNotNull(), _public_ipv4(n)).otherwise(public_ipv6(t)))), F.lit(False))
