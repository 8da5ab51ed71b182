"""Address classes of IP literals: a literal becomes hex digits of fixed width, looked up among numbered ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the IANA registries of special addresses that are not public, and the classes they are given.
# A narrower range stands above a wider one; "public" ones are exceptions within others.
SPECIAL = {
    "unspecified": ("0.0.0.0/32", "::/128"),
    "loopback": ("127.0.0.0/8", "::1/128"),
    "link_local": ("169.254.0.0/16", "fe80::/10"),
    "multicast": ("224.0.0.0/4", "ff00::/8"),
    "private": (
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
        "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7",
    ),
    "reserved": ("240.0.0.0/4", "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9"),
    "public": ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"),
}


def _ranges(version: int) -> list[tuple[int, str, str, str]]:
    """(length of prefix, first, last, class) with both ends as hex digits."""
    width = 8 if version == 4 else 32
    nets = [(ipaddress.ip_network(n), kind) for kind, names in SPECIAL.items() for n in names]
    return [(n.prefixlen, f"{int(n[0]):0{width}x}", f"{int(n[-1]):0{width}x}", kind) for n, kind in nets if n.version == version]


def v4_digits(raw: Column) -> Column:
    """8 hex digits of a dotted address (four decimal numbers without leading zeros), else null."""
    parts = F.split(raw, r"\.", -1)
    octet = r"(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    digits = F.array_join(F.transform(parts, lambda p: F.lower(F.lpad(F.hex(p.try_cast("int")), 2, "0"))), "")
    return F.when(raw.rlike(rf"^{octet}(\.{octet}){{3}}\z"), digits)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def v6_digits(raw: Column) -> Column:
    """32 hex digits of a colon address, "::" and a dotted tail expanded, else null. A zone after % is cut off."""
    group = "[0-9A-Fa-f]{1,4}"
    groups = lambda s: F.filter(F.split(s, ":", -1), lambda g: g != "")

    def with_tail(bare: Column) -> Column:
        tail = v4_digits(F.regexp_extract(bare, r":([0-9.]*\.[0-9.]*)\z", 1))
        colons = _let(tail, lambda t: F.concat(F.regexp_replace(bare, r"[0-9.]*\z", ""), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
        return F.when(bare.contains("."), colons).otherwise(bare)

    def parts(plain: Column) -> Column:
        halves = F.split(plain, "::", -1)
        good = plain.rlike(rf"^({group}(:{group})*)?(::({group}(:{group})*)?)?\z")
        return F.when(good, F.struct(F.size(halves).alias("n"), groups(F.get(halves, F.lit(0))).alias("left"), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right")))

    def digits(p: Column) -> Column:
        missing = 8 - F.size(p["left"]) - F.size(p["right"])
        whole = F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["right"])
        fits = F.when(p["n"] == 2, missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))

    return _let(_let(with_tail(F.regexp_replace(raw, r"%[^%]+\z", "")), parts), digits)


def _class(digits: Column, version: int) -> Column:
    ranges = F.array(*[F.struct(F.lit(-n).alias("wide"), F.lit(kind).alias("kind"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi, kind in _ranges(version)])
    return F.coalesce(F.array_min(F.filter(ranges, lambda r: (r["lo"] <= digits) & (digits <= r["hi"])))["kind"], F.lit("public"))


def address_class(raw: Column) -> Column:
    """Class of an IP literal by the narrowest range that holds it, 'public' if none does; 'invalid' for what is no literal, null too.

    IPv4 addresses written as IPv6 (::ffff:0:0/96) are reserved, so never public. Names aren't resolved.
    """
    both = F.struct(v4_digits(raw).alias("four"), v6_digits(raw).alias("six"))
    return _let(both, lambda d: F.when(d["four"].isNotNull(), _class(d["four"], 4)).when(d["six"].isNotNull(), _class(d["six"], 6)).otherwise("invalid"))


def all_public(literals: Column) -> Column:
    """Whether an array of literals has any and all are public."""
    return (F.size(literals) > 0) & F.forall(literals, lambda a: address_class(a) == "public")
