"""Addresses and networks (N1 to N7). Built-in functions only."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstream.plans.shared import small

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"

# Networks of a sensor's own surroundings.
LOCAL = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.168.0.0/16", "::/128", "::1/128", "fc00::/7", "fe80::/10",
]
# Special-purpose networks that are not globally routable.
SPECIAL = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "224.0.0.0/4", "::/128", "::1/128", "::ffff:0:0/96",
    "64:ff9b:1::/48", "100::/64", "2001:db8::/32", "2001:2::/48", "fc00::/7", "fe80::/10", "ff00::/8",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number, else null."""
    number = let(F.split(ip, r"\."), lambda p: sum((F.get(p, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(p, F.lit(0)).try_cast("long") * (1 << 24)))
    return F.when(is_ipv4(ip), number)


def ipv6_key(ip: Column) -> Column:
    """32 hex digits of an IPv6 address, null for anything else, a scope or over 45 characters."""
    tail = F.regexp_extract(ip, r":([0-9]+(\.[0-9]+){3})$", 1)
    last = F.lower(F.lpad(F.hex(ipv4_number(tail)), 8, "0"))
    hexed = F.concat(F.expr("''"), F.regexp_replace(ip, r"[0-9]+(\.[0-9]+){3}$", ""), F.substring(last, 1, 4), F.lit(":"), F.substring(last, 5, 4))
    plain = F.when(tail == "", ip).otherwise(hexed)

    def pieces(x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def joined(halves: Column) -> Column:
        left, right, n = pieces(F.get(halves, F.lit(0))), pieces(F.get(halves, F.lit(1))), F.size(halves)

        def filled(x: Column) -> Column:
            have = F.size(x.l) + F.size(x.r)
            all_ = F.concat(x.l, F.array_repeat(F.lit("0"), F.when(n == 2, 8 - have).otherwise(0)), x.r)
            key = F.lower(F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), ""))
            ok = ((n == 1) & (have == 8) | (n == 2) & (have <= 7)) & F.forall(all_, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
            return F.when(ok, key)

        return let(F.struct(left.alias("l"), right.alias("r")), filled)

    return F.when(ip.contains(":") & ~ip.contains("%") & (F.length(ip) <= 45), let(F.split(plain, "::"), joined))


def _ipv6_text(key: Column) -> Column:
    """Canonical text of 32 hex digits: no leading zeros, the first longest run of zero groups as ::."""
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(key, i * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")

    def short(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
            out = F.when(text.rlike(run), F.regexp_replace(text, f"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
        return out

    return F.when(key.isNotNull(), let(groups, short))


def _dotted(key: Column) -> Column:
    """The last 32 bits of 32 hex digits as IPv4 text."""
    return F.concat_ws(".", *[F.conv(F.substring(key, i, 2), 16, 10) for i in (25, 27, 29, 31)])


def normalise_ip(ip: Column) -> Column:
    """Canonical text with IPv4-in-IPv6 unwrapped, or null."""

    def text(key: Column) -> Column:
        return F.when(key.startswith("0" * 20 + "ffff"), _dotted(key)).otherwise(_ipv6_text(key))

    return let(F.trim(ip), lambda x: F.when(is_ipv4(x), x).when(x.contains(":"), let(ipv6_key(x), text)))


def canonical_ip(ip: Column) -> Column:
    """Canonical text of an address of either version, or null."""
    mapped = lambda x: F.when(x.startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), _dotted(x))).otherwise(_ipv6_text(x))
    return let(F.trim(ip), lambda x: F.when(is_ipv4(x), x).when(x.contains(":"), let(ipv6_key(x), mapped)))


def ip_key(ip: Column) -> Column:
    """(version, 32 hex digits): sorts addresses by number, IPv4 first."""
    pair = lambda version, key: F.struct(F.lit(version).alias("version"), key.alias("key"))
    v4 = F.lpad(F.lower(F.hex(ipv4_number(ip))), 32, "0")
    return F.when(is_ipv4(ip), pair(4, v4)).when(ip.contains(":"), let(ipv6_key(ip), lambda k: F.when(k.isNotNull(), pair(6, k))))


def parse_networks(text: str) -> list[str]:
    """Networks of a text list: commas, semicolons or lines, # comments; raises ValueError naming the first bad one."""
    found = []
    for part in text.replace(";", ",").replace("\n", ",").split(","):
        part = part.split("#")[0].strip()
        if part:
            try:
                found.append(str(ipaddress.ip_network(part, strict=False)))
            except ValueError as e:
                raise ValueError(f"not an address or network: {part}") from e
    return found


def _bounds(cidr: str) -> tuple[int, str, str, int]:
    n = ipaddress.ip_network(cidr, strict=False)
    return n.version, f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}", n.prefixlen


def network_table(spark: SparkSession, networks: list[str]) -> DataFrame:
    """(version, lo, hi, prefix, network) of CIDR texts."""
    return spark.createDataFrame([(*_bounds(n), n) for n in networks], "version int, lo string, hi string, prefix int, network string")


def _within(key: Column, networks: list[str], version: int) -> Column:
    """Whether a key (a number, or 32 hex digits) is in one of a few networks, as an expression."""
    bounds = [_bounds(n) for n in networks]
    own = [(int(lo, 16), int(hi, 16)) if v == 4 else (lo, hi) for v, lo, hi, _ in bounds if v == version]
    return let(key, lambda x: reduce(lambda a, b: a | b, [x.between(F.lit(lo), F.lit(hi)) for lo, hi in own], F.lit(False)))


def _class(ip: Column, networks: list[str]) -> Column:
    """Whether an address is in the networks, IPv4-in-IPv6 unwrapped; null if it is no address."""
    return let(normalise_ip(ip), lambda x: F.when(is_ipv4(x), _within(ipv4_number(x), networks, 4)).when(x.isNotNull(), _within(ipv6_key(x), networks, 6)))


def is_internal(ip: Column, extra: list[str] = ()) -> Column:
    """Local networks and the operator's own; null, unreadable or scoped addresses are not internal."""
    return F.coalesce(_class(ip, [*LOCAL, *extra]), F.lit(False))


def is_public(ip: Column) -> Column:
    """Globally routable and no multicast (N4); null or unreadable is not."""
    return ~F.coalesce(_class(ip, SPECIAL), F.lit(True))


def in_networks(df: DataFrame, ip: str, networks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose address is in one of ``networks`` (N6), or (left_anti) in none; the test runs on distinct addresses."""
    own = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_key", ip_key(F.col("_ip")))
    nets = small(networks.select("version", "lo", "hi"), 10_000)
    hit = own.join(nets, (F.col("_key.version") == F.col("version")) & F.col("_key.key").between(F.col("lo"), F.col("hi"))).select("_ip").distinct()
    return df.join(hit, df[ip] == hit["_ip"], how)


def longest_prefix(df: DataFrame, ip: str, networks: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of the most specific of ``networks`` (lo, hi, version, prefix) around the address.

    An equi-join for each prefix length that occurs: an address cut to a length's digits meets the networks of that
    length, so no address is compared with networks it can't be in. There are at most 129 lengths.
    """
    own = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_k", ip_key(F.col("_ip"))).where("_k is not null")
    nibble = F.floor((F.col("prefix") + F.when(F.col("version") == 4, 96).otherwise(0)) / 4).cast("int")
    nets = networks.withColumn("_nibbles", nibble)
    lengths = nets.select("version", "_nibbles").distinct()
    asked = own.join(F.broadcast(lengths), F.col("_k.version") == F.col("version")).withColumn("_cut", F.expr("substring(_k.key, 1, _nibbles)"))
    nets = nets.withColumn("_cut", F.expr("substring(lo, 1, _nibbles)"))
    found = asked.join(nets, ["version", "_nibbles", "_cut"]).where(F.col("_k.key").between(F.col("lo"), F.col("hi")))
    best = found.groupBy("_ip").agg(F.max_by(F.struct(*columns), F.struct("prefix", "lo")).alias("_best"))
    return df.join(best, df[ip] == best["_ip"], "left").select(df["*"], *[F.col(f"_best.{c}").alias(c) for c in columns])
