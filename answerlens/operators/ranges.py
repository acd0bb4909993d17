"""Addresses against a table of address ranges, by longest prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import ipv4_number
from .mentions import may_name

#: Ranges this short hold large shares of all addresses; their keys are dealt over so many salts.
WIDE_BITS, SALTS = 16, 64
_DOTTED = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _v4_hex(ip: Column) -> Column:
    return F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0"))


def _v6_hex(ip: Column) -> Column:
    """32 digits of an IPv6 text without brackets; NULL where it is none."""

    def plain(tail: Column) -> Column:  # a dotted tail becomes two groups
        digits = _v4_hex(tail)
        groups = F.concat(F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))
        return F.when(tail == "", ip).otherwise(F.concat(F.substr(ip, F.lit(1), F.length(ip) - F.length(tail)), groups))

    def side(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def groups(halves: Column) -> Column:
        left, right = side(F.get(halves, 0)), side(F.coalesce(F.get(halves, 1), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        short = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
        return F.when(F.size(halves) == 1, left).when((F.size(halves) == 2) & (missing > 0), short)

    def digits(parts: Column) -> Column:
        good = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ""))

    whole = _with(F.regexp_extract(ip, _DOTTED, 0), plain)
    return F.when(F.contains(ip, F.lit(":")), _with(_with(F.split(whole, "::", -1), groups), digits))


def address_hex(ip: Column) -> Column:
    """8 or 32 hexadecimal digits of an IPv4 or IPv6 address, lower case; NULL for anything else.

    Brackets and a zone are left off, and an IPv4 address mapped into IPv6 counts as IPv4.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(ip), r"^\[(.*)\]$", "$1"), "%[^/]*$", "")

    def either(x: Column) -> Column:
        return F.coalesce(_v4_hex(x), _with(_v6_hex(x), lambda v: F.when(v.startswith("0" * 20 + "ffff"), F.substring(v, 25, 8)).otherwise(v)))

    return _with(bare, either)


def prefix_of(digits: Column, bits: Column) -> Column:
    """The first ``bits`` of hexadecimal digits, the rest of the last digit cleared."""
    whole, odd = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.element_at(F.array(*[F.lit(n) for n in (1, 8, 4, 2)]), odd + 1)
    last = F.when(odd > 0, F.lower(F.hex((digit - F.pmod(digit, step)).cast("long")))).otherwise("")
    return F.concat(F.substr(digits, F.lit(1), whole), last)


def range_keys(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Adds ``width`` (digits of an address), ``bits`` and ``prefix``; malformed ranges are left out."""
    place, size = F.split_part(cidr, F.lit("/"), F.lit(1)), F.split_part(cidr, F.lit("/"), F.lit(2))
    mapped = F.contains(place, F.lit(":")) & (F.length(address_hex(place)) == 8)
    bits = F.when(size.rlike("^[0-9]{1,3}$"), size.try_cast("int")) - F.when(mapped, 96).otherwise(0)
    known = ranges.withColumns({"_digits": address_hex(place), "bits": bits})
    good = known.where(F.col("_digits").isNotNull() & F.col("bits").between(F.lit(0), F.length("_digits") * 4))
    return good.withColumns({"width": F.length("_digits"), "prefix": prefix_of(F.col("_digits"), F.col("bits"))}).drop("_digits")


def address_ranges(addresses: DataFrame, ranges: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """``(ip, cidr, bits, narrowest)``: each different address with every range that holds it, the narrowest ones marked.

    Ranges are keyed by (width, bits, masked prefix). An address asks for one key for each length that occurs
    (161 at most), so the join is on equal keys and never a comparison of all pairs; keys that no range has are left out before
    the shuffle, by a filter of 128 KB. Each address is looked up once however many
    rows have it, and the keys of wide ranges, which hold most addresses, are salted. Malformed addresses and ranges match nothing;
    equal ranges written in two ways are both there.
    """
    keyed = range_keys(ranges.select(F.col(cidr).alias("cidr")).distinct())
    lengths = sorted((r["width"], r["bits"]) for r in keyed.select("width", "bits").distinct().collect())  # 33 + 129 at most
    wide = F.col("bits") < WIDE_BITS
    key = F.concat_ws("/", "width", "bits", "prefix").alias("key")
    held = keyed.select(key)
    keyed = keyed.withColumn("salt", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    known = addresses.select(F.col(ip).alias("ip")).distinct().withColumn("_digits", address_hex(F.col("ip"))).where("_digits IS NOT NULL")
    sizes = {w: F.array(*[F.lit(b) for v, b in lengths if v == w]).cast("array<int>") for w in (8, 32)}
    asked = known.withColumn("width", F.length("_digits")).withColumn("bits", F.explode(F.when(F.col("width") == 8, sizes[8]).otherwise(sizes[32])))
    asked = asked.withColumns({
        "prefix": prefix_of(F.col("_digits"), F.col("bits")),
        "salt": F.when(wide, F.pmod(F.xxhash64("ip"), F.lit(SALTS))).otherwise(0).cast("int"),
    })
    asked = may_name(asked.select("ip", "width", "bits", "prefix", "salt", key), held)
    found = asked.join(keyed, ["width", "bits", "prefix", "salt"]).select("ip", "cidr", "bits")
    most = F.max("bits").over(Window.partitionBy("ip"))  # rows of one address: the ranges that hold it
    return found.withColumn("narrowest", F.col("bits") == most)


def in_ranges(rows: DataFrame, ranges: DataFrame, ip: str = "ip", cidr: str = "cidr") -> DataFrame:
    """Rows whose address lies in some range."""
    held = address_ranges(rows, ranges, ip, cidr).select(F.col("ip").alias("_ip")).distinct()
    return rows.join(held, F.col(ip) == F.col("_ip"), "left_semi")
