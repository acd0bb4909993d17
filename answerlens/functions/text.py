"""Text and number helpers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a web browser's `\s` matches, as the inside of a character class.
SPACE_CHARS = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACES = f"[{SPACE_CHARS}]+"


def lit_map(pairs: dict) -> Column:
    """A map literal from a small fixed dictionary."""
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def js_round(x: Column, digits: int = 0) -> Column:
    """Half-up rounding towards +infinity."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio_round(num: Column, den: Column, scale: int, div: int) -> Column:
    """``round_half_up(scale * num / den) / div`` on non-negative integers, exact; 0 when den is 0."""
    n, d = num.cast("bigint"), den.cast("bigint")
    top = n * F.lit(2 * scale) + d
    units = (top - F.pmod(top, d * 2)) / (d * 2)
    return F.when(d > 0, F.rint(units) / F.lit(float(div))).otherwise(F.lit(0.0))


def percent_1dp(num: Column, den: Column) -> Column:
    """``num / den`` as a percentage with one decimal, half up, 0 when there is no denominator."""
    return ratio_round(num, den, 1000, 10)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trim_ws(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACES}|{SPACES}$", "")


def collapse_ws(x: Column) -> Column:
    """Runs of white space to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def word_count(collapsed: Column) -> Column:
    """Words of a text whose white space is already collapsed."""
    return F.when(collapsed == "", F.lit(0)).otherwise(F.size(F.split(collapsed, " ", -1)))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)
