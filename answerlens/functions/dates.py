"""Date, grade and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ENGINE_LABELS, GRADE_BANDS, PILLARS
from .text import lit_map


def period_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def relative_age(ts: Column, as_of: Column) -> Column:
    """Largest whole unit since ``ts``: minute, hour, day, week, month."""
    secs = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))
    out = F.when(ts.isNull(), F.lit("never"))
    for size, unit in ((2592000, "month"), (604800, "week"), (86400, "day"), (3600, "hour"), (60, "minute")):
        n = F.floor(secs / size)
        text = F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago")))
        out = out.when(secs >= size, text)
    return out.otherwise(F.lit("just now"))


def grade_for(score: Column) -> Column:
    out = None
    for floor, grade in GRADE_BANDS:
        out = F.when(score >= floor, grade) if out is None else out.when(score >= floor, grade)
    return out.otherwise(F.lit("F"))


def score_tone(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "warn").otherwise(F.lit("bad"))


def engine_label(engine: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(ENGINE_LABELS), engine), engine)


def pillar_label(pillar: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map({p["id"]: p["label"] for p in PILLARS}), pillar), pillar)


def severity_label(severity: Column) -> Column:
    return F.initcap(severity)


# Display names of efforts.
EFFORT_LABELS = {"low": "Quick win", "medium": "Half-day", "high": "Dev project"}


def effort_label(effort: Column) -> Column:
    return F.try_element_at(lit_map(EFFORT_LABELS), effort)
