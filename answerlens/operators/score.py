"""Pillar roll-up, overall score, ceilings and grades; all evaluated in the site's row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import CAP_ALL_BLOCKED, CAP_PRIMARY_BLOCKED, CHECKS, PILLARS
from ..functions.dates import grade_for
from ..functions.fragments import q
from .ranking import carry_forward


def _pillar_sql(pos: int, pillar: dict) -> str:
    own = f"filter(checks, c -> c.pillar = '{pillar['id']}')"
    total = "aggregate(own, 0D, (a, c) -> a + c.weight)"
    earned = "aggregate(own, 0D, (a, c) -> a + c.score * c.weight)"
    struct = (
        f"named_struct('pos', {pos}, 'id', '{pillar['id']}', 'label', '{pillar['label']}', "
        f"'weight', {pillar['weight']}, 'score', cast(floor(ratio * 100 + 0.5D) AS INT), "
        f"'points', floor(ratio * {pillar['weight']} * 100 + 0.5D) / 100, 'n_checks', size(own), "
        f"'check_weight', {total})"
    )
    ratio = f"if(size(own) > 0, {earned} / {total}, 0D)"
    return f"get(transform(array({own}), own -> get(transform(array({ratio}), ratio -> {struct}), 0)), 0)"


_PILLARS_SQL = "array(" + ", ".join(_pillar_sql(i, p) for i, p in enumerate(PILLARS)) + ")"
_BLOCKED = "transform(filter(access, a -> NOT a.allowed AND a.is_primary), a -> a.ua)"


def with_score(checked: DataFrame) -> DataFrame:
    """Adds pillars, raw and capped overall, ceiling, grade and summary."""
    rolled = checked.withColumns({"pillars": F.expr(_PILLARS_SQL), "blocked": F.expr(_BLOCKED)}).withColumns(
        {
            "applicable": F.expr("filter(pillars, p -> p.n_checks > 0)"),
            "cap": F.expr(
                f"CASE WHEN everyone_blocked AND NOT exists(access, a -> a.allowed) THEN {CAP_ALL_BLOCKED} "
                f"WHEN size(blocked) > 0 THEN {CAP_PRIMARY_BLOCKED} END"
            ),
        }
    )
    totals = rolled.withColumns(
        {
            "weight_sum": F.expr("aggregate(applicable, 0, (a, p) -> a + p.weight)"),
            # Sums the points after they were rounded.
            "point_sum": F.expr("aggregate(applicable, 0D, (a, p) -> a + p.points)"),
        }
    )
    raw = F.expr("if(weight_sum > 0, cast(floor(point_sum / weight_sum * 100 + 0.5D) AS INT), 0)")
    capped = totals.withColumn("raw_overall", raw).withColumn("overall", F.expr("least(raw_overall, cap)"))
    reason = (
        f"CASE WHEN cap = {CAP_ALL_BLOCKED} THEN 'A blanket rule in robots.txt keeps every engine out; the score "
        "stays capped until it is removed.' "
        "ELSE concat(array_join(blocked, ', '), if(size(blocked) = 1, ' is', ' are'), ' blocked in robots.txt; the "
        f"score stays capped at {CAP_PRIMARY_BLOCKED} until access is restored.') END"
    )
    return (
        capped.withColumn("ceiling_reason", F.expr(f"if(overall < raw_overall, {reason}, NULL)"))
        .withColumn("grade", grade_for(F.col("overall")))
        .withColumn("summary", F.expr(_SUMMARY_SQL))
    )


# The two weakest pillars, ties in pillar order.
_WEAKEST = (
    "array_join(transform(slice(array_sort(transform(applicable, p -> named_struct('score', p.score, 'pos', p.pos, "
    "'label', lower(p.label)))), 1, 2), w -> w.label), ' and ')"
)
_SUMMARY_SQL = (
    "CASE WHEN ceiling_reason IS NOT NULL THEN concat(overall, '/100. ', ceiling_reason) "
    f"WHEN overall >= 85 THEN concat('Ready for AI search at ', overall, '/100; what is left lies in ', {_WEAKEST}, '.') "
    f"WHEN overall >= 65 THEN concat('Usable at ', overall, '/100; held back by ', {_WEAKEST}, '.') "
    f"WHEN overall >= 40 THEN concat('Held down to ', overall, '/100 above all by ', {_WEAKEST}, '.') "
    f"ELSE concat('Only ', overall, '/100: begin with ', {_WEAKEST}, '.') END"
)


def pillar_rows(scored: DataFrame, key: str = "site_id") -> DataFrame:
    return scored.selectExpr(key, "explode(slice(pillars, 1, 8)) AS p").select(key, "p.*")


_LABELS = "map(" + ", ".join(f"{q(c[0])}, {q(c[5])}" for c in CHECKS) + ")"


def serialise_pillars(scored: DataFrame, key: str = "site_id") -> DataFrame:
    """The nested pillar and check document that an audit row stores."""
    checks = (
        f"transform(filter(checks, c -> c.pillar = p.id), c -> named_struct('code', c.code, 'label', element_at({_LABELS}, c.code), 'score', c.score, "
        "'weight', c.weight, 'passed', c.passed, 'detail', c.detail))"
    )
    doc = F.to_json(
        F.struct(
            "overall",
            "raw_overall",
            "ceiling_reason",
            F.col("cap").alias("ceiling_cap"),
            "grade",
            "summary",
            F.expr(
                "transform(pillars, p -> named_struct('id', p.id, 'label', p.label, 'weight', p.weight, "
                f"'score', p.score, 'points', p.points, 'checks', {checks}))"
            ).alias("pillars"),
        )
    )
    return scored.select(key, doc.alias("pillar_scores"))


def previous_scores(audits: DataFrame) -> DataFrame:
    """Each audit with the score of the last complete audit of its site before it started, and the delta.

    An as-of lookup: completions and starts share a timeline per site and the last completed score is
    carried forward, by day so that a site with most of the audits is spread over tasks.
    """
    starts = audits.filter("site_id IS NOT NULL").select(
        "site_id", F.col("started_at").alias("at"), F.lit(1).alias("kind"), "audit_id",
        F.lit(None).cast("int").alias("carried"), F.col("overall_score").cast("int").alias("own"),
        (F.col("status") == "complete").alias("done"),
    )
    ends = audits.filter("site_id IS NOT NULL AND status = 'complete' AND overall_score IS NOT NULL").select(
        "site_id", F.col("completed_at").alias("at"), F.lit(0).alias("kind"), "audit_id",
        F.col("overall_score").cast("int").alias("carried"), F.lit(None).cast("int").alias("own"),
        F.lit(None).cast("boolean").alias("done"),
    )
    line = carry_forward(
        starts.unionByName(ends), "site_id", F.to_date("at"), ["at", "kind", "audit_id"], "carried", "previous_score"
    )
    return line.filter("kind = 1").select(
        "audit_id",
        "site_id",
        F.col("own").alias("overall_score"),
        "previous_score",
        F.when(F.col("done"), F.col("own") - F.col("previous_score")).alias("score_delta"),
    )
