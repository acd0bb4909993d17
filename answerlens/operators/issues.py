"""Issues, their order, and what is recommended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import EFFORT_DIVISOR, SEVERITY_RANK, fix_catalogue
from ..functions.fragments import let
from .ranking import row_number_by_range

_DIVISOR = "CASE i.effort " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in EFFORT_DIVISOR.items()) + " END"
_RANK = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " END"


def with_issues(scored: DataFrame) -> DataFrame:
    """Adds ``issues``: unearned checks with impact and priority, in report order.

    At most thirty per site, so they are derived and sorted inside the row.
    """
    impact = "floor((1D - c.score) * (c.weight / p.check_weight) * (p.weight / weight_sum) * 10000 + 0.5D) / 100"
    derived = (
        "transform(filter(checks, c -> c.score < 0.999D), c -> "
        + let(
            "get(filter(pillars, p -> p.id = c.pillar), 0)",
            "p",
            "named_struct('pos', c.pos, 'code', c.code, 'pillar', c.pillar, 'severity', c.severity, 'effort', c.effort, "
            f"'title', c.title, 'detail', c.detail, 'check_score', c.score, 'impact_points', {impact})",
        )
        + ")"
    )
    prioritised = f"transform({derived}, i -> named_struct('i', i, 'priority', floor(i.impact_points / ({_DIVISOR}) * 100 + 0.5D) / 100))"
    # Criticals first, then priority, then severity, then catalogue order.
    ordered = (
        f"array_sort(transform({prioritised}, x -> named_struct('not_critical', if(x.i.severity = 'critical', 0, 1), "
        f"'by_priority', -x.priority, 'severity_rank', {_RANK.format('x.i.severity')}, 'pos', x.i.pos, "
        "'code', x.i.code, 'pillar', x.i.pillar, 'severity', x.i.severity, 'effort', x.i.effort, 'title', x.i.title, "
        "'detail', x.i.detail, 'check_score', x.i.check_score, 'impact_points', x.i.impact_points, "
        "'priority_score', x.priority)))"
    )
    return scored.withColumn("issues", F.expr(ordered))


def issue_rows(with_issue_array: DataFrame, key: str = "site_id") -> DataFrame:
    """One row per site and issue with its catalogue copy; ``rank`` is the report order.

    The catalogue has thirty rows whatever the data, so its broadcast is bounded.
    """
    rows = with_issue_array.selectExpr(key, "posexplode(slice(issues, 1, 64)) AS (rank, i)").select(
        key, (F.col("rank") + 1).alias("rank"), "i.code", "i.pillar", "i.severity", "i.effort", "i.severity_rank",
        "i.detail", "i.check_score", "i.impact_points", "i.priority_score",
    )
    copy = fix_catalogue(with_issue_array.sparkSession).select(
        "code", "title", "what_it_means", "why_it_matters", "how_to_fix", "code_snippet"
    )
    return rows.join(F.broadcast(copy), "code")


def issue_affected(issues: DataFrame, affected: DataFrame, key: str = "site_id") -> DataFrame:
    """Affected count, the sample that ``affected`` lists for display, and the count again as stored total."""
    return issues.join(affected, [key, "code"], "left").select(
        *issues.columns,
        F.coalesce("affected_total", F.lit(0)).alias("affected_count"),
        F.coalesce("affected", F.array().cast("array<string>")).alias("affected_sample"),
        F.coalesce("affected_total", F.lit(0)).alias("affected_total"),
    )


def stored_order(issues: DataFrame, key: str = "site_id") -> DataFrame:
    """Rank in storage order: criticals first, then priority; ties by code.

    Ranked over ranges taken from the data, so no task sorts all issues of a key.
    """
    order = [F.expr("severity = 'critical'").desc(), F.col("priority_score").desc(), F.col("code")]
    return row_number_by_range(issues, [key], order, "stored_rank")


def issue_filter_status(issues: DataFrame, which: str) -> DataFrame:
    """``all``, ``open`` (open or in progress), ``done`` (fixed or ignored), ``report`` (not ignored)."""
    if which == "open":
        return issues.filter(F.col("status").isin("open", "in_progress"))
    if which == "done":
        return issues.filter(F.col("status").isin("fixed", "ignored"))
    if which == "report":
        return issues.filter(F.col("status") != "ignored")
    return issues


def issue_status_counts(issues: DataFrame, key: str) -> DataFrame:
    return issues.groupBy(key).agg(
        F.count_if(F.col("status").isin("open", "in_progress")).alias("open_issues"),
        F.count_if(F.col("status").isin("fixed", "ignored")).alias("done_issues"),
    )


def issue_set_status(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply the latest change of each (issue, audit, workspace); rows of other tenants are untouched."""
    keys = ["issue_id", "audit_id", "workspace_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("changed_at").desc(), F.col("change_id").desc())
    latest = (
        changes.withColumn("rn", F.row_number().over(w))
        .filter("rn = 1")
        .select(*keys, F.col("status").alias("new_status"))
    )
    return (
        issues.join(latest, keys, "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .drop("new_status")
    )


def top_issues(issues: DataFrame, k: int) -> DataFrame:
    """First ``k`` issues of each site; ``free_teaser`` is 3, the prose prompt is 8."""
    return issues.filter(F.col("rank") <= k)


_QUICK = "filter(issues, i -> i.effort = 'low' AND i.severity != 'critical')"
_CRITICAL = "filter(issues, i -> i.severity = 'critical')"
_PLURAL = "if({0} = 1, '{1}', '{2}')"


def static_summary(with_issue_array: DataFrame, key: str = "site_id") -> DataFrame:
    """A paragraph for the head of the report, chosen by what was found."""
    counted = with_issue_array.withColumns(
        {
            "n_critical": F.expr(f"size({_CRITICAL})"),
            "n_quick": F.expr(f"size({_QUICK})"),
            "n_issues": F.size("issues"),
            "host": F.regexp_replace("origin", "^[a-z]+://", ""),
            "lead": F.expr("lower(coalesce(get(issues, 0).title, 'small refinements'))"),
        }
    )
    text = f"""CASE
      WHEN n_critical > 0 THEN concat(host, ' scores ', overall, '/100 and has ', n_critical, ' critical ',
        {_PLURAL.format('n_critical', 'problem', 'problems')}, '. First: ', get(issues, 0).title, '. After that ', n_quick,
        {_PLURAL.format('n_quick', ' fix is quick.', ' fixes are quick.')})
      WHEN overall >= 80 THEN concat(host, ' is in good shape at ', overall, '/100. ', n_issues,
        {_PLURAL.format('n_issues', ' refinement remains', ' refinements remain')}, ', led by ', lead, '.')
      ELSE concat(host, ' scores ', overall, '/100 over ', pages_crawled,
        {_PLURAL.format('pages_crawled', ' page', ' pages')}, '. ', n_issues,
        {_PLURAL.format('n_issues', ' issue limits', ' issues limit')}, ' citations. Start with ', lead, '.') END"""
    return counted.select(key, F.expr(text).alias("executive_summary"))


def action_plan(with_issue_array: DataFrame, key: str = "site_id") -> DataFrame:
    """Up to five steps: two criticals, quick wins up to three in all (at least one), two larger items."""
    larger = "filter(issues, i -> i.effort != 'low' AND i.severity != 'critical')"
    room = f"if(3 - least(size({_CRITICAL}), 2) > 0, 3 - least(size({_CRITICAL}), 2), 1)"

    def pick(src: str, k: str, when: str) -> str:
        return f"transform(slice({src}, 1, {k}), i -> named_struct('code', i.code, 'timeframe', {when}))"

    steps = (
        f"slice(concat({pick(_CRITICAL, '2', repr('This week'))}, {pick(_QUICK, room, repr('This week'))}, "
        f"{pick(larger, '2', _TIMEFRAME)}), 1, 5)"
    )
    rows = with_issue_array.select(key, F.posexplode(F.expr(steps)).alias("step", "s")).select(
        key, (F.col("step") + 1).alias("step"), "s.code", "s.timeframe"
    )
    copy = fix_catalogue(with_issue_array.sparkSession).select(
        "code", "title", F.expr("array_join(slice(split(how_to_fix, '[.] ', -1), 1, 2), '. ')").alias("detail")
    )
    return rows.join(F.broadcast(copy), "code")


_TIMEFRAME = "if(i.effort = 'high', 'This quarter', 'This month')"


def prompt_suggestions(sites: DataFrame) -> DataFrame:
    """Five prompts worth tracking per site, from its brand and first topic."""
    provider = F.coalesce("topic", F.lit("provider"))
    service = F.coalesce("topic", F.lit("service"))
    # The five templates.
    prompts = F.array(
        F.format_string("best %s in the UK", provider),
        F.format_string("%s reviews", F.col("brand_name")),
        F.format_string("%s vs alternatives", service),
        F.format_string("how do I choose a %s", provider),
        F.format_string("%s pricing", F.col("brand_name")),
    )
    return sites.select("site_id", F.posexplode(prompts).alias("position", "prompt"))
