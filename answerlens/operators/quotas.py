"""Scheduling, usage, quotas and subscription state as table jobs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import plan_dim
from .ranking import row_number_by_range, trailing_count
from .reports import with_plan
from .tracker import top_k

STALE_HOURS = 144
FREE_AUDITS_PER_DAY = 5


def eligible_workspaces(workspaces: DataFrame) -> DataFrame:
    """Active or trialing, on a plan with weekly checks."""
    return with_plan(workspaces.filter(F.col("plan_status").isin("active", "trialing"))).filter("weekly_checks")


def stale_prompts(
    prompts: DataFrame, as_of: datetime, stale_hours: int = STALE_HOURS, k: int | None = None
) -> DataFrame:
    """All active prompts due for a check, never-checked first, with their place in the workspace's queue.

    ``k`` keeps only the first of each queue, for a run of limited size.
    """
    before = as_of - timedelta(hours=stale_hours)
    due = prompts.filter(
        F.col("is_active") & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") < F.lit(before)))
    )
    order = [F.col("last_checked_at").asc_nulls_first(), F.col("prompt_id")]
    if k is not None:
        return top_k(due, ["workspace_id"], order, k, "queue_pos")
    return row_number_by_range(due, ["workspace_id"], order, "queue_pos")


def prompts_touched(prompts: DataFrame, checks: DataFrame) -> DataFrame:
    """Prompts with ``last_checked_at`` moved on to their newest check (``prompt_id, checked_at``), never back."""
    newest = checks.groupBy("prompt_id").agg(F.max("checked_at").alias("_at"))
    return prompts.join(newest, "prompt_id", "left").withColumn("last_checked_at", F.greatest("last_checked_at", "_at")).select(*prompts.columns)


def run_log(totals: DataFrame, as_of: datetime, failures: DataFrame | None = None) -> DataFrame:
    """One row per workspace of a scheduled run: status, counts and the error of a run that failed (``workspace_id, error``)."""
    failed = failures.groupBy("workspace_id").agg(F.min("error").alias("error")) if failures is not None else None
    rows = totals.join(failed, "workspace_id", "left") if failed is not None else totals.withColumn("error", F.lit(None).cast("string"))
    return rows.select(
        "workspace_id", F.lit(as_of).alias("run_at"), F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status"),
        "prompts_run", "checks_written", "error",
    )


def run_totals(workspaces: DataFrame, queue: DataFrame, checks: DataFrame) -> DataFrame:
    """Per eligible workspace: prompts run and checks written by this run."""
    run = queue.groupBy("workspace_id").agg(F.count("*").alias("prompts_run"))
    wrote = checks.groupBy("workspace_id").agg(F.count("*").alias("checks_written"))
    return (
        eligible_workspaces(workspaces)
        .select("workspace_id", "plan")
        .join(run, "workspace_id", "left")
        .join(wrote, "workspace_id", "left")
        .na.fill(0, ["prompts_run", "checks_written"])
    )


def run_summary(workspaces: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: workspaces considered and eligible, prompts run, checks written."""
    zero = F.lit(0).cast("bigint")
    considered = workspaces.filter(F.col("plan_status").isin("active", "trialing")).select(
        F.lit(1).alias("considered"), zero.alias("eligible"), zero.alias("prompts_run"), zero.alias("checks_written")
    )
    eligible = totals.select(zero.alias("considered"), F.lit(1).alias("eligible"), "prompts_run", "checks_written")
    return considered.unionByName(eligible).agg(
        F.coalesce(F.sum("considered"), zero).alias("workspaces_considered"),
        F.coalesce(F.sum("eligible"), zero).alias("workspaces_eligible"),
        F.coalesce(F.sum("prompts_run"), zero).alias("prompts_run"),
        F.coalesce(F.sum("checks_written"), zero).alias("checks_written"),
    )


def usage_counter(stored: DataFrame, increments: DataFrame) -> DataFrame:
    """Stored counters plus increments, by workspace, month and metric."""
    both = stored.select("workspace_id", "period", "metric", "count").unionByName(
        increments.select("workspace_id", "period", "metric", "count")
    )
    return both.groupBy("workspace_id", "period", "metric").agg(F.sum("count").alias("count"))


def _violations(used: DataFrame, plan_of: DataFrame, limit: str, key: str) -> DataFrame:
    plans = plan_dim(plan_of.sparkSession)
    ladder = plans.select((F.col("plan_pos") - 1).alias("plan_pos"), F.col("plan").alias("upgrade_to"))
    return (
        plan_of.join(used, key, "left")
        .withColumn("used", F.coalesce("used", F.lit(0)))
        .filter(F.col(limit).isNotNull() & (F.col("used") >= F.col(limit)))
        .join(F.broadcast(ladder), "plan_pos", "left")
        .select(key, "plan", F.col(limit).alias("limit"), "used", "upgrade_to")
    )


def quota_audits(workspaces: DataFrame, counters: DataFrame, period: str) -> DataFrame:
    used = (
        counters.filter((F.col("period") == period) & (F.col("metric") == "audits"))
        .groupBy("workspace_id")
        .agg(F.sum("count").alias("used"))
    )
    return _violations(used, with_plan(workspaces), "audits_limit", "workspace_id")


def quota_sites(workspaces: DataFrame, sites: DataFrame) -> DataFrame:
    used = sites.groupBy("workspace_id").agg(F.count("*").alias("used"))
    return _violations(used, with_plan(workspaces), "sites_limit", "workspace_id")


def quota_prompts(workspaces: DataFrame, prompts: DataFrame) -> DataFrame:
    used = prompts.groupBy("workspace_id").agg(F.count("*").alias("used"))
    return _violations(used, with_plan(workspaces), "prompts_limit", "workspace_id")


def quota_competitors(workspaces: DataFrame, sites: DataFrame, competitors: DataFrame) -> DataFrame:
    used = competitors.groupBy("site_id").agg(F.count("*").alias("used"))
    per_site = sites.select("site_id", "workspace_id").join(with_plan(workspaces), "workspace_id")
    return _violations(used, per_site, "competitors_limit", "site_id")


def free_rate_limit(audits: DataFrame, limit: int = FREE_AUDITS_PER_DAY) -> DataFrame:
    """Each anonymous audit with the count of its address in the trailing 24 hours."""
    anonymous = audits.filter("workspace_id IS NULL AND created_ip IS NOT NULL").select(
        "audit_id", "created_ip", "started_at"
    )
    counted = trailing_count(anonymous, "created_ip", "started_at", "audit_id", 86400, "used_24h")
    return counted.withColumns(
        {
            "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("used_24h")),
            "over_limit": F.col("used_24h") > limit,
        }
    )


def subscription_state(events: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Newest subscription state of each workspace: plan, status, customer, subscription and end of the paid period.

    ``events`` carry ``event_id, received_at, type, workspace_id, status, price_plan, meta_plan`` and may carry
    ``customer_id, subscription_id, period_end`` (epoch seconds). An event that names no workspace belongs to the one that
    ``customers`` (``customer_id, workspace_id``) has for its customer. A failed payment only marks the workspace past due and
    leaves the rest as it was; a subscription that has ended leaves no subscription id.
    """
    for name, kind in (("customer_id", "string"), ("subscription_id", "string"), ("period_end", "bigint")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    if customers is not None:
        known_as = customers.select(F.col("customer_id").alias("_customer"), F.col("workspace_id").alias("_workspace"))
        asked = F.when(F.col("workspace_id").isNull(), F.col("customer_id"))
        events = events.join(known_as, asked == F.col("_customer"), "left").withColumn("workspace_id", F.coalesce("workspace_id", "_workspace"))
    known = ("free", "starter", "growth", "agency")
    terminal = F.coalesce(F.col("status").isin("canceled", "incomplete_expired", "unpaid"), F.lit(False))
    plan = F.coalesce("price_plan", F.when(F.col("meta_plan").isin(*known), F.col("meta_plan")))
    order = F.struct("received_at", "event_id")
    told = F.when(F.col("type") != "payment_failed", order)
    mapped = events.filter(F.col("workspace_id").isNotNull()).select(
        "workspace_id",
        order.alias("order"),
        told.alias("told"),
        F.when(F.col("type") != "payment_failed", F.when(terminal, "free").otherwise(F.coalesce(plan, F.lit("free")))).alias("plan"),
        F.when(F.col("type") == "payment_failed", "past_due")
        .when(F.col("status").isin("active", "trialing", "past_due"), F.col("status"))
        .when(terminal, "canceled")
        .otherwise(F.lit("active"))
        .alias("plan_status"),
        "customer_id",
        F.struct(F.when(~terminal, F.col("subscription_id")).alias("id"), F.timestamp_seconds("period_end").alias("end")).alias("paid"),
    )
    return mapped.groupBy("workspace_id").agg(
        F.max_by("plan", F.when(F.col("plan").isNotNull(), F.col("order"))).alias("plan"),
        F.max_by("plan_status", "order").alias("plan_status"),
        F.max_by("customer_id", F.when(F.col("customer_id").isNotNull(), F.col("told"))).alias("customer_id"),
        F.max_by("paid", "told").alias("paid"),
    ).select("workspace_id", "plan", "plan_status", "customer_id", F.col("paid.id").alias("subscription_id"), F.col("paid.end").alias("current_period_end"))


def event_ledger(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """First arrival of each event id that the ledger has not seen."""
    first = events.groupBy("event_id").agg(
        F.min_by(F.struct(*[c for c in events.columns if c != "event_id"]), F.struct("received_at", "seq")).alias("e")
    ).select("event_id", "e.*")
    return first.join(ledger.select("event_id"), "event_id", "left_anti") if ledger is not None else first
