"""Lists, dashboards and report datasets over sites, audits, prompts, competitors and checks.

Per-site scalar lookups are one grouped aggregate each, left-joined to the sites.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import plan_dim
from ..functions.text import percent_1dp
from ..functions.urls import host_of
from . import tracker as T
from .issues import stored_order
from .page_features import keep_where

DEFAULT_PRODUCT = "AnswerLens"
DEFAULT_COLOUR = "#4f46e5"


def latest_audits(audits: DataFrame) -> DataFrame:
    """Newest complete audit of each site."""
    newest = T.latest(
        audits.filter("status = 'complete' AND site_id IS NOT NULL"), ["site_id"], "completed_at", "audit_id"
    )
    return newest.select(
        "site_id",
        F.col("audit_id").alias("latest_audit_id"),
        F.col("overall_score").alias("latest_score"),
        F.col("completed_at").alias("latest_audit_at"),
    )


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("site_id").agg(F.count("*").alias(name))


def sites_list(sites: DataFrame, audits: DataFrame, prompts: DataFrame, competitors: DataFrame) -> DataFrame:
    return (
        sites.join(latest_audits(audits).drop("latest_audit_id"), "site_id", "left")
        .join(_counts(prompts, "prompt_count"), "site_id", "left")
        .join(_counts(competitors, "competitor_count"), "site_id", "left")
        .na.fill(0, ["prompt_count", "competitor_count"])
    )


def site_dashboard(
    sites: DataFrame, audits: DataFrame, prompts: DataFrame, competitors: DataFrame, checks: DataFrame
) -> DataFrame:
    """Sites with score, counts and current visibility (NULL where nothing was checked)."""
    state = T.current_state(checks).groupBy("site_id").agg(
        F.count("*").alias("checks"),
        F.count_if("brand_cited").alias("cited"),
        F.count_if(F.col("mode") == "simulated").alias("simulated"),
    )
    vis = F.when(F.col("checks") > 0, percent_1dp(F.col("cited"), F.col("checks")))
    return (
        sites_list(sites, audits, prompts, competitors)
        .join(state, "site_id", "left")
        .withColumn("visibility", vis)
        .na.fill(0, ["checks", "simulated"])
        .drop("cited")
    )


def workspace_kpis(dashboard: DataFrame) -> DataFrame:
    """Unweighted, rounded means over the scored and the checked sites of a workspace."""
    tenths = F.floor(F.col("visibility") * 10 + 0.5).cast("bigint")
    agg = dashboard.groupBy("workspace_id").agg(
        F.count("*").alias("sites"),
        F.sum("prompt_count").alias("tracked_prompts"),
        F.count("latest_score").alias("scored"),
        F.sum("latest_score").alias("score_sum"),
        F.count_if(F.col("checks") > 0).alias("checked"),
        F.sum(F.when(F.col("checks") > 0, tenths)).alias("vis_sum"),
    )
    mean = lambda top, n: F.when(n > 0, F.floor((top * 2 + n) / (n * 2)).cast("bigint"))
    return agg.select(
        "workspace_id",
        "sites",
        "tracked_prompts",
        mean(F.col("score_sum"), F.col("scored")).alias("avg_score"),
        mean(F.col("vis_sum"), F.col("checked") * 10).alias("avg_visibility"),
    )


def reports_index(sites: DataFrame, audits: DataFrame, checks: DataFrame) -> DataFrame:
    """Latest audit and number of all checks of each site."""
    return (
        sites.select("site_id", "workspace_id", "name", "origin")
        .join(latest_audits(audits).drop("latest_audit_at"), "site_id", "left")
        .join(_counts(checks, "checks"), "site_id", "left")
        .na.fill(0, ["checks"])
    )


def audits_list(audits: DataFrame, sites: DataFrame, k: int = 50) -> DataFrame:
    """Newest ``k`` audits of each workspace with the site's name; cut before the join."""
    newest = T.top_k(
        audits.filter("workspace_id IS NOT NULL"),
        ["workspace_id"],
        [F.col("started_at").desc(), F.col("audit_id").desc()],
        k,
    )
    return newest.join(sites.select("site_id", F.col("name").alias("site_name")), "site_id", "left")


def site_detail_audits(audits: DataFrame, k: int = 20) -> DataFrame:
    return T.top_k(
        audits.filter("site_id IS NOT NULL"), ["site_id"], [F.col("started_at").desc(), F.col("audit_id").desc()], k
    )


def audit_pages_list(features: DataFrame, key: str = "site_id") -> DataFrame:
    """The columns of the page list; a reader that shows one audit orders them by ``depth, url``."""
    return features.select(
        key, "depth", "url", "status_code", "title", "word_count", "h1_count", "js_dependent", "jsonld_blocks",
        "jsonld_invalid", "has_faq", "heading_skips", "error",
    )


def js_pages(features: DataFrame) -> DataFrame:
    return keep_where(features, "js_dependent")


def blocked_bots(access: DataFrame) -> DataFrame:
    return access.filter(~F.col("allowed"))


def audit_kpis(issues: DataFrame, features: DataFrame, key: str = "site_id") -> DataFrame:
    """Open work of each audit; ``open`` only, work in progress is not counted."""
    is_open = F.col("status") == "open"
    cents = F.floor(F.col("impact_points") * 100 + 0.5).cast("bigint")
    work = issues.groupBy(key).agg(
        F.count_if(is_open).alias("open_issues"),
        F.count_if(is_open & (F.col("severity") == "critical")).alias("critical_open"),
        F.sum(F.when(is_open, cents).otherwise(0)).alias("cents"),
    )
    pages = features.groupBy(key).agg(F.count_if("js_dependent").alias("js_pages"), F.count("*").alias("pages"))
    filled = pages.join(work, key, "left").na.fill(0)
    return filled.select(
        key, "open_issues", "critical_open", "js_pages", "pages",
        (F.col("cents") / 100).alias("recoverable_points"),
    )


def with_plan(workspaces: DataFrame) -> DataFrame:
    """Workspaces with the limits of their plan, unknown plans as free. The plan table has four rows."""
    plans = plan_dim(workspaces.sparkSession)
    known = F.col("plan").isin("free", "starter", "growth", "agency")
    return workspaces.withColumn("plan", F.when(known, F.col("plan")).otherwise(F.lit("free"))).join(
        F.broadcast(plans), "plan"
    )


def workspace_usage(workspaces: DataFrame, counters: DataFrame, period: str) -> DataFrame:
    """Plan limits beside this month's usage."""
    used = counters.filter(F.col("period") == period).groupBy("workspace_id").agg(
        F.sum(F.when(F.col("metric") == "audits", F.col("count")).otherwise(0)).alias("audits_used"),
        F.sum(F.when(F.col("metric") == "citation_checks", F.col("count")).otherwise(0)).alias("checks_used"),
    )
    return with_plan(workspaces).join(used, "workspace_id", "left").na.fill(0, ["audits_used", "checks_used"])


def prompts_list(prompts: DataFrame, sites: DataFrame) -> DataFrame:
    return prompts.join(sites.select("site_id", F.col("name").alias("site_name")), "site_id")


def competitors_list(competitors: DataFrame, sites: DataFrame) -> DataFrame:
    return competitors.select("competitor_id", "site_id", "name", "domain").join(
        sites.select("site_id", F.col("name").alias("site_name")), "site_id"
    )


def branding_resolve(workspaces: DataFrame) -> DataFrame:
    """Branding of exports: a workspace's own only where its plan allows."""
    own = F.col("white_label")
    return with_plan(workspaces).select(
        "workspace_id",
        F.when(own & (F.coalesce("brand_name", F.lit("")) != ""), F.col("brand_name"))
        .otherwise(F.lit(DEFAULT_PRODUCT))
        .alias("product_name"),
        F.when(own, F.col("brand_colour")).otherwise(F.lit(DEFAULT_COLOUR)).alias("brand_colour"),
        F.when(own, F.col("brand_footer")).alias("footer"),
        F.when(own, F.col("brand_contact")).alias("contact"),
        "white_label",
    )


def share_links_active(links: DataFrame, audits: DataFrame, as_of: datetime) -> DataFrame:
    """Links neither revoked nor expired, with the audit each shows."""
    live = links.filter(
        F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of)))
    )
    wants_audit = F.col("kind").isin("audit", "combined")
    return (
        live.join(latest_audits(audits).select("site_id", "latest_audit_id"), "site_id", "left")
        .withColumn("resolved_audit_id", F.coalesce("audit_id", F.when(wants_audit, F.col("latest_audit_id"))))
        .drop("latest_audit_id")
    )


def share_view_counts(links: DataFrame, views: DataFrame) -> DataFrame:
    """Stored count plus the views since."""
    seen = views.groupBy("link_id").agg(F.count("*").alias("views"))
    return links.join(seen, "link_id", "left").withColumn(
        "view_count", F.col("view_count") + F.coalesce("views", F.lit(0))
    ).drop("views")


#: What a report reads of the stored pillar document and of the stored crawler access.
STORED = (
    "summary string, pillars array<struct<label:string,score:double,weight:int>>, action_plan array<struct<title:string,detail:string,timeframe:string>>"
)
ACCESS = "array<struct<ua:string,vendor:string,allowed:boolean>>"
REPORT_ISSUE = [
    "title", "severity", "effort", "pillar", "what_it_means", "why_it_matters", "how_to_fix", "code_snippet", "impact_points", "priority_score",
    "affected_count", "affected_sample",
]


def audit_report_data(audits: DataFrame, sites: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """The report of every complete audit, those without a site included: a ``header`` document per audit, and ``issues`` rows.

    Pillars, plan and crawler access come from what the audit stored (``pillar_scores`` and ``robots``, JSON as
    ``sink_audit`` writes them); these lists are as long as that document. Issues can be any number, so they
    stay rows, each with its place in the storage order among those that are not ignored.
    """
    complete = audits.filter("status = 'complete'")
    for name in ("grade", "pillar_scores", "robots"):
        if name not in audits.columns:
            complete = complete.withColumn(name, F.lit(None).cast("string"))
    if "previous_score" not in audits.columns:
        complete = complete.withColumn("previous_score", F.lit(None).cast("int"))
    named = complete.join(sites.select("site_id", F.col("name").alias("site_name"), F.col("brand_name").alias("site_brand")), "site_id", "left")
    host = host_of(F.col("origin"))
    header = named.withColumns({"stored": F.from_json("pillar_scores", STORED), "access": F.from_json("robots", ACCESS)}).select(
        "audit_id",
        F.struct(F.coalesce("site_name", host).alias("name"), "origin", F.coalesce("site_brand", host).alias("brand_name")).alias("site"),
        F.struct(
            F.coalesce("overall_score", F.lit(0)).alias("overall"),
            F.coalesce("grade", F.lit("-")).alias("grade"),
            F.col("previous_score").alias("previous"),
            F.coalesce("summary", "stored.summary", F.lit("")).alias("summary"),
        ).alias("score"),
        F.coalesce("stored.pillars", F.array()).alias("pillars"),
        F.coalesce("access", F.array()).alias("ai_access"),
        F.coalesce("stored.action_plan", F.array()).alias("action_plan"),
        "pages_crawled",
    )
    kept = issues.filter("status != 'ignored'").join(complete.select("audit_id"), "audit_id", "left_semi")
    return {"header": header, "issues": stored_order(kept, "audit_id").select("audit_id", "stored_rank", "code", *REPORT_ISSUE)}


def citation_report_data(sites: DataFrame, checks: DataFrame, prompts: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """The citation report of every site: a ``header`` document per site, and ``prompts`` and ``benchmark`` rows.

    Only lists with a fixed bound are nested in the header (four engines, one entry per day of the
    window). Prompts and competitors grow with the site, so they stay rows.
    """
    newest = T.latest_checks(checks, prompts)
    visibility = T.current_visibility(checks, sites).select(
        "site_id", F.struct("checks", "cited", "visibility", "avg_sov").alias("visibility")
    )
    engines = T.engine_totals(newest).groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct("engine", "checks", "cited", "visibility"))).alias("by_engine")
    )
    matrix = T.prompt_matrix(newest)
    tracked = matrix.groupBy("site_id").agg(F.count("*").alias("n_prompts"))
    history = T.history_collapse(T.visibility_history(checks, as_of)).groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct("day", "visibility"))).alias("history")
    )
    header = sites.select("site_id", F.struct("name", "origin", "brand_name").alias("site"))
    for part in (visibility, T.any_simulated(newest), engines, tracked, history):
        header = header.join(part, "site_id", "left")
    return {
        "header": header.na.fill(False, ["any_simulated"]).na.fill(0, ["n_prompts"]),
        "prompts": matrix,
        "benchmark": T.competitor_benchmark(checks, sites),
    }
