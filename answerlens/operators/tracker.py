"""Tracker aggregates over the append-only citation checks.

Every operator takes the time it works at (``as_of``) and keeps site and workspace as grouping keys:
one tenant is a filter pushed into the scan. ``DISTINCT ON`` becomes a rank filtered to 1, which
Spark prunes on the map side before the shuffle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_bucket
from ..functions.text import percent_1dp, ratio_round

SCALE = 10000  # share of voice is stored with four decimals


def latest(df: DataFrame, keys: list[str], ts: str = "checked_at", tie: str = "check_id") -> DataFrame:
    """Newest row per key; ties go to the larger id."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def latest_checks(checks: DataFrame, prompts: DataFrame) -> DataFrame:
    """Newest check of each prompt and engine, errored ones included, with its prompt.

    Reduced before the join, so the join moves one row per prompt and engine.
    """
    newest = latest(checks, ["prompt_id", "engine"])
    return newest.join(prompts.select("prompt_id", "prompt", "intent"), "prompt_id")


def sov_units(col: str = "share_of_voice") -> Column:
    """Share of voice as whole ten-thousandths, so that sums are exact."""
    return F.floor(F.col(col) * SCALE + 0.5).cast("bigint")


def _visibility_aggs() -> list[Column]:
    return [
        F.count("*").alias("checks"),
        F.count_if("brand_cited").alias("cited"),
        F.sum(sov_units()).alias("sov_units"),
    ]


def _sov_percent(units: str, n: str) -> Column:
    """Mean share of voice as a percentage with one decimal."""
    return ratio_round(F.col(units), F.col(n) * 10, 1, 10)


def visibility_history(checks: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    """Per site, day and engine: checks, cited, visibility and mean share of voice; errors left out.

    A ``day`` filter stands beside the timestamp filter, so a table partitioned by day is pruned.
    """
    since = as_of - timedelta(days=days)
    rows = checks.filter((F.col("checked_at") > F.lit(since)) & F.col("error").isNull())
    if "day" in checks.columns:
        rows = rows.filter(F.col("day") >= since.strftime("%Y-%m-%d")).drop("day")
    daily = rows.groupBy("site_id", day_bucket(F.col("checked_at")).alias("day"), "engine").agg(*_visibility_aggs())
    return daily.select(
        "site_id",
        "day",
        "engine",
        "checks",
        "cited",
        percent_1dp(F.col("cited"), F.col("checks")).alias("visibility"),
        _sov_percent("sov_units", "checks").alias("avg_sov"),
    )


def current_state(checks: DataFrame) -> DataFrame:
    """Newest non-errored check per prompt and engine of a site."""
    return latest(checks.filter(F.col("error").isNull()), ["site_id", "prompt_id", "engine"])


def current_visibility(checks: DataFrame, sites: DataFrame) -> DataFrame:
    """Per site, zero-filled: checks, cited, visibility, mean share of voice, simulated."""
    agg = current_state(checks).groupBy("site_id").agg(
        *_visibility_aggs(), F.count_if(F.col("mode") == "simulated").alias("simulated")
    )
    filled = sites.select("site_id").join(agg, "site_id", "left").na.fill(0)
    return filled.select(
        "site_id",
        "checks",
        "cited",
        percent_1dp(F.col("cited"), F.col("checks")).alias("visibility"),
        _sov_percent("sov_units", "checks").alias("avg_sov"),
        "simulated",
    )


def competitor_benchmark(checks: DataFrame, sites: DataFrame) -> DataFrame:
    """Brand and competitors of each site on one scale, over the current state.

    The state is read once: each check is exploded to one entry for the brand and one per competitor,
    combined on the map side by (site, name). The brand's entries also count the checks. A site
    without checks keeps a brand row of zeros.
    """
    entry = "named_struct('is_brand', {0}, 'name', {1}, 'mentions', cast({2} AS bigint), 'appeared', {3})"
    brand = entry.format("true", "cast(NULL AS string)", "brand_mentions", "brand_cited")
    rival = entry.format("false", "m.name", "m.mentions", "m.mentions > 0")
    entries = current_state(checks).select(
        "site_id",
        F.explode(F.expr(f"concat(array({brand}), coalesce(transform(competitor_mentions, m -> {rival}), array()))")).alias("e"),
    )
    named = entries.groupBy("site_id", "e.is_brand", "e.name").agg(
        F.sum("e.mentions").alias("mentions"), F.count_if("e.appeared").alias("appearances"), F.count("*").alias("n")
    )
    is_brand = F.coalesce("is_brand", F.lit(True))
    by_site = Window.partitionBy("site_id")
    rows = (
        sites.select("site_id", "brand_name")
        .join(named, "site_id", "left")
        .select(
            "site_id",
            F.when(is_brand, F.col("brand_name")).otherwise(F.col("name")).alias("name"),
            is_brand.alias("is_brand"),
            F.coalesce("mentions", F.lit(0)).alias("mentions"),
            F.coalesce("appearances", F.lit(0)).alias("appearances"),
            F.coalesce(F.max(F.when(F.col("is_brand"), F.col("n"))).over(by_site), F.lit(0)).alias("total_checks"),
        )
        .filter(F.col("name").isNotNull())
    )
    ranked = by_site.orderBy(
        F.col("mentions").desc(), F.col("appearances").desc(), F.col("is_brand").desc(), "name"
    )
    return rows.select(
        "*",
        percent_1dp(F.col("appearances"), F.col("total_checks")).alias("presence"),
        F.row_number().over(ranked).alias("rank"),
    )


def benchmark_bars(benchmark: DataFrame, k: int = 12) -> DataFrame:
    """Top rows of each site with mentions as a percentage of the largest."""
    best = benchmark.groupBy("site_id").agg(F.max("mentions").alias("best"))
    return (
        benchmark.filter(F.col("rank") <= k)
        .join(best, "site_id")
        .select(
            "site_id", "name", "is_brand", "mentions", "rank",
            F.when(F.col("best") > 0, F.col("mentions") * 100 / F.col("best")).otherwise(F.lit(0.0)).alias("width"),
        )
    )


def prompt_history(checks: DataFrame, k: int = 60) -> DataFrame:
    """Newest ``k`` checks of each prompt."""
    return top_k(checks, ["prompt_id"], [F.col("checked_at").desc(), F.col("check_id").desc()], k)


def history_collapse(history: DataFrame) -> DataFrame:
    """One point per site and day; share of voice is the check-weighted mean of the rounded means."""
    tenths = F.floor(F.col("avg_sov") * 10 + 0.5).cast("bigint")
    daily = history.groupBy("site_id", "day").agg(
        F.sum("checks").alias("checks"), F.sum("cited").alias("cited"), F.sum(tenths * F.col("checks")).alias("weighted")
    )
    return daily.select(
        "site_id",
        "day",
        "checks",
        "cited",
        percent_1dp(F.col("cited"), F.col("checks")).alias("visibility"),
        ratio_round(F.col("weighted"), F.col("checks"), 1, 10).alias("sov"),
    )


def engine_totals(latest_rows: DataFrame) -> DataFrame:
    """Per site and engine over the latest checks, errored ones included."""
    agg = latest_rows.groupBy("site_id", "engine").agg(
        F.count("*").alias("checks"),
        F.count_if("brand_cited").alias("cited"),
        F.count_if(F.col("mode") == "simulated").alias("simulated"),
    )
    return agg.withColumn("visibility", percent_1dp(F.col("cited"), F.col("checks")))


def any_simulated(latest_rows: DataFrame) -> DataFrame:
    return latest_rows.groupBy("site_id").agg(F.bool_or(F.col("mode") == "simulated").alias("any_simulated"))


def prompt_matrix(latest_rows: DataFrame, by: str = "prompt_id") -> DataFrame:
    """Prompt by engine grid. Keyed by id; by text it merges locales of one prompt."""
    cell = F.struct("engine", "check_id", "brand_cited", "brand_position", "share_of_voice", "mode")
    return latest_rows.groupBy("site_id", by).agg(F.array_sort(F.collect_list(cell)).alias("results"))


def prompt_scorecard(latest_rows: DataFrame) -> DataFrame:
    return latest_rows.groupBy("prompt_id").agg(
        F.count_if("brand_cited").alias("cited"), F.count("*").alias("results")
    )
