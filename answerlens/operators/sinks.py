"""Sinks: what is stored, how it is partitioned, and that readers see whole versions of it (``sources/versions.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_bucket
from ..session import materialise
from ..sources import versions as V
from .validate import first_of_key


def sink_pages(features: DataFrame, key: str = "audit_id", order: str = "crawl_pos") -> DataFrame:
    """Page rows to append: the first of each (audit, url); errors become the page's issue list."""
    rows = first_of_key(features, [key, "url"], [order])
    issues = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("issues", issues).drop("error", "visible_text", "internal_links")


def sink_issues(issues: DataFrame, tailored: DataFrame | None = None, key: str = "site_id") -> DataFrame:
    """Issue rows; the text tailored to an audit's issue (``key, code, text``) is appended to its explanation and flags the row."""
    if tailored is None:
        return issues.withColumn("ai_generated", F.lit(False))
    joined = issues.join(tailored.select(key, "code", F.col("text").alias("_tailored")), [key, "code"], "left")
    has = F.coalesce("_tailored", F.lit("")) != ""
    return joined.withColumns(
        {
            "what_it_means": F.when(has, F.concat("what_it_means", F.lit("\n\n"), "_tailored")).otherwise(F.col("what_it_means")),
            "ai_generated": has,
        }
    ).drop("_tailored")


def sink_audit(audits: DataFrame, outcome: DataFrame) -> DataFrame:
    """Audit rows updated with their outcome; audits without one keep their state.

    ``outcome`` carries ``audit_id, status, reason, overall, grade, pillar_scores, action_plan, pages,
    capped, summary, completed_at`` and may carry the crawler access (``robots``) and the answer surface
    (``answer_surface``) as JSON, from which reports read. ``summary`` is the executive summary. The action
    plan is kept inside the stored pillar document.
    """
    extra = [c for c in ("robots", "answer_surface") if c in outcome.columns]
    done = outcome.select("audit_id", F.struct(*[c for c in outcome.columns if c != "audit_id"]).alias("o"))
    failed = F.col("o.status") == "failed"
    doc = F.when(
        F.col("o.action_plan").isNotNull(),
        F.concat(
            F.expr("substr(o.pillar_scores, 1, length(o.pillar_scores) - 1)"),
            F.lit(',"action_plan":'),
            F.col("o.action_plan"),
            F.lit("}"),
        ),
    ).otherwise(F.col("o.pillar_scores"))
    took = (F.unix_millis(F.col("o.completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")))
    return audits.join(done, "audit_id", "left").select(
        "audit_id",
        "site_id",
        "started_at",
        F.coalesce("o.status", "status").alias("status"),
        F.when(failed, F.lit(None)).otherwise(F.coalesce("o.overall", "overall_score")).alias("overall_score"),
        F.when(~failed, F.col("o.grade")).alias("grade"),
        F.when(~failed, doc).alias("pillar_scores"),
        F.coalesce(F.when(~failed, F.col("o.pages")), F.lit(0)).alias("pages_crawled"),
        F.coalesce(F.when(~failed, F.col("o.capped")), F.lit(False)).alias("pages_capped"),
        F.when(~failed, F.col("o.summary")).alias("summary"),
        *[F.when(~failed, F.col(f"o.{c}")).alias(c) for c in extra],
        F.when(failed, F.col("o.reason")).alias("error"),
        F.coalesce("o.completed_at", "completed_at").alias("completed_at"),
        took.alias("duration_ms"),
    )


def sink_checks(results: DataFrame) -> DataFrame:
    """Check rows to append, errored ones included, with the day they are partitioned by."""
    return results.withColumn("day", day_bucket(F.col("checked_at")))


def append_once(rows: DataFrame, path: str, key: str, part: str) -> dict:
    """Adds as one version the rows whose ``key`` their partition ``part`` does not hold, and reads only the partitions of ``rows``.

    A run that fails before its manifest is written has added nothing, and a repeated run adds nothing more; of two
    runs at once the later one looks again. The rebalance hint lets adaptive execution split a partition with
    most of the rows over many writers and gather those with few.
    """
    spark = rows.sparkSession
    table = materialise(rows, "appended")

    def change(at: dict) -> dict:
        stored, new = V.read_version(spark, path, at), table
        if stored is not None:
            parts = [r[0] for r in table.select(part).distinct().collect()]  # days of one run
            known = stored.where(F.col(part).isin(parts)).select(key, part)
            new = table.join(known, [key, part], "left_anti").select(table.columns)
        return {"dirs": at["dirs"] + V.stage(new.hint("rebalance", part), path, [part]), "schema": table.schema}

    return V.rewrite(spark, path, change)


def append_checks(results: DataFrame, path: str) -> dict:
    """Append to the history of checks, partitioned by day; checks whose id the day holds already are left out."""
    return append_once(sink_checks(results), path, "check_id", "day")


def overwrite_parts(rows: DataFrame, path: str, key: str, part: str) -> dict:
    """Writes the partitions present in ``rows`` anew, as one version; stored rows of those that ``rows`` does not hold stay."""
    spark = rows.sparkSession
    table = materialise(rows, "overwritten")

    def change(at: dict) -> dict:
        stored, whole, dirs = V.read_version(spark, path, at), table, at["dirs"]
        if stored is not None:
            parts = [r[0] for r in table.select(part).distinct().collect()]  # months of one run
            others = stored.where(F.col(part).isin(parts)).join(table.select(key, part), [key, part], "left_anti")
            whole = table.unionByName(others, allowMissingColumns=True)
            dirs = [d for d in dirs if d.split(f"{part}=")[-1] not in parts]
        schema = whole.schema if stored is None else table.limit(0).unionByName(stored.limit(0), allowMissingColumns=True).schema
        return {"dirs": dirs + V.stage(whole.hint("rebalance", part), path, [part], by_value=True), "schema": schema}

    return V.rewrite(spark, path, change)


def overwrite_audits(rows: DataFrame, path: str) -> dict:
    """Write the months present in ``rows`` anew; stored audits of those months that ``rows`` does not hold stay."""
    return overwrite_parts(rows.withColumn("month", F.date_format("started_at", "yyyy-MM")), path, "audit_id", "month")


def replace_rows(rows: DataFrame, path: str) -> dict:
    """Makes ``rows`` the whole table, as one version."""
    return V.rewrite(rows.sparkSession, path, lambda at: {"dirs": V.stage(rows, path), "schema": rows.schema})
