"""The site audit as one job over any number of sites.

Pages are analysed once and stored; everything after reads the narrow feature table. Stages that are
read by several outputs are tables in the output folder, so a lost executor repeats a stage, not the job,
and one manifest at the end names them all: readers never see tables of two runs.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import issues as I
from ..operators import robots as B
from ..operators import score as S
from ..operators.page_features import page_features
from ..operators.reach import audit_gate
from ..operators.surface import answer_surface
from ..sources import versions as V
from ..sources.pages import scan_pages
from ..sources.site_files import scan_site_files


@dataclass
class AuditTables:
    """Stored results of a run, each a DataFrame over its table."""

    page_features: DataFrame
    scores: DataFrame
    checks: DataFrame
    issues: DataFrame
    action_plan: DataFrame
    ai_access: DataFrame


def run_audit(
    spark: SparkSession, pages: DataFrame, sites: DataFrame, files: DataFrame, out: str, order: str = "crawl_pos"
) -> AuditTables:
    """Audit every site of ``pages``. All tables become visible together, when the last one is written.

    ``pages``: ``site_id``, ``url``, ``html`` or ``body``, ``order`` and optional fetch columns.
    ``sites``: ``site_id``, ``origin``, ``brand_name``. ``files``: ``origin, kind, status_code, body``.
    """

    tables: dict[str, dict] = {}

    def store(df: DataFrame, name: str) -> DataFrame:
        tables[name] = V.stage_table(df, out)
        return V.read_version(spark, out, tables[name])

    features = store(page_features(scan_pages(pages)), "page_features")
    robots = store(B.parsed_robots(files.filter("kind = 'robots'").drop("kind")), "robots")
    surface = answer_surface(scan_site_files(files), robots)
    gate = store(audit_gate(features, order), "gate")
    # A site that fails the gate is not scored: it gets its reason, and no checks, issues or plan.
    passed = sites.join(gate.filter("status = 'complete'"), "site_id", "left_semi")
    facts = K.site_facts(features, passed, robots, surface)
    scored = store(I.with_issues(S.with_score(K.with_checks(facts))), "scored")
    counted = features.groupBy("site_id").agg(F.count("*").alias("crawled"))
    scores = gate.join(scored, "site_id", "left").join(counted, "site_id", "left").join(sites.select("site_id", F.col("origin").alias("home")), "site_id").select(
        "site_id",
        F.col("home").alias("origin"),
        "status",
        "reason",
        "overall", "raw_overall", "grade", "ceiling_reason", "summary",
        F.coalesce("pages_crawled", "crawled").alias("pages_crawled"),
    )
    issues = I.issue_affected(I.issue_rows(scored), K.affected_pages(features, order))
    results = {"scores": scores, "checks": K.check_rows(scored), "issues": issues, "action_plan": I.action_plan(scored), "ai_access": B.ai_access_matrix(robots)}
    for name, rows in results.items():
        store(rows, name)
    V.rewrite(spark, out, lambda at: {"dirs": [], "schema": features.schema, "tables": tables})
    return read_audit(spark, out)


def read_audit(spark: SparkSession, out: str) -> AuditTables:
    """The tables of the last run that came to its end, all of that run."""
    tables = V.read_tables(spark, out)
    return AuditTables(**{f.name: tables[f.name] for f in fields(AuditTables)})
