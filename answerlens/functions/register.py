"""Scalar operators as SQL functions, so plain SQL can use them. Bodies are inlined by Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dims import GRADE_BANDS
from .fragments import let
from .links import base_parts, normalise_links
from .urls import domain_sql


def register(spark: SparkSession) -> None:
    """Create ``grade_for``, ``domain_of``, ``normalise_link``, ``day_bucket`` and ``period_month``."""
    bands = " ".join(f"WHEN score >= {floor} THEN '{grade}'" for floor, grade in GRADE_BANDS)
    bodies = {
        "grade_for(score INT) RETURNS STRING": f"CASE {bands} ELSE 'F' END",
        "domain_of(url STRING) RETURNS STRING": domain_sql("url"),
        "normalise_link(href STRING, page_url STRING) RETURNS STRING": let(
            base_parts("page_url"), "bu", f"get({normalise_links('array(href)', 'bu')}, 0)"
        ),
        "day_bucket(ts TIMESTAMP) RETURNS STRING": "date_format(ts, 'yyyy-MM-dd')",
        "period_month(ts TIMESTAMP) RETURNS STRING": "date_format(ts, 'yyyy-MM')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
