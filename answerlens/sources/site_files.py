"""Per-origin text files: robots.txt, llms.txt, llms-full.txt, sitemap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["robots", "llms", "llms_full", "sitemap"]


def scan_site_files(files: DataFrame) -> DataFrame:
    """``(origin, kind, status_code, body)`` rows to one row per origin, a struct per kind.

    Conditional aggregates rather than a pivot: one shuffle, and the plan does not depend on the data.
    """
    file = F.struct("status_code", "body")
    return files.groupBy("origin").agg(
        *[F.first(F.when(F.col("kind") == k, file), ignorenulls=True).alias(k) for k in KINDS]
    )
