"""Crawled page source: one row per fetched URL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws

# Columns a crawl may lack, with the value they then take.
_DEFAULTS = {
    "final_url": (None, "string"),
    "status_code": (200, "int"),
    "content_type": ("text/html", "string"),
    "error": (None, "string"),
    "depth": (0, "int"),
}


#: Bytes of a scan that one task analyses.
PER_TASK = 16 << 20


def spread(df: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Deals out a scan of large splits, or of fewer than there are cores, as analysis costs far more than moving the pages.

    The number of tasks grows with the table: a split is dealt to one task for each ``per_task`` of the bytes that it may have, so none
    gets longer as the table grows. A table with small splits enough, or one that is more than a scan, is left as it is.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if re.search(r"Join|Aggregate|Exchange|Window|Sort|Generate|Limit|Python|Arrow|LocalTable|Scan ExistingRDD|Relation\[", plan):
        return df
    spark = df.sparkSession
    splits, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    tasks = max(cores, splits * -(-_split_bytes(spark) // per_task))
    return df.repartition(tasks) if splits < tasks else df


def _split_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` as a number."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]


def scan_pages(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """Read a page table (path or DataFrame) and add the columns it lacks."""
    df = spark.read.parquet(source) if isinstance(source, str) else source
    if "body" not in df.columns:
        df = df.withColumnRenamed("html", "body")
    missing = {k: F.lit(v).cast(t) for k, (v, t) in _DEFAULTS.items() if k not in df.columns}
    return spread(df.withColumns(missing) if missing else df)


def body_is_truncated(body: Column, cap: int | None = None) -> Column:
    return F.lit(False) if cap is None else F.coalesce(F.octet_length(body) > cap, F.lit(False))


def body_cap(body: Column, cap: int | None = None) -> Column:
    """The first ``cap`` bytes of a body, cut between characters; the whole body without one."""
    if cap is None:
        return body
    cut = F.make_valid_utf8(F.substring(body.cast("binary"), 1, cap).cast("string"))
    return F.when(body_is_truncated(body, cap), cut).otherwise(body)


def page_gate(error: Column, body: Column, content_type: Column) -> Column:
    """Why a fetched page cannot be analysed; NULL when it can."""
    return (
        F.when(error.isNotNull() & (error != ""), error)
        .when(body.isNull() | (trim_ws(body) == ""), F.lit("Empty response body"))
        .when(
            content_type.isNotNull() & (content_type != "") & ~content_type.rlike("(?i)html|xml"),
            F.concat(F.lit("Not HTML ("), content_type, F.lit(")")),
        )
    )
