"""Structured Streaming twins of the append-only facts and event handlers.

Sources are append-only folders read with an explicit schema. Aggregates run in update mode and are
written by ``foreachBatch`` to a store with one row per key: a delta a micro-batch, merged into its base from
time to time, and the last batch counted noted in the same manifest, so a retried batch counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percent_1dp
from ..operators.tracker import _sov_percent, sov_units
from ..session import scratch_path
from ..sources.versions import read_keyed, upsert


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 64) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def append_rows(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Start an append query to Parquet; the file sink's log makes it exactly-once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def update_store(stream: DataFrame, path: str, checkpoint: str, keys: list[str], fold: list[Column] | None = None, mode: str = "update", **store):
    """Start a query whose micro-batches go to a store with one row per key (``sources/versions.py``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, keys, batch_id, checkpoint, fold, **store)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def drain_updates(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an update stream over what is available and return its state."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    update_store(stream, path, scratch_path(spark, f"{label}_checkpoint"), keys).awaitTermination()
    state = read_keyed(spark, path, keys)
    return state if state is not None else spark.createDataFrame([], stream.schema)


def drain_appends(stream: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    append_rows(stream, path, scratch_path(spark, f"{label}_checkpoint"), partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# --- operators -------------------------------------------------------------------------------


def checks_append(checks: DataFrame) -> DataFrame:
    """Checks with the day they are partitioned by."""
    return checks.withColumn("day", F.date_format("checked_at", "yyyy-MM-dd"))


def event_dedupe(events: DataFrame, late: str = "2 days") -> DataFrame:
    """First arrival of each event id within the lateness, which bounds the state. Older replays are kept out
    by the ledger (``ledger.py``), to which the stream's batches go."""
    return events.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["event_id"])


DAY = ["site_id", "day", "engine"]


def day_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("checks", "cited", "sov_units")]


def daily_sums(checks: DataFrame) -> DataFrame:
    """Counts of one batch of checks by day, site and engine; sums of sums, so late rows of any age join theirs."""
    good = checks.filter(F.col("error").isNull()).withColumn("day", F.date_format("checked_at", "yyyy-MM-dd"))
    return good.groupBy(*DAY).agg(F.count("*").alias("checks"), F.count_if("brand_cited").alias("cited"), F.sum(sov_units()).alias("sov_units"))


def daily_visibility(sums: DataFrame) -> DataFrame:
    """The series from the sums."""
    return sums.select(
        *DAY, "checks", "cited", percent_1dp(F.col("cited"), F.col("checks")).alias("visibility"), _sov_percent("sov_units", "checks").alias("avg_sov")
    )


def update_daily(checks: DataFrame, path: str, checkpoint: str, **store):
    """Start a query that adds each micro-batch to the daily sums at ``path``. It has no state and no watermark: the store is the state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(daily_sums(batch), path, DAY, batch_id, checkpoint, day_sums(), **store)

    return checks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    sums = read_keyed(spark, path, DAY, day_sums())
    return daily_visibility(sums if sums is not None else spark.createDataFrame([], "site_id string, day string, engine string, checks long, cited long, sov_units long"))


def usage_monthly(usage: DataFrame) -> DataFrame:
    return usage.groupBy("workspace_id", "period", "metric").agg(F.sum("count").alias("count"))


def latest_state(checks: DataFrame) -> DataFrame:
    """Newest check per prompt and engine; state holds one row per pair."""
    order = F.struct("checked_at", "check_id")
    row = F.struct("check_id", "checked_at", "brand_cited", "mode", "error")
    return checks.groupBy("prompt_id", "engine").agg(F.max_by(row, order).alias("r")).select("prompt_id", "engine", "r.*")


def view_counts(views: DataFrame) -> DataFrame:
    return views.groupBy("link_id").agg(F.count("*").alias("views"))
