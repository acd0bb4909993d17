"""Windows over keys that may hold most of the data.

Each helper splits a key by a bucket that grows with its order (a day, a minute), works inside
(key, bucket), and carries one row per bucket across. No task sees more than a bucket of a hot key,
and the carried rows are bounded by the time span, not by the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def row_number_by_bucket(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str = "rn"
) -> DataFrame:
    """``row_number`` over ``keys`` by (bucket, order)."""
    tagged = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_rn") + F.col("_offset"))
        .drop("_rn", "_offset", "_bucket")
    )


def row_number_by_range(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", ranges: int | None = None) -> DataFrame:
    """``row_number`` over ``keys`` by ``order``, for keys that may hold most of the rows.

    Rows are range-partitioned by (keys, order), so a hot key lies in many ranges in turn; each range is
    numbered alone and moved on by the counts of the ranges before it. Ranges follow the data; their
    number is ``ranges``, or that of the session's shuffle partitions. The ranges are a stored table, so
    that both passes see the same ones.
    """
    spark = df.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(count, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    cut = materialise(cut, "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_range")
        .agg(F.count("*").alias("_n"))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, same)
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("int"))
        .select(*df.columns, name)
    )


def carry_forward(
    df: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str
) -> DataFrame:
    """Last non-null ``value`` at or before each row of ``key`` in (bucket, order)."""
    tagged = df.withColumn("_bucket", bucket)
    inside = (
        Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        tagged.groupBy(key, "_bucket")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(before))
        .drop("_end")
    )
    return (
        tagged.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
        .join(ends, [key, "_bucket"])
        .withColumn(name, F.coalesce("_own", "_carried"))
        .drop("_own", "_carried", "_bucket")
    )


def trailing_count(df: DataFrame, key: str, ts: str, tie: str, seconds: int, name: str) -> DataFrame:
    """For each row, how many rows of its key lie in ``(ts - seconds, ts]``, ties broken by ``tie``.

    Whole minutes in between come from per-minute counts; the two edge minutes are counted exactly
    inside (key, minute).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_t", micros)
    minute = 60_000_000
    span = seconds * 1_000_000
    points = rows.select(
        key,
        tie,
        F.explode(
            F.array(
                F.struct(F.lit("own").alias("kind"), F.col("_t").alias("t")),
                F.struct(F.lit("edge").alias("kind"), (F.col("_t") - span).alias("t")),
            )
        ).alias("p"),
    ).select(key, tie, "p.kind", "p.t", F.floor(F.col("p.t") / minute).alias("_minute"))
    own = F.when(F.col("kind") == "own", 1).otherwise(0)
    # own: rows of the minute up to and with this one; edge: rows of the minute up to the point.
    inside = (
        Window.partitionBy(key, "_minute")
        .orderBy("t", F.when(F.col("kind") == "own", 0).otherwise(1), tie)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    minute_line = Window.partitionBy(key).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    per_minute = (
        points.groupBy(key, "_minute")
        .agg(F.sum(own).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(minute_line), F.lit(0)))
        .drop("_n")
    )
    cumulative = (
        points.withColumn("_upto", F.sum(own).over(inside))
        .join(per_minute, [key, "_minute"])
        .withColumn("_cum", F.col("_upto") + F.col("_before"))
    )
    counts = cumulative.groupBy(key, tie).agg(
        (
            F.max(F.when(F.col("kind") == "own", F.col("_cum")))
            - F.max(F.when(F.col("kind") == "edge", F.col("_cum")))
        ).alias(name)
    )
    return df.join(counts, [key, tie])
