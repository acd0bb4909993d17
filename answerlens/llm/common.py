"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.session import materialise

WORD_GAP = r"[\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole ``documents`` table, only the columns named (all without any)."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(parts))


def unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, so a recomputed task repeats it."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def in_small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on rows of this session travel to the workers in batches of about ``size`` bytes, or of one row; no result depends on it.

    A task's texts would else be held whole: in the executor, in its worker and as objects there. A size that the application was started with stays.
    """
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, size)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None) -> DataFrame:
    """Applies ``fn`` to every Arrow batch of every partition, cut into parts of ``rows`` rows where that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, key: str, order: list[str], into: str, rows: int, per_bucket: int = 50_000) -> DataFrame:
    """Numbers the rows of each ``key`` from 0 without gaps.

    A key is cut into buckets by a hash of ``order``; their count grows with ``rows``, so no task sorts
    a whole key. Ties get different numbers in any order.
    """
    buckets = max(1, -(-rows // per_bucket))
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    ranked = cut.withColumn("_inside", inside - 1)
    joined = ranked.join(offsets, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(into, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_key", "_b", "_offset")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``, as ``(node, root)`` with the smallest node as root.

    Alternates the large-star and small-star steps until the edges stay the same; each round is a
    table in the shared folder. A hub only meets a partial minimum and a join, never a window.
    """
    spark = edges.sparkSession
    cur = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if now == state:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def predictions(docs: DataFrame, scorer: Callable[[DataFrame], DataFrame], column: str, threshold: float) -> DataFrame:
    """What ``scorer`` adds as ``column``, without the text: doc_id, held_out, score, predicted."""
    scored = scorer(docs)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col(column).alias("score"),
        (F.col(column) >= threshold).cast("int").alias("predicted"),
    )


def with_column(docs: DataFrame, name: str, kind: str, fn: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """Adds one column computed from Arrow batches; a column of that name is replaced."""
    docs = docs.drop(name)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, fn(batch)], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{schema}, `{name}` {kind}" if schema else f"`{name}` {kind}")


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task; it must not depend on what a task has read."""
    held = sys.__dict__.setdefault("_answerlens_llm", {})
    if key not in held:
        held[key] = make()
    return held[key]
