"""An eternal ledger of event ids, behind Bloom filters that say which of its buckets need to be read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from ..sources.versions import bucket_of, read_version, remove_unnamed, rewrite, stage

HASHES = 5
BITS_PER_ID = 10
BLOOM = T.StructType([T.StructField("word", T.LongType()), T.StructField("mask", T.LongType()), T.StructField("bucket", T.IntegerType())])


def bits_of(key: str, words: int) -> Column:
    """The bits of an id in its bucket's filter: (word, mask), each once."""
    places = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(64 * words)) for i in range(HASHES)]))
    return F.transform(places, lambda p: F.struct(F.floor(p / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")).alias("mask")))


def _filter(rows: DataFrame, key: str, words: int) -> DataFrame:
    """Filters of the ids in ``rows(key, bucket)`` as a table of 64-bit words."""
    return rows.select("bucket", F.explode(bits_of(key, words)).alias("b")).groupBy("bucket", "b.word").agg(F.bit_or("b.mask").alias("mask")).select("word", "mask", "bucket")


def _blooms(spark: SparkSession, path: str, at: dict) -> DataFrame:
    return read_version(spark, path, {"dirs": at["bloom"], "schema": json.loads(BLOOM.json())})


def perhaps_known(fresh: DataFrame, filters: DataFrame, key: str, words: int) -> DataFrame:
    """``(key, bucket)`` of the rows whose bits are all set: every known id, and about one in a hundred others."""
    asked = fresh.select(key, "bucket", bits_of(key, words).alias("bits")).select(key, "bucket", F.size("bits").alias("all"), F.explode("bits").alias("b"))
    asked = asked.select(key, "bucket", "all", "b.word", F.col("b.mask").alias("bit"))
    hit = asked.join(filters, ["bucket", "word"]).where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return hit.groupBy(key, "bucket").agg(F.count("*").alias("n"), F.first("all").alias("all")).where("n = all").select(key, "bucket")


def admit(batch: DataFrame, path: str, batch_id: int, writer: str = "", key: str = "event_id", order: tuple[str, ...] = ("received_at", "seq"), buckets: int = 64, words: int = 256, most_parts: int = 8) -> dict:
    """Adds the events of a batch whose id the ledger does not hold, the first of each id; returns the version, with the buckets ``read``.

    The ledger lies in buckets of the id, each with a Bloom filter of about ten bits an id, kept as a table of
    words, so a filter test is an equi join that reads only the words of this batch's buckets. Only buckets with an id that its filter
    may hold are read themselves. A batch of this ``writer`` that is counted already changes nothing. At ``most_parts`` deltas the parts
    are merged and filters that have filled up are made anew with more words.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("e")).select(key, "e.*")
    table = None

    def change(at: dict) -> dict | None:
        nonlocal table
        done, count, size = at.get("done", {}), at.get("buckets", buckets), at.get("words", words)
        if batch_id <= done.get(writer, -1):
            return None
        if table is None:
            table = materialise(first.withColumn("bucket", bucket_of([key], count)), "events")
        new, touched = table, []
        if at["dirs"]:
            mine = [r["bucket"] for r in table.select("bucket").distinct().collect()]  # at most the number of buckets
            filters = _blooms(spark, path, at).where(F.col("bucket").isin(mine)).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
            perhaps = materialise(perhaps_known(table, filters, key, size), "perhaps")
            touched = sorted(r["bucket"] for r in perhaps.select("bucket").distinct().collect())
            if touched:
                held = read_version(spark, path, at).where(F.col("bucket").isin(touched)).select(key, "bucket")
                known = held.join(perhaps, [key, "bucket"], "left_semi")
                new = table.join(known, [key, "bucket"], "left_anti").select(table.columns)
        new = materialise(new, "new_events")
        dirs = at["dirs"] + stage(new.repartition("bucket"), path, ["bucket"])
        bloom = at.get("bloom", []) + stage(_filter(new, key, size).repartition("bucket"), path, ["bucket"])
        return {"dirs": dirs, "schema": new.schema, "bloom": bloom, "done": {**done, writer: batch_id}, "buckets": count, "words": size, "deltas": at.get("deltas", 0) + 1, "read": touched}

    at = rewrite(spark, path, change)
    return compact(spark, path, key) | {"read": at["read"]} if at.get("deltas", 0) >= most_parts else at


def compact(spark: SparkSession, path: str, key: str = "event_id") -> dict:
    """One part of rows, one of filters; their words grow with the ids."""

    def change(at: dict) -> dict | None:
        rows = read_version(spark, path, at)
        if rows is None or not at.get("deltas"):
            return None
        need = -(-rows.count() * BITS_PER_ID // (64 * at["buckets"]))
        size = at["words"]
        while size < need:
            size *= 2
        dirs = stage(rows.repartition("bucket"), path, ["bucket"])
        fresh = _filter(rows, key, size) if size > at["words"] else _blooms(spark, path, at).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask")).select("word", "mask", "bucket")
        return {"dirs": dirs, "schema": rows.schema, "bloom": stage(fresh.repartition("bucket"), path, ["bucket"]), "words": size, "deltas": 0}

    at = rewrite(spark, path, change)
    remove_unnamed(spark, path)
    return at


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    rows = read_version(spark, path)
    return rows.drop("bucket") if rows is not None else None


def keep_ledger(events: DataFrame, path: str, checkpoint: str, **ledger):
    """Start a query that admits every micro-batch of ``events`` to the ledger at ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        admit(batch, path, batch_id, checkpoint, **ledger)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
