"""Sharding by sampled splitters."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, materialise, numbered, unit

RANGES_PER_SHARD = 32
SAMPLES_PER_RANGE = 64


def _splitters(sample: pd.DataFrame, parts: int) -> np.ndarray:
    """Keys at which the weighted sample is cut into ``parts``; a key that fills a part alone gets a range alone."""
    if sample.empty:
        return np.empty(0, dtype="int64")
    sample = sample.sort_values("k")
    keys, reach = sample["k"].to_numpy("int64"), np.cumsum(sample["w"].to_numpy("float64"))
    cuts = keys[np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts, side="right").clip(max=len(keys) - 1)]
    twice = cuts[1:][cuts[1:] == cuts[:-1]]
    return np.unique(np.concatenate([cuts, twice + 1]))


def _draw(table: DataFrame, rate: float, seed: int) -> pd.DataFrame:
    """A sample of keys weighted by size; about as many rows as ``rate`` times the bytes, so of a set size."""
    copies = F.floor(F.col("size") * F.lit(rate) + unit(F.col("doc_id"), F.col("k"), F.lit(seed)))
    return table.select("k", copies.alias("w")).where("w > 0").groupBy("k").agg(F.sum("w").alias("w")).toPandas()


def _place(splitters: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, k.to_numpy("int64"), side="right").astype("int32"))

    return place("k")


def range_shards(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = RANGES_PER_SHARD, samples_per_range: int = SAMPLES_PER_RANGE) -> DataFrame:
    """Range-partitions ``docs(doc_id, text)`` into shards of nearly equal bytes.

    The key is a hash of the text, so equal texts share a range. A size-weighted sample of keys (a set
    number, ``n_shards * ranges_per_shard * samples_per_range`` expected) gives quantile splitters. The
    ranges are then weighed exactly: one that is over twice its share is cut again by splitters drawn
    from it alone, or, if it holds one key, by a number drawn for each row, which rows without id or with equal ids have as well. Shards are bundles of whole ranges,
    the heaviest dealt first to the lightest shard.

    Null text has no bytes and the key of the empty text; null ids and repeated rows are kept. An empty
    table gives no rows. Returns doc_id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    table = materialise(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("k"), unit(F.col("doc_id"), F.monotonically_increasing_id()).alias("u"),
    ), "sizes")
    total, rows = table.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = n_shards * ranges_per_shard
    share = max(1.0, total / parts)
    cuts = _splitters(_draw(table, parts * samples_per_range / max(1, total), 0), parts)
    for turn in range(1, 64):
        placed = table.withColumn("r", _place(cuts))
        weighed = placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high")).toPandas()
        over = weighed[(weighed["bytes"] > 2 * share) & (weighed["low"] < weighed["high"])]
        if over.empty:
            break
        again = _draw(placed.where(F.col("r").isin(over["r"].tolist())), parts * samples_per_range / over["bytes"].sum(), turn)
        where = np.searchsorted(cuts, again["k"].to_numpy("int64"), side="right")
        new = [_splitters(again[where == r], max(2, int(-(-b // share)))) for r, b in zip(over["r"], over["bytes"], strict=True)]
        middle = [np.array([(lo + hi) // 2 + 1], dtype="int64") for lo, hi in zip(over["low"], over["high"], strict=True)]
        cuts = np.unique(np.concatenate([cuts, *new, *middle]))
    pieces = {int(r): max(1, int(-(-b // share))) for r, b in zip(weighed["r"], weighed["bytes"], strict=True)}
    alone = {int(r): n for r, n, lo, hi in zip(weighed["r"], pieces.values(), weighed["low"], weighed["high"], strict=True) if lo == hi and n > 1}

    @F.pandas_udf("int")
    def piece(r: pd.Series, u: pd.Series) -> pd.Series:
        return (r.map(alone).fillna(1) * u).astype("int32")

    cut = placed.withColumn("p", piece("r", F.col("u")))
    loads = [(0, s) for s in range(n_shards)]
    plan = []
    for r, p, size in cut.groupBy("r", "p").agg(F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "r", "p").toPandas().itertuples(index=False):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + int(size), shard))
        plan.append((int(r), int(p), shard))
    spark = docs.sparkSession
    # At most twice the ranges asked for, and a piece for each share of the bytes: a fixed number of rows.
    dealt = spark.createDataFrame(plan, "r int, p int, shard int")
    return numbered(cut.join(F.broadcast(dealt), ["r", "p"]), "shard", ["doc_id", "text_crc32", "u"], "slot", rows).select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents``, by nearly equal bytes. Null and empty texts weigh 16 bytes; very long ones lie whole in one
    shard; equal texts share a range unless it is cut as too heavy; null ids and repeated rows are kept; an empty table gives no rows.
    """
    out = range_shards(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
