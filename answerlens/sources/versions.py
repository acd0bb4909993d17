"""Tables that readers see in whole versions.

Rows are staged as Parquet below ``data/part=<id>``; a version is one small manifest that names the
directories which belong to it. A manifest appears by one rename that never replaces a file, so of two writers
on the same version one fails and starts again, and a write that dies leaves files that no manifest names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has published the version in the meantime."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path(folder))] if files.exists(path(folder)) else []


def current(spark: SparkSession, path: str) -> dict:
    """The newest manifest: ``version``, ``dirs`` and what the writer noted; version 0 has no directories."""
    newest = max((n for n in _names(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith((".", "_"))), default=None)
    if newest is None:
        return {"version": 0, "dirs": [], "schema": None}
    text = spark.read.text(f"{path}/_versions/{newest}", wholetext=True).first()[0]
    return json.loads(text)


def stage(rows: DataFrame, path: str, partition_by: list[str] | None = None, by_value: bool = False) -> list[str]:
    """Writes ``rows`` where no reader looks yet; the directories to name in a manifest, one for each value where asked for."""
    part = f"part={uuid.uuid4().hex}"
    writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
    writer.parquet(f"{path}/data/{part}")
    return [f"{part}/{n}" for n in _names(rows.sparkSession, f"{path}/data/{part}") if "=" in n] if by_value else [part]


def publish(spark: SparkSession, path: str, after: dict, dirs: list[str], schema: T.StructType, **notes) -> dict:
    """Makes ``dirs`` the table, as the version that follows ``after``; ``Conflict`` if that one exists already."""
    version = after["version"] + 1
    manifest = {**{k: v for k, v in after.items() if k not in ("version", "dirs", "schema")}, "version": version, "dirs": dirs, "schema": json.loads(schema.json()), **notes}
    files, place = _files(spark, path)
    draft, final = place(f"{path}/_versions/_draft-{uuid.uuid4().hex}"), place(f"{path}/_versions/{version:020d}.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), never_replace)
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise Conflict(f"{path} has version {version} already") from None
        raise
    return manifest


def read_version(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame | None:
    """The rows of a version, of the newest one by default; None where nothing was published."""
    manifest = manifest or current(spark, path)
    if manifest["schema"] is None:
        return None
    schema = T.StructType.fromJson(manifest["schema"])
    if not manifest["dirs"]:
        return spark.createDataFrame([], schema)
    whole = schema.add("part", "string") if "part" not in schema.names else schema
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{d}" for d in manifest["dirs"]]).drop("part")


def stage_table(rows: DataFrame, path: str) -> dict:
    """Writes one of several tables that a manifest will name together (``tables=``)."""
    return {"dirs": stage(rows, path), "schema": json.loads(rows.schema.json())}


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version."""
    return {name: read_version(spark, path, t) for name, t in current(spark, path).get("tables", {}).items()}


def rewrite(spark: SparkSession, path: str, change: Callable[[dict], dict | None], tries: int = 5) -> dict:
    """Publishes what ``change`` makes of the newest version; begins anew when another writer was first."""
    for left in reversed(range(tries)):
        at = current(spark, path)
        try:
            done = change(at)
            return at if done is None else publish(spark, path, at, **done)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def remove_unnamed(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes what the newest ``keep`` versions do not name: replaced files, older manifests, leavings of failed writes.

    To be run by the only writer; readers of older versions should have ended.
    """
    files, place = _files(spark, path)
    manifests = sorted(n for n in _names(spark, f"{path}/_versions") if n.endswith(".json") and not n.startswith((".", "_")))
    named = {p for n in manifests[-keep:] for p in re.findall("part=[0-9a-f]{32}", spark.read.text(f"{path}/_versions/{n}", wholetext=True).first()[0])}
    for n in [*manifests[:-keep], *(n for n in _names(spark, f"{path}/_versions") if n.startswith("_draft-"))]:
        files.delete(place(f"{path}/_versions/{n}"), False)
    for part in _names(spark, f"{path}/data"):
        if part.startswith("part=") and part not in named:
            files.delete(place(f"{path}/data/{part}"), True)


# --- one row per key ----------------------------------------------------------------------------


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def folded(rows: DataFrame, keys: list[str], fold: list[Column] | None = None) -> DataFrame:
    """One row per key: the one of the latest version, or what ``fold``, a list of aggregates that keep their columns' names, makes of all."""
    if fold:
        return rows.groupBy("bucket", *keys).agg(*fold, F.max("version").alias("version"))
    order = Window.partitionBy("bucket", *keys).orderBy(F.col("version").desc())
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def upsert(batch: DataFrame, path: str, keys: list[str], batch_id: int, writer: str = "", fold: list[Column] | None = None, buckets: int = 16, most_deltas: int = 8) -> dict:
    """Adds a micro-batch with one row per key; its rows replace those of their keys, or join them by ``fold``.

    A batch of this ``writer`` (a stream's checkpoint) that a version has counted already is left out, so a replay changes
    nothing. Each batch is one delta, laid out by a bucket of the key. At ``most_deltas`` they are merged with the base,
    bucket by bucket: a store holds at most ``most_deltas`` parts besides its base, and what they replace is deleted.
    """
    spark = batch.sparkSession

    def change(at: dict) -> dict | None:
        done = at.get("done", {})
        if batch_id <= done.get(writer, -1):
            return None
        count = at.get("buckets", buckets)
        rows = batch.withColumn("version", F.lit(at["version"] + 1).cast("long")).withColumn("bucket", bucket_of(keys, count))
        dirs = at["dirs"] + stage(rows.repartition("bucket"), path, ["bucket"])
        return {"dirs": dirs, "schema": rows.schema, "done": {**done, writer: batch_id}, "buckets": count, "deltas": at.get("deltas", 0) + 1}

    at = rewrite(spark, path, change)
    return compact(spark, path, keys, fold) if at.get("deltas", 0) >= most_deltas else at


def compact(spark: SparkSession, path: str, keys: list[str], fold: list[Column] | None = None) -> dict:
    """Merges the deltas into the base; the version before stays readable until the next merge."""

    def change(at: dict) -> dict | None:
        rows = read_version(spark, path, at)
        if rows is None or not at.get("deltas"):
            return None
        merged = folded(rows, keys, fold).select(rows.columns)
        return {"dirs": stage(merged.repartition("bucket"), path, ["bucket"]), "schema": rows.schema, "deltas": 0}

    at = rewrite(spark, path, change)
    remove_unnamed(spark, path)
    return at


def read_keyed(spark: SparkSession, path: str, keys: list[str], fold: list[Column] | None = None) -> DataFrame | None:
    """One row per key; a base without deltas is read as it is."""
    at = current(spark, path)
    rows = read_version(spark, path, at)
    if rows is None:
        return None
    return (folded(rows, keys, fold) if at.get("deltas") else rows).drop("bucket", "version")
