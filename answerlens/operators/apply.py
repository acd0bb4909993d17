"""Updates and deletes as table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import slugify
from .ranking import row_number_by_bucket
from .tracker import latest


def apply_patch(table: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Latest patch per key. A column ``c`` is written when ``set_c`` is true, so NULL can be written too."""
    newest = latest(patches, [key], "patched_at", "patch_id").select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], *[F.col(f"set_{c}").alias(f"_set_{c}") for c in columns]
    )
    joined = table.join(newest, key, "left")
    return joined.withColumns(
        {c: F.when(F.coalesce(f"_set_{c}", F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    ).select(*table.columns)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, key: str, links: dict[str, str]) -> dict[str, DataFrame]:
    """Drop ``deleted`` keys of the first table and everything that refers to what is dropped.

    ``links`` maps a child table to ``parent.column``, parents first.
    """
    root = next(iter(tables))
    gone = {root: deleted.select(key).distinct()}
    out = {root: tables[root].join(gone[root], key, "left_anti")}
    for child, ref in links.items():
        parent, column = ref.split(".")
        dead = gone[parent].select(F.col(gone[parent].columns[0]).alias(column))
        out[child] = tables[child].join(dead, column, "left_anti")
        own_key = tables[child].columns[0]
        gone[child] = tables[child].join(dead, column, "left_semi").select(own_key).distinct()
    return out


def unique_slug(df: DataFrame, name: str, created_at: str, key: str) -> DataFrame:
    """Slug of ``name``; collisions get ``-2``, ``-3`` … in order of creation.

    Ranked by creation day, so one very common slug is spread over tasks.
    """
    based = df.withColumn("base_slug", slugify(F.col(name), 40, "workspace"))
    ranked = row_number_by_bucket(
        based, ["base_slug"], F.to_date(created_at), [F.col(created_at), F.col(key)], "slug_no"
    )
    suffix = F.when(F.col("slug_no") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("slug_no").cast("string")))
    return ranked.withColumn("slug", F.concat("base_slug", suffix))
