"""The crawl frontier as link-graph reachability.

Level-synchronous breadth-first search over an edge table, for all sites at once. Each level is one job: one
join, one anti join against what was seen, and a rank. Levels are written to the shared folder, so lineage
stays short and a lost executor costs one level at most.
"""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .ranking import row_number_by_range
from .robots import robots_allowed

_VISITED = ["site_id", "url", "depth", "rank"]
_ORIGIN = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def crawl_edges(features: DataFrame) -> DataFrame:
    """``(site_id, src, dst, pos)`` of every distinct link of pages without an error to their own origin."""
    # Outer, as Spark infers two tests of the list below a plain generator and would extract a page's links for each of them again.
    links = F.posexplode_outer("internal_links").alias("pos", "dst")
    edges = features.filter("error IS NULL").select("site_id", F.col("url").alias("src"), links).where("dst IS NOT NULL")
    return edges.filter(F.lower(F.regexp_extract("src", _ORIGIN, 0)) == F.lower(F.regexp_extract("dst", _ORIGIN, 0)))


def crawl_robots_skip(edges: DataFrame, robots: DataFrame, sites: DataFrame, ua: str) -> DataFrame:
    """Edges with ``allowed``: may ``ua`` fetch the target?"""
    path = F.regexp_replace(F.regexp_extract("dst", r"^[a-z]+://[^/?#]*([^#]*)", 1), r"^(?=\?|$)", "/")
    targets = edges.select("site_id", "dst").distinct().join(sites.select("site_id", "origin"), "site_id")
    decided = robots_allowed(
        targets.select("site_id", "dst", "origin", F.lit(ua).alias("ua"), path.alias("path")), robots
    ).select("site_id", "dst", "allowed")
    return edges.join(decided, ["site_id", "dst"])


def crawl_seeds(seeds: DataFrame, robots: DataFrame, sites: DataFrame, ua: str) -> DataFrame:
    """Seeds with ``allowed`` and, where robots.txt refuses ``ua``, the error of their only page row.

    A refused seed is reported as an outcome of one skipped page, never as an empty crawl.
    """
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1), r"^(?=\?|$)", "/")
    asked = seeds.select("site_id", "url").join(sites.select("site_id", "origin"), "site_id")
    decided = robots_allowed(
        asked.select("site_id", "url", "origin", F.lit(ua).alias("ua"), path.alias("path")), robots
    )
    refusal = F.concat(F.lit("robots.txt disallows "), F.lit(ua), F.lit(" from "), F.col("path"))
    return decided.select(
        "site_id",
        "url",
        "allowed",
        F.when(~F.col("allowed"), refusal).alias("error"),
        F.when(F.col("allowed"), 0).otherwise(1).alias("skipped_by_robots"),
    )


#: Up to so many edges a level is numbered by one window; beyond, over ranges, as one site may hold most of it.
WINDOW_EDGES = 5_000_000


def _rank_level(level: DataFrame, cap: int | None, by_range: bool) -> DataFrame:
    """Discovery order inside a level: parent's rank, then link position; no more than can be used.

    ``cap + 1`` rows per site are enough to fill the cap and to know that more remained.
    """
    if cap is None and by_range:
        return row_number_by_range(level, ["site_id"], [F.col("parent_rank"), F.col("pos")], "level_rank")
    w = Window.partitionBy("site_id").orderBy("parent_rank", "pos")
    ranked = level.withColumn("level_rank", F.row_number().over(w))
    return ranked if cap is None else ranked.filter(F.col("level_rank") <= cap + 1)


class _Bucketed:
    """A table in the shared folder whose rows lie in hash buckets of their keys, so joins on these move only the other side."""

    def __init__(self, spark, keys: list[str]):
        self.spark, self.keys = spark, keys
        self.name, self.path = f"answerlens_{uuid.uuid4().hex}", scratch_path(spark, "buckets")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> int:
        """Adds rows; their number comes from the write itself."""
        seen = Observation()
        placed = rows.repartition(self.buckets, *self.keys).observe(seen, F.count(F.lit(1)).alias("n"))
        placed.write.format("parquet").bucketBy(self.buckets, *self.keys).option("path", self.path).mode("append").saveAsTable(self.name)
        return seen.get["n"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def detach(self) -> DataFrame:
        """The files without the name in the catalog."""
        schema = self.rows().schema
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def crawl_reach(edges: DataFrame, seeds: DataFrame, cap: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Pages reached from each site's seed in breadth-first order: ``(site_id, url, depth, rank)``.

    First visit wins. The whole graph is walked; with ``cap`` a page past it is not expanded, with ``max_depth``
    the walk ends at that level. Edges may carry ``allowed``; those that do
    not are dropped. The result keeps one row beyond the cap where a site had more (``rank > cap``).

    Edges lie in buckets of (site, source) and visited pages in buckets of (site, url), so a level is one job that
    moves only its frontier and what it finds, and whose own row count ends the walk.
    """
    spark = edges.sparkSession
    if "allowed" in edges.columns:
        edges = edges.filter("allowed").drop("allowed")
    links, visited = _Bucketed(spark, ["site_id", "src"]), _Bucketed(spark, ["site_id", "url"])
    by_range = links.append(edges.select("site_id", "src", "pos", "dst")) > WINDOW_EDGES
    visited.append(seeds.select("site_id", "url", F.lit(0).alias("depth"), F.lit(1).alias("rank"), F.lit(1).alias("reached")))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        known = visited.rows()
        frontier = known.where(F.col("depth") == depth - 1)
        open_pages = (frontier if cap is None else frontier.filter(F.col("rank") < cap)).select(
            "site_id", F.col("url").alias("src"), F.col("rank").alias("parent_rank"), "reached"
        )
        found = (
            open_pages.join(links.rows(), ["site_id", "src"])
            .groupBy("site_id", F.col("dst").alias("url"))
            .agg(F.min(F.struct("parent_rank", "pos")).alias("first"), F.max("reached").alias("reached"))
            .select("site_id", "url", "first.parent_rank", "first.pos", "reached")
            .join(known.select("site_id", "url"), ["site_id", "url"], "left_anti")
        )
        # ``reached`` is the highest rank of the site so far; every row of a level carries it to the next.
        level = _rank_level(found, cap, by_range).withColumn("rank", F.col("level_rank") + F.col("reached"))
        if cap is not None:
            level = level.filter(F.col("rank") <= cap + 1)
        if by_range and cap is None:
            level = materialise(level, f"level_{depth}")
            level = level.drop("reached").join(level.groupBy("site_id").agg(F.max("rank").alias("reached")), "site_id")
        else:
            level = level.withColumn("reached", F.max("rank").over(Window.partitionBy("site_id")))
        level = level.select("site_id", "url", F.lit(depth).alias("depth"), "rank", "reached")
        if not visited.append(level):
            break
    links.detach()
    return visited.detach().select(*_VISITED)


def skipped_by_robots(edges: DataFrame, reached: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct disallowed links of the expanded pages, counted once each, per site."""
    expanded = (reached if cap is None else reached.filter(F.col("rank") < cap)).select("site_id", F.col("url").alias("src"))
    refused = (
        edges.filter(~F.col("allowed"))
        .join(expanded, ["site_id", "src"], "left_semi")
        .groupBy("site_id", "dst")
        .agg(F.lit(1).alias("one"))
        .groupBy("site_id")
        .agg(F.count("*").alias("skipped"))
    )
    return seeds.select("site_id").join(refused, "site_id", "left").select(
        "site_id", F.coalesce("skipped", F.lit(0)).alias("skipped_by_robots")
    )


def crawl_cap(reached: DataFrame, cap: int) -> DataFrame:
    """Per site: pages kept and whether more remained."""
    return reached.groupBy("site_id").agg(
        F.count_if(F.col("rank") <= cap).alias("pages"), (F.max("rank") > cap).alias("capped")
    )


def audit_gate(features: DataFrame, order: str, key: str = "site_id") -> DataFrame:
    """Per site: ``complete`` when any page is usable, else ``failed`` with the first page's reason."""
    usable = F.col("error").isNull() & (F.coalesce("status_code", F.lit(0)) < 400)
    first = F.struct(F.col("status_code"), F.col("error"), F.col("url"))
    agg = features.groupBy(key).agg(
        F.bool_or(usable).alias("any_usable"), F.min_by(first, F.struct(F.col(order), F.col("url"))).alias("first")
    )
    host = F.regexp_extract("first.url", r"^[A-Za-z]+://([^/?#]+)", 1)
    reason = F.when(
        F.col("first.status_code") >= 400,
        F.concat(
            host, F.lit(" answered HTTP "), F.col("first.status_code").cast("string"),
            F.lit("; a server that refuses unknown crawlers refuses GPTBot, ClaudeBot and PerplexityBot too"),
        ),
    ).otherwise(
        F.concat(F.lit("Could not fetch "), host, F.lit(": "), F.coalesce("first.error", F.lit("the request failed")))
    )
    return agg.select(
        key,
        F.when(F.col("any_usable"), "complete").otherwise(F.lit("failed")).alias("status"),
        F.when(~F.col("any_usable"), reason).alias("reason"),
    )
