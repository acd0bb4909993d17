"""Answer-surface operators: llms.txt, llms-full.txt and the sitemap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def served(file: Column) -> Column:
    """Answered below 400 with something that is not a page of markup."""
    ok = (file["status_code"] > 0) & (file["status_code"] < 400) & ~file["body"].rlike(r"^\s*<")
    return F.coalesce(ok, F.lit(False))


def llms_well_formed(file: Column) -> Column:
    return served(file) & file["body"].rlike(r"(?m)^#\s+\S") & file["body"].rlike(r"\[.+\]\(.+\)")


def llms_sections(file: Column) -> Column:
    n = F.regexp_count(file["body"], F.lit(r"(?m)^##\s+\S"))
    return F.when(served(file), n).otherwise(F.lit(0))


def file_bytes(file: Column) -> Column:
    return F.coalesce(F.octet_length(file["body"]), F.lit(0))


def sitemap_url(origin: Column, sitemaps: Column) -> Column:
    """The first sitemap that robots.txt names, else the usual address."""
    return F.coalesce(F.get(sitemaps, 0), F.concat(origin, F.lit("/sitemap.xml")))


def sitemap_present(file: Column) -> Column:
    ok = (file["status_code"] > 0) & (file["status_code"] < 400) & file["body"].rlike("(?i)<(urlset|sitemapindex)")
    return F.coalesce(ok, F.lit(False))


def answer_surface(files: DataFrame, robots: DataFrame) -> DataFrame:
    """One row per origin with the three surface structs. ``files`` comes from ``scan_site_files``."""
    llms, full, smap = F.col("llms"), F.col("llms_full"), F.col("sitemap")
    present = sitemap_present(smap)
    by_origin = files.join(robots.select("origin", "sitemaps"), "origin", "left")
    named = F.coalesce(F.size("sitemaps"), F.lit(0)) > 0
    return by_origin.select(
        "origin",
        F.struct(
            served(llms).alias("present"),
            F.when(served(llms), file_bytes(llms)).otherwise(F.lit(0)).alias("bytes"),
            llms_well_formed(llms).alias("well_formed"),
            llms_sections(llms).alias("sections"),
        ).alias("llms_txt"),
        F.struct(served(full).alias("present"), file_bytes(full).alias("bytes")).alias("llms_full_txt"),
        F.struct(
            present.alias("present"),
            F.when(present, F.regexp_count(smap["body"], F.lit("(?i)<loc>"))).otherwise(F.lit(0)).alias("url_count"),
            F.when(present & named, F.lit("robots")).when(present, F.lit("default")).alias("source"),
            sitemap_url(F.col("origin"), F.col("sitemaps")).alias("url"),
        ).alias("sitemap"),
    )
