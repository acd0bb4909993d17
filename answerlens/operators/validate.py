"""Row rules, unique keys and references as quarantine splits.

Row rules add ``reasons`` in the row. Unique and reference checks find offenders with a rank or an
anti join; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import ENGINES
from ..functions.text import trim_ws

INTENTS = ["informational", "commercial", "local", "navigational"]

# Allowed values and ranges by table.
ENUMS = {
    "workspaces": {
        "plan": ["free", "starter", "growth", "agency"],
        "plan_status": ["active", "past_due", "canceled", "trialing"],
    },
    "audits": {
        "scope": ["site", "single_url"],
        "status": ["queued", "running", "complete", "failed"],
    },
    "issues": {
        "severity": ["critical", "high", "medium", "low"],
        "effort": ["low", "medium", "high"],
        "status": ["open", "in_progress", "fixed", "ignored"],
    },
    "prompts": {"intent": INTENTS},
    "checks": {
        "engine": ENGINES,
        "mode": ["live", "simulated"],
        "sentiment": ["positive", "neutral", "negative"],
        "trigger_source": ["manual", "schedule", "seed"],
    },
    "share_links": {"kind": ["audit", "citations", "combined"]},
    "scheduled_runs": {
        "kind": ["weekly_citations", "weekly_audit"],
        "status": ["running", "complete", "failed", "skipped"],
    },
}
RANGES = {"audits": {"overall_score": (0, 100), "previous_score": (0, 100)}}
UNIQUE_KEYS = {
    "sites": ["workspace_id", "origin"],
    "audits": ["public_id"],
    "audit_pages": ["audit_id", "url"],
    "prompts": ["site_id", "prompt", "locale"],
    "competitors": ["site_id", "name"],
    "usage_counters": ["workspace_id", "period", "metric"],
}


def _between(text: Column, low: int, high: int) -> Column:
    return F.length(trim_ws(text)).between(low, high)


def _rule(name: str, ok: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))


def _optional(col: Column, ok: Column) -> Column:
    return col.isNull() | ok


def with_reasons(df: DataFrame, rules: list[Column]) -> DataFrame:
    return df.withColumn("reasons", F.array_compact(F.array(*rules)))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)`` of a table with ``reasons``."""
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def _alias_rule(col: str) -> Column:
    fine = (F.size(col) <= 10) & F.forall(col, lambda a: F.length(trim_ws(a)).between(1, 120))
    return _rule(col, _optional(F.col(col), fine))


def validate_sites(df: DataFrame) -> DataFrame:
    url = trim_ws(F.col("url"))
    return with_reasons(
        df,
        [
            _rule("url", _between(F.col("url"), 3, 2048) & ~url.rlike(r"\s")),
            _rule("brand_name", _between(F.col("brand_name"), 1, 120)),
            _rule("name", _optional(F.col("name"), F.length(trim_ws(F.col("name"))) <= 120)),
            _alias_rule("brand_aliases"),
        ],
    )


def validate_prompts(df: DataFrame) -> DataFrame:
    engines = F.col("engines")
    known = F.array(*[F.lit(e) for e in ENGINES])
    return with_reasons(
        df,
        [
            _rule("prompt", _between(F.col("prompt"), 3, 500)),
            _rule("intent", _optional(F.col("intent"), F.col("intent").isin(*INTENTS))),
            _rule("locale", _optional(F.col("locale"), trim_ws(F.col("locale")).rlike("^[a-z]{2}(-[A-Z]{2})?$"))),
            _rule(
                "engines",
                _optional(engines, F.size(engines).between(1, 4) & (F.size(F.array_except(engines, known)) == 0)),
            ),
        ],
    )


def validate_competitors(df: DataFrame) -> DataFrame:
    return with_reasons(
        df,
        [
            _rule("name", _between(F.col("name"), 1, 120)),
            _rule("domain", _optional(F.col("domain"), F.length(trim_ws(F.col("domain"))) <= 253)),
            _alias_rule("aliases"),
        ],
    )


def validate_branding(df: DataFrame) -> DataFrame:
    short = lambda c, n: _optional(F.col(c), F.length(trim_ws(F.col(c))) <= n)
    url = trim_ws(F.col("brand_logo_url"))
    return with_reasons(
        df,
        [
            _rule("name", _optional(F.col("name"), _between(F.col("name"), 1, 120))),
            _rule("brand_name", short("brand_name", 120)),
            _rule(
                "brand_logo_url",
                _optional(F.col("brand_logo_url"), url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$") & (F.length(url) <= 2048)),
            ),
            _rule("brand_colour", _optional(F.col("brand_colour"), trim_ws(F.col("brand_colour")).rlike("^#[0-9a-fA-F]{6}$"))),
            _rule("brand_footer", short("brand_footer", 300)),
            _rule("brand_contact", short("brand_contact", 300)),
        ],
    )


def validate_share_links(df: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return with_reasons(
        df,
        [
            _rule("kind", kind.isin("audit", "citations", "combined")),
            _rule("audit_id", (kind != "audit") | F.col("audit_id").isNotNull()),
            _rule("site_id", (kind == "audit") | F.col("site_id").isNotNull()),
            _rule("label", _optional(F.col("label"), F.length(trim_ws(F.col("label"))) <= 120)),
        ],
    )


def validate_enums(df: DataFrame, table: str) -> DataFrame:
    """Allowed values and ranges of a table; NULL passes."""
    rules = [_rule(c, _optional(F.col(c), F.col(c).isin(*v))) for c, v in ENUMS.get(table, {}).items() if c in df.columns]
    rules += [
        _rule(c, _optional(F.col(c), F.col(c).between(*v))) for c, v in RANGES.get(table, {}).items() if c in df.columns
    ]
    return with_reasons(df, rules)


def validate_unique(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, first by ``order``, with how many rows shared the key.

    Both come from one combined aggregate, so a key with most of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.min_by(F.struct(*rest), F.struct(*order)).alias("kept"))
        .select(*keys, "copies", "kept.*")
    )


def validate_fk(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is absent; a NULL reference is allowed."""
    return df.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row of each key; the rank is pruned on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
