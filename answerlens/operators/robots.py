"""robots.txt operators over a table of origins.

Files are exploded to lines and grouped with one window per origin (a file is capped at 2 MB, so
an origin's lines are bounded); everything after is one row per origin, evaluated in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import BOTS
from ..functions.fragments import let, q
from ..functions.text import trim_ws

_RULES = "array<struct<is_allow:boolean,path:string,len:int,literal:boolean,regex:string>>"
_NO_RULES = f"cast(array() AS {_RULES})"


def robots_status(files: DataFrame) -> DataFrame:
    """Effective status and body: fetch error is absent, 4xx/5xx is empty, HTML counts as 404."""
    status = F.col("status_code")
    html = F.col("body").rlike(r"^\s*<")
    effective = F.when(status.isNull(), status).when(status >= 400, status).when(html, F.lit(404)).otherwise(status)
    return files.select(
        *[c for c in files.columns if c not in ("status_code", "body")],
        effective.alias("status_code"),
        F.when(effective.isNull() | (effective >= 400), F.lit("")).otherwise(F.col("body")).alias("body"),
        (status.isNull() | F.coalesce(effective.isin(404, 410, 403), F.lit(False))).alias("permissive_by_absence"),
    )


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(origin, pos, field, value)`` of every kept line."""
    exploded = robots.select("origin", F.posexplode(F.split("body", r"\r?\n", -1)).alias("pos", "line"))
    bare = trim_ws(F.regexp_replace("line", r"(?s)#.*$", ""))
    parsed = (
        exploded.withColumn("bare", bare)
        .filter(F.contains(F.col("bare"), F.lit(":")))
        .select(
            "origin",
            "pos",
            F.lower(trim_ws(F.regexp_extract("bare", r"(?s)^([^:]*):", 1))).alias("field"),
            trim_ws(F.regexp_replace("bare", r"(?s)^[^:]*:", "")).alias("value"),
        )
    )
    return parsed.filter((F.col("value") != "") | (F.col("field") == "disallow"))


def robots_groups(lines: DataFrame) -> DataFrame:
    """Lines with ``group_id``: a run of user-agent lines opens a group; 0 is before any group."""
    by_origin = Window.partitionBy("origin").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(by_origin), F.lit(False))
    return lines.withColumn("opens", opens.cast("int")).select(
        "origin",
        "pos",
        "field",
        "value",
        F.sum("opens").over(by_origin).cast("int").alias("group_id"),
    )


def robots_rules(grouped: DataFrame) -> DataFrame:
    """Allow and disallow rows of each group; an empty disallow is no rule."""
    return grouped.filter(
        F.col("field").isin("allow", "disallow") & (F.col("group_id") > 0) & (F.col("value") != "")
    ).select(
        "origin",
        "group_id",
        "pos",
        F.col("field").alias("rule_type"),
        F.col("value").alias("path"),
        F.expr(pattern_regex("value")).alias("regex"),
    )


def robots_crawl_delay(grouped: DataFrame) -> DataFrame:
    """Last finite non-negative crawl delay of each group."""
    delay = F.col("value").try_cast("double")
    ok = delay.isNotNull() & (delay >= 0) & ~F.isnan(delay) & (delay < float("inf"))
    return (
        grouped.filter((F.col("field") == "crawl-delay") & (F.col("group_id") > 0))
        .withColumn("crawl_delay", delay)
        .filter(ok)
        .groupBy("origin", "group_id")
        .agg(F.max_by("crawl_delay", "pos").alias("crawl_delay"))
    )


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    """Sitemap lines of each origin in file order."""
    item = F.when(F.col("field") == "sitemap", F.struct("pos", "value"))
    return lines.groupBy("origin").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["value"]).alias("sitemaps")
    )


def pattern_regex(path: str) -> str:
    """Start-anchored regex of a robots path: ``*`` is any run, a last ``$`` is the end.

    Each run stops at the first place its next piece fits and never gives it back, which is enough for
    such patterns, so a rule full of ``*`` stays linear in the path.
    """
    special = q(r"([.+?^${}()|\[\]\\])")
    escaped = f"regexp_replace(regexp_replace({path}, '[$]$', ''), {special}, {q(r'\\$1')})"
    anchored = f"endswith({path}, '$')"
    piece = (
        f"CASE WHEN pi = 0 THEN pc WHEN pi = size(pp) - 1 AND {anchored} THEN concat('.*', pc) "
        "ELSE concat('(?>.*?', pc, ')') END"
    )
    pieces = let(f"split({escaped}, '[*]', -1)", "pp", f"array_join(transform(pp, (pc, pi) -> {piece}), '')")
    return f"concat('^', {pieces}, if({anchored}, '$', ''))"


def parsed_robots(files: DataFrame) -> DataFrame:
    """One row per origin: status, groups (agents, rules, delay) and sitemaps.

    One shuffle: the window and both aggregates share the partitioning by origin.
    """
    status = robots_status(files)
    lines = robots_groups(robots_lines(status)).withColumn("regex", F.expr(pattern_regex("value")))
    rule = (
        "named_struct('pos', pos, 'is_allow', field = 'allow', 'path', value, 'len', length(value), "
        "'literal', NOT value RLIKE '[*]|[$]$', 'regex', regex)"
    )
    delay = "try_cast(value AS double)"
    groups = lines.groupBy("origin", "group_id").agg(
        F.expr("collect_list(if(field = 'user-agent', lower(value), NULL)) AS agents"),
        F.expr(
            f"array_sort(collect_list(if(field IN ('allow', 'disallow') AND value != '', {rule}, NULL))) AS ordered"
        ),
        F.expr(
            f"max_by({delay}, if(field = 'crawl-delay' AND {delay} >= 0 AND {delay} < double('Infinity'), pos, NULL)) "
            "AS crawl_delay"
        ),
        F.expr(
            "array_sort(collect_list(if(field = 'sitemap', named_struct('pos', pos, 'value', value), NULL))) AS maps"
        ),
    )
    kept = (
        "if(group_id > 0, named_struct('group_id', group_id, 'agents', agents, 'rules', cast(transform(ordered, "
        "r -> named_struct('is_allow', r.is_allow, 'path', r.path, 'len', r.len, 'literal', r.literal, 'regex', "
        f"r.regex)) AS {_RULES}), 'crawl_delay', crawl_delay), NULL)"
    )
    per_origin = groups.groupBy("origin").agg(
        F.expr(f"array_sort(collect_list({kept}), (a, b) -> a.group_id - b.group_id) AS groups"),
        F.expr("transform(array_sort(flatten(collect_list(maps))), m -> m.value) AS sitemaps"),
    )
    joined = status.drop("body").join(per_origin, "origin", "left")
    return joined.withColumns({"sitemaps": F.coalesce("sitemaps", F.array().cast("array<string>"))})


def group_for(groups: str, ua: str) -> str:
    """The group that speaks to ``ua``: longest agent that starts its name, else the first ``*``."""
    named = (
        f"flatten(transform({groups}, g -> transform(filter(g.agents, a -> a != '*' AND startswith(lower({ua}), a)), "
        "a -> named_struct('rank', -length(a), 'group_id', g.group_id))))"
    )
    wild = f"get(filter({groups}, g -> array_contains(g.agents, '*')), 0).group_id"
    wanted = f"coalesce(get(array_sort({named}), 0).group_id, {wild})"
    return let(wanted, "gw", f"get(filter({groups}, g -> g.group_id = gw), 0)")


def rules_for(groups: str, ua: str) -> str:
    """Rules that bind ``ua``; empty when none do."""
    return f"coalesce({group_for(groups, ua)}.rules, {_NO_RULES})"


def path_allowed(rules: str, path: str) -> str:
    """Longest matching rule decides, allow wins a tie, no match is allowed."""
    matches = f"if(r.literal, startswith({path}, r.path), regexp_like({path}, r.regex))"
    better = "(r.len > acc.len OR (r.len = acc.len AND r.is_allow))"
    return (
        f"aggregate({rules}, named_struct('len', -1, 'allow', true), (acc, r) -> if({better} AND {matches}, "
        "named_struct('len', r.len, 'allow', r.is_allow), acc), acc -> acc.allow)"
    )


def robots_allowed(paths: DataFrame, robots: DataFrame) -> DataFrame:
    """``(origin, ua, path)`` rows with ``allowed``.

    The rules travel as one row per (origin, ua), so a path is never multiplied by rules. A hot
    origin's paths are split by the adaptive skew join; the small side is sized by Spark itself.
    """
    wanted = paths.select("origin", "ua").distinct()
    rules = wanted.join(robots.select("origin", "groups"), "origin", "left").select(
        "origin", "ua", F.expr(rules_for("groups", "ua")).alias("rules")
    )
    return (
        paths.join(rules, ["origin", "ua"], "left")
        .withColumn("allowed", F.expr(path_allowed(f"coalesce(rules, {_NO_RULES})", "path")))
        .drop("rules")
    )


def ai_access(groups: str = "groups") -> Column:
    """Access of each scored crawler to the home page, as ``array<struct>`` in display order."""
    bots = ", ".join(
        f"named_struct('ua', {q(b['ua'])}, 'vendor', {q(b['vendor'])}, 'purpose', {q(b['purpose'])}, "
        f"'is_primary', {str(b['primary']).lower()})"
        for b in BOTS
    )
    allowed = path_allowed(rules_for(groups, "b.ua"), "'/'")
    mentioned = (
        f"coalesce(exists({groups}, g -> exists(g.agents, a -> a != '*' AND startswith(lower(b.ua), a))), false)"
    )
    row = (
        "named_struct('ua', b.ua, 'vendor', b.vendor, 'purpose', b.purpose, 'is_primary', b.is_primary, "
        "'allowed', ok, 'explicitly_blocked', NOT ok AND said, 'mentioned', said)"
    )
    return F.expr(f"transform(array({bots}), b -> {let(allowed, 'ok', let(mentioned, 'said', row))})")


def ai_access_matrix(robots: DataFrame) -> DataFrame:
    """One row per origin and scored crawler."""
    return robots.select("origin", F.explode(ai_access()).alias("a")).select("origin", "a.*")


def blocks_everyone(groups: str = "groups") -> Column:
    """The first ``*`` group disallows the whole site; Allow rules are not considered."""
    first = f"get(filter({groups}, g -> array_contains(g.agents, '*')), 0).rules"
    return F.expr(f"coalesce(exists({first}, r -> NOT r.is_allow AND r.path IN ('/', '/*')), false)")
