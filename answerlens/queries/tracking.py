"""Tracker queries over checks, prompts and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracker as T
from . import views as V
from .views import AS_OF, flat, oracle

_PCT = "coalesce((2000 * {n} + {d}) // nullif(2 * {d}, 0), 0) / 10.0"
_SOV = "coalesce((2 * {u} + 10 * {d}) // nullif(20 * {d}, 0), 0) / 10.0"
_UNITS = "cast(sum(cast(round(share_of_voice * 10000) AS bigint)) AS bigint)"
_STATE = (
    "state AS (SELECT * FROM v_checks WHERE error IS NULL "
    "QUALIFY row_number() OVER (PARTITION BY site_id, prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1)"
)
_NEWEST = (
    "newest AS (SELECT c.*, p.prompt, p.intent FROM (SELECT * FROM v_checks QUALIFY row_number() OVER "
    "(PARTITION BY prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1) c JOIN v_prompts p USING (prompt_id))"
)
_HISTORY = (
    "hist AS (SELECT site_id, strftime(checked_at, '%Y-%m-%d') AS day, engine, count(*) AS checks, "
    f"count(*) FILTER (brand_cited) AS cited, {_UNITS} AS u FROM v_checks "
    "WHERE error IS NULL AND checked_at > TIMESTAMP '{since}' GROUP BY 1, 2, 3), "
    f"history AS (SELECT site_id, day, engine, checks, cited, {_PCT.format(n='cited', d='checks')} AS visibility, "
    f"{_SOV.format(u='u', d='checks')} AS avg_sov FROM hist)"
)
_BENCH = (
    f"WITH {_STATE}, tot AS (SELECT site_id, count(*) AS n, cast(sum(brand_mentions) AS bigint) AS m, "
    "count(*) FILTER (brand_cited) AS a FROM state GROUP BY 1), "
    "raw AS (SELECT s.site_id, s.brand_name AS name, true AS is_brand, coalesce(m, 0) AS mentions, coalesce(a, 0) AS appearances, "
    "coalesce(n, 0) AS total_checks FROM v_sites s LEFT JOIN tot USING (site_id) "
    "UNION ALL SELECT site_id, 'Rival A', false, cast(sum(rival_a) AS bigint), count(*) FILTER (rival_a > 0), count(*) FROM state SEMI JOIN v_sites USING (site_id) GROUP BY 1 "
    "UNION ALL SELECT site_id, 'Rival B', false, cast(sum(rival_b) AS bigint), count(*) FILTER (rival_b > 0), count(*) FROM state SEMI JOIN v_sites USING (site_id) GROUP BY 1), "
    f"bench AS (SELECT *, {_PCT.format(n='appearances', d='total_checks')} AS presence, row_number() OVER "
    "(PARTITION BY site_id ORDER BY mentions DESC, appearances DESC, is_brand DESC, name) AS rank FROM raw) "
)
_MATRIX = (
    "string_agg(engine || ':' || check_id || ':' || brand_cited || ':' || coalesce(cast(brand_position AS varchar), '-') || ':' || mode, "
    "'|' ORDER BY engine, check_id) AS grid"
)


def _newest(spark, sf):
    return T.latest_checks(V.checks(spark, sf), V.prompts(spark, sf))


def _history(spark, sf, days=14):
    return T.visibility_history(V.checks(spark, sf), AS_OF, days)


def _grid(df):
    cell = F.expr(
        "array_join(transform(results, r -> concat_ws(':', r.engine, r.check_id, r.brand_cited, "
        "coalesce(cast(r.brand_position AS string), '-'), r.mode)), '|')"
    )
    return df.withColumn("grid", cell).drop("results")


def latest_checks(spark, sf):
    return flat(_newest(spark, sf).select(
        "prompt_id", "engine", "check_id", "checked_at", "prompt", "intent", "brand_cited", "share_of_voice", "error", "mode"))


def visibility_history(spark, sf):
    return flat(_history(spark, sf))


def current_visibility(spark, sf):
    return flat(T.current_visibility(V.checks(spark, sf), V.sites(spark, sf)))


def competitor_benchmark(spark, sf):
    return flat(T.competitor_benchmark(V.checks(spark, sf), V.sites(spark, sf)))


def benchmark_bars(spark, sf):
    return flat(T.benchmark_bars(T.competitor_benchmark(V.checks(spark, sf), V.sites(spark, sf)), 2))


def prompt_history(spark, sf):
    return flat(T.prompt_history(V.checks(spark, sf)).select("prompt_id", "check_id", "checked_at", "engine", "rn"))


def history_collapse(spark, sf):
    return flat(T.history_collapse(_history(spark, sf, 90)))


def engine_totals(spark, sf):
    return flat(T.engine_totals(_newest(spark, sf)))


def prompt_matrix(spark, sf):
    return flat(_grid(T.prompt_matrix(_newest(spark, sf))))


def prompt_matrix_text(spark, sf):
    return flat(_grid(T.prompt_matrix(_newest(spark, sf), "prompt")))


def any_simulated(spark, sf):
    return flat(T.any_simulated(_newest(spark, sf)))


def prompt_scorecard(spark, sf):
    return flat(T.prompt_scorecard(_newest(spark, sf)))


QUERIES = {
    "latest_checks": (latest_checks, f"WITH {_NEWEST} SELECT prompt_id, engine, check_id, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, "
                      "prompt, intent, brand_cited, share_of_voice, error, mode FROM newest"),
    "visibility_history": (visibility_history, f"WITH {_HISTORY.format(since='2024-01-17 00:00:00')} SELECT * FROM history"),
    "current_visibility": (
        current_visibility,
        f"WITH {_STATE}, a AS (SELECT s.site_id, count(check_id) AS checks, count(*) FILTER (brand_cited) AS cited, "
        f"coalesce({_UNITS}, 0) AS u, count(*) FILTER (mode = 'simulated') AS simulated FROM v_sites s LEFT JOIN state USING (site_id) GROUP BY 1) "
        f"SELECT site_id, checks, cited, {_PCT.format(n='cited', d='checks')} AS visibility, {_SOV.format(u='u', d='checks')} AS avg_sov, simulated FROM a",
    ),
    "competitor_benchmark": (competitor_benchmark, _BENCH + "SELECT * FROM bench"),
    "benchmark_bars": (
        benchmark_bars,
        _BENCH + "SELECT site_id, name, is_brand, mentions, rank, width FROM (SELECT *, CASE WHEN max(mentions) OVER (PARTITION BY site_id) > 0 "
        "THEN mentions * 100 / max(mentions) OVER (PARTITION BY site_id) ELSE 0.0 END AS width FROM bench) WHERE rank <= 2",
    ),
    "prompt_history": (
        prompt_history,
        "SELECT prompt_id, check_id, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, engine, rn FROM (SELECT *, row_number() OVER "
        "(PARTITION BY prompt_id ORDER BY checked_at DESC, check_id DESC) AS rn FROM v_checks) WHERE rn <= 60",
    ),
    "history_collapse": (
        history_collapse,
        f"WITH {_HISTORY.format(since='2023-11-02 00:00:00')}, d AS (SELECT site_id, day, cast(sum(checks) AS bigint) AS checks, cast(sum(cited) AS bigint) AS cited, "
        "cast(sum(cast(round(avg_sov * 10) AS bigint) * checks) AS bigint) AS w FROM history GROUP BY 1, 2) "
        f"SELECT site_id, day, checks, cited, {_PCT.format(n='cited', d='checks')} AS visibility, ((2 * w + checks) // (2 * checks)) / 10.0 AS sov FROM d",
    ),
    "engine_totals": (
        engine_totals,
        f"WITH {_NEWEST}, g AS (SELECT site_id, engine, count(*) AS checks, count(*) FILTER (brand_cited) AS cited, "
        "count(*) FILTER (mode = 'simulated') AS simulated FROM newest GROUP BY 1, 2) "
        f"SELECT *, {_PCT.format(n='cited', d='checks')} AS visibility FROM g",
    ),
    "prompt_matrix": (prompt_matrix, f"WITH {_NEWEST} SELECT site_id, prompt_id, {_MATRIX} FROM newest GROUP BY 1, 2"),
    "prompt_matrix_text": (prompt_matrix_text, f"WITH {_NEWEST} SELECT site_id, prompt, {_MATRIX} FROM newest GROUP BY 1, 2"),
    "any_simulated": (any_simulated, f"WITH {_NEWEST} SELECT site_id, bool_or(mode = 'simulated') AS any_simulated FROM newest GROUP BY 1"),
    "prompt_scorecard": (
        prompt_scorecard,
        f"WITH {_NEWEST} SELECT prompt_id, count(*) FILTER (brand_cited) AS cited, count(*) AS results FROM newest GROUP BY 1",
    ),
}
QUERIES = {k: (fn, oracle(sql)) for k, (fn, sql) in QUERIES.items()}
