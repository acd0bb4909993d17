"""Registered queries against DuckDB on the smallest tables, and what every query must satisfy."""

import duckdb
import pytest

import __spark_entry__ as entry
from answerlens.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "pf_visible_text", "pf_jsonld_types", "pf_internal_links", "robots_allowed", "overall_capped", "visibility_history", "current_visibility",
    "competitor_benchmark", "site_dashboard", "free_rate_limit", "previous_score", "stale_prompts", "subscription_state", "validate_enums",
    "analyse_response", "count_mentions", "scan_answers_serp", "crawl_seeds", "stream_latest_state",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
    assert want, "a check on no rows checks nothing"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(registry()) <= set(oracles), "every analytics query has its statement"


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "overall" in df.columns
