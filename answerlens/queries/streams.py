"""Streaming queries: each runs over the whole table and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quotas import subscription_state
from ..session import scratch_path
from ..streaming import streams as X
from ..streaming.ledger import keep_ledger, read_ledger
from ..streaming.rate_limit import rate_limit
from . import views as V
from .relational import QUERIES as BATCH
from .relational import customers
from .views import flat, oracle

_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
#: Lateness that keeps every row of a table read in whatever order its files have.
WHOLE = "36500 days"
_LINEITEM = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_shipdate", T.TimestampNTZType())])


def _stream(s, sf, view, time=None):
    """A view of a table read as a stream."""
    s.conf.set("spark.sql.session.timeZone", "UTC")
    source, columns = V.VIEWS[view]
    schema = _LINEITEM if source == "lineitem" else _EVENTS
    raw = X.read_stream(s, sf, schema, f"{source}.parquet")
    df = raw.selectExpr(*[f"{e[0] if isinstance(e, tuple) else e} AS {a}" for a, e in columns])
    return df.withColumn(time, F.col(time).cast("timestamp")) if time else df


def stream_checks_append(s, sf):
    out = X.drain_appends(X.checks_append(_stream(s, sf, "checks", "checked_at")), "checks", ["day"])
    return flat(out.groupBy("day", "engine").agg(F.count("*").alias("checks"), F.count("error").alias("errors")))


def stream_event_dedupe(s, sf):
    path = scratch_path(s, "ledger")
    keep_ledger(_stream(s, sf, "billing", "received_at"), path, scratch_path(s, "ledger_checkpoint")).awaitTermination()
    return flat(read_ledger(s, path).select("event_id", "seq", "received_at"))


def stream_daily_visibility(s, sf):
    path = scratch_path(s, "daily")
    X.update_daily(_stream(s, sf, "checks", "checked_at"), path, scratch_path(s, "daily_checkpoint")).awaitTermination()
    return flat(X.read_daily(s, path))


def stream_usage_monthly(s, sf):
    return flat(X.drain_updates(X.usage_monthly(_stream(s, sf, "usage")), ["workspace_id", "period", "metric"], "usage"))


def stream_rate_limit(s, sf):
    return flat(X.drain_updates(rate_limit(_stream(s, sf, "free_audits", "started_at"), WHOLE), ["audit_id"], "rate").select("audit_id", "created_ip", "used_24h", "remaining", "over_limit"))


def stream_latest_state(s, sf):
    return flat(X.drain_updates(X.latest_state(_stream(s, sf, "checks", "checked_at")), ["prompt_id", "engine"], "latest"))


def stream_subscription_state(s, sf):
    return flat(X.drain_updates(subscription_state(_stream(s, sf, "billing", "received_at"), customers(s, sf)), ["workspace_id"], "subs"))


def stream_view_counts(s, sf):
    return flat(X.drain_updates(X.view_counts(_stream(s, sf, "views")), ["link_id"], "views"))


QUERIES = {
    "stream_checks_append": (stream_checks_append, oracle("SELECT strftime(checked_at, '%Y-%m-%d') AS day, engine, count(*) AS checks, count(error) AS errors FROM v_checks GROUP BY 1, 2")),
    "stream_event_dedupe": (stream_event_dedupe, oracle("SELECT event_id, seq, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at FROM v_billing QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, seq) = 1")),
    "stream_daily_visibility": (stream_daily_visibility, oracle(
        "WITH g AS (SELECT site_id, strftime(checked_at, '%Y-%m-%d') AS day, engine, count(*) AS checks, count(*) FILTER (brand_cited) AS cited, cast(sum(cast(round(share_of_voice * 10000) AS bigint)) AS bigint) AS u "
        "FROM v_checks WHERE error IS NULL GROUP BY 1, 2, 3) SELECT site_id, day, engine, checks, cited, ((2000 * cited + checks) // (2 * checks)) / 10.0 AS visibility, ((2 * u + 10 * checks) // (20 * checks)) / 10.0 AS avg_sov FROM g")),
    "stream_usage_monthly": (stream_usage_monthly, oracle("SELECT workspace_id, period, metric, count(*) AS count FROM v_usage GROUP BY 1, 2, 3")),
    "stream_rate_limit": (stream_rate_limit, BATCH["free_rate_limit"][1]),
    "stream_latest_state": (stream_latest_state, oracle(
        "SELECT prompt_id, engine, check_id, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at, brand_cited, mode, error FROM v_checks "
        "QUALIFY row_number() OVER (PARTITION BY prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1")),
    "stream_subscription_state": (stream_subscription_state, BATCH["subscription_state"][1]),
    "stream_view_counts": (stream_view_counts, oracle("SELECT link_id, count(*) AS views FROM v_views GROUP BY 1")),
}
