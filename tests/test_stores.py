"""Versioned tables, keyed stores, the ledger and the exact rate limit, over several micro-batches and after failures."""

import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from answerlens.operators import quotas as Q
from answerlens.operators import sinks
from answerlens.operators.tracker import visibility_history
from answerlens.plans.audit import read_audit, run_audit
from answerlens.sources import versions as V
from answerlens.streaming import ledger as L
from answerlens.streaming import streams as X
from answerlens.streaming.rate_limit import TrailingCounts, rate_limit, use_rocksdb

T0 = datetime(2024, 1, 1)


def files(df, folder, parts):
    """One input file for each list of ids, in that order."""
    for ids in parts:
        df.where(F.col("n").isin(ids)).drop("n").coalesce(1).write.mode("append").parquet(folder)


def bad(rows, column):
    """Rows of which one fails in a task."""
    return rows.withColumn(column, F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col(column)))


# Whole versions


def test_two_writers_on_one_version(spark, tmp_path):
    path, df = str(tmp_path), spark.createDataFrame([(1,)], "a int")
    at = V.current(spark, path)
    V.publish(spark, path, at, V.stage(df, path), df.schema)
    with pytest.raises(V.Conflict):
        V.publish(spark, path, at, V.stage(df, path), df.schema)
    assert V.current(spark, path)["version"] == 1 and V.read_version(spark, path).count() == 1


def test_a_second_writer_between_read_and_append(spark, tmp_path, monkeypatch):
    path, at = str(tmp_path), datetime(2024, 1, 31)
    rows = lambda ids: spark.createDataFrame([(i, at) for i in ids], "check_id string, checked_at timestamp")
    sinks.append_checks(rows("a"), path)
    publish, calls = V.publish, []

    def late(*args, **kw):
        if not calls:
            calls.append(1)
            sinks.append_checks(rows("bc"), path)  # the other writer is first
        return publish(*args, **kw)

    monkeypatch.setattr(V, "publish", late)
    sinks.append_checks(rows("cd"), path)
    assert sorted(r["check_id"] for r in V.read_version(spark, path).collect()) == list("abcd")


def test_a_failed_write_changes_nothing_and_can_be_repeated(spark, tmp_path):
    path, at = str(tmp_path), datetime(2024, 1, 31)
    audits = spark.createDataFrame([(1, at, 10), (2, at, 20), (3, datetime(2024, 2, 1), 30)], "audit_id int, started_at timestamp, overall_score int")
    sinks.overwrite_audits(audits, path)
    more = audits.where("audit_id = 1").withColumn("overall_score", F.lit(11))
    with pytest.raises(Exception, match="lost"):
        sinks.overwrite_audits(bad(more, "overall_score"), path)
    seen = lambda: {r["audit_id"]: r["overall_score"] for r in V.read_version(spark, path).collect()}
    assert seen() == {1: 10, 2: 20, 3: 30}
    for _ in range(2):
        sinks.overwrite_audits(more, path)
        assert seen() == {1: 11, 2: 20, 3: 30}
    V.remove_unnamed(spark, path, keep=1)
    assert seen() == {1: 11, 2: 20, 3: 30} and len(V._names(spark, f"{path}/_versions")) == 1


def test_an_append_reads_only_its_days(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(str(k), T0 + timedelta(days=k)) for k in range(6)], "check_id string, checked_at timestamp")
    sinks.append_checks(rows, path)
    known = V.read_version(spark, path).where(F.col("day").isin(["2024-01-03"]))
    assert re.search(r"PartitionFilters: \[[^\]]*day", known._jdf.queryExecution().executedPlan().toString())
    sinks.append_checks(rows.where("check_id >= '3'").union(spark.createDataFrame([("new", T0)], rows.schema)), path)
    assert V.read_version(spark, path).count() == 7


def test_an_audit_run_that_fails_leaves_the_run_before(spark, tmp_path):
    html = "<html><head><title>Acme</title></head><body><h1>Hi</h1><p>{}</p></body></html>".format("word " * 400)
    pages = spark.createDataFrame([("a", "https://a.example/", html, 0, 200)], "site_id string, url string, html string, crawl_pos int, status_code int")
    sites = spark.createDataFrame([("a", "https://a.example", "Acme")], "site_id string, origin string, brand_name string")
    robots = spark.createDataFrame([("https://a.example", "robots", 200, "User-agent: CCBot\nDisallow: /")], "origin string, kind string, status_code int, body string")
    run_audit(spark, pages, sites, robots, str(tmp_path))
    with pytest.raises(Exception, match="lost"):
        run_audit(spark, pages.withColumn("html", F.lit("<p>other</p>")), sites, bad(robots, "body"), str(tmp_path))
    out = read_audit(spark, str(tmp_path))
    assert out.page_features.first()["title"] == "Acme" and out.ai_access.filter("NOT allowed").count() == 1


# One row per key


def test_keyed_store_replays_merges_and_stays_small(spark, tmp_path):
    path, want = str(tmp_path), {}
    for b in range(11):
        rows = [(k % 7, f"{b}-{k}") for k in range(b, b + 4)]
        for _ in range(2):  # each batch twice
            at = V.upsert(spark.createDataFrame(rows, "k int, v string"), path, ["k"], b, buckets=4, most_deltas=3)
        want |= dict(rows)
        assert at["deltas"] < 3 and len(at["dirs"]) <= 3
    V.upsert(spark.createDataFrame([(0, "old")], "k int, v string"), path, ["k"], 4)
    assert dict(map(tuple, V.read_keyed(spark, path, ["k"]).collect())) == want
    assert len(V._names(spark, f"{path}/data")) <= 2 * 4


def test_keyed_store_when_a_batch_fails_half_way(spark, tmp_path):
    path, rows = str(tmp_path), spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    fold = [F.sum("v").alias("v")]
    V.upsert(rows, path, ["k"], 0, fold=fold)
    with pytest.raises(Exception, match="lost"):
        V.upsert(bad(rows, "v"), path, ["k"], 1, fold=fold)
    V.upsert(rows, path, ["k"], 1, fold=fold)
    assert dict(map(tuple, V.read_keyed(spark, path, ["k"], fold).collect())) == {1: 10, 2: 12}


def test_counters_over_several_files(spark, tmp_path):
    rows = [(n, f"w{k % 3}", "2024-01", "audits", 1) for n in range(10) for k in range(n, n + 5)]
    df = spark.createDataFrame(rows, "n int, workspace_id string, period string, metric string, count int")
    files(df, f"{tmp_path}/in", [[n] for n in range(10)])
    path, check, keys = f"{tmp_path}/out", f"{tmp_path}/check", ["workspace_id", "period", "metric"]
    for _ in range(2):  # the second start finds nothing new
        stream = X.usage_monthly(X.read_stream(spark, f"{tmp_path}/in", df.drop("n").schema, files_per_batch=1))
        X.update_store(stream, path, check, keys, most_deltas=4).awaitTermination()
    want = {w: sum(r[1] == w for r in rows) for w in ("w0", "w1", "w2")}
    assert {r["workspace_id"]: r["count"] for r in V.read_keyed(spark, path, keys).collect()} == want
    assert len(V.current(spark, path)["dirs"]) <= 4


def test_daily_sums_with_rows_of_any_lateness(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 6, k, "s", "chatgpt", T0 + timedelta(days=(k % 6) * 5 - (40 if k % 9 == 0 else 0), minutes=k), rng.random() < 0.5, round(rng.random(), 2), None if k % 8 else "down") for k in range(240)]
    df = spark.createDataFrame(rows, "n int, check_id int, site_id string, engine string, checked_at timestamp, brand_cited boolean, share_of_voice double, error string")
    files(df, f"{tmp_path}/in", [[n] for n in range(6)])
    stream = X.read_stream(spark, f"{tmp_path}/in", df.drop("n").schema, files_per_batch=1)
    X.update_daily(stream, f"{tmp_path}/out", f"{tmp_path}/check", most_deltas=4).awaitTermination()
    want = visibility_history(df, T0 + timedelta(days=400), 1000)
    cols = ["site_id", "day", "engine", "checks", "cited", "visibility", "avg_sov"]
    assert sorted(map(tuple, X.read_daily(spark, f"{tmp_path}/out").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


# The ledger


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, seq int, received_at timestamp")


def test_ledger_reads_only_buckets_that_may_hold_an_id(spark, tmp_path):
    path = str(tmp_path)
    first = [(f"e{k}", k, T0 + timedelta(minutes=k)) for k in range(2000)]
    L.admit(events(spark, first + first[:50]), path, 0)
    got = L.admit(events(spark, [(f"new{k}", k, T0) for k in range(20)]), path, 1)
    assert len(got["read"]) <= 2  # no id is known: next to nothing is read
    replay = [(f"e{k}", 9000 + k, T0 + timedelta(days=900)) for k in (3, 4)]
    got = L.admit(events(spark, [*replay, ("fresh", 1, T0)]), path, 2)
    home = {r[0] for r in events(spark, replay).select(V.bucket_of(["event_id"], 64)).collect()}
    assert home <= set(got["read"]) and len(got["read"]) <= len(home) + 1
    for _ in range(2):
        L.admit(events(spark, [("twice", 1, T0)]), path, 3)
    held = {r["event_id"]: r["seq"] for r in L.read_ledger(spark, path).collect()}
    assert len(held) == 2022 and held["e3"] == 3 and L.read_ledger(spark, path).count() == 2022


def test_ledger_grows_its_filters_and_keeps_knowing(spark, tmp_path):
    path = str(tmp_path)
    for b in range(4):
        L.admit(events(spark, [(f"e{b}-{k}", k, T0) for k in range(3000)]), path, b, buckets=2, words=4, most_parts=2)
    at = V.current(spark, path)
    assert at["words"] >= 512 and at["deltas"] < 2
    got = L.admit(events(spark, [(f"e{b}-{k}", -1, T0) for b in range(4) for k in range(0, 3000, 10)]), path, 9)
    assert L.read_ledger(spark, path).where("seq < 0").count() == 0 and set(got["read"]) == {0, 1}
    few = L.admit(events(spark, [(f"other{k}", k, T0) for k in range(300)]), path, 10)
    assert L.read_ledger(spark, path).count() == 12_300 and few["version"] > at["version"]


def test_a_replay_long_after_the_watermark_is_dropped(spark, tmp_path):
    rows = [(n, f"e{k % 40}", 100 * n + k, T0 + timedelta(days=30 * n, minutes=k)) for n in range(4) for k in range(30 * n % 50, 30 * n % 50 + 20)]
    df = spark.createDataFrame(rows, "n int, event_id string, seq int, received_at timestamp")
    files(df, f"{tmp_path}/in", [[n] for n in range(4)])
    stream = X.event_dedupe(X.read_stream(spark, f"{tmp_path}/in", df.drop("n").schema, files_per_batch=1))
    L.keep_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = [(r["event_id"], r["seq"]) for r in L.read_ledger(spark, f"{tmp_path}/out").collect()]
    want = {}
    for _, e, seq, _ in rows:
        want.setdefault(e, seq)
    assert dict(got) == want and len(got) == len(want)


# The rate limit


def test_rate_limit_is_exact_over_batches_with_late_rows(spark, tmp_path):
    rng, rows = random.Random(5), []
    for n in range(5):
        for _ in range(60):
            late = rng.random() < 0.3
            at = T0 + timedelta(hours=11 * n, seconds=rng.randrange(0, 11 * 3600, 30)) - timedelta(hours=rng.randrange(1, 20) if late else 0)
            rows.append((n, len(rows), None if rng.random() < 0.95 else "w", rng.choice(["hot", "hot", "a", "b", None]), at))
    df = spark.createDataFrame(rows, "n int, audit_id long, workspace_id string, created_ip string, started_at timestamp")
    files(df, f"{tmp_path}/in", [[n] for n in range(5)])
    files(df, f"{tmp_path}/in", [[2]])  # a file again
    stream = rate_limit(X.read_stream(spark, f"{tmp_path}/in", df.drop("n").schema, files_per_batch=1), "48 hours")
    cols = ["audit_id", "created_ip", "used_24h", "remaining", "over_limit"]
    got = X.drain_updates(stream, ["audit_id"], "limit").select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.free_rate_limit(df).select(cols).collect()))


def test_rate_limit_frees_its_state(spark, tmp_path):
    rows = [(0, k, None, f"ip{k % 5}", T0 + timedelta(minutes=k)) for k in range(100)] + [(n, 100 + n, None, "last", T0 + timedelta(days=3 + n)) for n in (1, 2)]
    df = spark.createDataFrame(rows, "n int, audit_id long, workspace_id string, created_ip string, started_at timestamp")
    files(df, f"{tmp_path}/in", [[0], [1], [2]])
    use_rocksdb(spark)
    stream = rate_limit(X.read_stream(spark, f"{tmp_path}/in", df.drop("n").schema, files_per_batch=1), "1 hour")
    query = X.update_store(stream, f"{tmp_path}/out", f"{tmp_path}/check", ["audit_id"])
    query.awaitTermination()
    read = spark.read.format("statestore").option("stateVarName", "sizes").load(f"{tmp_path}/check")
    assert {r["key"]["created_ip"] for r in read.select("key").collect()} == {"last"}
    assert V.read_keyed(spark, f"{tmp_path}/out", ["audit_id"]).count() == 102


class _Held:
    """A map state in memory that counts how often it is used."""

    def __init__(self):
        self.at, self.calls = {}, 0

    def _use(self, value):
        self.calls += 1
        return value

    def iterator(self):
        return self._use(iter(self.at.items()))

    def containsKey(self, key):
        return self._use(key in self.at)

    def getValue(self, key):
        return self._use(self.at[key])

    def updateValue(self, key, value):
        self._use(self.at.__setitem__(key, value))

    def removeKey(self, key):
        self._use(self.at.pop(key))


class _Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def getMapState(self, *_):
        self.states.append(_Held())
        return self.states[-1]

    def registerTimer(self, at):
        self.timers.append(at)


def test_rate_limit_uses_its_state_by_hours_not_by_minutes():
    rng, handle, counts = random.Random(7), _Handle(), TrailingCounts(86400)
    counts.init(handle)
    rows = [(rng.randrange(10 * 86400) * 1_000_000, n) for n in range(3_000)]  # nearly each in a minute of its own
    got = {}
    for part in (rows[:2_000], rows[1_900:]):  # the second comes late, and repeats some
        frame = pd.DataFrame(part, columns=["t", "audit_id"])
        for out in counts.handleInputRows(("ip",), iter([frame[:700], frame[700:]]), None):
            got |= dict(zip(out["audit_id"], out["used_24h"], strict=True))
    assert got == {i: sum((t - 86_400_000_000 < u) and (u, j) <= (t, i) for u, j in rows) for t, i in rows}
    assert len(handle.timers) == 10
    assert sum(s.calls for s in handle.states) < 3 * 2 * 240
