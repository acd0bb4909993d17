"""Ranking helpers, crawl reach, rewrites, streams and whole jobs, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from answerlens.functions.register import register
from answerlens.operators import apply as A
from answerlens.operators import quotas as Q
from answerlens.operators import ranking as R
from answerlens.operators import reach as G
from answerlens.operators import score as S
from answerlens.operators import validate as C
from answerlens.plans.audit import run_audit
from answerlens.plans.citations import run_weekly
from answerlens.schemas import TABLES
from answerlens.sources.versions import read_version
from answerlens.streaming import streams as X

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    # One key holds most rows; several share a timestamp.
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", T0 + timedelta(seconds=rng.randrange(0, 4 * 86400, 30))) for i in range(800)]
    return rows, spark.createDataFrame(rows, "id int, k string, ts timestamp")


def test_trailing_count(events):
    rows, df = events
    got = {r["id"]: r["n"] for r in R.trailing_count(df, "k", "ts", "id", 86400, "n").collect()}
    for i, k, ts in rows:
        want = sum(k2 == k and ts - timedelta(days=1) < t2 and (t2, i2) <= (ts, i) for i2, k2, t2 in rows)
        assert got[i] == want


def test_row_number_by_bucket(events):
    rows, df = events
    out = R.row_number_by_bucket(df, ["k"], F.to_date("ts"), [F.col("ts"), F.col("id")])
    got = {r["id"]: r["rn"] for r in out.collect()}
    for k in {r[1] for r in rows}:
        order = sorted((t, i) for i, k2, t in rows if k2 == k)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_carry_forward(spark, events):
    rows, df = events
    valued = df.withColumn("v", F.when(F.col("id") % 7 == 0, F.col("id")))
    got = {r["id"]: r["last"] for r in R.carry_forward(valued, "k", F.to_date("ts"), ["ts", "id"], "v", "last").collect()}
    for k in {r[1] for r in rows}:
        seen = None
        for _, i in sorted((t, i) for i, k2, t in rows if k2 == k):
            seen = i if i % 7 == 0 else seen
            assert got[i] == seen


def bfs(edges, seed, cap):
    """First visit wins, in queue order; a page at the cap is not expanded."""
    queue, seen, pages = [seed], {seed}, []
    while queue and len(pages) < cap:
        page = queue.pop(0)
        pages.append(page)
        if len(pages) < cap:
            for nxt in edges.get(page, []):
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append(nxt)
    return pages, bool(queue)


@pytest.mark.parametrize("cap", [7, 40, 2000])
def test_reach_is_queue_order(spark, cap):
    rng = random.Random(cap)
    graphs = {s: {f"p{i}": [f"p{rng.randrange(60)}" for _ in range(rng.randrange(4))] for i in range(50)} for s in ("a", "b")}
    rows = [(s, src, pos, dst) for s, g in graphs.items() for src, out in g.items() for pos, dst in enumerate(out)]
    edges = spark.createDataFrame(rows, "site_id string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("a", "p0"), ("b", "p0"), ("c", "p0")], "site_id string, url string")
    reached = G.crawl_reach(edges, seeds, cap)
    got, caps = {}, {r["site_id"]: r for r in G.crawl_cap(reached, cap).collect()}
    for r in sorted(reached.collect(), key=lambda r: r["rank"]):
        if r["rank"] <= cap:
            got.setdefault(r["site_id"], []).append(r["url"])
    for site in ("a", "b", "c"):
        pages, more = bfs(graphs.get(site, {}), "p0", cap)
        assert got[site] == pages
        assert (caps[site]["pages"], caps[site]["capped"]) == (len(pages), more)


def test_previous_score_is_as_of_start(spark):
    d = lambda n: T0 + timedelta(days=n)
    rows = [(1, "s", "complete", 50, d(0), d(1)), (2, "s", "failed", None, d(2), d(2)), (3, "s", "complete", 70, d(3), d(9)), (4, "s", "complete", 60, d(5), d(6)), (5, "s", "running", None, d(10), None)]
    df = spark.createDataFrame(rows, "audit_id int, site_id string, status string, overall_score int, started_at timestamp, completed_at timestamp")
    got = {r["audit_id"]: (r["previous_score"], r["score_delta"]) for r in S.previous_scores(df).collect()}
    assert got == {1: (None, None), 2: (50, None), 3: (50, 20), 4: (50, 10), 5: (70, None)}


def test_patch_can_write_null(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    patches = spark.createDataFrame(
        [(1, None, True, 5, False, T0, 1), (1, "old", True, 9, True, T0 - timedelta(days=1), 2)],
        "id int, x string, set_x boolean, y int, set_y boolean, patched_at timestamp, patch_id int")
    assert sorted(map(tuple, A.apply_patch(table, patches, "id", ["x", "y"]).collect())) == [(1, None, 1), (2, "b", 2)]


def test_payment_failure_keeps_the_plan(spark):
    rows = [("e1", T0, "subscription", "w", "active", "growth", None), ("e2", T0 + timedelta(days=1), "payment_failed", "w", None, None, None),
            ("e3", T0, "subscription", "x", "canceled", "growth", None), ("e4", T0, "subscription", "y", "trialing", None, "agency"), ("e5", T0, "subscription", None, "active", "growth", None)]
    df = spark.createDataFrame(rows, "event_id string, received_at timestamp, type string, workspace_id string, status string, price_plan string, meta_plan string")
    got = {r["workspace_id"]: (r["plan"], r["plan_status"]) for r in Q.subscription_state(df).collect()}
    assert got == {"w": ("growth", "past_due"), "x": ("free", "canceled"), "y": ("agency", "trialing")}


def test_subscription_by_customer_with_period_and_id(spark):
    day = lambda n: T0 + timedelta(days=n)
    rows = [
        ("e1", day(0), "subscription", "w", "active", "growth", "cus_w", "sub_1", 100), ("e2", day(1), "subscription", None, "active", "agency", "cus_w", "sub_2", 200),
        ("e3", day(2), "payment_failed", None, None, None, "cus_w", None, None), ("e4", day(1), "subscription", None, "unpaid", "growth", "cus_x", "sub_3", 300),
        ("e5", day(1), "subscription", None, "active", "growth", "cus_nobody", "sub_4", 400), ("e6", day(3), "subscription", "y", "trialing", "starter", None, "sub_5", None)]
    df = spark.createDataFrame(rows, "event_id string, received_at timestamp, type string, workspace_id string, status string, price_plan string, customer_id string, subscription_id string, period_end long").withColumn("meta_plan", F.lit(None).cast("string"))
    known = spark.createDataFrame([("cus_w", "w"), ("cus_x", "x")], "customer_id string, workspace_id string")
    got = {r[0]: tuple(r[1:]) for r in Q.subscription_state(df, known).withColumn("current_period_end", F.unix_seconds("current_period_end")).collect()}
    assert got == {"w": ("agency", "past_due", "cus_w", "sub_2", 200), "x": ("free", "canceled", "cus_x", None, 300), "y": ("starter", "trialing", None, "sub_5", None)}


def test_quarantine_split(spark):
    df = spark.createDataFrame([("ok", None, "en-GB", ["claude"]), ("x", "shop", "en_GB", ["bing"])], "prompt string, intent string, locale string, engines array<string>")
    good, bad = C.split(C.validate_prompts(df.replace("ok", "long enough")))
    assert good.count() == 1 and bad.collect()[0]["reasons"] == ["prompt", "intent", "locale", "engines"]


def test_update_stream_over_several_batches(spark, tmp_path):
    rows = [(i, i % 3, "chatgpt", T0 + timedelta(minutes=i), i % 2 == 0, "live", None) for i in range(30)]
    ddl = "check_id int, prompt_id int, engine string, checked_at timestamp, brand_cited boolean, mode string, error string"
    df = spark.createDataFrame(rows, ddl)
    for n in range(3):
        df.filter(F.col("check_id") % 3 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = X.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    got = {r["prompt_id"]: r["check_id"] for r in X.drain_updates(X.latest_state(stream), ["prompt_id", "engine"], "t").collect()}
    assert got == {0: 27, 1: 28, 2: 29}


def test_audit_job(spark, tmp_path):
    html = "<html><head><title>Acme widgets store</title></head><body><h1>Hi</h1><p>{}</p></body></html>".format("word " * 400)
    pages = spark.createDataFrame([("a", "https://a.example/", html, 0, 200), ("a", "https://a.example/x", "", 1, 200), ("b", "https://b.example/", html, 0, 503)],
                                  "site_id string, url string, html string, crawl_pos int, status_code int")
    sites = spark.createDataFrame([("a", "https://a.example", "Acme"), ("b", "https://b.example", "B")], "site_id string, origin string, brand_name string")
    files = spark.createDataFrame([(f"https://{s}.example", k, 200 if k == "robots" else 404, "User-agent: CCBot\nDisallow: /") for s in "ab" for k in ("robots", "llms")],
                                  "origin string, kind string, status_code int, body string")
    out = run_audit(spark, pages, sites, files, str(tmp_path / "audit"))
    scores = {r["site_id"]: r for r in out.scores.collect()}
    assert scores["a"]["status"] == "complete" and 0 < scores["a"]["overall"] <= 100 and scores["a"]["pages_crawled"] == 2
    assert scores["b"]["status"] == "failed" and scores["b"]["overall"] is None and "HTTP 503" in scores["b"]["reason"]
    assert out.issues.filter("site_id = 'a' AND code = 'robots.ccbot_access'").count() == 1
    assert out.ai_access.filter("NOT allowed").count() == 2


def test_weekly_job(spark, tmp_path):
    as_of = datetime(2024, 1, 31, 6)
    workspaces = spark.createDataFrame([("w1", "starter", "active"), ("w2", "free", "active"), ("w3", "agency", "canceled")], "workspace_id string, plan string, plan_status string")
    prompts = spark.createDataFrame(
        [("p1", "w1", "s1", ["claude", "chatgpt", "perplexity"], True, None), ("p2", "w1", "s1", ["chatgpt"], True, as_of - timedelta(hours=1)), ("p3", "w2", "s1", ["chatgpt"], True, None)],
        "prompt_id string, workspace_id string, site_id string, engines array<string>, is_active boolean, last_checked_at timestamp")
    sites = spark.createDataFrame([("s1", "Acme", [], "acme.example")], "site_id string, brand_name string, brand_aliases array<string>, domain string")
    rivals = spark.createDataFrame([("s1", "Zoho", None, None)], "site_id string, name string, domain string, aliases array<string>")
    recorded = spark.createDataFrame([("p1", "chatgpt", 200, '{"output_text":"Zoho, then Acme."}')], "prompt_id string, engine string, http_status int, payload string")
    usage = run_weekly(prompts, workspaces, sites, rivals, recorded, as_of, str(tmp_path / "checks"))
    assert [tuple(r) for r in usage.collect()] == [("w1", "2024-01", "citation_checks", 2)]
    rows = {r["engine"]: r for r in read_version(spark, str(tmp_path / "checks")).collect()}
    assert (rows["chatgpt"]["brand_position"], rows["chatgpt"]["share_of_voice"], rows["chatgpt"]["error"]) == (2, 0.5, None)
    assert rows["perplexity"]["error"] == "No answer was recorded" and not rows["perplexity"]["brand_cited"]


def test_sql_functions_and_schemas(spark):
    register(spark)
    row = spark.sql("SELECT grade_for(89) g, domain_of('https://www.A.example:8/x') d, normalise_link('/a/#x', 'https://e.com/b') l").collect()[0]
    assert tuple(row) == ("B", "a.example", "https://e.com/a")
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_a_repeated_run_adds_nothing_and_months_keep_other_audits(spark, tmp_path):
    from datetime import datetime

    from answerlens.operators import sinks

    at = datetime(2024, 1, 31)
    checks = spark.createDataFrame([("c1", "p1", at), ("c2", "p2", at)], "check_id string, prompt_id string, checked_at timestamp")
    path = f"{tmp_path}/checks"
    for _ in range(2):
        sinks.append_checks(checks, path)
    assert read_version(spark, path).count() == 2
    audits = spark.createDataFrame([(1, at, 10), (2, at, 20)], "audit_id int, started_at timestamp, overall_score int")
    sinks.overwrite_audits(audits, f"{tmp_path}/audits")
    sinks.overwrite_audits(audits.filter("audit_id = 1").withColumn("overall_score", F.lit(11)), f"{tmp_path}/audits")
    assert {r["audit_id"]: r["overall_score"] for r in read_version(spark, f"{tmp_path}/audits").collect()} == {1: 11, 2: 20}


def test_touched_prompts_are_not_due_again(spark):
    from datetime import datetime

    from answerlens.operators import quotas as Q

    at = datetime(2024, 1, 31)
    prompts = spark.createDataFrame([("p1", "w", True, None), ("p2", "w", True, datetime(2024, 1, 1)), ("p3", "w", True, at)], "prompt_id string, workspace_id string, is_active boolean, last_checked_at timestamp")
    assert [(r["prompt_id"], r["queue_pos"]) for r in Q.stale_prompts(prompts, at).orderBy("queue_pos").collect()] == [("p1", 1), ("p2", 2)]
    checks = spark.createDataFrame([("p1", at), ("p2", at)], "prompt_id string, checked_at timestamp")
    assert Q.stale_prompts(Q.prompts_touched(prompts, checks), at).count() == 0


def test_ranks_over_ranges_of_a_hot_key(spark):
    from answerlens.operators.ranking import row_number_by_range

    rows = [("hot" if k % 2 else f"k{k % 7}", (k * 7919) % 1000) for k in range(2000)]
    got = row_number_by_range(spark.createDataFrame(rows, "k string, v int"), ["k"], [F.col("v")], ranges=9).collect()
    by = {}
    for r in got:
        by.setdefault(r["k"], []).append((r["rn"], r["v"]))
    for pairs in by.values():
        assert [n for n, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
        assert [v for _, v in sorted(pairs)] == sorted(v for _, v in pairs)


def test_a_failed_site_has_a_reason_and_nothing_else(spark, tmp_path):
    from answerlens.plans.audit import run_audit

    pages = spark.createDataFrame([(1, "https://up.example/", "<h1>x</h1>", 200, 0), (2, "https://down.example/", "<h1>x</h1>", 503, 0)], "site_id int, url string, html string, status_code int, crawl_pos int")
    sites = spark.createDataFrame([(1, "https://up.example", "Up"), (2, "https://down.example", "Down")], "site_id int, origin string, brand_name string")
    files = spark.createDataFrame([("https://up.example", "robots", 200, ""), ("https://down.example", "robots", 200, "")], "origin string, kind string, status_code int, body string")
    out = run_audit(spark, pages, sites, files, str(tmp_path))
    scores = {r["site_id"]: r for r in out.scores.collect()}
    assert scores[1]["overall"] is not None and scores[2]["overall"] is None and "503" in scores[2]["reason"]
    for table in (out.checks, out.issues, out.action_plan):
        assert {r["site_id"] for r in table.select("site_id").distinct().collect()} <= {1}


def test_a_crawl_level_moves_no_edges(spark):
    """Edges and visited pages are read in buckets: no exchange above their scans, and one write a level."""
    n = 40
    edges = spark.createDataFrame([("a", f"p{i}", k, f"p{j}") for i in range(n) for k, j in enumerate((2 * i + 1, 2 * i + 2)) if j < n], "site_id string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("a", "p0")], "site_id string, url string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, append = [], G._Bucketed.append

    def noted(self, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return append(self, rows)

    try:
        G._Bucketed.append = noted
        assert G.crawl_reach(edges, seeds).count() == n
    finally:
        G._Bucketed.append = append
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    levels = plans[2:]
    assert len(levels) == 6  # depths 1 to 5, and the empty one
    for plan in levels:
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "FileScan parquet" in line and "src#" in line:
                assert "Bucketed: true" in line
                above = lines[k - 4 : k]
                assert not any("Exchange" in x for x in above)


def test_levels_numbered_over_ranges(spark, monkeypatch):
    """The way for graphs with more edges than one window takes gives the same order."""
    rng = random.Random(1)
    edges = spark.createDataFrame([(s, f"p{i}", k, f"p{rng.randrange(80)}") for s in "ab" for i in range(80) for k in range(3)], "site_id string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("a", "p0"), ("b", "p0")], "site_id string, url string")
    one = sorted(map(tuple, G.crawl_reach(edges, seeds).collect()))
    monkeypatch.setattr(G, "WINDOW_EDGES", 1)
    assert sorted(map(tuple, G.crawl_reach(edges, seeds).collect())) == one


def test_a_long_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([("a", f"p{i}", 0, f"p{i + 1}") for i in range(25)], "site_id string, src string, pos int, dst string")
    seeds = spark.createDataFrame([("a", "p0")], "site_id string, url string")
    got = {r["url"]: (r["depth"], r["rank"]) for r in G.crawl_reach(edges, seeds).collect()}
    assert got == {f"p{i}": (i, i + 1) for i in range(26)}
    assert G.crawl_reach(edges.limit(0), seeds).count() == 1 and G.crawl_reach(edges, seeds, max_depth=3).count() == 4


def test_sink_issues_reads_the_pages_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["sink_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan and "body" not in plan
