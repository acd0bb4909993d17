"""Checks, pillars, ceilings, issues and the gate, from hand-made page features."""

import pytest

from answerlens import dims
from answerlens.operators import checks as K
from answerlens.operators import issues as I
from answerlens.operators import robots as B
from answerlens.operators import score as S
from answerlens.operators.reach import audit_gate

GOOD = dict(
    url="https://example.com/", depth=0, status_code=200, error=None, title="Tidewater, Harbour Boats and Lessons", title_length=36,
    meta_description="Boats by the hour, lessons by the week.", h1_count=1, heading_skips=0, word_count=1300, js_dependent=False, js_dependent_reason=None,
    jsonld_blocks=3, jsonld_invalid=0, jsonld_types=["Article", "BreadcrumbList", "FAQPage", "Organization"],
    same_as=[f"https://social{i}.example/tidewater" for i in range(4)], has_faq_schema=True, has_faq=True,
    has_direct_answer=True, list_count=4, table_count=2, date_modified="2025-05-04", author="M. Reed", crawl_pos=0,
)
DDL = (
    "site_id string, url string, depth int, status_code int, error string, title string, title_length int, meta_description string, h1_count int, "
    "heading_skips int, word_count int, js_dependent boolean, js_dependent_reason string, jsonld_blocks int, jsonld_invalid int, jsonld_types array<string>, "
    "same_as array<string>, has_faq_schema boolean, has_faq boolean, has_direct_answer boolean, list_count int, table_count int, date_modified string, author string, crawl_pos int"
)
OPEN = "User-agent: *\nDisallow:\n"
SITES = {
    "good": ([{}], OPEN),
    "gptbot": ([{}], "User-agent: GPTBot\nDisallow: /\n"),
    "all": ([{}], "User-agent: *\nDisallow: /\n"),
    "js": ([dict(js_dependent=True, js_dependent_reason="why", word_count=18)], OPEN),
    "invalid": ([dict(jsonld_invalid=1)], OPEN),
    "no_ld": ([dict(jsonld_blocks=0, jsonld_types=[], same_as=[])], OPEN),
    "dead": ([dict(status_code=500, error="Server error")], OPEN),
    "refused": ([dict(status_code=403)], OPEN),
    "unreached": ([dict(status_code=None, error="fetch failed")], OPEN),
    "mixed": ([dict(status_code=500, error="Server error"), {}], OPEN),
    "thin": ([dict(word_count=n, crawl_pos=i, url=f"https://example.com/{i}") for i, n in enumerate([100, 200, 400, 901] + [50] * 36)], OPEN),
    "ppx": ([dict(word_count=120)], "User-agent: PerplexityBot\nDisallow: /\n"),
    "nobrand": ([dict(title="x", title_length=1)], OPEN),
}


@pytest.fixture(scope="module")
def data(spark):
    rows = [tuple({**GOOD, **o, "site_id": s}[c.split(" ")[0]] for c in DDL.replace("array<string>", "a").split(", ")) for s, (pages, _) in SITES.items() for o in pages]
    features = spark.createDataFrame(rows, DDL)
    sites = spark.createDataFrame([(s, s, "" if s == "nobrand" else "Tidewater") for s in SITES], "site_id string, origin string, brand_name string")
    robots = B.parsed_robots(spark.createDataFrame([(s, 200, r) for s, (_, r) in SITES.items()], "origin string, status_code int, body string"))
    surface = spark.createDataFrame(
        [(s, (s != "ppx", 900, s != "ppx", 3), (s != "ppx", 9000), (True, 42, "robots", "u")) for s in SITES],
        "origin string, llms_txt struct<present:boolean,bytes:int,well_formed:boolean,sections:int>, llms_full_txt struct<present:boolean,bytes:int>, "
        "sitemap struct<present:boolean,url_count:int,source:string,url:string>")
    scored = I.with_issues(S.with_score(K.with_checks(K.site_facts(features, sites, robots, surface)))).cache()
    return {"features": features, "scored": scored, "rows": {r["site_id"]: r for r in scored.collect()}}


def pillar(row, name):
    return next(p for p in row["pillars"] if p["id"] == name)


def test_good_site(data):
    good = data["rows"]["good"]
    assert good["overall"] >= 95 and good["grade"] == "A" and good["issues"] == []
    assert sum(p["weight"] for p in dims.PILLARS) == 100
    assert len(good["checks"]) == 29


def test_blocked_bot_leads(data):
    row = data["rows"]["gptbot"]
    assert row["overall"] == 60 and row["ceiling_reason"].startswith("GPTBot is blocked")
    assert (row["issues"][0]["code"], row["issues"][0]["severity"]) == ("robots.gptbot_access", "critical")


def test_blanket_block(data):
    row = data["rows"]["all"]
    assert pillar(row, "crawler_access")["score"] <= 10
    assert row["overall"] == 25 and row["grade"] == "F"


def test_js_only(data):
    row = data["rows"]["js"]
    assert pillar(row, "no_js_content")["score"] < 40
    issue = next(i for i in row["issues"] if i["code"] == "nojs.server_rendered")
    assert (issue["severity"], issue["effort"]) == ("critical", "high")


def test_invalid_is_not_missing(data):
    codes = [i["code"] for i in data["rows"]["invalid"]["issues"]]
    assert "schema.valid" in codes and "schema.present" not in codes
    missing = {c["code"]: c for c in data["rows"]["no_ld"]["checks"]}
    assert missing["schema.valid"]["passed"] and missing["schema.valid"]["score"] == 0.0
    assert "schema.valid" in [i["code"] for i in data["rows"]["no_ld"]["issues"]]


def test_unusable_pages_drop_content_pillars(data):
    for site in ("dead", "unreached", "refused"):
        row = data["rows"][site]
        assert pillar(row, "structured_data")["n_checks"] == 0 and row["overall"] > 0
        assert "nojs.no_pages" in [c["code"] for c in row["checks"]]


def test_issues_have_copy_and_weight(data):
    rows = I.issue_rows(data["scored"]).collect()
    assert rows
    for r in rows:
        assert r["impact_points"] > 0 and r["priority_score"] > 0
        assert all(len(r[c]) > 20 for c in ("what_it_means", "why_it_matters", "how_to_fix"))
    assert set(dims.COPY) == {c[0] for c in dims.CHECKS}


def test_order_is_by_priority_after_criticals(data):
    for row in data["rows"].values():
        rest = [i for i in row["issues"] if i["severity"] != "critical"]
        assert [i["priority_score"] for i in rest] == sorted((i["priority_score"] for i in rest), reverse=True)
        flags = [i["severity"] == "critical" for i in row["issues"]]
        assert flags == sorted(flags, reverse=True)


def test_median_and_affected(data):
    row = data["rows"]["thin"]
    assert row["median_words"] == 50
    affected = {(r["site_id"], r["code"]): r for r in K.affected_pages(data["features"], "crawl_pos").collect()}
    thin = affected["thin", "nojs.sufficient_depth"]
    assert len(thin["affected"]) == 10 and thin["affected_total"] == 38
    every = K.affected_rows(data["features"], "crawl_pos").filter("site_id = 'thin' AND code = 'nojs.sufficient_depth'")
    assert every.count() == 38
    assert thin["affected"][:3] == ["https://example.com/0", "https://example.com/1", "https://example.com/4"]
    assert affected["nobrand", "entity.titles"]["affected_total"] == 1
    assert K.js_reasons(data["features"], "crawl_pos").collect()[0]["reasons"] == ["why"]


def test_brand_check_needs_a_brand(data):
    assert "entity.brand_in_title" not in [c["code"] for c in data["rows"]["nobrand"]["checks"]]


def test_gate(data):
    got = {r["site_id"]: r for r in audit_gate(data["features"], "crawl_pos").collect()}
    assert got["mixed"]["status"] == "complete"
    assert got["unreached"]["status"] == "failed" and "fetch failed" in got["unreached"]["reason"] and "example.com" in got["unreached"]["reason"]
    assert "HTTP 403" in got["refused"]["reason"] and "GPTBot" in got["refused"]["reason"]


def test_action_plan(data):
    plan = {}
    for r in I.action_plan(data["scored"]).orderBy("site_id", "step").collect():
        plan.setdefault(r["site_id"], []).append(r)
    assert all(len(v) <= 5 for v in plan.values())
    assert [s["code"] for s in plan["gptbot"]] == ["robots.gptbot_access"] and plan["gptbot"][0]["timeframe"] == "This week"
    assert any(s["timeframe"] == "This month" for s in plan["ppx"])
