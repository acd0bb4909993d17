"""robots.txt precedence, wildcards, grouping and the access matrix."""

import pytest

from answerlens.operators import robots as B
from answerlens.operators.surface import answer_surface
from answerlens.sources.site_files import scan_site_files

FILES = {
    "none": (None, None),
    "closed": (200, "user-agent: *\ndisallow: /\ncrawl-delay: 4"),
    "guest": (200, "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nDisallow: /drafts\n"),
    "inner": (200, "User-agent: *\nDisallow: /shop\nAllow: /shop/sale\nDisallow: /shop/sale/old\n"),
    "globs": (200, "User-agent: *\nDisallow: /*.zip$\nDisallow: /u/*/mail\n"),
    "nothing": (200, "User-agent: *\nDisallow:\nDisallow:   # none\n"),
    "pair": (200, "User-agent: CCBot\nUser-agent: PerplexityBot\nDisallow: /\n"),
    "notes": (200, "# top\r\nsitemap: https://tide.example/map.xml\r\nUser-Agent: * # all\r\nDisallow: /quay # closed\r\n"),
    "named": (200, "User-agent: *\nAllow: /\n\nUser-agent: CCBot\nDisallow: /\n"),
    "page": (200, "\n <!doctype html>"),
    "down": (502, "User-agent: *\nDisallow: /"),
    "prefix": (200, "User-agent: gpt\nDisallow: /\nCrawl-delay: 2\nCrawl-delay: -1\nCrawl-delay: 3.5\n"),
    "tie": (200, "Disallow: /early\nUser-agent: *\nDisallow: /k\nAllow: /k\nSitemap: s\nDisallow: /b+c(d\n"),
    "runs": (200, "User-agent: q\nNote: x\nUser-agent: *\nDisallow: /\nUser-agent: *\nAllow: /\n"),
}
CASES = [
    ("none", "GPTBot", "/k", True), ("closed", "ClaudeBot", "/", False), ("guest", "GPTBot", "/essay", True), ("guest", "GPTBot", "/drafts/1", False),
    ("guest", "CCBot", "/essay", False), ("inner", "Bot", "/shop/cart", False), ("inner", "Bot", "/shop/sale/new", True), ("inner", "Bot", "/shop/sale/old/2", False),
    ("globs", "Bot", "/a/b.zip", False), ("globs", "Bot", "/a/b.zip?x", True), ("globs", "Bot", "/u/7/mail", False), ("nothing", "Bot", "/k", True),
    ("pair", "CCBot", "/", False), ("pair", "PerplexityBot", "/", False), ("pair", "GPTBot", "/", True), ("notes", "Bot", "/quay", False),
    ("page", "Bot", "/", True), ("down", "Bot", "/", True), ("prefix", "GPTBot", "/", False), ("prefix", "ClaudeBot", "/", True),
    ("tie", "Bot", "/k", True), ("tie", "Bot", "/early", True), ("tie", "Bot", "/b+c(d/e", False), ("runs", "Bot", "/", False),
]


@pytest.fixture(scope="module")
def robots(spark):
    files = spark.createDataFrame([(k, *v) for k, v in FILES.items()], "origin string, status_code int, body string")
    return B.parsed_robots(files).cache()


def test_allowed(spark, robots):
    paths = spark.createDataFrame([(o, u, p) for o, u, p, _ in CASES], "origin string, ua string, path string")
    got = {(r["origin"], r["ua"], r["path"]): r["allowed"] for r in B.robots_allowed(paths, robots).collect()}
    assert got == {(o, u, p): a for o, u, p, a in CASES}


def test_status_and_sitemaps(robots):
    rows = {r["origin"]: r for r in robots.collect()}
    assert rows["none"]["permissive_by_absence"] and rows["page"]["status_code"] == 404
    assert not rows["down"]["permissive_by_absence"] and rows["down"]["groups"] is None
    assert rows["notes"]["sitemaps"] == ["https://tide.example/map.xml"]
    assert rows["prefix"]["groups"][0]["crawl_delay"] == 3.5
    assert len(rows["runs"]["groups"]) == 3


def test_matrix(robots):
    rows = {(r["origin"], r["ua"]): r for r in B.ai_access_matrix(robots).collect()}
    ccb, ppx = rows["named", "CCBot"], rows["named", "PerplexityBot"]
    assert not ccb["allowed"] and ccb["explicitly_blocked"]
    assert ppx["allowed"] and not ppx["mentioned"]
    assert not rows["closed", "GPTBot"]["explicitly_blocked"]
    assert rows["none", "CCBot"]["allowed"]


def test_blocks_everyone(robots):
    got = {r["origin"]: r["b"] for r in robots.select("origin", B.blocks_everyone().alias("b")).collect()}
    assert {k for k, v in got.items() if v} == {"closed", "guest", "runs"}


def test_surface(spark, robots):
    files = spark.createDataFrame(
        [("notes", "llms", 200, "intro\n# Acme\n\n## A\n- [x](https://e.com)\n## B\n"), ("notes", "llms_full", 200, " <p>"),
         ("notes", "sitemap", 200, "<URLSET><loc>a</loc><LOC>b</LOC>"), ("closed", "llms", 404, "# x [a](b)"), ("closed", "sitemap", 200, "<html>")],
        "origin string, kind string, status_code int, body string")
    got = {r["origin"]: r for r in answer_surface(scan_site_files(files), robots).collect()}
    a = got["notes"]
    assert a["llms_txt"]["well_formed"] and a["llms_txt"]["sections"] == 2
    assert not a["llms_full_txt"]["present"]
    assert (a["sitemap"]["present"], a["sitemap"]["url_count"], a["sitemap"]["source"]) == (True, 2, "robots")
    assert not got["closed"]["llms_txt"]["present"] and not got["closed"]["sitemap"]["present"]
    assert got["closed"]["sitemap"]["url"] == "closed/sitemap.xml"


def test_pattern_regex_agrees_with_globs(spark):
    from fnmatch import fnmatchcase

    from pyspark.sql import functions as F

    rules = ["/a*b*c", "/*.pdf$", "/*a*a*$", "/x$", "/", "/*", "/a$b", "/(x)+*[y]", "*", "/**b", "$", "/*a*a*a*a*a*a*a*a*b"]
    paths = ["/abc", "/a-b-c-d", "/acb", "/f.pdf", "/f.pdf?x", "/xaxa", "/aa", "/x", "/xy", "/a$b", "/(x)+1[y]2", "/bb", "", "/" + "a" * 3000]
    df = spark.createDataFrame([(r, p) for r in rules for p in paths], "rule string, path string")
    for row in df.withColumn("hit", F.expr(f"regexp_like(path, {B.pattern_regex('rule')})")).collect():
        rule, end = (row["rule"][:-1], "") if row["rule"].endswith("$") else (row["rule"], "*")
        want = fnmatchcase(row["path"], rule.replace("[", "[[]") + end)
        assert row["hit"] == want, (row["rule"], row["path"][:40])
