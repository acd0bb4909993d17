"""The engine's input tables as views of the given Parquet tables.

Each view is a projection in SQL that Spark and DuckDB both read, so a query and its check start
from the same rows. Where the dialects differ a pair ``(spark, duckdb)`` is given. Nothing is
filtered away: every row of a source table becomes a row of its view.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = datetime(2024, 1, 31)
PERIOD = "2024-01"

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
NL = "chr(10)"

_LD_ORG = (
    "concat('<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"Organization\",\"name\":\"Org ', "
    "page_id, '\",\"sameAs\":[\"https://social.example/', page_id % 9, '\",\"https://wiki.example/', page_id % 5, '\"]}</script>')"
)
_LD_GRAPH = (
    "concat('<script type=\"application/ld+json\">{\"@graph\":[{\"@type\":[\"Article\",\"FAQPage\"],\"author\":{\"@type\":\"Person\","
    "\"name\":\"Writer ', page_id, '\"},\"dateModified\":\"2024-01-', 10 + page_id % 20, '\"},{\"@type\":\"BreadcrumbList\","
    "\"sameAs\":\"https://social.example/', page_id % 9, '\"}]}</script>')"
)
_LD_BROKEN = "'<script type=\"application/ld+json\">{\"@type\":\"Article\",</script><script type=\"application/ld+json\">{\"name\":\"x\"}</script>'"
_HEAD = (
    "concat(CASE page_id % 4 WHEN 1 THEN " + _LD_ORG + " WHEN 2 THEN " + _LD_GRAPH + " WHEN 3 THEN " + _LD_BROKEN + " ELSE '' END, "
    "CASE WHEN page_id % 3 = 0 THEN concat('<meta name=\"description\" content=\" About &amp; more ', page_id, ' \">') ELSE '' END, "
    "CASE WHEN page_id % 5 = 2 THEN concat('<link rel=\"canonical\" href=\"https://canon.example/', page_id, '\">') ELSE '' END, "
    "CASE WHEN page_id % 7 = 3 THEN '<meta content=\"NOINDEX, follow\" name=\"robots\">' ELSE '' END, "
    "CASE WHEN page_id % 11 = 4 THEN '<meta name=\"author\" content=\"Meta Writer\">' ELSE '' END, "
    "CASE WHEN page_id % 13 = 5 THEN '<meta property=\"article:modified_time\" content=\"2023-12-01\">' ELSE '' END, '</head>')"
)
_BODY = (
    "concat(CASE page_id % 6 WHEN 0 THEN '<h2>Overview</h2><h4>Deep part</h4>' "
    "WHEN 1 THEN '<h2>What does it cost?</h2><p>Little.</p><h2>How to start</h2>' "
    "WHEN 2 THEN '<table><tr><td>1</td></tr></table><ol><li>a</li></ol>' "
    "WHEN 3 THEN '<details><summary>Q</summary>A</details><details><summary>R</summary>B</details>' "
    "WHEN 4 THEN '<div id=\"root\"></div><script src=\"/a.js\"></script><script src=\"/b.js\"></script><script src=\"/c.js\"></script>' "
    "ELSE '<noscript>Please enable JavaScript.</noscript><h1>Second</h1>' END, "
    "'<a href=\"/p/', page_id % 17, '?utm_source=x&amp;id=2#top\">next</a><a href=\"../up/./', page_id % 3, '/\">up</a>"
    "<a href=\"mailto:a@b.example\">m</a><a href=\"/file.PDF\">f</a><a href=\"https://other.example/x\">o</a>', '</article>')"
)

_BOT_FILE = (
    "CASE length(host) % 5 WHEN 1 THEN concat('User-agent: GPTBot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Allow: /') "
    "WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'Sitemap: https://', host, '/map.xml') "
    "WHEN 3 THEN concat('Disallow: /orphan', chr(10), 'User-agent: *', chr(10), 'Disallow: /', chr(10), 'User-agent: gptbot', chr(10), 'User-agent: CCBot', chr(10), "
    "'Allow: /', chr(10), 'Disallow: /en/', chr(10), 'Crawl-delay: 2.5', chr(10), 'crawl-delay: x') "
    "WHEN 4 THEN concat('# note', chr(10), 'user-agent: * # all', chr(10), 'Disallow: /*/7', chr(10), 'Allow: /*/75', chr(36), chr(10), 'Disallow:', chr(10), "
    "'Sitemap: https://one.example/s.xml', chr(10), 'sitemap: https://two.example/s.xml', chr(10), 'nonsense') "
    "ELSE '<html>not found</html>' END"
)

VIEWS: dict[str, tuple[str, list[tuple[str, object]]]] = {
    # One site per host of the page table.
    "page_rows": ("pages", [("page_id", "page_id"), ("url", "url"), ("host", HOST), ("site_id", HOST),
                            ("html", f"replace(replace(html, '</head>', {_HEAD}), '</article>', {_BODY})"),
                            ("status_code", "CASE WHEN page_id % 19 = 7 THEN 500 ELSE 200 END"),
                            ("content_type", "CASE WHEN page_id % 23 = 9 THEN 'application/json' ELSE 'text/html' END"),
                            ("error", "CASE WHEN page_id % 29 = 11 THEN 'Timed out' END")]),
    "hosts": ("page_hosts", [("host", "host"), ("site_id", "host"), ("origin", "concat('https://', host)"),
                             ("brand_name", "CASE WHEN length(host) % 7 = 0 THEN '' ELSE regexp_extract(host, '([a-z]+)[.]example', 1) END"),
                             ("topic", "CASE WHEN length(host) % 2 = 0 THEN 'crm' END"),
                             ("robots_code", "CASE WHEN length(host) % 9 = 0 THEN NULL WHEN length(host) % 9 = 1 THEN 503 ELSE 200 END"),
                             ("robots_body", _BOT_FILE),
                             ("llms_code", "CASE WHEN length(host) % 3 = 0 THEN 404 ELSE 200 END"),
                             ("llms_body", "CASE WHEN length(host) % 4 = 0 THEN 'plain text' ELSE concat('# ', host, chr(10), chr(10), '## Pages', chr(10), '- [Home](https://', host, '/)', chr(10), '## More') END"),
                             ("full_code", "CASE WHEN length(host) % 2 = 0 THEN 200 ELSE 404 END"),
                             ("full_body", "CASE WHEN length(host) % 6 = 0 THEN '<p>x</p>' ELSE concat('full text of ', host) END"),
                             ("map_code", "CASE WHEN length(host) % 5 = 0 THEN 404 ELSE 200 END"),
                             ("map_body", "concat('<?xml version=\"1.0\"?><urlset>', repeat('<url><loc>u</loc></url>', cast(length(host) % 8 AS int)), '</urlset>')")]),
    # A page graph: site page_id % 8, page i links to 2i+1 and 2i+2 of its site, back to 0 and to itself, as links at the end of
    # the page's own html, whose other links are taken out.
    "graph_pages": ("pages", [("page_id", "page_id"), ("site_id", "page_id % 8"),
                              ("local", "cast(floor(page_id / 8) AS bigint)"),
                              ("url", "concat('https://s', page_id % 8, '.example.com/p/', cast(floor(page_id / 8) AS bigint))"),
                              ("base", "concat('https://s', page_id % 8, '.example.com/p/')"),
                              ("html", "concat(replace(html, '<a ', '<i '), '<a href=\"/p/', 2 * cast(floor(page_id / 8) AS bigint) + 1, '#top\">down</a><a href=\"', "
                                       "2 * cast(floor(page_id / 8) AS bigint) + 2, '\">on</a><a href=\"https://s', page_id % 8, '.example.com/p/0?utm_source=x\">home</a>"
                                       "<a href=\"../p/./', cast(floor(page_id / 8) AS bigint), '\">here</a><a href=\"https://elsewhere.example/p/1\">out</a>')")]),
    "checks": ("events", [
        ("check_id", "event_id"), ("checked_at", "ts"), ("prompt_id", "user_id"), ("site_id", "user_id % 25"),
        ("workspace_id", "user_id % 25 % 20"),
        ("engine", "CASE event_type WHEN 'click' THEN 'chatgpt' WHEN 'view' THEN 'perplexity' WHEN 'purchase' THEN 'google_aio' "
                   "WHEN 'signup' THEN 'claude' ELSE CASE event_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'perplexity' "
                   "WHEN 2 THEN 'google_aio' ELSE 'claude' END END"),
        ("error", "CASE WHEN event_type = 'error' THEN 'Request timed out' END"),
        ("brand_cited", "value >= 20 AND event_type <> 'error'"),
        ("share_of_voice", "CASE WHEN event_type = 'error' THEN 0.0e0 ELSE (event_id % 101) / 100.0e0 END"),
        ("k", "cast(regexp_extract(props, '([0-9]+)', 1) AS bigint)"),
        ("brand_mentions", "CASE WHEN event_type = 'error' THEN 0 ELSE cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 4 END"),
        ("rival_a", "CASE WHEN event_type = 'error' THEN 0 ELSE cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 3 END"),
        ("rival_b", "CASE WHEN event_type = 'error' THEN 0 ELSE cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 5 END"),
        ("brand_position", "CASE WHEN event_type <> 'error' AND value >= 20 THEN 1 + event_id % 3 END"),
        ("mode", "CASE WHEN event_id % 3 = 0 THEN 'simulated' ELSE 'live' END"),
        ("trigger_source", "CASE event_id % 5 WHEN 0 THEN 'manual' WHEN 4 THEN 'cron' ELSE 'schedule' END"),
        ("sentiment", "CASE WHEN event_type <> 'error' AND value >= 20 THEN CASE event_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' ELSE 'neutral' END END"),
    ]),
    "sites": ("supplier", [
        ("site_id", "s_suppkey"), ("workspace_id", "s_suppkey % 20"),
        ("origin", "concat('https://www.s', s_suppkey % 90, '.example.com')"), ("domain", "concat('s', s_suppkey % 90, '.example.com')"),
        ("name", "s_name"), ("brand_name", "concat('Brand ', s_suppkey)"),
        ("created_at", "cast(cast('2023-01-01' AS date) + cast(s_suppkey % 300 AS int) AS timestamp)"),
        ("url", "CASE s_suppkey % 6 WHEN 0 THEN concat(' www.S', s_suppkey, '.Example.com/page ') WHEN 1 THEN 'x' WHEN 2 THEN 'bad url.example' "
                "ELSE concat('HTTPS://www.s', s_suppkey, '.example.com:443/a?b=1') END"),
        ("alias_csv", "CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a,,b' WHEN 2 THEN '1,2,3,4,5,6,7,8,9,10,11' ELSE 'Acme,Acme CRM' END"),
        ("label", "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE s_name END"),
    ]),
    "prompts": ("part", [
        ("prompt_id", "p_partkey"), ("site_id", "p_partkey % 25"), ("workspace_id", "p_partkey % 25 % 20"), ("prompt", "p_name"),
        ("intent", "CASE p_size % 6 WHEN 0 THEN 'informational' WHEN 1 THEN 'commercial' WHEN 2 THEN 'local' WHEN 3 THEN 'navigational' WHEN 4 THEN 'other' END"),
        ("locale", "CASE p_size % 5 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'en' WHEN 2 THEN 'de-DE' WHEN 3 THEN 'EN_us' ELSE 'pt-br' END"),
        ("engine_csv", "CASE p_partkey % 5 WHEN 0 THEN 'claude,chatgpt' WHEN 1 THEN 'chatgpt,perplexity,google_aio' WHEN 2 THEN 'google_aio' WHEN 3 THEN 'bing,claude' ELSE 'perplexity,chatgpt,google_aio,claude' END"),
        ("is_active", "p_size % 7 <> 0"),
        ("last_checked_at", "CASE WHEN p_partkey % 5 <> 0 THEN cast(cast('2024-01-31' AS date) - cast(p_size AS int) AS timestamp) END"),
        ("created_at", "cast(cast('2023-01-01' AS date) + cast(p_partkey % 365 AS int) AS timestamp)"),
        ("plan", "CASE p_partkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'growth' ELSE 'agency' END"),
        ("engines_limit", "CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END"),
    ]),
    "competitors": ("part", [
        ("competitor_id", "p_partkey"), ("site_id", "p_partkey % 25"), ("workspace_id", "p_partkey % 25 % 20"), ("name", "p_brand"),
        ("domain", "concat(' HTTPS://www.', p_type, '.Example.com/shop/', p_size)"),
        ("alias_csv", "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END"),
        ("created_at", "cast(cast('2023-01-01' AS date) + cast(p_partkey % 365 AS int) AS timestamp)"),
    ]),
    "audits": ("orders", [
        ("audit_id", "o_orderkey"), ("site_id", "CASE WHEN o_orderkey % 10 <> 9 THEN o_custkey % 25 END"),
        ("workspace_id", "CASE WHEN o_orderkey % 10 <> 9 THEN o_custkey % 25 % 20 END"),
        ("public_id", "concat('p', o_orderkey % 14000)"), ("scope", "CASE WHEN o_orderkey % 3 = 0 THEN 'single_url' WHEN o_orderkey % 97 = 1 THEN 'folder' ELSE 'site' END"),
        ("target_url", "concat('https://www.s', o_custkey % 25, '.example.com/')"), ("origin", "concat('https://www.s', o_custkey % 25, '.example.com')"),
        ("status", "CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE 'complete' END"),
        ("overall_score", "CASE WHEN o_orderstatus <> 'P' THEN cast(floor(o_totalprice) AS bigint) % 103 END"),
        ("pages_crawled", "o_custkey % 60"), ("started_at", "o_orderdate"),
        ("completed_at", ("timestampadd(MINUTE, cast(o_orderkey % 50 AS int), o_orderdate)", "o_orderdate + to_minutes(o_orderkey % 50)")),
        ("summary", "CASE WHEN o_orderstatus <> 'P' THEN concat('Summary ', o_orderkey) END"),
    ]),
    "free_audits": ("events", [("audit_id", "event_id"), ("workspace_id", "cast(NULL AS bigint)"), ("created_ip", "concat('ip', user_id % 40)"), ("started_at", "ts")]),
    "workspaces": ("customer", [
        ("workspace_id", "c_custkey"), ("name", "CASE WHEN c_custkey % 9 = 0 THEN c_mktsegment ELSE c_name END"),
        ("plan", "CASE c_custkey % 5 WHEN 0 THEN 'free' WHEN 1 THEN 'starter' WHEN 2 THEN 'growth' WHEN 3 THEN 'agency' ELSE 'legacy' END"),
        ("plan_status", "CASE c_nationkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'canceled' ELSE 'paused' END"),
        ("brand_name", "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_name END"),
        ("brand_logo_url", "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'logo.png' ELSE concat('https://cdn.example/', c_custkey, '.png') END"),
        ("brand_colour", "CASE c_custkey % 5 WHEN 0 THEN '#4f46e5' WHEN 1 THEN '#FFF' WHEN 2 THEN 'red' ELSE '#00ff7F' END"),
        ("brand_footer", "CASE WHEN c_custkey % 6 = 0 THEN repeat('f', 301) WHEN c_custkey % 6 = 1 THEN NULL ELSE c_mktsegment END"),
        ("brand_contact", "concat(c_name, '@example.com')"),
        ("created_at", "cast(cast('2023-01-01' AS date) + cast(c_custkey % 200 AS int) AS timestamp)"),
    ]),
    "issues": ("lineitem", [
        ("issue_id", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"), ("audit_id", "l_orderkey % 500"), ("workspace_id", "l_orderkey % 20"),
        ("code", "concat('check_', l_partkey % 30)"), ("severity", "CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"),
        ("effort", "CASE l_suppkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"),
        ("impact_points", "floor(l_quantity) / 10.0e0"), ("priority_score", "floor(l_extendedprice / 100) / 10.0e0"),
        ("status", "CASE l_returnflag WHEN 'A' THEN 'open' WHEN 'N' THEN 'in_progress' ELSE CASE l_linestatus WHEN 'O' THEN 'fixed' ELSE 'ignored' END END"),
    ]),
    "changes": ("lineitem", [
        ("change_id", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_extendedprice)"),
        ("issue_id", "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"), ("audit_id", "l_orderkey % 500"),
        ("workspace_id", "CASE WHEN l_suppkey % 4 = 0 THEN 999 ELSE l_orderkey % 20 END"),
        ("status", "CASE WHEN l_discount < 0.05 THEN 'fixed' ELSE 'in_progress' END"), ("changed_at", "l_shipdate"),
    ]),
    "share_links": ("orders", [
        ("link_id", "o_orderkey"), ("kind", "CASE o_orderkey % 4 WHEN 0 THEN 'audit' WHEN 1 THEN 'citations' WHEN 2 THEN 'combined' ELSE 'pdf' END"),
        ("site_id", "CASE WHEN o_orderkey % 6 <> 1 THEN o_custkey % 25 END"), ("audit_id", "CASE WHEN o_orderkey % 8 < 3 THEN o_orderkey END"),
        ("revoked_at", "CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END"),
        ("expires_at", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate WHEN o_orderkey % 5 = 1 THEN cast('2030-01-01' AS timestamp) END"),
        ("view_count", "o_custkey % 10"), ("label", "CASE WHEN o_orderkey % 50 = 0 THEN repeat('x', 121) ELSE o_orderpriority END"),
    ]),
    "views": ("lineitem", [("link_id", "l_orderkey"), ("viewed_at", "l_shipdate")]),
    "billing": ("events", [
        ("event_id", "concat('evt_', cast(floor(event_id / 2) AS bigint))"), ("seq", "event_id"), ("received_at", "ts"),
        ("workspace_id", "CASE WHEN event_id % 6 <> 5 THEN user_id END"), ("customer_id", "CASE WHEN event_id % 4 <> 3 THEN concat('cus_', user_id) END"),
        ("subscription_id", "concat('sub_', event_id % 1000)"), ("period_end", "event_id * 1000"),
        ("type", "CASE WHEN event_type = 'error' THEN 'payment_failed' ELSE 'subscription' END"),
        ("status", "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'trialing' WHEN 'purchase' THEN 'past_due' WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'unpaid' WHEN 1 THEN 'canceled' ELSE 'incomplete' END END"),
        ("price_plan", "CASE event_id % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' END"),
        ("meta_plan", "CASE event_id % 5 WHEN 0 THEN 'agency' WHEN 1 THEN 'gold' END"),
    ]),
    "usage": ("events", [
        ("workspace_id", "user_id"), ("period", ("date_format(ts, 'yyyy-MM')", "strftime(ts, '%Y-%m')")),
        ("metric", "CASE WHEN event_type IN ('purchase', 'signup') THEN 'audits' ELSE 'citation_checks' END"), ("count", "1"), ("at", "ts"),
    ]),
    "answers": ("conversations", [
        ("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("site_id", "conv_id % 5"), ("text", "text"),
        ("answer", "concat(text, CASE (conv_id + turn) % 6 WHEN 0 THEN ' Northwind CRM is the strongest and most reliable option.' "
                   "WHEN 1 THEN ' Northwind-CRM is overpriced; users report complaints. Contoso leads.' "
                   "WHEN 2 THEN ' Contoso, Fabrikam and Northwind are popular. Fabrikam (fabrikam!) again.' "
                   "WHEN 3 THEN ' Northwinds is no match, nor is aNorthwind.' WHEN 4 THEN ' Fabrikam Suite first, then Northwind  CRM.' ELSE '' END)"),
        ("u1", "CASE WHEN turn % 3 = 0 THEN 'https://www.Northwind.example/pricing?utm=1' ELSE 'https://blog.contoso.example/post#x' END"),
        ("u2", "CASE WHEN turn % 3 = 0 THEN 'https://www.Northwind.example/pricing/' ELSE 'https://notnorthwind.example/' END"),
        ("u3", "CASE WHEN conv_id % 2 = 0 THEN 'https://user@fabrikam.example:8443/a' ELSE 'not a url' END"),
        ("engine", "CASE turn % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'perplexity' WHEN 2 THEN 'google_aio' ELSE 'claude' END"),
        ("http_status", "CASE WHEN conv_id % 11 = 3 THEN 429 ELSE 200 END"),
    ]),
    "docs": ("documents", [("doc_id", "doc_id"), ("text", "text"), ("lang", "lang"), ("source", "source")]),
}

_NUMBER_TYPES = (T.IntegerType, T.ShortType, T.ByteType)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, columns = VIEWS[name]
    if source == "page_hosts":
        base = _table(spark, sf, "pages").select(F.expr(HOST).alias("host")).distinct()
    else:
        base = _table(spark, sf, source)
    return base.selectExpr(*[f"{e[0] if isinstance(e, tuple) else e} AS {a}" for a, e in columns])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _table(spark, sf, name)


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    src = f"(SELECT DISTINCT {HOST} AS host FROM pages)" if source == "page_hosts" else source
    cols = ", ".join(f"{e[1] if isinstance(e, tuple) else e} AS {a}" for a, e in columns)
    return f"v_{name} AS (SELECT {cols} FROM {src})"


def oracle(body: str) -> str:
    """A DuckDB statement; every ``v_<view>`` it names is put in front as a CTE."""
    used = [n for n in VIEWS if re.search(rf"\bv_{n}\b", body)]
    ctes = ", ".join(view_sql(n) for n in used)
    text = body.strip()
    head = re.match(r"(?i)with\s+(recursive\s+)?", text)
    recursive = "RECURSIVE " if head and head.group(1) else ""
    if head:
        rest = text[head.end():]
        return f"WITH {recursive}{ctes}{', ' if ctes else ''}{rest}"
    return f"WITH {ctes} {text}" if ctes else text


def flat(df: DataFrame) -> DataFrame:
    """Whole numbers to bigint, times to text, string lists to text: types both engines share."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _NUMBER_TYPES):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- shapes only Spark needs ------------------------------------------------------------------


def checks(spark: SparkSession, sf: str) -> DataFrame:
    rivals = F.expr(
        "array(named_struct('name', 'Rival A', 'mentions', rival_a, 'position', cast(NULL AS int), 'linked', false), "
        "named_struct('name', 'Rival B', 'mentions', rival_b, 'position', cast(NULL AS int), 'linked', false))"
    )
    none = "cast(array() AS array<struct<name:string,mentions:bigint,position:int,linked:boolean>>)"
    return view(spark, sf, "checks").withColumn(
        "competitor_mentions", F.when(F.col("error").isNull(), rivals).otherwise(F.expr(none))
    )


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "prompts").withColumn("engines", F.split("engine_csv", ","))


def competitors(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "competitors").withColumn("aliases", F.split("alias_csv", ","))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sites").withColumn("brand_aliases", F.split("alias_csv", ","))


def site_files(spark: SparkSession, sf: str) -> DataFrame:
    """``(origin, kind, status_code, body)`` of every host."""
    kinds = [("robots", "robots"), ("llms", "llms"), ("llms_full", "full"), ("sitemap", "map")]
    rows = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"{c}_code").alias("status_code"), F.col(f"{c}_body").alias("body")) for k, c in kinds]
    )
    return view(spark, sf, "hosts").select("origin", F.explode(rows).alias("f")).select("origin", "f.*")
