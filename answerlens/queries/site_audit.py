"""Page features, robots, answer surface, checks, score and issues over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import BOTS, CHECKS, COPY, PILLARS, fix_catalogue
from ..functions.links import normalise_link
from ..operators import checks as K
from ..operators import issues as I
from ..operators import reach as G
from ..operators import reports as R
from ..operators import robots as B
from ..operators import score as S
from ..operators import sinks
from ..operators import surface as U
from ..operators.page_features import page_features
from ..session import materialise
from ..sources.pages import body_cap, body_is_truncated, page_gate, scan_pages
from ..sources.site_files import scan_site_files
from . import views as V
from .views import flat, oracle

# --- Spark side ------------------------------------------------------------------------------


def _pages(s, sf):
    return scan_pages(V.view(s, sf, "page_rows"))


def _features(s, sf, only=None):
    return page_features(_pages(s, sf).drop("host"), only)


CHECK_FEATURES = [
    "title", "title_length", "meta_description", "h1_count", "heading_skips", "word_count", "js_dependent",
    "js_dependent_reason", "jsonld_blocks", "jsonld_invalid", "jsonld_types", "same_as", "has_faq_schema", "has_faq",
    "has_direct_answer", "list_count", "table_count", "date_modified", "author",
]


def _robots(s, sf):
    files = V.site_files(s, sf)
    return B.parsed_robots(files.filter("kind = 'robots'").drop("kind"))


def _surface(s, sf, robots=None):
    return U.answer_surface(scan_site_files(V.site_files(s, sf)), robots if robots is not None else _robots(s, sf))


def _hosts(s, sf):
    return V.view(s, sf, "hosts").select("site_id", "origin", "brand_name")


def _checked(s, sf, features=None):
    robots = _robots(s, sf)
    features = features if features is not None else _features(s, sf, CHECK_FEATURES)
    return K.with_checks(K.site_facts(features, _hosts(s, sf), robots, _surface(s, sf, robots)))


def _scored(s, sf, features=None):
    return S.with_score(_checked(s, sf, features))


def _issues(s, sf, features=None):
    return I.with_issues(_scored(s, sf, features))


def _stored_features(s, sf):
    """Features that several branches read: written once, so pages are analysed once."""
    return materialise(_features(s, sf, CHECK_FEATURES), "page_features")


def _feature(*names):
    def run(s, sf):
        return flat(_features(s, sf, list(names)).select("page_id", *names))

    return run


def heading_outline(s, sf):
    text = F.expr("array_join(transform(heading_outline, h -> concat(h.level, ':', h.text)), '|')")
    return flat(_features(s, sf, ["heading_outline"]).select("page_id", text.alias("outline")))


def normalise_link_q(s, sf):
    hrefs = F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")
    rows = V.view(s, sf, "page_rows").select("page_id", "url", F.explode(hrefs).alias("raw")).withColumn(
        "href", F.expr("replace(raw, '&amp;', '&')"))
    return flat(rows.groupBy("page_id", "url", "href").agg(F.count("*").alias("n")).select(
        "page_id", "href", "n", normalise_link("href", "url").alias("link")))


def domain_of_q(s, sf):
    from ..functions.urls import domain_of, host_of

    return flat(V.view(s, sf, "page_rows").select("page_id", domain_of(F.col("url")).alias("domain")))


def host_of_q(s, sf):
    from ..functions.urls import host_of

    return flat(V.view(s, sf, "page_rows").select("page_id", host_of(F.col("url")).alias("host")))


def domain_matches_q(s, sf):
    from ..functions.urls import domain_matches, domain_of

    p = V.view(s, sf, "page_rows").select("page_id", domain_of(F.col("url")).alias("d"), F.expr("split_part(host, '.', -2) || '.' || split_part(host, '.', -1)").alias("t"))
    return flat(p.select("page_id", domain_matches(F.col("d"), F.col("t")).alias("hit"), domain_matches(F.concat(F.lit("not"), F.col("t")), F.col("t")).alias("lookalike")))


def scan_pages_q(s, sf):
    p = _pages(s, sf)
    return flat(p.select("page_id", "url", "status_code", "content_type", F.octet_length("body").alias("bytes"), "depth", "error"))


BODY_CUT = 1500  # bytes; most pages are longer


def body_cap_q(s, sf):
    body = F.col("html")
    return flat(V.view(s, sf, "page_rows").select(
        "page_id", body_is_truncated(body, BODY_CUT).alias("truncated"), F.length(body_cap(body, BODY_CUT)).alias("kept_chars")
    ))


def page_gate_q(s, sf):
    p = _pages(s, sf)
    return flat(p.select("page_id", page_gate(F.col("error"), F.col("body"), F.col("content_type")).alias("reason")))


def scan_site_files_q(s, sf):
    f = scan_site_files(V.site_files(s, sf))
    return flat(f.select("origin", F.col("robots.status_code").alias("robots_code"), F.length("llms.body").alias("llms_chars"),
                         F.col("llms_full.status_code").alias("full_code"), F.length("sitemap.body").alias("map_chars")))


def _robot_files(s, sf):
    return B.robots_status(V.site_files(s, sf).filter("kind = 'robots'").drop("kind"))


def robots_lines(s, sf):
    return flat(B.robots_lines(_robot_files(s, sf)))


def robots_groups(s, sf):
    return flat(B.robots_groups(B.robots_lines(_robot_files(s, sf))))


def robots_rules(s, sf):
    return flat(B.robots_rules(B.robots_groups(B.robots_lines(_robot_files(s, sf)))).drop("regex"))


def robots_crawl_delay(s, sf):
    return flat(B.robots_crawl_delay(B.robots_groups(B.robots_lines(_robot_files(s, sf)))))


def robots_sitemaps(s, sf):
    return flat(B.robots_sitemaps(B.robots_lines(_robot_files(s, sf))))


def robots_status(s, sf):
    return flat(_robot_files(s, sf).select("origin", "status_code", "permissive_by_absence", F.length("body").alias("chars")))


def robots_group_for(s, sf):
    r = _robots(s, sf)
    cols = [F.struct(F.lit(b["ua"]).alias("ua"), F.expr(B.group_for("groups", f"'{b['ua']}'") + ".group_id").alias("group_id")) for b in BOTS]
    return flat(r.select("origin", F.explode(F.array(*cols)).alias("g")).select("origin", "g.ua", "g.group_id"))


def robots_allowed(s, sf):
    paths = V.view(s, sf, "page_rows").select(
        "page_id", F.concat(F.lit("https://"), "host").alias("origin"),
        F.expr("CASE page_id % 3 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'CCBot' ELSE 'SomeBot' END").alias("ua"),
        F.expr("regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1)").alias("path"))
    return flat(B.robots_allowed(paths, _robots(s, sf)).select("page_id", "ua", "path", "allowed"))


def ai_access_matrix(s, sf):
    return flat(B.ai_access_matrix(_robots(s, sf)).select("origin", "ua", "allowed", "explicitly_blocked", "mentioned"))


def robots_blocks_everyone(s, sf):
    return flat(_robots(s, sf).select("origin", B.blocks_everyone().alias("blocked")))


def _surf(*cols):
    def run(s, sf):
        return flat(_surface(s, sf).select("origin", *[F.expr(c) for c in cols]))

    return run


def _check_query(codes):
    def run(s, sf):
        rows = K.check_rows(_checked(s, sf))
        return flat(rows.filter(F.col("code").isin(*codes)).select("site_id", "code", "score", "weight", "passed"))

    return run


def pillar_scores(s, sf):
    return flat(S.pillar_rows(_scored(s, sf)).select("site_id", "id", "score", "points", "n_checks"))


def overall_score(s, sf):
    return flat(_scored(s, sf).select("site_id", "raw_overall"))


def score_ceiling(s, sf):
    return flat(_scored(s, sf).select("site_id", "cap", "blocked"))


def overall_capped(s, sf):
    return flat(_scored(s, sf).select("site_id", "overall", "raw_overall", (F.col("ceiling_reason").isNotNull()).alias("bitten"), "grade"))


def score_summary(s, sf):
    return flat(_scored(s, sf).select("site_id", "summary"))


def serialise_pillars(s, sf):
    doc = S.serialise_pillars(_scored(s, sf))
    j = F.from_json("pillar_scores", "overall bigint, grade string, pillars array<struct<id:string,score:bigint,checks:array<struct<code:string>>>>")
    return flat(doc.select("site_id", j.alias("j")).select(
        "site_id", "j.overall", "j.grade",
        F.expr("array_join(transform(j.pillars, p -> concat(p.id, ':', p.score, ':', size(p.checks))), '|')").alias("pillars")))


def derive_issues(s, sf):
    return flat(I.issue_rows(_issues(s, sf)).select("site_id", "code", "severity", "effort", "impact_points"))


def priority_score(s, sf):
    return flat(I.issue_rows(_issues(s, sf)).select("site_id", "code", "priority_score"))


def order_issues_report(s, sf):
    return flat(I.issue_rows(_issues(s, sf)).select("site_id", "code", "rank"))


def free_teaser(s, sf):
    return flat(I.top_issues(I.issue_rows(_issues(s, sf)), 3).select("site_id", "code", "rank"))


def recommend_top8(s, sf):
    return flat(I.top_issues(I.issue_rows(_issues(s, sf)), 8).select("site_id", "code", "rank"))


def check_affected(s, sf):
    wanted = ["js_dependent", "word_count", "jsonld_blocks", "jsonld_invalid", "h1_count", "heading_skips", "title_length"]
    feats = materialise(_features(s, sf, wanted), "page_features")
    return flat(K.affected_pages(feats, "page_id"))


def issue_affected(s, sf):
    feats = _stored_features(s, sf)
    aff = K.affected_pages(feats, "page_id")
    rows = I.issue_rows(_issues(s, sf, feats)).select("site_id", "code")
    return flat(I.issue_affected(rows, aff).select("site_id", "code", "affected_count", F.size("affected_sample").alias("shown"), "affected_total"))


def js_reasons(s, sf):
    return flat(K.js_reasons(_features(s, sf, ["js_dependent", "js_dependent_reason"]), "page_id"))


def static_summary(s, sf):
    return flat(I.static_summary(_issues(s, sf)))


def action_plan(s, sf):
    return flat(I.action_plan(_issues(s, sf)).select("site_id", "step", "code", "timeframe", "title", "detail"))


def fix_catalogue_q(s, sf):
    used = I.issue_rows(_issues(s, sf)).groupBy("code").agg(F.count("*").alias("sites"))
    cat = fix_catalogue(s).select("code", "pillar", "severity", "effort")
    return flat(cat.join(used, "code", "left").na.fill(0, ["sites"]))


def prompt_suggestions(s, sf):
    return flat(I.prompt_suggestions(V.view(s, sf, "hosts")))


def audit_pages_list(s, sf):
    return flat(R.audit_pages_list(_features(s, sf, CHECK_FEATURES)).select("site_id", "depth", "url", "word_count", "h1_count", "heading_skips"))


def audit_flags(s, sf):
    bots = R.blocked_bots(B.ai_access_matrix(_robots(s, sf))).select(F.col("origin").alias("item"), F.col("ua").alias("flag"))
    pages = R.js_pages(_features(s, sf, ["js_dependent"])).select(F.col("url").alias("item"), F.lit("js").alias("flag"))
    return flat(bots.unionByName(pages))


def audit_kpis(s, sf):
    feats = _stored_features(s, sf)
    rows = I.issue_rows(_issues(s, sf, feats)).withColumn(
        "status", F.expr("CASE WHEN effort = 'high' THEN 'in_progress' WHEN severity = 'low' THEN 'ignored' ELSE 'open' END"))
    return flat(R.audit_kpis(rows, feats))


def audit_gate(s, sf):
    f = _features(s, sf, ["h1_count"])
    return flat(G.audit_gate(f, "page_id").select("site_id", "status", F.col("reason").isNotNull().alias("has_reason")))


def sink_pages(s, sf):
    p = _features(s, sf).withColumn("audit_id", F.expr("length(site_id) % 4")).withColumn("url", F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+", 0))
    rows = sinks.sink_pages(p, "audit_id", "page_id")
    return flat(rows.select("audit_id", "url", "page_id", "issues"))


def sink_issues(s, sf):
    # Two branches read the issues: written once, so pages are analysed once.
    rows = I.issue_rows(materialise(_issues(s, sf).select("site_id", "issues"), "issues"))
    # Every other site gets texts of its own.
    tailored = rows.filter("severity = 'critical' AND length(site_id) % 2 = 0").select("site_id", "code", F.concat(F.lit("For "), "site_id").alias("text"))
    out = sinks.sink_issues(rows, tailored)
    return flat(out.select("site_id", "code", "ai_generated", F.endswith("what_it_means", F.concat(F.lit("\n\nFor "), "site_id")).alias("tailored")))


def sink_audit(s, sf):
    feats = _stored_features(s, sf)
    scored = materialise(_issues(s, sf, feats), "scored")
    plan = I.action_plan(scored).groupBy("site_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("step", "title", "detail", "timeframe")))).alias("action_plan"))
    gate = G.audit_gate(feats, "page_id")
    robots = _robots(s, sf)
    # A fixed number of crawlers per origin.
    access = B.ai_access_matrix(robots).groupBy("origin").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ua", "allowed")))).alias("robots"))
    surface = _surface(s, sf, robots).select("origin", F.to_json(F.struct("llms_txt", "llms_full_txt", "sitemap")).alias("answer_surface"))
    outcome = (scored.select("site_id", "origin", "overall", "grade", F.col("pages_crawled").alias("pages"))
               .join(I.static_summary(scored).withColumnRenamed("executive_summary", "summary"), "site_id").join(access, "origin").join(surface, "origin")
               .join(S.serialise_pillars(scored), "site_id").join(plan, "site_id", "left").join(gate, "site_id")
               .select(F.col("site_id").alias("audit_id"), "status", "reason", "overall", "grade", "pillar_scores", "action_plan", "pages",
                       F.lit(False).alias("capped"), "summary", "robots", "answer_surface", F.to_timestamp(F.lit("2024-01-31 00:01:30")).alias("completed_at")))
    audits = V.view(s, sf, "hosts").select(F.col("site_id").alias("audit_id"), "site_id", F.to_timestamp(F.lit("2024-01-31 00:00:00")).alias("started_at"),
                                           F.lit("running").alias("status"), F.lit(None).cast("int").alias("overall_score"), F.lit(None).cast("timestamp").alias("completed_at"))
    out = sinks.sink_audit(audits, outcome)
    return flat(out.select("audit_id", "status", "overall_score", "pages_crawled", "duration_ms",
                           (F.get_json_object("pillar_scores", "$.action_plan[0].step") == "1").alias("has_plan"), F.col("error").isNotNull().alias("has_error"),
                           F.col("summary").isNotNull().alias("has_summary"), F.size(F.from_json("robots", "array<struct<ua:string,allowed:boolean>>")).alias("n_bots"),
                           F.get_json_object("answer_surface", "$.llms_txt.present").alias("llms"),
                           F.get_json_object("pillar_scores", "$.pillars[0].checks[0].label").alias("first_label")))


# --- crawl graph -----------------------------------------------------------------------------

GRAPH_CAP = 60


def _edges(s, sf):
    """The links of the pages' html, as a crawl finds them."""
    pages = scan_pages(V.view(s, sf, "graph_pages").select("site_id", "url", "html"))
    return G.crawl_edges(page_features(pages, ["internal_links"]))


def _seeds(s, sf):
    return V.view(s, sf, "graph_pages").groupBy("site_id").agg(F.concat(F.lit("https://s"), F.col("site_id"), F.lit(".example.com/p/0")).alias("url"))


def crawl_edges(s, sf):
    return flat(_edges(s, sf))


def crawl_reach(s, sf):
    return flat(G.crawl_reach(_edges(s, sf), _seeds(s, sf)).select("site_id", "url", "depth", "rank"))


def crawl_cap(s, sf):
    return flat(G.crawl_cap(G.crawl_reach(_edges(s, sf), _seeds(s, sf), GRAPH_CAP), GRAPH_CAP))


def _graph_robots(s, sf):
    body = F.concat(F.lit("User-agent: *\nDisallow: /p/*5\nAllow: /p/1"), F.expr("chr(10)"), F.lit("Disallow: /p/8$"))
    files = _seeds(s, sf).select(F.regexp_extract("url", "^(https://[^/]+)", 1).alias("origin"), F.lit(200).alias("status_code"), body.alias("body"))
    return B.parsed_robots(files)


def _guarded(s, sf):
    sites = _seeds(s, sf).select("site_id", F.regexp_extract("url", "^(https://[^/]+)", 1).alias("origin"))
    return materialise(G.crawl_robots_skip(_edges(s, sf), _graph_robots(s, sf), sites, "VisibilityBot"), "guarded")


def crawl_robots_skip(s, sf):
    edges = _guarded(s, sf)
    reached = G.crawl_reach(edges, _seeds(s, sf))
    n = reached.groupBy("site_id").agg(F.count("*").alias("reached"))
    return flat(G.skipped_by_robots(edges, reached, _seeds(s, sf)).join(n, "site_id"))


def crawl_seeds(s, sf):
    seeds = _seeds(s, sf)
    sites = seeds.select("site_id", F.regexp_extract("url", "^(https://[^/]+)", 1).alias("origin"))
    rule = F.when(F.col("site_id") % 2 == 0, F.lit("Disallow: /p/")).otherwise(F.lit("Disallow: /q/"))
    files = seeds.select(F.regexp_extract("url", "^(https://[^/]+)", 1).alias("origin"), F.lit(200).alias("status_code"),
                         F.concat(F.lit("User-agent: visibility"), F.expr("chr(10)"), rule).alias("body"))
    return flat(G.crawl_seeds(seeds, B.parsed_robots(files), sites, "VisibilityBot"))


# --- DuckDB side -----------------------------------------------------------------------------

_STRIP = "v_body"
for _tag in ("script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "header", "aside"):
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}(\\s[^>]*)?>.*?</{_tag}>', '', 'g')"
_DEC = "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def _txt(x):
    return f"trim(regexp_replace({_DEC.format(f'''regexp_replace({x}, '<[/!A-Za-z][^>]*>', '', 'g')''')}, '\\s+', ' ', 'g'))"


_PF = (
    "p0 AS (SELECT page_id, site_id, url, status_code, CASE WHEN error IS NOT NULL THEN error WHEN content_type NOT LIKE '%html%' THEN 'Not HTML (' || content_type || ')' END AS err, html, error, content_type FROM v_page_rows), "
    "p1 AS (SELECT *, CASE WHEN err IS NULL THEN regexp_replace(html, '(?s)<!--.*?-->', '', 'g') ELSE '' END AS nc FROM p0), "
    "p2 AS (SELECT *, regexp_replace(nc, '(?is)(<script[^>]*>).*?</script>', '\\1', 'g') AS doc, regexp_extract(nc, '(?is)<body>(.*)', 1) AS v_body, "
    "regexp_extract_all(nc, '(?is)<script type=\"application/ld.json\">(.*?)</script>', 1) AS ld FROM p1), "
    f"p3 AS (SELECT *, {_STRIP} AS main FROM p2), "
    f"p4 AS (SELECT *, {_txt('main')} AS vt, list_filter(list_transform(regexp_extract_all(doc, '(?is)<h[1-6][ >].*?</h[1-6]>'), lambda h: {{'l': cast(substr(h, 3, 1) AS bigint), 't': {_txt('h')}}}), lambda h: h.t <> '') AS hs, "
    "list_filter(ld, lambda b: json_valid(b) AND b NOT LIKE '%\"Article\",') AS good FROM p3), "
    "p5 AS (SELECT *, CASE WHEN vt = '' THEN 0 ELSE len(string_split(vt, ' ')) END AS wc, CASE WHEN err IS NULL THEN length(vt) / length(html) ELSE 0.0 END AS ratio, "
    "cast(len(list_filter(hs, lambda h: regexp_matches(h.t, '(?i)^(who|what|when|where|why|how|which|can|do|does|is|are|should|will)\\b') OR h.t LIKE '%?')) AS bigint) AS qh, "
    "cast(len(regexp_extract_all(doc, '<details>')) AS bigint) AS nd, cast(len(regexp_extract_all(doc, '<script[^>]* src=')) AS bigint) AS nsrc, "
    "doc LIKE '%<div id=\"root\"></div>%' AS spa, nc LIKE '%Please enable JavaScript%' AS plea, "
    "CASE WHEN len(good) = 0 OR good[1] LIKE '{\"name%' THEN [] WHEN good[1] LIKE '%@graph%' THEN ['Article', 'FAQPage', 'Person', 'BreadcrumbList'] ELSE ['Organization'] END AS ty, "
    "regexp_extract(main, '(?is)<p(?:\\s[^>]*)?>(.*?)(?:</p>|<(?:p|div|ul|ol|table|h[1-6]|section|article|details|footer|nav)[\\s>]|</(?:article|body|div)>|$)', 1) AS fp FROM p4), "
    f"pf AS (SELECT *, len(list_filter(range(2, len(hs) + 1), lambda i: hs[i].l - hs[i - 1].l > 1)) AS skips, {_txt('fp')} AS fpt, "
    "CASE WHEN err IS NOT NULL THEN NULL WHEN spa AND wc < 200 THEN 'The mount point of a script framework is empty in the HTML' WHEN wc < 120 AND nsrc >= 3 THEN 'The HTML holds ' || wc || ' words and ' || nsrc || ' scripts' "
    "WHEN plea THEN 'A noscript block asks for JavaScript' WHEN ratio < 0.03 AND wc < 300 THEN 'Visible text is ' || (floor(ratio * 1000 + 0.5) / 10) || '% of the HTML' END AS why, "
    "list_contains(ty, 'FAQPage') AS faqs, list_contains(ty, 'FAQPage') OR nd >= 2 OR qh >= 2 OR regexp_matches(vt, '(?i)\\b(frequently asked questions|faqs?)\\b') AS faq, "
    "trim(" + _DEC.format("regexp_extract(doc, '(?is)<title>(.*?)</title>', 1)") + ") AS ttl, "
    "nullif(trim(" + _DEC.format("regexp_extract(doc, 'name=\"description\" content=\"([^\"]*)\"', 1)") + "), '') AS md, "
    "CASE WHEN len(good) > 0 AND good[1] LIKE '%@graph%' THEN 'Writer ' || page_id WHEN doc LIKE '%content=\"Meta Writer\"%' THEN 'Meta Writer' END AS author, "
    "CASE WHEN len(good) > 0 AND good[1] LIKE '%@graph%' THEN json_extract_string(good[1], '$.\"@graph\"[0].dateModified') WHEN doc LIKE '%article:modified_time%' THEN '2023-12-01' END AS dm, "
    "CASE WHEN len(good) = 0 THEN [] WHEN good[1] LIKE '%@graph%' THEN [json_extract_string(good[1], '$.\"@graph\"[1].sameAs')] WHEN good[1] LIKE '%Organization%' THEN "
    "[json_extract_string(good[1], '$.sameAs[0]'), json_extract_string(good[1], '$.sameAs[1]')] ELSE [] END AS sa, "
    "cast(len(ld) AS bigint) AS nld, cast(len(ld) - len(list_filter(good, lambda b: b LIKE '%@type%')) AS bigint) AS ninv, "
    "cast(len(regexp_extract_all(doc, '<h1[ >]')) AS bigint) AS nh1, cast(len(regexp_extract_all(doc, '<[uo]l[ >]')) AS bigint) AS nlist, cast(len(regexp_extract_all(doc, '<table[ >]')) AS bigint) AS ntab FROM p5)"
)


def _pf(select):
    return oracle(f"WITH {_PF} {select}")


_RB = (
    "rf AS (SELECT origin, CASE WHEN robots_code >= 400 THEN robots_code WHEN robots_code IS NULL THEN NULL WHEN robots_body LIKE '<%' THEN 404 ELSE robots_code END AS code, robots_body FROM v_hosts), "
    "rs AS (SELECT origin, code AS status_code, code IS NULL OR code IN (404, 410, 403) AS permissive, CASE WHEN code < 400 THEN robots_body ELSE '' END AS body FROM rf), "
    "rl0 AS (SELECT origin, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM rs), "
    "rl1 AS (SELECT origin, pos, trim(split_part(line, '#', 1)) AS l FROM rl0), "
    "rl AS (SELECT origin, pos, lower(trim(split_part(l, ':', 1))) AS field, trim(substr(l, strpos(l, ':') + 1)) AS value FROM rl1 WHERE l LIKE '%:%' AND (trim(substr(l, strpos(l, ':') + 1)) <> '' OR lower(trim(split_part(l, ':', 1))) = 'disallow')), "
    "rg AS (SELECT origin, pos, field, value, cast(sum(o) OVER (PARTITION BY origin ORDER BY pos) AS bigint) AS group_id FROM (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY origin ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS o FROM rl)), "
    "rr AS (SELECT origin, group_id, pos, field AS rule_type, value AS path, replace(replace(replace(CASE WHEN value LIKE '%$' THEN substr(value, 1, length(value) - 1) ELSE value || '*' END, '%', '!%'), '_', '!_'), '*', '%') AS pat FROM rg WHERE field IN ('allow', 'disallow') AND group_id > 0 AND value <> '')"
)
_BOTS_SQL = "bots AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b['ua']}', {str(b['primary']).lower()})" for i, b in enumerate(BOTS)) + ") t(bpos, ua, prim))"
_GF = (
    f"{_RB}, {_BOTS_SQL}, uas AS (SELECT ua FROM bots UNION SELECT 'SomeBot'), "
    "named AS (SELECT g.origin, u.ua, g.group_id, row_number() OVER (PARTITION BY g.origin, u.ua ORDER BY length(g.value) DESC, g.group_id) AS rn FROM rg g JOIN uas u ON g.field = 'user-agent' AND g.value <> '*' AND starts_with(lower(u.ua), lower(g.value))), "
    "wild AS (SELECT origin, min(group_id) AS group_id FROM rg WHERE field = 'user-agent' AND value = '*' GROUP BY 1), "
    "gf AS (SELECT rs.origin, u.ua, coalesce(n.group_id, w.group_id) AS group_id, n.group_id IS NOT NULL AS mentioned FROM rs CROSS JOIN uas u LEFT JOIN named n ON n.origin = rs.origin AND n.ua = u.ua AND n.rn = 1 LEFT JOIN wild w ON w.origin = rs.origin)"
)
_ACC = (
    f"{_GF}, hit AS (SELECT gf.origin, gf.ua, arg_max(rule_type, (length(path), rule_type = 'allow')) AS verdict FROM gf JOIN rr ON rr.origin = gf.origin AND rr.group_id = gf.group_id AND '/' LIKE rr.pat ESCAPE '!' GROUP BY 1, 2), "
    "acc AS (SELECT gf.origin, bots.ua, bpos, prim, coalesce(verdict, 'allow') = 'allow' AS allowed, mentioned FROM gf JOIN bots USING (ua) LEFT JOIN hit ON hit.origin = gf.origin AND hit.ua = gf.ua), "
    "eb AS (SELECT rs.origin, coalesce(bool_or(rr.path IN ('/', '/*') AND rr.rule_type = 'disallow'), false) AS blocked FROM rs LEFT JOIN wild USING (origin) LEFT JOIN rr ON rr.origin = rs.origin AND rr.group_id = wild.group_id GROUP BY 1)"
)
_SM = "sm AS (SELECT origin, list(value ORDER BY pos) AS maps FROM rl WHERE field = 'sitemap' GROUP BY 1)"
_SURF = (
    f"{_SM}, sf AS (SELECT h.origin, h.site_id, llms_code < 400 AND llms_body NOT LIKE '<%' AS lp, llms_code < 400 AND regexp_matches(llms_body, '(^|\\n)# ') AND llms_body LIKE '%[%](%)%' AS lw, "
    "CASE WHEN llms_code < 400 THEN cast(len(regexp_extract_all(llms_body, '(^|\\n)## ')) AS bigint) ELSE 0 END AS ls, CASE WHEN llms_code < 400 THEN strlen(llms_body) ELSE 0 END AS lb, "
    "full_code < 400 AND full_body NOT LIKE '<%' AS fp, strlen(full_body) AS fb, map_code < 400 AS mp, CASE WHEN map_code < 400 THEN cast(len(regexp_extract_all(map_body, '<loc>')) AS bigint) ELSE 0 END AS mn, "
    "CASE WHEN map_code < 400 THEN CASE WHEN maps IS NULL THEN 'default' ELSE 'robots' END END AS msrc, coalesce(maps[1], h.origin || '/sitemap.xml') AS murl FROM v_hosts h LEFT JOIN sm USING (origin))"
)
_USE = "(err IS NULL AND status_code < 400)"
_AGG = (
    f"u AS (SELECT pf.*, h.brand_name FROM pf JOIN v_hosts h USING (site_id) WHERE {_USE}), "
    "c0 AS (SELECT site_id, count(*) AS n, count(*) FILTER (why IS NOT NULL) AS js, count(*) FILTER (wc < 300) AS thin, count(*) FILTER (nld > 0) AS wld, count(*) FILTER (ninv > 0) AS inv, "
    "bool_or(list_has_any(ty, ['Organization', 'LocalBusiness', 'WebSite', 'Person'])) AS grd, bool_or(list_contains(ty, 'Article')) AS ct, bool_or(list_contains(ty, 'BreadcrumbList')) AS bc, "
    "count(*) FILTER (nh1 <> 1) AS bh1, count(*) FILTER (skips > 0) AS sk, count(*) FILTER (faq) AS fq, count(*) FILTER (CASE WHEN fpt = '' THEN 0 ELSE len(string_split(fpt, ' ')) END BETWEEN 15 AND 80) AS da, "
    "count(*) FILTER (nlist > 0 OR ntab > 0) AS xb, count(*) FILTER (contains(lower(ttl), lower(brand_name))) AS br, count(*) FILTER (author IS NOT NULL) AS au, count(*) FILTER (dm IS NOT NULL) AS fr, "
    "count(*) FILTER (length(ttl) >= 10) AS tt, count(*) FILTER (md IS NOT NULL) AS me FROM u GROUP BY 1), "
    "c1 AS (SELECT site_id, count(DISTINCT x) AS sa FROM (SELECT site_id, unnest(sa) AS x FROM u) GROUP BY 1), "
    "b AS (SELECT h.site_id, h.origin, h.brand_name, coalesce(n, 0) AS n, js, thin, wld, inv, grd, ct, bc, bh1, sk, fq, da, xb, br, au, fr, tt, me, coalesce(c1.sa, 0) AS sa, rs.status_code AS rcode, eb.blocked AS eblk, sf.* EXCLUDE (origin, site_id) "
    "FROM v_hosts h LEFT JOIN c0 USING (site_id) LEFT JOIN c1 USING (site_id) JOIN rs ON rs.origin = h.origin JOIN eb ON eb.origin = h.origin JOIN sf ON sf.origin = h.origin)"
)
_N = "n > 0"
_CHECK_SQL = {
    "robots.wildcard_blocks_all": ("true", "CASE WHEN eblk THEN 0.0 ELSE 1.0 END", "NOT eblk"),
    "robots.reachable": ("true", "CASE WHEN rcode < 400 THEN 1.0 ELSE 0.5 END", "coalesce(rcode < 400, false)"),
    "nojs.no_pages": ("n = 0", "0.0", "false"),
    "nojs.server_rendered": (_N, "1.0 - js / n", "js = 0"),
    "nojs.sufficient_depth": (_N, "1.0 - thin / n", "thin <= n * cast(0.3 AS double)"),
    "schema.present": (_N, "wld / n", "wld = n"),
    "schema.valid": (_N, "CASE WHEN wld > 0 THEN 1.0 - inv / wld ELSE 0.0 END", "inv = 0"),
    "schema.entity_grounding": (_N, "CASE WHEN grd THEN 1.0 ELSE 0.0 END", "grd"),
    "schema.content_type": (_N, "CASE WHEN ct THEN 1.0 ELSE 0.0 END", "ct"),
    "schema.breadcrumbs": (_N, "CASE WHEN bc THEN 1.0 ELSE 0.0 END", "bc"),
    "answer.single_h1": (_N, "1.0 - bh1 / n", "bh1 = 0"),
    "answer.heading_hierarchy": (_N, "1.0 - sk / n", "sk = 0"),
    "answer.faq_coverage": (_N, "least(1.0, fq / n * 1.5)", "fq > 0"),
    "answer.direct_answer": (_N, "da / n", "2 * da >= n"),
    "answer.extractable_blocks": (_N, "xb / n", "2 * xb >= n"),
    "surface.llms_txt": ("true", "CASE WHEN lp AND lw THEN 1.0 WHEN lp THEN 0.6 ELSE 0.0 END", "lp AND lw"),
    "surface.llms_full_txt": ("true", "CASE WHEN fp THEN 1.0 ELSE 0.0 END", "fp"),
    "surface.sitemap": ("true", "CASE WHEN mp THEN 1.0 ELSE 0.0 END", "mp"),
    "entity.brand_in_title": (f"{_N} AND trim(brand_name) <> ''", "br / n", "br >= n * cast(0.7 AS double)"),
    "entity.same_as": (_N, "CASE WHEN sa >= 3 THEN 1.0 WHEN sa > 0 THEN 0.5 ELSE 0.0 END", "sa >= 3"),
    "entity.author_markup": (_N, "au / n", "2 * au >= n"),
    "entity.freshness": (_N, "fr / n", "2 * fr >= n"),
    "entity.titles": (_N, "tt / n", "tt = n"),
    "entity.meta_description": (_N, "me / n", "me >= n * cast(0.8 AS double)"),
}
_META = {c: (i, p, w, sev, eff, t) for i, (c, p, w, sev, eff, t) in enumerate(CHECKS)}


def _ck_union():
    parts = []
    for code, (when, score, ok) in _CHECK_SQL.items():
        pos, pillar, weight, sev, eff, _ = _META[code]
        parts.append(f"SELECT site_id, '{code}' AS code, {pos} AS pos, '{pillar}' AS pillar, cast({score} AS double) AS score, cast({weight} AS double) AS weight, {ok} AS passed, '{sev}' AS severity, '{eff}' AS effort FROM b WHERE {when}")
    for code, (pos, pillar, weight, sev, eff, _) in _META.items():
        if code.endswith("_access"):
            ua = next(b["ua"] for b in BOTS if f"robots.{b['ua'].lower()}_access" == code)
            parts.append(f"SELECT h.site_id, '{code}', {pos}, '{pillar}', CASE WHEN allowed THEN cast(1 AS double) ELSE cast(0 AS double) END, cast({weight} AS double), allowed, '{sev}', '{eff}' FROM acc JOIN v_hosts h USING (origin) WHERE ua = '{ua}'")
    return "ck AS (" + " UNION ALL ".join(parts) + ")"


_PIL = "pd AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p['id']}', {p['weight']}, '{p['label'].lower()}')" for i, p in enumerate(PILLARS)) + ") t(ppos, id, pw, plabel))"
_SCORE = (
    f"{_PF}, {_ACC}, {_SURF}, {_AGG}, {_ck_union()}, {_PIL}, "
    "pl0 AS (SELECT h.site_id, id, ppos, pw, plabel, count(code) AS n_checks, coalesce(sum(weight), 0) AS w, CASE WHEN count(code) > 0 THEN sum(score * weight) / sum(weight) ELSE 0.0 END AS r FROM v_hosts h CROSS JOIN pd LEFT JOIN ck ON ck.site_id = h.site_id AND ck.pillar = pd.id GROUP BY ALL), "
    "pl AS (SELECT *, cast(floor(round(r * 100, 9) + 0.5) AS bigint) AS score, floor(round(r * pw * 100, 9) + 0.5) / 100 AS points FROM pl0), "
    "ov0 AS (SELECT site_id, cast(floor(round(sum(points) FILTER (n_checks > 0) / sum(pw) FILTER (n_checks > 0) * 100, 9) + 0.5) AS bigint) AS raw_overall, cast(sum(pw) FILTER (n_checks > 0) AS bigint) AS wsum FROM pl GROUP BY 1), "
    "bl AS (SELECT h.site_id, coalesce(string_agg(ua, '|' ORDER BY bpos) FILTER (prim AND NOT allowed), '') AS blocked, bool_or(allowed) AS any_ok FROM acc JOIN v_hosts h USING (origin) GROUP BY 1), "
    "ov AS (SELECT ov0.site_id, raw_overall, wsum, bl.blocked, CASE WHEN b.eblk AND NOT any_ok THEN 25 WHEN bl.blocked <> '' THEN 60 END AS cap, n FROM ov0 JOIN bl USING (site_id) JOIN b USING (site_id)), "
    "ot AS (SELECT *, least(raw_overall, coalesce(cap, 100)) AS overall, coalesce(cap < raw_overall, false) AS bitten FROM ov), "
    "og AS (SELECT *, substr('FFFFFFFFEEEDDDCCBBAAA', cast(overall // 5 AS int) + 1, 1) AS grade FROM ot)"
)
_ISS = (
    f"{_SCORE}, i0 AS (SELECT ck.*, floor(round((1.0 - ck.score) * (ck.weight / pl.w) * (pl.pw / wsum) * 100 * 100, 9) + 0.5) / 100 AS impact FROM ck JOIN pl ON pl.site_id = ck.site_id AND pl.id = ck.pillar JOIN ot ON ot.site_id = ck.site_id WHERE ck.score < 0.999), "
    "i1 AS (SELECT *, floor(round(impact / CASE effort WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.5 END * 100, 9) + 0.5) / 100 AS prio, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS sr FROM i0), "
    "iss AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY severity <> 'critical', prio DESC, sr, pos) AS rank FROM i1)"
)
_COPYT = "cp AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{t}')" for c, _, _, _, _, t in CHECKS) + ") t(code, title))"


def _checks_oracle(codes):
    inlist = ", ".join(f"'{c}'" for c in codes)
    return oracle(f"WITH {_SCORE} SELECT site_id, code, score, weight, passed FROM ck WHERE code IN ({inlist})")


def _sc(select):
    return oracle(f"WITH {_SCORE} {select}")


def _is(select):
    return oracle(f"WITH {_ISS} {select}")


_WK = "wk AS (SELECT site_id, string_agg(plabel, ' and ' ORDER BY score, ppos) AS weak FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score, ppos) AS rn FROM pl WHERE n_checks > 0) WHERE rn <= 2 GROUP BY 1)"
_HREF = (
    "hr AS (SELECT page_id, url, replace(unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)), '&amp;', '&') AS href FROM v_page_rows), "
    "hn AS (SELECT page_id, url, href, count(*) AS n FROM hr GROUP BY 1, 2, 3), "
    "ha AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]+') AS og, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) AS dir FROM hn), "
    "hb AS (SELECT *, CASE WHEN href LIKE 'mailto:%' THEN NULL WHEN href LIKE 'http%' THEN CASE WHEN starts_with(href, og || '/') THEN href END WHEN href LIKE '/%' THEN og || href "
    "WHEN href LIKE '../up/./%' THEN og || regexp_replace(dir, '[^/]+/$', '') || 'up/' || substr(href, 9) ELSE og || dir || href END AS ab FROM ha), "
    "hc AS (SELECT *, split_part(ab, '#', 1) AS a2 FROM hb), hd AS (SELECT *, split_part(a2, '?', 1) AS pp, CASE WHEN a2 LIKE '%?%' THEN split_part(a2, '?', 2) END AS qq FROM hc), "
    "he AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(pp, '([^/])/+$', '\\1'), ''), lambda ch: CASE WHEN regexp_matches(ch, '[^!-~]') THEN url_encode(ch) WHEN ch IN ('\"', '<', '>', '`', '{', '}', '^') THEN url_encode(ch) ELSE ch END), '') AS p2, "
    "array_to_string(list_filter(string_split(qq, '&'), lambda x: NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|msclkid|ref|mc_cid|mc_eid)')), '&') AS q2 FROM hd), "
    "hf AS (SELECT *, CASE WHEN ab IS NULL OR regexp_matches(pp, '(?i)\\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|gz|mp4|mp3|woff2?|ttf|eot)$') THEN NULL ELSE p2 || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END END AS link FROM he)"
)
_TREE = (
    "nodes AS (SELECT site_id, local, base FROM v_graph_pages), "
    "walk(site_id, n, depth) AS (SELECT DISTINCT site_id, cast(0 AS bigint), cast(0 AS bigint) FROM nodes UNION ALL "
    "SELECT w.site_id, 2 * w.n + k.k, w.depth + 1 FROM walk w JOIN nodes x ON x.site_id = w.site_id AND x.local = w.n CROSS JOIN (VALUES (1), (2)) k(k))"
)
_WALKG = (
    "nodes AS (SELECT site_id, local FROM v_graph_pages), "
    "walk(site_id, n) AS (SELECT DISTINCT site_id, cast(0 AS bigint) FROM nodes UNION ALL "
    "SELECT w.site_id, 2 * w.n + k.k FROM walk w JOIN nodes x ON x.site_id = w.site_id AND x.local = w.n CROSS JOIN (VALUES (1), (2)) k(k) "
    "WHERE NOT ('/p/' || (2 * w.n + k.k) LIKE '/p/%5%' OR 2 * w.n + k.k = 8)), "
    "ref AS (SELECT DISTINCT w.site_id, 2 * w.n + k.k AS m FROM walk w JOIN nodes x ON x.site_id = w.site_id AND x.local = w.n CROSS JOIN (VALUES (1), (2)) k(k) "
    "WHERE '/p/' || (2 * w.n + k.k) LIKE '/p/%5%' OR 2 * w.n + k.k = 8)"
)
_U8 = "'https://s' || site_id || '.example.com/p/' || n"

QUERIES = {
    "scan_pages": (scan_pages_q, oracle("SELECT page_id, url, cast(status_code AS bigint) AS status_code, content_type, strlen(html) AS bytes, cast(0 AS bigint) AS depth, error FROM v_page_rows")),
    "body_cap": (body_cap_q, oracle(
        "WITH b AS (SELECT page_id, html, strlen(html) AS nb, "
        f"list_max(list_filter(range(0, least(length(html), {BODY_CUT}) + 1), lambda i: strlen(substr(html, 1, i)) <= {BODY_CUT})) AS part FROM v_page_rows) "
        f"SELECT page_id, nb > {BODY_CUT} AS truncated, CASE WHEN nb <= {BODY_CUT} THEN length(html) ELSE part + "
        f"CASE WHEN strlen(substr(html, 1, part)) < {BODY_CUT} THEN 1 ELSE 0 END END AS kept_chars FROM b")),
    "page_gate": (page_gate_q, oracle("SELECT page_id, CASE WHEN error IS NOT NULL THEN error WHEN trim(html) = '' THEN 'Empty response body' WHEN content_type <> 'text/html' THEN 'Not HTML (' || content_type || ')' END AS reason FROM v_page_rows")),
    "domain_of": (domain_of_q, oracle("SELECT page_id, regexp_replace(lower(host), '^www[.]', '') AS domain FROM v_page_rows")),
    "host_of": (host_of_q, oracle("SELECT page_id, host FROM v_page_rows")),
    "domain_matches": (domain_matches_q, oracle("SELECT page_id, true AS hit, false AS lookalike FROM v_page_rows")),
    "normalise_link": (normalise_link_q, oracle(f"WITH {_HREF} SELECT page_id, href, n, link FROM hf")),
    "pf_visible_text": (_feature("visible_text"), _pf("SELECT page_id, vt AS visible_text FROM pf")),
    "pf_word_count": (_feature("word_count"), _pf("SELECT page_id, wc AS word_count FROM pf")),
    "pf_text_ratio": (_feature("text_ratio"), _pf("SELECT page_id, floor(cast(ratio AS double) * 10000 + 0.5) / 10000 AS text_ratio FROM pf")),
    "pf_title": (_feature("title", "title_length"), _pf("SELECT page_id, nullif(ttl, '') AS title, length(ttl) AS title_length FROM pf")),
    "pf_meta_description": (_feature("meta_description"), _pf("SELECT page_id, md AS meta_description FROM pf")),
    "pf_h1": (_feature("h1"), _pf(f"SELECT page_id, nullif({_txt(chr(40) + 'regexp_extract(doc, ' + chr(39) + '(?is)<h1[ >].*?</h1>' + chr(39) + ')' + chr(41))}, '') AS h1 FROM pf")),
    "pf_h1_count": (_feature("h1_count"), _pf("SELECT page_id, nh1 AS h1_count FROM pf")),
    "pf_heading_outline": (heading_outline, _pf("SELECT page_id, array_to_string(list_transform(hs, lambda h: h.l || ':' || h.t), '|') AS outline FROM pf")),
    "pf_heading_skips": (_feature("heading_skips"), _pf("SELECT page_id, skips AS heading_skips FROM pf")),
    "pf_question_headings": (_feature("question_headings"), _pf("SELECT page_id, qh AS question_headings FROM pf")),
    "pf_jsonld_blocks": (_feature("jsonld_blocks"), _pf("SELECT page_id, nld AS jsonld_blocks FROM pf")),
    "pf_jsonld_invalid": (_feature("jsonld_invalid"), _pf("SELECT page_id, ninv AS jsonld_invalid FROM pf")),
    "pf_jsonld_valid": (lambda s, sf: flat(_features(s, sf, ["jsonld_blocks", "jsonld_invalid"]).select("page_id", (F.col("jsonld_blocks") - F.col("jsonld_invalid")).alias("valid"))), _pf("SELECT page_id, nld - ninv AS valid FROM pf")),
    "pf_jsonld_types": (_feature("jsonld_types"), _pf("SELECT page_id, array_to_string(ty, '|') AS jsonld_types FROM pf")),
    "pf_same_as": (_feature("same_as"), _pf("SELECT page_id, array_to_string(sa, '|') AS same_as FROM pf")),
    "pf_jsonld_find": (_feature("author", "date_modified"), _pf("SELECT page_id, author, dm AS date_modified FROM pf")),
    "pf_author": (_feature("author"), _pf("SELECT page_id, author FROM pf")),
    "pf_date_modified": (_feature("date_modified"), _pf("SELECT page_id, dm AS date_modified FROM pf")),
    "pf_has_faq_schema": (_feature("has_faq_schema"), _pf("SELECT page_id, faqs AS has_faq_schema FROM pf")),
    "pf_has_faq": (_feature("has_faq"), _pf("SELECT page_id, faq AS has_faq FROM pf")),
    "pf_direct_answer": (_feature("has_direct_answer"), _pf("SELECT page_id, CASE WHEN fpt = '' THEN 0 ELSE len(string_split(fpt, ' ')) END BETWEEN 15 AND 80 AS has_direct_answer FROM pf")),
    "pf_list_count": (_feature("list_count"), _pf("SELECT page_id, nlist AS list_count FROM pf")),
    "pf_table_count": (_feature("table_count"), _pf("SELECT page_id, ntab AS table_count FROM pf")),
    "pf_script_count": (_feature("script_count"), _pf("SELECT page_id, nsrc AS script_count FROM pf")),
    "pf_spa_root_empty": (_feature("spa_root_empty"), _pf("SELECT page_id, spa AS spa_root_empty FROM pf")),
    "pf_js_dependent": (_feature("js_dependent", "js_dependent_reason"), _pf("SELECT page_id, why IS NOT NULL AS js_dependent, why AS js_dependent_reason FROM pf")),
    "pf_canonical": (_feature("canonical"), _pf("SELECT page_id, nullif(regexp_extract(doc, 'rel=\"canonical\" href=\"([^\"]*)\"', 1), '') AS canonical FROM pf")),
    "pf_noindex": (_feature("noindex"), _pf("SELECT page_id, doc LIKE '%content=\"NOINDEX%' AS noindex FROM pf")),
    "pf_internal_links": (_feature("internal_links"), oracle(
        f"WITH {_HREF.replace('FROM v_page_rows), hn', chr(44) + ' generate_subscripts(regexp_extract_all(html, ' + chr(39) + 'href=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34) + chr(39) + ', 1), 1) AS hp FROM v_page_rows WHERE error IS NULL AND content_type = ' + chr(39) + 'text/html' + chr(39) + '), hn').replace('count(*) AS n FROM hr GROUP BY 1, 2, 3', 'hp AS n FROM hr WHERE NOT starts_with(href, ' + chr(39) + 'https://canon' + chr(39) + ')')}, "
        "fl AS (SELECT page_id, link, min(n) AS n FROM hf WHERE link IS NOT NULL GROUP BY 1, 2) SELECT p.page_id, coalesce(string_agg(link, '|' ORDER BY n), '') AS internal_links FROM v_page_rows p LEFT JOIN fl USING (page_id) GROUP BY 1")),
    "scan_site_files": (scan_site_files_q, oracle("SELECT origin, cast(robots_code AS bigint) AS robots_code, length(llms_body) AS llms_chars, cast(full_code AS bigint) AS full_code, length(map_body) AS map_chars FROM v_hosts")),
    "robots_lines": (robots_lines, oracle(f"WITH {_RB} SELECT origin, pos, field, value FROM rl")),
    "robots_groups": (robots_groups, oracle(f"WITH {_RB} SELECT origin, pos, field, value, group_id FROM rg")),
    "robots_rules": (robots_rules, oracle(f"WITH {_RB} SELECT origin, group_id, pos, rule_type, path FROM rr")),
    "robots_crawl_delay": (robots_crawl_delay, oracle(f"WITH {_RB} SELECT origin, group_id, arg_max(try_cast(value AS double), pos) FILTER (try_cast(value AS double) >= 0) AS crawl_delay FROM rg WHERE field = 'crawl-delay' AND group_id > 0 GROUP BY 1, 2")),
    "robots_sitemaps": (robots_sitemaps, oracle(f"WITH {_RB} SELECT origin, coalesce(string_agg(value, '|' ORDER BY pos) FILTER (field = 'sitemap'), '') AS sitemaps FROM rl GROUP BY 1")),
    "robots_status": (robots_status, oracle(f"WITH {_RB} SELECT origin, cast(status_code AS bigint) AS status_code, permissive AS permissive_by_absence, length(body) AS chars FROM rs")),
    "robots_group_for": (robots_group_for, oracle(f"WITH {_GF} SELECT origin, ua, group_id FROM gf WHERE ua <> 'SomeBot'")),
    "robots_allowed": (robots_allowed, oracle(
        f"WITH {_GF}, q AS (SELECT page_id, 'https://' || host AS origin, CASE page_id % 3 WHEN 0 THEN 'GPTBot' WHEN 1 THEN 'CCBot' ELSE 'SomeBot' END AS ua, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS path FROM v_page_rows) "
        "SELECT page_id, q.ua, q.path, coalesce(arg_max(rule_type, (length(rr.path), rule_type = 'allow')) FILTER (rr.path IS NOT NULL), 'allow') = 'allow' AS allowed FROM q JOIN gf ON gf.origin = q.origin AND gf.ua = q.ua "
        "LEFT JOIN rr ON rr.origin = gf.origin AND rr.group_id = gf.group_id AND q.path LIKE rr.pat ESCAPE '!' GROUP BY 1, 2, 3")),
    "ai_access_matrix": (ai_access_matrix, oracle(f"WITH {_ACC} SELECT origin, ua, allowed, NOT allowed AND mentioned AS explicitly_blocked, mentioned FROM acc")),
    "robots_blocks_everyone": (robots_blocks_everyone, oracle(f"WITH {_ACC} SELECT origin, blocked FROM eb")),
    "llms_present": (_surf("llms_txt.present AS present", "llms_txt.bytes AS bytes"), oracle(f"WITH {_RB}, {_SURF} SELECT origin, lp AS present, lb AS bytes FROM sf")),
    "llms_well_formed": (_surf("llms_txt.well_formed AS well_formed"), oracle(f"WITH {_RB}, {_SURF} SELECT origin, lw AS well_formed FROM sf")),
    "llms_sections": (_surf("llms_txt.sections AS sections"), oracle(f"WITH {_RB}, {_SURF} SELECT origin, ls AS sections FROM sf")),
    "llms_full_present": (_surf("llms_full_txt.present AS present", "llms_full_txt.bytes AS bytes"), oracle(f"WITH {_RB}, {_SURF} SELECT origin, fp AS present, fb AS bytes FROM sf")),
    "sitemap_stats": (_surf("sitemap.present AS present", "sitemap.url_count AS url_count", "sitemap.source AS source", "sitemap.url AS url"),
                      oracle(f"WITH {_RB}, {_SURF} SELECT origin, mp AS present, mn AS url_count, msrc AS source, murl AS url FROM sf")),
    "checks_crawler_access": (_check_query([c for c, p, *_ in CHECKS if p == "crawler_access"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "crawler_access"])),
    "checks_no_js_content": (_check_query([c for c, p, *_ in CHECKS if p == "no_js_content"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "no_js_content"])),
    "checks_structured_data": (_check_query([c for c, p, *_ in CHECKS if p == "structured_data"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "structured_data"])),
    "checks_answerability": (_check_query([c for c, p, *_ in CHECKS if p == "answerability"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "answerability"])),
    "checks_answer_surface": (_check_query([c for c, p, *_ in CHECKS if p == "answer_surface"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "answer_surface"])),
    "checks_entity_clarity": (_check_query([c for c, p, *_ in CHECKS if p == "entity_clarity"]), _checks_oracle([c for c, p, *_ in CHECKS if p == "entity_clarity"])),
    "pillar_scores": (pillar_scores, _sc("SELECT site_id, id, score, points, n_checks FROM pl")),
    "overall_score": (overall_score, _sc("SELECT site_id, raw_overall FROM ot")),
    "score_ceiling": (score_ceiling, _sc("SELECT site_id, cast(cap AS bigint) AS cap, blocked FROM ot")),
    "overall_capped": (overall_capped, _sc("SELECT site_id, overall, raw_overall, bitten, grade FROM og")),
    "score_summary": (score_summary, oracle(
        f"WITH {_SCORE}, {_WK} SELECT site_id, CASE WHEN bitten AND cap = 25 THEN overall || '/100. A blanket rule in robots.txt keeps every engine out; the score stays capped until it is removed.' "
        "WHEN bitten THEN overall || '/100. ' || replace(blocked, '|', ', ') || CASE WHEN blocked LIKE '%|%' THEN ' are' ELSE ' is' END || ' blocked in robots.txt; the score stays capped at 60 until access is restored.' "
        "WHEN overall >= 85 THEN 'Ready for AI search at ' || overall || '/100; what is left lies in ' || weak || '.' WHEN overall >= 65 THEN 'Usable at ' || overall || '/100; held back by ' || weak || '.' "
        "WHEN overall >= 40 THEN 'Held down to ' || overall || '/100 above all by ' || weak || '.' ELSE 'Only ' || overall || '/100: begin with ' || weak || '.' END AS summary FROM og JOIN wk USING (site_id)")),
    "serialise_pillars": (serialise_pillars, _sc("SELECT site_id, overall, grade, string_agg(id || ':' || score || ':' || n_checks, '|' ORDER BY ppos) AS pillars FROM pl JOIN og USING (site_id) GROUP BY 1, 2, 3")),
    "derive_issues": (derive_issues, _is("SELECT site_id, code, severity, effort, impact AS impact_points FROM iss")),
    "priority_score": (priority_score, _is("SELECT site_id, code, prio AS priority_score FROM iss")),
    "order_issues_report": (order_issues_report, _is("SELECT site_id, code, rank FROM iss")),
    "free_teaser": (free_teaser, _is("SELECT site_id, code, rank FROM iss WHERE rank <= 3")),
    "recommend_top8": (recommend_top8, _is("SELECT site_id, code, rank FROM iss WHERE rank <= 8")),
    "check_affected": (check_affected, oracle(
        f"WITH {_PF}, f AS (SELECT * FROM pf WHERE {_USE}), a AS (SELECT site_id, page_id, 'nojs.server_rendered' AS code, url AS item FROM f WHERE why IS NOT NULL UNION ALL SELECT site_id, page_id, 'nojs.sufficient_depth', url FROM f WHERE wc < 300 "
        "UNION ALL SELECT site_id, page_id, 'schema.present', url FROM f WHERE nld = 0 UNION ALL SELECT site_id, page_id, 'schema.valid', url FROM f WHERE ninv > 0 UNION ALL SELECT site_id, page_id, 'answer.single_h1', url || ' (' || nh1 || ' H1s)' FROM f WHERE nh1 <> 1 "
        "UNION ALL SELECT site_id, page_id, 'answer.heading_hierarchy', url || ' (' || skips || ' skips)' FROM f WHERE skips > 0 UNION ALL SELECT site_id, page_id, 'entity.titles', url FROM f WHERE length(ttl) < 10), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY site_id, code ORDER BY page_id) AS rn FROM a) SELECT site_id, code, string_agg(item, '|' ORDER BY page_id) FILTER (rn <= 10) AS affected, count(*) AS affected_total FROM r GROUP BY 1, 2")),
    "issue_affected": (issue_affected, oracle(
        f"WITH {_ISS}, a AS (SELECT site_id, unnest(['nojs.server_rendered', 'nojs.sufficient_depth', 'schema.present', 'schema.valid', 'answer.single_h1', 'answer.heading_hierarchy', 'entity.titles']) AS code, "
        "unnest([js, thin, n - wld, inv, bh1, sk, n - tt]) AS k FROM b) SELECT i.site_id, i.code, coalesce(k, 0) AS affected_count, least(10, coalesce(k, 0)) AS shown, coalesce(k, 0) AS affected_total FROM iss i LEFT JOIN a USING (site_id, code)")),
    "js_reasons": (js_reasons, oracle(
        f"WITH {_PF}, r AS (SELECT site_id, why, min(page_id) AS o FROM pf WHERE {_USE} AND why IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY o, why) AS rn FROM r) "
        "SELECT site_id, string_agg(why, '|' ORDER BY rn) AS reasons FROM k WHERE rn <= 3 GROUP BY 1")),
    "static_summary": (static_summary, oracle(
        f"WITH {_ISS}, {_COPYT}, pc AS (SELECT site_id, count(*) AS pages FROM v_page_rows GROUP BY 1), s AS (SELECT og.site_id, overall, pages, count(iss.code) AS ni, count(*) FILTER (severity = 'critical') AS nc, count(*) FILTER (effort = 'low' AND severity <> 'critical') AS nq, "
        "max(title) FILTER (rank = 1) AS lead FROM og JOIN pc USING (site_id) LEFT JOIN iss USING (site_id) LEFT JOIN cp ON cp.code = iss.code GROUP BY 1, 2, 3) "
        "SELECT site_id, CASE WHEN nc > 0 THEN site_id || ' scores ' || overall || '/100 and has ' || nc || ' critical ' || CASE WHEN nc = 1 THEN 'problem' ELSE 'problems' END || '. First: ' || lead || '. After that ' || nq || CASE WHEN nq = 1 THEN ' fix is quick.' ELSE ' fixes are quick.' END "
        "WHEN overall >= 80 THEN site_id || ' is in good shape at ' || overall || '/100. ' || ni || CASE WHEN ni = 1 THEN ' refinement remains' ELSE ' refinements remain' END || ', led by ' || lower(lead) || '.' "
        "ELSE site_id || ' scores ' || overall || '/100 over ' || pages || CASE WHEN pages = 1 THEN ' page' ELSE ' pages' END || '. ' || ni || CASE WHEN ni = 1 THEN ' issue limits' ELSE ' issues limit' END || ' citations. Start with ' || lower(lead) || '.' END AS executive_summary FROM s")),
    "action_plan": (action_plan, oracle(
        f"WITH {_ISS}, k AS (SELECT *, row_number() OVER (PARTITION BY site_id, CASE WHEN severity = 'critical' THEN 0 WHEN effort = 'low' THEN 1 ELSE 2 END ORDER BY rank) AS rn, "
        "CASE WHEN severity = 'critical' THEN 0 WHEN effort = 'low' THEN 1 ELSE 2 END AS cls, count(*) FILTER (severity = 'critical') OVER (PARTITION BY site_id) AS nc FROM iss), "
        "w AS (SELECT site_id, code, CASE WHEN cls < 2 THEN 'This week' WHEN effort = 'high' THEN 'This quarter' ELSE 'This month' END AS timeframe, row_number() OVER (PARTITION BY site_id ORDER BY cls, rank) AS step "
        "FROM k WHERE CASE cls WHEN 0 THEN rn <= 2 WHEN 1 THEN rn <= 3 - least(nc, 2) ELSE rn <= 2 END), "
        "c AS (SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(c, t, COPY[c][2].replace("'", "''")) for c, _, _, _, _, t in CHECKS) + ") t(code, title, fix)) "
        "SELECT site_id, step, w.code, timeframe, title, array_to_string(list_slice(string_split(fix, '. '), 1, 2), '. ') AS detail FROM w JOIN c ON c.code = w.code WHERE step <= 5")),
    "fix_catalogue": (fix_catalogue_q, oracle(
        f"WITH {_ISS}, cat AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}', '{sv}', '{ef}')" for c, p, _, sv, ef, _ in CHECKS) + ") t(code, pillar, severity, effort)) "
        "SELECT cat.code, cat.pillar, cat.severity, cat.effort, count(iss.site_id) AS sites FROM cat LEFT JOIN iss ON iss.code = cat.code GROUP BY 1, 2, 3, 4")),
    "prompt_suggestions": (prompt_suggestions, oracle(
        "SELECT site_id, unnest(range(0, 5)) AS position, unnest(['best ' || coalesce(topic, 'provider') || ' in the UK', brand_name || ' reviews', coalesce(topic, 'service') || ' vs alternatives', 'how do I choose a ' || coalesce(topic, 'provider'), brand_name || ' pricing']) AS prompt FROM v_hosts")),
    "audit_pages_list": (audit_pages_list, _pf("SELECT site_id, cast(0 AS bigint) AS depth, url, wc AS word_count, nh1 AS h1_count, skips AS heading_skips FROM pf")),
    "audit_flags": (audit_flags, oracle(f"WITH {_PF}, {_ACC} SELECT origin AS item, ua AS flag FROM acc WHERE NOT allowed UNION ALL SELECT url, 'js' FROM pf WHERE why IS NOT NULL")),
    "audit_kpis": (audit_kpis, oracle(
        f"WITH {_ISS}, w AS (SELECT site_id, count(*) FILTER (st = 'open') AS open_issues, count(*) FILTER (st = 'open' AND severity = 'critical') AS critical_open, coalesce(sum(cast(round(impact * 100) AS bigint)) FILTER (st = 'open'), 0) / 100 AS recoverable_points "
        "FROM (SELECT *, CASE WHEN effort = 'high' THEN 'in_progress' WHEN severity = 'low' THEN 'ignored' ELSE 'open' END AS st FROM iss) GROUP BY 1), p AS (SELECT site_id, count(*) FILTER (why IS NOT NULL) AS js_pages, count(*) AS pages FROM pf GROUP BY 1) "
        "SELECT site_id, coalesce(open_issues, 0) AS open_issues, coalesce(critical_open, 0) AS critical_open, js_pages, pages, cast(coalesce(recoverable_points, 0) AS double) AS recoverable_points FROM p LEFT JOIN w USING (site_id)")),
    "audit_gate": (audit_gate, _pf(f"SELECT site_id, CASE WHEN bool_or({_USE}) THEN 'complete' ELSE 'failed' END AS status, NOT bool_or({_USE}) AS has_reason FROM pf GROUP BY 1")),
    "sink_pages": (sink_pages, oracle(
        "WITH k AS (SELECT length(site_id) % 4 AS audit_id, regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+') AS url, page_id, CASE WHEN error IS NOT NULL THEN error WHEN content_type <> 'text/html' THEN 'Not HTML (' || content_type || ')' ELSE '' END AS issues FROM v_page_rows) "
        "SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY audit_id, url ORDER BY page_id) = 1")),
    "sink_issues": (sink_issues, _is("SELECT site_id, code, severity = 'critical' AND length(site_id) % 2 = 0 AS ai_generated, severity = 'critical' AND length(site_id) % 2 = 0 AS tailored FROM iss")),
    "sink_audit": (sink_audit, oracle(
        f"WITH {_SCORE}, g AS (SELECT site_id, bool_or({_USE}) AS fine, count(*) AS k FROM pf GROUP BY 1) SELECT site_id AS audit_id, CASE WHEN fine THEN 'complete' ELSE 'failed' END AS status, CASE WHEN fine THEN overall END AS overall_score, "
        "CASE WHEN fine THEN k ELSE 0 END AS pages_crawled, cast(90000 AS bigint) AS duration_ms, CASE WHEN fine THEN true END AS has_plan, NOT fine AS has_error, "
        "fine AS has_summary, CASE WHEN fine THEN cast(6 AS bigint) END AS n_bots, CASE WHEN fine THEN cast(sf.lp AS varchar) END AS llms, "
        "CASE WHEN fine THEN 'GPTBot may not crawl the site' END AS first_label FROM g JOIN og USING (site_id) JOIN v_hosts h USING (site_id) JOIN sf ON sf.origin = h.origin")),
    "crawl_seeds": (crawl_seeds, oracle(
        "SELECT DISTINCT site_id, base || '0' AS url, site_id % 2 = 1 AS allowed, CASE WHEN site_id % 2 = 0 THEN 'robots.txt disallows VisibilityBot from /p/0' END AS error, "
        "1 - site_id % 2 AS skipped_by_robots FROM v_graph_pages")),
    "crawl_edges": (crawl_edges, oracle(
        "WITH l AS (SELECT *, CASE WHEN local = 0 THEN [1, 2, 0] ELSE [2 * local + 1, 2 * local + 2, 0, local] END AS ns FROM v_graph_pages) "
        "SELECT site_id, url AS src, unnest(range(0, len(ns))) AS pos, base || unnest(ns) AS dst FROM l")),
    "crawl_reach": (crawl_reach, oracle(f"WITH RECURSIVE {_TREE} SELECT site_id, {_U8} AS url, depth, n + 1 AS rank FROM walk")),
    "crawl_cap": (crawl_cap, oracle(f"WITH RECURSIVE {_TREE}, f AS (SELECT site_id, count(*) AS all_found FROM walk WHERE n < 2 * {GRAPH_CAP - 1} + 1 GROUP BY 1) SELECT site_id, least({GRAPH_CAP}, all_found) AS pages, all_found > {GRAPH_CAP} AS capped FROM f")),
    "crawl_robots_skip": (crawl_robots_skip, oracle(f"WITH RECURSIVE {_WALKG}, a AS (SELECT site_id, count(*) AS reached FROM walk GROUP BY 1), s AS (SELECT site_id, count(*) AS k FROM ref GROUP BY 1) SELECT site_id, coalesce(k, 0) AS skipped_by_robots, reached FROM a LEFT JOIN s USING (site_id)")),
}
