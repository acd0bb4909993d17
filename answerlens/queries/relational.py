"""Lists, dashboards, quotas, scheduling, validation and table rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import PLANS, plan_dim
from ..operators import apply as A
from ..operators import issues as I
from ..operators import quotas as Q
from ..operators import reports as R
from ..operators import score as S
from ..operators import validate as C
from . import views as V
from .views import AS_OF, PERIOD, flat, oracle

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_AUD = (
    "lastaud AS (SELECT site_id, audit_id AS latest_audit_id, overall_score AS latest_score, completed_at AS latest_audit_at "
    "FROM v_audits WHERE status = 'complete' AND site_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, audit_id DESC) = 1)"
)
_COUNTS = (
    f"{_AUD}, pc AS (SELECT site_id, count(*) AS prompt_count FROM v_prompts GROUP BY 1), "
    "cc AS (SELECT site_id, count(*) AS competitor_count FROM v_competitors GROUP BY 1)"
)
_STATE = (
    "state AS (SELECT * FROM v_checks WHERE error IS NULL "
    "QUALIFY row_number() OVER (PARTITION BY site_id, prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1)"
)
_PLAN_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in PLANS)
_PLANS = (
    "plans AS (SELECT * FROM (VALUES " + _PLAN_ROWS + ") t(plan, plan_pos, plan_name, price_gbp, sites_limit, pages_per_audit, audits_limit, "
    "prompts_limit, engines_limit, competitors_limit, weekly_checks, pdf_export, white_label, share_links, api_access)), "
    "wp AS (SELECT w.workspace_id, w.name, w.plan_status, w.brand_name, w.brand_colour, w.brand_footer, w.brand_contact, p.* "
    "FROM v_workspaces w JOIN plans p ON p.plan = CASE WHEN w.plan IN ('free', 'starter', 'growth', 'agency') THEN w.plan ELSE 'free' END)"
)
_UP = "(SELECT p2.plan FROM plans p2 WHERE p2.plan_pos = x.plan_pos + 1)"
_DUE = (
    "due AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY last_checked_at ASC NULLS FIRST, prompt_id) AS queue_pos "
    "FROM v_prompts WHERE is_active AND (last_checked_at IS NULL OR last_checked_at < TIMESTAMP '2024-01-25 00:00:00'))"
)


def _dashboard(s, sf):
    return R.site_dashboard(V.sites(s, sf), V.view(s, sf, "audits"), V.prompts(s, sf), V.competitors(s, sf), V.checks(s, sf))


def sites_list(s, sf):
    df = R.sites_list(V.sites(s, sf), V.view(s, sf, "audits"), V.prompts(s, sf), V.competitors(s, sf))
    return flat(df.select("site_id", "workspace_id", "name", "latest_score", "latest_audit_at", "prompt_count", "competitor_count"))


def site_dashboard(s, sf):
    return flat(_dashboard(s, sf).select(
        "site_id", "workspace_id", "name", "latest_score", "latest_audit_at", "prompt_count", "competitor_count", "visibility", "checks", "simulated"))


def workspace_kpis(s, sf):
    return flat(R.workspace_kpis(_dashboard(s, sf)))


def reports_index(s, sf):
    return flat(R.reports_index(V.sites(s, sf), V.view(s, sf, "audits"), V.checks(s, sf)))


def audits_list(s, sf):
    df = R.audits_list(V.view(s, sf, "audits"), V.sites(s, sf))
    return flat(df.select("workspace_id", "audit_id", "site_name", "status", "overall_score", "started_at", "rn"))


def site_detail_audits(s, sf):
    return flat(R.site_detail_audits(V.view(s, sf, "audits")).select("site_id", "audit_id", "status", "overall_score", "started_at", "rn"))


def prompts_list(s, sf):
    return flat(R.prompts_list(V.prompts(s, sf), V.sites(s, sf)).select("prompt_id", "site_id", "prompt", "engines", "is_active", "site_name"))


def competitors_list(s, sf):
    return flat(R.competitors_list(V.competitors(s, sf), V.sites(s, sf)))


def branding_resolve(s, sf):
    return flat(R.branding_resolve(V.view(s, sf, "workspaces")))


def share_links_active(s, sf):
    df = R.share_links_active(V.view(s, sf, "share_links"), V.view(s, sf, "audits"), AS_OF)
    return flat(df.select("link_id", "kind", "site_id", "resolved_audit_id"))


def share_view_counts(s, sf):
    return flat(R.share_view_counts(V.view(s, sf, "share_links"), V.view(s, sf, "views")).select("link_id", "view_count"))


def previous_score(s, sf):
    return flat(S.previous_scores(V.view(s, sf, "audits")).drop("score_delta"))


def score_delta(s, sf):
    return flat(S.previous_scores(V.view(s, sf, "audits")).select("audit_id", "score_delta"))


def workspace_usage(s, sf):
    df = R.workspace_usage(V.view(s, sf, "workspaces"), V.view(s, sf, "usage"), PERIOD)
    return flat(df.select("workspace_id", "plan", "sites_limit", "audits_limit", "prompts_limit", "audits_used", "checks_used"))


def plan_dim_q(s, sf):
    df = R.with_plan(V.view(s, sf, "workspaces")).groupBy("plan").agg(F.count("*").alias("workspaces"))
    return flat(plan_dim(s).join(df, "plan", "left").na.fill(0, ["workspaces"]))


def eligible_workspaces(s, sf):
    return flat(Q.eligible_workspaces(V.view(s, sf, "workspaces")).select("workspace_id", "plan", "plan_status"))


def _queue(s, sf):
    return Q.stale_prompts(V.prompts(s, sf), AS_OF)


def stale_prompts(s, sf):
    return flat(_queue(s, sf).select("workspace_id", "prompt_id", "last_checked_at", "queue_pos"))


def _totals(s, sf):
    return Q.run_totals(V.view(s, sf, "workspaces"), _queue(s, sf), V.checks(s, sf))


def run_totals(s, sf):
    return flat(_totals(s, sf))


def run_prompts_touched(s, sf):
    return flat(Q.prompts_touched(V.prompts(s, sf), V.checks(s, sf)).select("prompt_id", "last_checked_at"))


def run_log(s, sf):
    return flat(Q.run_log(_totals(s, sf), AS_OF).select("workspace_id", "status", "prompts_run", "checks_written"))


def run_summary(s, sf):
    return flat(Q.run_summary(V.view(s, sf, "workspaces"), _totals(s, sf)))


def usage_counter(s, sf):
    u = V.view(s, sf, "usage")
    stored = V.prompts(s, sf).groupBy("workspace_id").agg(F.count("*").alias("count")).select(
        "workspace_id", F.lit(PERIOD).alias("period"), F.lit("audits").alias("metric"), "count")
    return flat(Q.usage_counter(stored, u))


def quota_audits(s, sf):
    return flat(Q.quota_audits(V.view(s, sf, "workspaces"), V.view(s, sf, "usage"), PERIOD))


def quota_sites(s, sf):
    return flat(Q.quota_sites(V.view(s, sf, "workspaces"), V.sites(s, sf)))


def quota_prompts(s, sf):
    return flat(Q.quota_prompts(V.view(s, sf, "workspaces"), V.prompts(s, sf)))


def quota_competitors(s, sf):
    return flat(Q.quota_competitors(V.view(s, sf, "workspaces"), V.sites(s, sf), V.competitors(s, sf)))


def free_rate_limit(s, sf):
    return flat(Q.free_rate_limit(V.view(s, sf, "free_audits")).select("audit_id", "created_ip", "used_24h", "remaining", "over_limit"))


def subscription_state(s, sf):
    return flat(Q.subscription_state(V.view(s, sf, "billing"), customers(s, sf)))


def customers(s, sf):
    return V.view(s, sf, "workspaces").select(F.concat(F.lit("cus_"), F.col("workspace_id")).alias("customer_id"), "workspace_id")


def event_ledger(s, sf):
    ledger = V.table(s, sf, "orders").select(F.concat(F.lit("evt_"), F.col("o_orderkey") * 7).alias("event_id")).distinct()
    return flat(Q.event_ledger(V.view(s, sf, "billing"), ledger).select("event_id", "seq", "received_at", "type"))


def engines_allowed(s, sf):
    from ..operators.mentions import engines_allowed as ea

    return flat(ea(V.prompts(s, sf)).select("prompt_id", "allowed_engines"))


def engines_disallowed(s, sf):
    from ..operators.mentions import engines_allowed as ea

    return flat(ea(V.prompts(s, sf)).select("prompt_id", "disallowed_engines"))


def build_query(s, sf):
    from ..operators.mentions import build_query as bq

    df = bq(V.prompts(s, sf), V.sites(s, sf), V.competitors(s, sf))
    return flat(df.select("prompt_id", "brand_name", "domain", "locale",
                          "n_rivals"))


def query_competitors(s, sf):
    from ..operators.mentions import query_competitors as qc

    return flat(qc(V.competitors(s, sf)).select("site_id", "name", "domain", F.size("aliases").alias("n_aliases")))


def issue_filter_status(s, sf):
    i = V.view(s, sf, "issues")
    one = i.groupBy("audit_id").agg(
        F.count("*").alias("every"), F.count_if(F.col("status").isin("open", "in_progress")).alias("open"),
        F.count_if(F.col("status").isin("fixed", "ignored")).alias("done"), F.count_if(F.col("status") != "ignored").alias("report"))
    return flat(one.select("audit_id", F.expr("stack(4, 'all', every, 'open', open, 'done', done, 'report', report) AS (which, n)")).filter("n > 0"))


def issue_status_counts(s, sf):
    return flat(I.issue_status_counts(V.view(s, sf, "issues"), "audit_id"))


def issue_set_status(s, sf):
    return flat(I.issue_set_status(V.view(s, sf, "issues"), V.view(s, sf, "changes")).select("issue_id", "audit_id", "workspace_id", "code", "status"))


def order_issues_stored(s, sf):
    i = V.view(s, sf, "issues").withColumn("code", F.col("issue_id"))
    return flat(I.stored_order(i, "audit_id").select("audit_id", "issue_id", "severity", "priority_score", "stored_rank"))


def unique_slug(s, sf):
    return flat(A.unique_slug(V.view(s, sf, "workspaces"), "name", "created_at", "workspace_id").select("workspace_id", "slug"))


def apply_patch(s, sf):
    patches = V.table(s, sf, "lineitem").select(
        F.col("l_partkey").alias("prompt_id"), F.col("l_shipdate").alias("patched_at"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("patch_id"),
        F.expr("CASE WHEN l_quantity > 25 THEN NULL ELSE 'local' END").alias("intent"), F.expr("l_suppkey % 2 = 0").alias("set_intent"),
        F.expr("l_returnflag = 'A'").alias("is_active"), F.expr("l_suppkey % 3 = 0").alias("set_is_active"))
    return flat(A.apply_patch(V.view(s, sf, "prompts"), patches, "prompt_id", ["intent", "is_active"]).select("prompt_id", "prompt", "intent", "is_active"))


def cascade_delete(s, sf):
    tables = {"sites": V.view(s, sf, "sites"), "prompts": V.view(s, sf, "prompts"), "checks": V.view(s, sf, "checks")}
    dead = V.table(s, sf, "nation").select((F.col("n_nationkey") * 3).cast("bigint").alias("site_id"))
    left = A.cascade_delete(tables, dead, "site_id", {"prompts": "sites.site_id", "checks": "prompts.prompt_id"})
    out = None
    for name, df in left.items():
        one = df.groupBy("site_id").agg(F.count("*").alias("left_rows")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return flat(out)


def _reasons(df, key):
    return flat(df.select(key, "reasons"))


def validate_sites(s, sf):
    return _reasons(C.validate_sites(V.sites(s, sf)), "site_id")


def validate_prompts(s, sf):
    return _reasons(C.validate_prompts(V.prompts(s, sf)), "prompt_id")


def validate_competitors(s, sf):
    return _reasons(C.validate_competitors(V.competitors(s, sf)), "competitor_id")


def validate_branding(s, sf):
    return _reasons(C.validate_branding(V.view(s, sf, "workspaces")), "workspace_id")


def validate_share_links(s, sf):
    return _reasons(C.validate_share_links(V.view(s, sf, "share_links")), "link_id")


def validate_enums(s, sf):
    parts = [("workspaces", "workspaces", "workspace_id"), ("audits", "audits", "audit_id"), ("issues", "issues", "issue_id"),
             ("prompts", "prompts", "prompt_id"), ("checks", "checks", "check_id"), ("share_links", "share_links", "link_id")]
    out = None
    for name, view, key in parts:
        bad = C.validate_enums(V.view(s, sf, view), name).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), "reasons").filter(F.size("reasons") > 0)
        out = bad if out is None else out.unionByName(bad)
    return flat(out)


def validate_unique(s, sf):
    parts = [("sites", V.view(s, sf, "sites"), ["created_at", "site_id"], "site_id"),
             ("audits", V.view(s, sf, "audits"), ["started_at", "audit_id"], "audit_id"),
             ("prompts", V.view(s, sf, "prompts"), ["created_at", "prompt_id"], "prompt_id"),
             ("competitors", V.view(s, sf, "competitors"), ["created_at", "competitor_id"], "competitor_id")]
    out = None
    for name, df, order, key in parts:
        keep = C.validate_unique(df, C.UNIQUE_KEYS[name], order).filter("copies > 1").select(
            F.lit(name).alias("table_name"), F.col(key).alias("kept_key"), "copies")
        out = keep if out is None else out.unionByName(keep)
    return flat(out)


def validate_fk(s, sf):
    bad = C.validate_fk(V.view(s, sf, "checks"), V.view(s, sf, "prompts").filter("is_active"), "prompt_id").select(
        F.lit("checks.prompt_id").alias("ref"), F.col("check_id").alias("row_key"))
    links = C.validate_fk(V.view(s, sf, "share_links"), V.view(s, sf, "audits").filter("status = 'complete'"), "audit_id").select(
        F.lit("share_links.audit_id").alias("ref"), F.col("link_id").alias("row_key"))
    return flat(bad.unionByName(links))


def domain_scalars(s, sf):
    from ..functions.urls import clean_domain

    c = V.competitors(s, sf)
    return flat(c.select("competitor_id", clean_domain(F.col("domain")).alias("clean")))


def slugify_q(s, sf):
    from ..functions.urls import slugify

    return flat(V.view(s, sf, "docs").select("doc_id", slugify(F.col("text"), 50).alias("slug")))


def parse_site_url_q(s, sf):
    from ..functions.urls import normalise_target, parse_site_url

    p = V.sites(s, sf).select("site_id", normalise_target(F.col("url")).alias("target"), parse_site_url(F.col("url")).alias("p"))
    return flat(p.select("site_id", "target", "p.origin", "p.domain"))


def normalise_target_q(s, sf):
    from ..functions.urls import normalise_target

    return flat(V.sites(s, sf).select("site_id", normalise_target(F.col("url")).alias("target")))


def relative_age_q(s, sf):
    from ..functions.dates import relative_age

    return flat(V.view(s, sf, "checks").select("check_id", relative_age(F.col("checked_at"), F.lit(AS_OF)).alias("age")))


def period_month_q(s, sf):
    from ..functions.dates import period_month

    return flat(V.view(s, sf, "checks").groupBy(period_month(F.col("checked_at")).alias("period")).agg(F.count("*").alias("checks")))


def day_bucket_q(s, sf):
    from ..functions.dates import day_bucket

    return flat(V.view(s, sf, "checks").groupBy(day_bucket(F.col("checked_at")).alias("day")).agg(F.count("*").alias("checks")))


def grade_for_q(s, sf):
    from ..functions.dates import grade_for

    return flat(V.view(s, sf, "audits").filter("overall_score IS NOT NULL").select("audit_id", grade_for(F.col("overall_score")).alias("grade")))


def score_tone_q(s, sf):
    from ..functions.dates import score_tone

    return flat(V.view(s, sf, "audits").filter("overall_score IS NOT NULL").select("audit_id", score_tone(F.col("overall_score")).alias("tone")))


def engine_label_q(s, sf):
    from ..functions.dates import engine_label

    return flat(V.view(s, sf, "checks").groupBy(engine_label(F.col("engine")).alias("label")).agg(F.count("*").alias("n")))


def severity_label_q(s, sf):
    from ..functions.dates import severity_label

    return flat(V.view(s, sf, "issues").groupBy(severity_label(F.col("severity")).alias("label")).agg(F.count("*").alias("n")))


def effort_label_q(s, sf):
    from ..functions.dates import effort_label

    return flat(V.view(s, sf, "issues").groupBy(effort_label(F.col("effort")).alias("label")).agg(F.count("*").alias("n")))


def pillar_label_q(s, sf):
    from ..dims import PILLARS
    from ..functions.dates import pillar_label

    ids = F.array(*[F.lit(p["id"]) for p in PILLARS])
    c = V.view(s, sf, "checks").select(F.get(ids, (F.col("check_id") % 6).cast("int")).alias("pillar"))
    return flat(c.groupBy(pillar_label(F.col("pillar")).alias("label")).agg(F.count("*").alias("n")))


def ratios_q(s, sf):
    from ..functions.text import clamp01, js_round, safe_ratio

    c = V.view(s, sf, "checks")
    r = safe_ratio(F.col("rival_b").cast("double"), F.col("rival_a").cast("double"))
    return flat(c.select("check_id", clamp01(r).alias("clamped"), js_round(r * 10 - 5, 0).alias("rounded")))


def median_rounded_q(s, sf):
    from ..functions.text import js_round

    c = V.view(s, sf, "checks").groupBy("site_id", "k").agg(F.count("*").alias("n"))
    return flat(c.groupBy("site_id").agg(js_round(F.expr("percentile(k, 0.5, n)"), 0).cast("bigint").alias("median_k")))


def is_public_url_q(s, sf):
    from ..functions.urls import is_public_url

    url = F.expr(
        "concat(CASE check_id % 4 WHEN 0 THEN 'http://' WHEN 1 THEN 'https://' WHEN 2 THEN 'ftp://' ELSE 'HTTP://u:p@' END, "
        "check_id % 256, '.', k * 2, '.', check_id % 7, '.1', CASE WHEN k % 2 = 0 THEN ':8080/a' ELSE '/a' END)")
    return flat(V.view(s, sf, "checks").select("check_id", is_public_url(url).alias("is_public")))


def cidr_contains_q(s, sf):
    from ..functions.urls import cidr_contains

    ip = F.expr("concat(100 + check_id % 30, '.', k, '.', check_id % 300, '.', site_id)")
    cidr = F.expr("concat(100 + check_id % 25, '.', k - k % 4, '.0.0/', CASE WHEN check_id % 9 = 0 THEN 33 ELSE check_id % 30 END)")
    return flat(V.view(s, sf, "checks").select("check_id", cidr_contains(ip, cidr).alias("inside")))


def cidr_join(s, sf):
    """Every address of the checks, IPv4 and IPv6, against ranges taken from them."""
    from ..operators.ranges import address_ranges

    c = V.view(s, sf, "checks")
    ip = F.expr("CASE WHEN check_id % 5 = 0 THEN concat('2001:db8:', lower(hex(k)), '::', lower(hex(check_id % 1024))) ELSE concat(100 + check_id % 30, '.', k, '.', check_id % 256, '.', site_id) END")
    cidr = F.expr("CASE WHEN check_id % 7 = 0 THEN concat('2001:db8:', lower(hex(k - k % 4)), '::/', 30 + check_id % 19) ELSE concat(100 + check_id % 25, '.', k - k % 4, '.0.0/', 8 + check_id % 25) END")
    found = address_ranges(c.select(ip.alias("ip")), c.select(cidr.alias("cidr")))
    return flat(found.groupBy("ip").agg(F.count("*").alias("n_ranges"), F.max("bits").cast("bigint").alias("bits"), F.min(F.when(F.col("narrowest"), F.col("cidr"))).alias("narrowest")))


_ID = "regexp_extract(lower(trim(url)), '^(?:https?://)?([^/?#]*)', 1)"
_IP = "concat(100 + check_id % 30, '.', k, '.', check_id % 300, '.', site_id)"

QUERIES = {
    "sites_list": (sites_list, f"WITH {_COUNTS} SELECT site_id, workspace_id, name, latest_score, {_TS.format('latest_audit_at')}, "
                   "coalesce(prompt_count, 0) AS prompt_count, coalesce(competitor_count, 0) AS competitor_count "
                   "FROM v_sites LEFT JOIN lastaud USING (site_id) LEFT JOIN pc USING (site_id) LEFT JOIN cc USING (site_id)"),
    "site_dashboard": (site_dashboard, f"WITH {_COUNTS}, {_STATE}, v AS (SELECT site_id, count(*) AS checks, count(*) FILTER (brand_cited) AS cited, "
                       "count(*) FILTER (mode = 'simulated') AS simulated FROM state GROUP BY 1) "
                       f"SELECT site_id, workspace_id, name, latest_score, {_TS.format('latest_audit_at')}, coalesce(prompt_count, 0) AS prompt_count, "
                       "coalesce(competitor_count, 0) AS competitor_count, ((2000 * cited + checks) // (2 * checks)) / 10.0 AS visibility, "
                       "coalesce(checks, 0) AS checks, coalesce(simulated, 0) AS simulated FROM v_sites LEFT JOIN lastaud USING (site_id) "
                       "LEFT JOIN pc USING (site_id) LEFT JOIN cc USING (site_id) LEFT JOIN v USING (site_id)"),
    "workspace_kpis": (workspace_kpis, f"WITH {_COUNTS}, {_STATE}, v AS (SELECT site_id, count(*) AS checks, count(*) FILTER (brand_cited) AS cited FROM state GROUP BY 1), "
                       "d AS (SELECT workspace_id, site_id, latest_score, coalesce(prompt_count, 0) AS prompt_count, checks, "
                       "(2000 * cited + checks) // (2 * checks) AS tenths FROM v_sites LEFT JOIN lastaud USING (site_id) LEFT JOIN pc USING (site_id) LEFT JOIN v USING (site_id)) "
                       "SELECT workspace_id, count(*) AS sites, cast(sum(prompt_count) AS bigint) AS tracked_prompts, "
                       "cast(floor(avg(latest_score) + 0.5) AS bigint) AS avg_score, cast((2 * sum(tenths) + 10 * count(checks)) // nullif(20 * count(checks), 0) AS bigint) AS avg_visibility FROM d GROUP BY 1"),
    "reports_index": (reports_index, f"WITH {_AUD}, n AS (SELECT site_id, count(*) AS checks FROM v_checks GROUP BY 1) "
                      "SELECT site_id, workspace_id, name, origin, latest_audit_id, latest_score, coalesce(checks, 0) AS checks "
                      "FROM v_sites LEFT JOIN lastaud USING (site_id) LEFT JOIN n USING (site_id)"),
    "audits_list": (audits_list, "SELECT a.workspace_id, a.audit_id, s.name AS site_name, a.status, a.overall_score, strftime(a.started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rn "
                    "FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY started_at DESC, audit_id DESC) AS rn FROM v_audits WHERE workspace_id IS NOT NULL) a "
                    "LEFT JOIN v_sites s USING (site_id) WHERE rn <= 50"),
    "site_detail_audits": (site_detail_audits, "SELECT site_id, audit_id, status, overall_score, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, rn "
                           "FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, audit_id DESC) AS rn FROM v_audits WHERE site_id IS NOT NULL) WHERE rn <= 20"),
    "prompts_list": (prompts_list, "SELECT p.prompt_id, p.site_id, p.prompt, replace(p.engine_csv, ',', '|') AS engines, p.is_active, s.name AS site_name FROM v_prompts p JOIN v_sites s USING (site_id)"),
    "competitors_list": (competitors_list, "SELECT c.competitor_id, c.site_id, c.name, c.domain, s.name AS site_name FROM v_competitors c JOIN v_sites s USING (site_id)"),
    "branding_resolve": (branding_resolve, f"WITH {_PLANS} SELECT workspace_id, CASE WHEN white_label AND brand_name <> '' THEN brand_name ELSE 'AnswerLens' END AS product_name, "
                         "CASE WHEN white_label THEN brand_colour ELSE '#4f46e5' END AS brand_colour, CASE WHEN white_label THEN brand_footer END AS footer, "
                         "CASE WHEN white_label THEN brand_contact END AS contact, white_label FROM wp"),
    "share_links_active": (share_links_active, f"WITH {_AUD} SELECT link_id, kind, l.site_id, coalesce(l.audit_id, CASE WHEN kind IN ('audit', 'combined') THEN latest_audit_id END) AS resolved_audit_id "
                           "FROM v_share_links l LEFT JOIN lastaud USING (site_id) WHERE revoked_at IS NULL AND NOT coalesce(expires_at < TIMESTAMP '2024-01-31 00:00:00', false)"),
    "share_view_counts": (share_view_counts, "SELECT l.link_id, view_count + coalesce(n, 0) AS view_count FROM v_share_links l LEFT JOIN (SELECT link_id, count(*) AS n FROM v_views GROUP BY 1) USING (link_id)"),
    "previous_score": (previous_score, "WITH a AS (SELECT * FROM v_audits WHERE site_id IS NOT NULL), d AS (SELECT site_id, completed_at, max_by(overall_score, audit_id) AS previous_score FROM a WHERE status = 'complete' GROUP BY 1, 2) "
                       "SELECT a.audit_id, a.site_id, a.overall_score, d.previous_score FROM a ASOF LEFT JOIN d ON a.site_id = d.site_id AND a.started_at >= d.completed_at"),
    "score_delta": (score_delta, "WITH a AS (SELECT * FROM v_audits WHERE site_id IS NOT NULL), d AS (SELECT site_id, completed_at, max_by(overall_score, audit_id) AS previous_score FROM a WHERE status = 'complete' GROUP BY 1, 2) "
                    "SELECT a.audit_id, CASE WHEN a.status = 'complete' THEN a.overall_score - d.previous_score END AS score_delta FROM a ASOF LEFT JOIN d ON a.site_id = d.site_id AND a.started_at >= d.completed_at"),
    "workspace_usage": (workspace_usage, f"WITH {_PLANS}, u AS (SELECT workspace_id, count(*) FILTER (metric = 'audits') AS a, count(*) FILTER (metric = 'citation_checks') AS c FROM v_usage WHERE period = '2024-01' GROUP BY 1) "
                        "SELECT workspace_id, plan, cast(sites_limit AS bigint) AS sites_limit, cast(audits_limit AS bigint) AS audits_limit, cast(prompts_limit AS bigint) AS prompts_limit, coalesce(a, 0) AS audits_used, coalesce(c, 0) AS checks_used FROM wp LEFT JOIN u USING (workspace_id)"),
    "plan_dim": (plan_dim_q, f"WITH {_PLANS} SELECT p.plan, cast(p.plan_pos AS bigint) AS plan_pos, p.plan_name, cast(p.price_gbp AS bigint) AS price_gbp, cast(p.sites_limit AS bigint) AS sites_limit, "
                 "cast(p.pages_per_audit AS bigint) AS pages_per_audit, cast(p.audits_limit AS bigint) AS audits_limit, cast(p.prompts_limit AS bigint) AS prompts_limit, cast(p.engines_limit AS bigint) AS engines_limit, "
                 "cast(p.competitors_limit AS bigint) AS competitors_limit, p.weekly_checks, p.pdf_export, p.white_label, p.share_links, p.api_access, (SELECT count(*) FROM wp WHERE wp.plan = p.plan) AS workspaces FROM plans p"),
    "eligible_workspaces": (eligible_workspaces, f"WITH {_PLANS} SELECT workspace_id, plan, plan_status FROM wp WHERE weekly_checks AND plan_status IN ('active', 'trialing')"),
    "stale_prompts": (stale_prompts, f"WITH {_DUE} SELECT workspace_id, prompt_id, {_TS.format('last_checked_at')}, queue_pos FROM due"),
    "run_totals": (run_totals, f"WITH {_PLANS}, {_DUE}, r AS (SELECT workspace_id, count(*) AS n FROM due GROUP BY 1), c AS (SELECT workspace_id, count(*) AS m FROM v_checks GROUP BY 1) "
                   "SELECT workspace_id, plan, coalesce(n, 0) AS prompts_run, coalesce(m, 0) AS checks_written FROM wp LEFT JOIN r USING (workspace_id) LEFT JOIN c USING (workspace_id) WHERE weekly_checks AND plan_status IN ('active', 'trialing')"),
    "run_prompts_touched": (run_prompts_touched, "WITH n AS (SELECT prompt_id, max(checked_at) AS seen FROM v_checks GROUP BY 1), "
                            "t AS (SELECT prompt_id, CASE WHEN seen IS NULL THEN p.last_checked_at WHEN p.last_checked_at IS NULL THEN seen ELSE greatest(p.last_checked_at, seen) END AS last_checked_at "
                            f"FROM v_prompts p LEFT JOIN n USING (prompt_id)) SELECT prompt_id, {_TS.format('last_checked_at')} FROM t"),
    "run_log": (run_log, f"WITH {_PLANS}, {_DUE}, r AS (SELECT workspace_id, count(*) AS n FROM due GROUP BY 1), c AS (SELECT workspace_id, count(*) AS m FROM v_checks GROUP BY 1) "
                "SELECT wp.workspace_id, 'complete' AS status, coalesce(n, 0) AS prompts_run, coalesce(m, 0) AS checks_written FROM wp LEFT JOIN r USING (workspace_id) LEFT JOIN c USING (workspace_id) "
                "WHERE weekly_checks AND plan_status IN ('active', 'trialing')"),
    "run_summary": (run_summary, f"WITH {_PLANS}, {_DUE}, e AS (SELECT * FROM wp WHERE weekly_checks AND plan_status IN ('active', 'trialing')) "
                    "SELECT (SELECT count(*) FROM v_workspaces WHERE plan_status IN ('active', 'trialing')) AS workspaces_considered, (SELECT count(*) FROM e) AS workspaces_eligible, "
                    "(SELECT count(*) FROM due WHERE workspace_id IN (SELECT workspace_id FROM e)) AS prompts_run, (SELECT count(*) FROM v_checks WHERE workspace_id IN (SELECT workspace_id FROM e)) AS checks_written"),
    "usage_counter": (usage_counter, "SELECT workspace_id, period, metric, cast(sum(count) AS bigint) AS count FROM (SELECT workspace_id, period, metric, count FROM v_usage "
                      "UNION ALL SELECT workspace_id, '2024-01', 'audits', count(*) FROM v_prompts GROUP BY 1) GROUP BY 1, 2, 3"),
    "quota_audits": (quota_audits, f"WITH {_PLANS}, x AS (SELECT wp.*, coalesce(n, 0) AS used FROM wp LEFT JOIN (SELECT workspace_id, count(*) AS n FROM v_usage WHERE metric = 'audits' AND period = '2024-01' GROUP BY 1) USING (workspace_id)) "
                     f"SELECT workspace_id, plan, cast(audits_limit AS bigint) AS \"limit\", used, {_UP} AS upgrade_to FROM x WHERE used >= audits_limit"),
    "quota_sites": (quota_sites, f"WITH {_PLANS}, x AS (SELECT wp.*, coalesce(n, 0) AS used FROM wp LEFT JOIN (SELECT workspace_id, count(*) AS n FROM v_sites GROUP BY 1) USING (workspace_id)) "
                    f"SELECT workspace_id, plan, cast(sites_limit AS bigint) AS \"limit\", used, {_UP} AS upgrade_to FROM x WHERE used >= sites_limit"),
    "quota_prompts": (quota_prompts, f"WITH {_PLANS}, x AS (SELECT wp.*, coalesce(n, 0) AS used FROM wp LEFT JOIN (SELECT workspace_id, count(*) AS n FROM v_prompts GROUP BY 1) USING (workspace_id)) "
                      f"SELECT workspace_id, plan, cast(prompts_limit AS bigint) AS \"limit\", used, {_UP} AS upgrade_to FROM x WHERE used >= prompts_limit"),
    "quota_competitors": (quota_competitors, f"WITH {_PLANS}, x AS (SELECT s.site_id, wp.*, coalesce(n, 0) AS used FROM v_sites s JOIN wp USING (workspace_id) LEFT JOIN (SELECT site_id, count(*) AS n FROM v_competitors GROUP BY 1) USING (site_id)) "
                          f"SELECT site_id, plan, cast(competitors_limit AS bigint) AS \"limit\", used, {_UP} AS upgrade_to FROM x WHERE used >= competitors_limit"),
    "free_rate_limit": (free_rate_limit, "SELECT a.audit_id, a.created_ip, count(*) AS used_24h, greatest(0, 5 - count(*)) AS remaining, count(*) > 5 AS over_limit "
                        "FROM v_free_audits a JOIN v_free_audits b ON a.created_ip = b.created_ip AND b.started_at > a.started_at - INTERVAL 24 HOURS "
                        "AND (b.started_at < a.started_at OR (b.started_at = a.started_at AND b.audit_id <= a.audit_id)) GROUP BY 1, 2"),
    "subscription_state": (subscription_state, "WITH e AS (SELECT b.* REPLACE (coalesce(b.workspace_id, w.workspace_id) AS workspace_id) FROM v_billing b LEFT JOIN v_workspaces w ON b.workspace_id IS NULL AND b.customer_id = 'cus_' || w.workspace_id), "
                           "m AS (SELECT *, status IN ('canceled', 'unpaid', 'incomplete_expired') IS TRUE AS over, type <> 'payment_failed' AS told, CASE WHEN type <> 'payment_failed' THEN CASE WHEN status IN ('canceled', 'unpaid', 'incomplete_expired') THEN 'free' "
                           "ELSE coalesce(price_plan, CASE WHEN meta_plan IN ('free', 'starter', 'growth', 'agency') THEN meta_plan END, 'free') END END AS p, "
                           "CASE WHEN type = 'payment_failed' THEN 'past_due' WHEN status IN ('active', 'trialing', 'past_due') THEN status WHEN status IN ('canceled', 'unpaid', 'incomplete_expired') THEN 'canceled' ELSE 'active' END AS st FROM e WHERE workspace_id IS NOT NULL), "
                           "g AS (SELECT workspace_id, arg_max(p, (received_at, event_id)) FILTER (p IS NOT NULL) AS plan, arg_max(st, (received_at, event_id)) AS plan_status, arg_max(customer_id, (received_at, event_id)) FILTER (told AND customer_id IS NOT NULL) AS customer_id, "
                           "arg_max({'i': CASE WHEN NOT over THEN subscription_id END, 'e': period_end}, (received_at, event_id)) FILTER (told) AS paid FROM m GROUP BY 1) "
                           "SELECT workspace_id, plan, plan_status, customer_id, paid.i AS subscription_id, strftime(make_timestamp(cast(paid.e * 1000000 AS bigint)), '%Y-%m-%d %H:%M:%S') AS current_period_end FROM g"),
    "event_ledger": (event_ledger, "SELECT event_id, seq, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS received_at, type FROM v_billing WHERE event_id NOT IN (SELECT 'evt_' || (o_orderkey * 7) FROM orders) "
                     "QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY received_at, seq) = 1"),
    "engines_allowed": (engines_allowed, "SELECT prompt_id, array_to_string(list_filter(string_split(engine_csv, ','), lambda e: list_contains(list_slice(['chatgpt', 'perplexity', 'google_aio', 'claude'], 1, engines_limit), e)), '|') AS allowed_engines FROM v_prompts"),
    "engines_disallowed": (engines_disallowed, "SELECT prompt_id, array_to_string(list_filter(string_split(engine_csv, ','), lambda e: NOT list_contains(list_slice(['chatgpt', 'perplexity', 'google_aio', 'claude'], 1, engines_limit), e)), '|') AS disallowed_engines FROM v_prompts"),
    "query_competitors": (query_competitors, "SELECT site_id, name, domain, cast(coalesce(len(string_split(alias_csv, ',')), 0) AS bigint) AS n_aliases FROM v_competitors"),
    "build_query": (build_query, "SELECT p.prompt_id, s.brand_name, s.domain, p.locale, coalesce(n, 0) AS n_rivals FROM v_prompts p JOIN v_sites s USING (site_id) "
                    "LEFT JOIN (SELECT site_id, count(*) AS n FROM v_competitors GROUP BY 1) c USING (site_id)"),
    "issue_filter_status": (issue_filter_status, "WITH w AS (SELECT audit_id, 'all' AS which FROM v_issues UNION ALL SELECT audit_id, 'open' FROM v_issues WHERE status IN ('open', 'in_progress') "
                            "UNION ALL SELECT audit_id, 'done' FROM v_issues WHERE status IN ('fixed', 'ignored') UNION ALL SELECT audit_id, 'report' FROM v_issues WHERE status <> 'ignored') SELECT audit_id, which, count(*) AS n FROM w GROUP BY 1, 2"),
    "issue_status_counts": (issue_status_counts, "SELECT audit_id, count(*) FILTER (status IN ('open', 'in_progress')) AS open_issues, count(*) FILTER (status IN ('fixed', 'ignored')) AS done_issues FROM v_issues GROUP BY 1"),
    "issue_set_status": (issue_set_status, "WITH c AS (SELECT * FROM v_changes QUALIFY row_number() OVER (PARTITION BY issue_id, audit_id, workspace_id ORDER BY changed_at DESC, change_id DESC) = 1) "
                         "SELECT i.issue_id, i.audit_id, i.workspace_id, i.code, coalesce(c.status, i.status) AS status FROM v_issues i LEFT JOIN c USING (issue_id, audit_id, workspace_id)"),
    "order_issues_stored": (order_issues_stored, "SELECT audit_id, issue_id, severity, priority_score, row_number() OVER (PARTITION BY audit_id ORDER BY severity = 'critical' DESC, priority_score DESC, issue_id) AS stored_rank FROM v_issues"),
    "unique_slug": (unique_slug, "WITH b AS (SELECT *, coalesce(nullif(substr(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), ''), 'workspace') AS base FROM v_workspaces) "
                    "SELECT workspace_id, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || (row_number() OVER w) END AS slug FROM b WINDOW w AS (PARTITION BY base ORDER BY created_at, workspace_id)"),
    "apply_patch": (apply_patch, "WITH p AS (SELECT l_partkey AS prompt_id, CASE WHEN l_quantity > 25 THEN NULL ELSE 'local' END AS intent, l_suppkey % 2 = 0 AS si, l_returnflag = 'A' AS act, l_suppkey % 3 = 0 AS sa FROM lineitem "
                    "QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_extendedprice) DESC) = 1) "
                    "SELECT v.prompt_id, v.prompt, CASE WHEN si THEN p.intent ELSE v.intent END AS intent, CASE WHEN sa THEN p.act ELSE v.is_active END AS is_active FROM v_prompts v LEFT JOIN p USING (prompt_id)"),
    "cascade_delete": (cascade_delete, "WITH dead AS (SELECT n_nationkey * 3 AS site_id FROM nation), s AS (SELECT * FROM v_sites WHERE site_id NOT IN (SELECT site_id FROM dead)), "
                       "gs AS (SELECT site_id FROM dead), p AS (SELECT * FROM v_prompts WHERE site_id NOT IN (SELECT site_id FROM gs)), "
                       "gp AS (SELECT prompt_id FROM v_prompts WHERE site_id IN (SELECT site_id FROM gs)) "
                       "SELECT site_id, count(*) AS left_rows, 'sites' AS table_name FROM s GROUP BY 1 UNION ALL SELECT site_id, count(*), 'prompts' FROM p GROUP BY 1 "
                       "UNION ALL SELECT site_id, count(*), 'checks' FROM v_checks WHERE prompt_id NOT IN (SELECT prompt_id FROM gp) GROUP BY 1"),
    "validate_sites": (validate_sites, "SELECT site_id, concat_ws('|', CASE WHEN NOT (length(trim(url)) BETWEEN 3 AND 2048 AND NOT regexp_matches(trim(url), '\\s')) THEN 'url' END, "
                       "CASE WHEN NOT length(trim(brand_name)) BETWEEN 1 AND 120 THEN 'brand_name' END, CASE WHEN length(trim(name)) > 120 THEN 'name' END, "
                       "CASE WHEN alias_csv IS NOT NULL AND (len(string_split(alias_csv, ',')) > 10 OR len(list_filter(string_split(alias_csv, ','), lambda a: trim(a) = '' OR length(trim(a)) > 120)) > 0) THEN 'brand_aliases' END) AS reasons FROM v_sites"),
    "validate_prompts": (validate_prompts, "SELECT prompt_id, concat_ws('|', CASE WHEN NOT length(trim(prompt)) BETWEEN 3 AND 500 THEN 'prompt' END, CASE WHEN intent NOT IN ('informational', 'commercial', 'local', 'navigational') THEN 'intent' END, "
                         "CASE WHEN NOT regexp_full_match(locale, '[a-z]{2}(-[A-Z]{2})?') THEN 'locale' END, CASE WHEN engine_csv LIKE '%bing%' THEN 'engines' END) AS reasons FROM v_prompts"),
    "validate_competitors": (validate_competitors, "SELECT competitor_id, concat_ws('|', CASE WHEN NOT length(trim(name)) BETWEEN 1 AND 120 THEN 'name' END, CASE WHEN length(trim(domain)) > 253 THEN 'domain' END, "
                             "CASE WHEN length(trim(alias_csv)) NOT BETWEEN 1 AND 120 THEN 'aliases' END) AS reasons FROM v_competitors"),
    "validate_branding": (validate_branding, "SELECT workspace_id, concat_ws('|', CASE WHEN NOT length(trim(name)) BETWEEN 1 AND 120 THEN 'name' END, CASE WHEN length(trim(brand_name)) > 120 THEN 'brand_name' END, "
                          "CASE WHEN brand_logo_url NOT LIKE '%:%' THEN 'brand_logo_url' END, CASE WHEN NOT regexp_full_match(brand_colour, '#[0-9a-fA-F]{6}') THEN 'brand_colour' END, "
                          "CASE WHEN length(trim(brand_footer)) > 300 THEN 'brand_footer' END, CASE WHEN length(trim(brand_contact)) > 300 THEN 'brand_contact' END) AS reasons FROM v_workspaces"),
    "validate_share_links": (validate_share_links, "SELECT link_id, concat_ws('|', CASE WHEN kind NOT IN ('audit', 'citations', 'combined') THEN 'kind' END, CASE WHEN kind = 'audit' AND audit_id IS NULL THEN 'audit_id' END, "
                             "CASE WHEN kind <> 'audit' AND site_id IS NULL THEN 'site_id' END, CASE WHEN length(trim(label)) > 120 THEN 'label' END) AS reasons FROM v_share_links"),
    "validate_enums": (validate_enums, "WITH r AS (SELECT 'workspaces' AS table_name, cast(workspace_id AS varchar) AS row_key, concat_ws('|', CASE WHEN plan = 'legacy' THEN 'plan' END, CASE WHEN plan_status = 'paused' THEN 'plan_status' END) AS reasons FROM v_workspaces "
                       "UNION ALL SELECT 'audits', cast(audit_id AS varchar), concat_ws('|', CASE WHEN scope = 'folder' THEN 'scope' END, CASE WHEN overall_score > 100 THEN 'overall_score' END) FROM v_audits "
                       "UNION ALL SELECT 'issues', issue_id, concat_ws('|', CASE WHEN status NOT IN ('open', 'in_progress', 'fixed', 'ignored') THEN 'status' END) FROM v_issues "
                       "UNION ALL SELECT 'prompts', cast(prompt_id AS varchar), CASE WHEN intent = 'other' THEN 'intent' ELSE '' END FROM v_prompts "
                       "UNION ALL SELECT 'checks', cast(check_id AS varchar), concat_ws('|', CASE WHEN sentiment = 'mixed' THEN 'sentiment' END, CASE WHEN trigger_source = 'cron' THEN 'trigger_source' END) FROM v_checks "
                       "UNION ALL SELECT 'share_links', cast(link_id AS varchar), CASE WHEN kind = 'pdf' THEN 'kind' ELSE '' END FROM v_share_links) SELECT * FROM r WHERE reasons <> ''"),
    "validate_unique": (validate_unique, "SELECT 'sites' AS table_name, arg_min(site_id, (created_at, site_id)) AS kept_key, count(*) AS copies FROM v_sites GROUP BY workspace_id, origin HAVING count(*) > 1 "
                        "UNION ALL SELECT 'audits', arg_min(audit_id, (started_at, audit_id)), count(*) FROM v_audits GROUP BY public_id HAVING count(*) > 1 "
                        "UNION ALL SELECT 'prompts', arg_min(prompt_id, (created_at, prompt_id)), count(*) FROM v_prompts GROUP BY site_id, prompt, locale HAVING count(*) > 1 "
                        "UNION ALL SELECT 'competitors', arg_min(competitor_id, (created_at, competitor_id)), count(*) FROM v_competitors GROUP BY site_id, name HAVING count(*) > 1"),
    "validate_fk": (validate_fk, "SELECT 'checks.prompt_id' AS ref, check_id AS row_key FROM v_checks WHERE prompt_id NOT IN (SELECT prompt_id FROM v_prompts WHERE is_active) "
                    "UNION ALL SELECT 'share_links.audit_id', link_id FROM v_share_links WHERE audit_id IS NOT NULL AND audit_id NOT IN (SELECT audit_id FROM v_audits WHERE status = 'complete')"),
    "clean_domain": (domain_scalars, "SELECT competitor_id, lower(regexp_extract(trim(domain), '(?i)^(?:https?://)?(?:www[.])?([^/]*)', 1)) AS clean FROM v_competitors"),
    "slugify": (slugify_q, "SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), ''), 'report') AS slug FROM v_docs"),
    "normalise_target": (normalise_target_q, "SELECT site_id, CASE WHEN lower(trim(url)) LIKE 'http%://%' THEN trim(url) ELSE 'https://' || trim(url) END AS target FROM v_sites"),
    "parse_site_url": (parse_site_url_q, f"WITH h AS (SELECT site_id, url, CASE WHEN lower(trim(url)) LIKE 'http%://%' THEN trim(url) ELSE 'https://' || trim(url) END AS target, regexp_replace({_ID}, ':443', '') AS host FROM v_sites) "
                       "SELECT site_id, target, CASE WHEN host NOT LIKE '% %' THEN 'https://' || host END AS origin, CASE WHEN host NOT LIKE '% %' THEN regexp_replace(host, '^www[.]', '') ELSE '' END AS domain FROM h"),
    "relative_age": (relative_age_q, "WITH a AS (SELECT check_id, cast(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(checked_at)) AS bigint) AS s FROM v_checks), u AS (SELECT check_id, s, CASE WHEN s >= 2592000 THEN 2592000 WHEN s >= 604800 THEN 604800 "
                     "WHEN s >= 86400 THEN 86400 WHEN s >= 3600 THEN 3600 WHEN s >= 60 THEN 60 END AS sz FROM a) SELECT check_id, CASE WHEN sz IS NULL THEN 'just now' ELSE (s // sz) || ' ' || CASE sz WHEN 2592000 THEN 'month' WHEN 604800 THEN 'week' "
                     "WHEN 86400 THEN 'day' WHEN 3600 THEN 'hour' ELSE 'minute' END || CASE WHEN s // sz = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM u"),
    "period_month": (period_month_q, "SELECT strftime(checked_at, '%Y-%m') AS period, count(*) AS checks FROM v_checks GROUP BY 1"),
    "day_bucket": (day_bucket_q, "SELECT cast(cast(checked_at AS date) AS varchar) AS day, count(*) AS checks FROM v_checks GROUP BY 1"),
    "grade_for": (grade_for_q, "SELECT audit_id, substr('FFFFFFFFEEEDDDCCBBAAA', cast(overall_score // 5 AS int) + 1, 1) AS grade FROM v_audits WHERE overall_score IS NOT NULL"),
    "score_tone": (score_tone_q, "SELECT audit_id, CASE WHEN overall_score < 50 THEN 'bad' WHEN overall_score < 80 THEN 'warn' ELSE 'good' END AS tone FROM v_audits WHERE overall_score IS NOT NULL"),
    "engine_label": (engine_label_q, "SELECT CASE engine WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'perplexity' THEN 'Perplexity' WHEN 'claude' THEN 'Claude' ELSE 'Google AI Overviews' END AS label, count(*) AS n FROM v_checks GROUP BY 1"),
    "severity_label": (severity_label_q, "SELECT upper(substr(severity, 1, 1)) || substr(severity, 2) AS label, count(*) AS n FROM v_issues GROUP BY 1"),
    "effort_label": (effort_label_q, "SELECT CASE effort WHEN 'low' THEN 'Quick win' WHEN 'medium' THEN 'Half-day' ELSE 'Dev project' END AS label, count(*) AS n FROM v_issues GROUP BY 1"),
    "pillar_label": (pillar_label_q, "SELECT CASE check_id % 6 WHEN 0 THEN 'AI crawler access' WHEN 1 THEN 'Content without JavaScript' WHEN 2 THEN 'Structured data' WHEN 3 THEN 'Answerability' WHEN 4 THEN 'Answer surface' ELSE 'Entity clarity' END AS label, count(*) AS n FROM v_checks GROUP BY 1"),
    "clamp01_safe_ratio": (ratios_q, "WITH r AS (SELECT check_id, CASE WHEN rival_a > 0 THEN rival_b / rival_a ELSE 0.0 END AS r FROM v_checks) SELECT check_id, least(1.0, greatest(0.0, cast(r AS double))) AS clamped, floor(cast(r AS double) * 10 - 5 + 0.5) AS rounded FROM r"),
    "median_rounded": (median_rounded_q, "SELECT site_id, cast(floor(median(k) + 0.5) AS bigint) AS median_k FROM v_checks GROUP BY 1"),
    "is_public_url": (is_public_url_q, "WITH p AS (SELECT check_id, check_id % 256 AS a, k * 2 AS b FROM v_checks) SELECT check_id, check_id % 4 IN (0, 1) AND NOT (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) "
                      "OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR a >= 224) AS is_public FROM p"),
    "cidr_contains": (cidr_contains_q, "WITH p AS (SELECT check_id, CASE WHEN check_id % 9 = 0 THEN 33 ELSE check_id % 30 END AS bits, check_id % 300 AS o3, "
                      "(((100 + check_id % 30) * 256 + k) * 256 + check_id % 300) * 256 + site_id AS ip, (((100 + check_id % 25) * 256 + k - k % 4) * 256) * 256 AS net FROM v_checks) "
                      "SELECT check_id, o3 < 256 AND bits <= 32 AND (ip >> (32 - bits)) = (net >> (32 - bits)) AS inside FROM p"),
    "cidr_join": (cidr_join, "WITH a AS (SELECT DISTINCT CASE WHEN check_id % 5 = 0 THEN 48 ELSE 32 END AS w, CASE WHEN check_id % 5 = 0 THEN '2001:db8:' || lower(hex(k)) || '::' || lower(hex(check_id % 1024)) "
                  "ELSE concat(100 + check_id % 30, '.', k, '.', check_id % 256, '.', site_id) END AS ip, CASE WHEN check_id % 5 = 0 THEN cast(536939960 AS bigint) * 65536 + k ELSE (((100 + check_id % 30) * 256 + k) * 256 + check_id % 256) * 256 + site_id END AS n FROM v_checks), "
                  "r AS (SELECT DISTINCT CASE WHEN check_id % 7 = 0 THEN 48 ELSE 32 END AS w, CASE WHEN check_id % 7 = 0 THEN 30 + check_id % 19 ELSE 8 + check_id % 25 END AS bits, "
                  "CASE WHEN check_id % 7 = 0 THEN '2001:db8:' || lower(hex(k - k % 4)) || '::/' || (30 + check_id % 19) ELSE concat(100 + check_id % 25, '.', k - k % 4, '.0.0/', 8 + check_id % 25) END AS cidr, "
                  "CASE WHEN check_id % 7 = 0 THEN cast(536939960 AS bigint) * 65536 + k - k % 4 ELSE ((100 + check_id % 25) * 256 + k - k % 4) * 65536 END AS net FROM v_checks), "
                  "m AS (SELECT ip, cidr, bits, max(bits) OVER (PARTITION BY ip) AS most FROM a JOIN r ON a.w = r.w AND (cast(n AS bigint) >> (a.w - bits)) = (cast(net AS bigint) >> (a.w - bits))) "
                  "SELECT ip, count(*) AS n_ranges, max(cast(bits AS bigint)) AS bits, min(cidr) FILTER (bits = most) AS narrowest FROM m GROUP BY 1"),
}
QUERIES = {k: (fn, oracle(sql)) for k, (fn, sql) in QUERIES.items()}
