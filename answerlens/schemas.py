"""Explicit schemas of the core tables. Nothing is inferred when a table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CITATION_URL = "struct<url:string,title:string,domain:string,is_brand:boolean>"
COMPETITOR_MENTION = "struct<name:string,mentions:int,position:int,linked:boolean>"

TABLES = {
    "workspaces": "workspace_id string, name string, slug string, plan string, plan_status string, brand_name string, "
    "brand_logo_url string, brand_colour string, brand_footer string, brand_contact string, created_at timestamp",
    "sites": "site_id string, workspace_id string, origin string, domain string, name string, brand_name string, "
    "brand_aliases array<string>, created_at timestamp",
    "audits": "audit_id string, workspace_id string, site_id string, public_id string, scope string, target_url string, "
    "origin string, status string, overall_score int, previous_score int, grade string, pillar_scores string, robots string, "
    "answer_surface string, pages_crawled int, pages_capped boolean, summary string, error string, created_ip string, "
    "started_at timestamp, completed_at timestamp, duration_ms bigint",
    "audit_pages": "audit_id string, url string, depth int, status_code int, content_type string, title string, "
    "meta_description string, h1 string, h1_count int, heading_outline array<struct<level:int,text:string>>, heading_skips int, "
    "word_count int, text_ratio double, js_dependent boolean, jsonld_blocks int, jsonld_invalid int, jsonld_types array<string>, "
    "has_faq boolean, question_headings int, list_count int, table_count int, same_as array<string>, date_modified string, "
    "author string, issues array<string>",
    "audit_issues": "issue_id string, audit_id string, workspace_id string, code string, pillar string, severity string, "
    "effort string, title string, what_it_means string, why_it_matters string, how_to_fix string, code_snippet string, "
    "impact_points decimal(5,2), priority_score decimal(6,2), affected_count int, affected_sample array<string>, "
    "evidence string, ai_generated boolean, status string, created_at timestamp",
    "tracked_prompts": "prompt_id string, workspace_id string, site_id string, prompt string, intent string, locale string, "
    "engines array<string>, is_active boolean, last_checked_at timestamp, created_at timestamp",
    "competitors": "competitor_id string, workspace_id string, site_id string, name string, domain string, aliases array<string>, "
    "created_at timestamp",
    "citation_checks": "check_id string, workspace_id string, site_id string, prompt_id string, engine string, mode string, "
    "brand_cited boolean, brand_position int, brand_mentions int, domain_linked boolean, share_of_voice double, "
    f"citation_urls array<{CITATION_URL}>, competitor_mentions array<{COMPETITOR_MENTION}>, response_excerpt string, "
    "sentiment string, latency_ms int, error string, trigger_source string, checked_at timestamp, day string",
    "share_links": "link_id string, workspace_id string, site_id string, audit_id string, kind string, token string, "
    "label string, revoked_at timestamp, view_count int, created_at timestamp, expires_at timestamp",
    "usage_counters": "workspace_id string, period string, metric string, count bigint",
    "scheduled_runs": "run_id string, workspace_id string, kind string, status string, prompts_run int, checks_written int, "
    "detail string, error string, started_at timestamp, finished_at timestamp",
    "billing_events": "event_id string, seq bigint, type string, received_at timestamp, workspace_id string, status string, "
    "price_plan string, meta_plan string",
}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A core table with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(path)
