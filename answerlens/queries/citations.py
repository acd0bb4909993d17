"""Recorded answers: payload scans, mention analysis, and the datasets built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import citation_url_key
from ..operators import mentions as M
from ..operators import reports as R
from ..operators import sinks
from ..operators import tracker as T
from ..sources import answers as A
from . import views as V
from .views import AS_OF, flat, oracle

DOC_NAMES = ["the", "of the", "und", "de", "de la"]
OVERLAPPING = ["of the", "the in", "in the"]
_LINK = "named_struct('url', {0}, 'title', concat('T ', {0}))"
_URLS = f"array({_LINK.format('u1')}, {_LINK.format('u2')}, {_LINK.format('u3')})"


def _answers(s, sf):
    return V.view(s, sf, "answers").withColumn("urls", F.expr(_URLS))


def _dictionary(s, sf):
    sites = V.view(s, sf, "answers").select("site_id").distinct().select(
        "site_id", F.lit("Northwind CRM").alias("brand_name"), F.array(F.lit("Northwind")).alias("brand_aliases"),
        F.lit("northwind.example").alias("domain"))
    rivals = F.array(
        F.struct(F.lit("Contoso").alias("name"), F.lit("contoso.example").alias("domain"), F.array().cast("array<string>").alias("aliases")),
        F.struct(F.lit("Fabrikam").alias("name"), F.lit("fabrikam.example").alias("domain"), F.array(F.lit("Fabrikam Suite")).alias("aliases")))
    competitors = sites.select("site_id", F.explode(rivals).alias("r")).select("site_id", "r.*")
    return M.build_dictionary(sites, competitors)


def _analysed(s, sf):
    rows = _answers(s, sf).withColumn(
        "error", F.expr("CASE WHEN http_status <> 200 THEN concat('HTTP ', http_status) END"))
    return M.analyse_response(rows, _dictionary(s, sf))


def _payload(s, sf, sql):
    return _answers(s, sf).select("conv_id", "turn", "engine", "http_status", F.expr(f"to_json({sql})").alias("payload"))


_P_OPENAI = (
    "named_struct('output_text', answer, 'output', array(named_struct('content', array("
    f"named_struct('text', answer, 'annotations', array({_LINK.format('u1')}, named_struct('url', '', 'title', 'none'))), "
    f"named_struct('text', concat('More: ', text), 'annotations', array({_LINK.format('u2')})), "
    f"named_struct('text', if(turn % 2 = 0, '  ', answer), 'annotations', array({_LINK.format('u3')}))))))"
)
_P_PERPLEXITY = (
    "named_struct('choices', array(named_struct('message', named_struct('content', answer)), named_struct('message', named_struct('content', 'second'))), "
    f"'citations', array(u1, u2), 'search_results', array({_LINK.format('u3')}, named_struct('url', '', 'title', 'x')))"
)
_P_ANTHROPIC = (
    f"named_struct('content', array(named_struct('type', 'text', 'text', answer, 'citations', array({_LINK.format('u1')}), 'content', cast(NULL AS array<struct<url:string,title:string>>)), "
    f"named_struct('type', 'web_search_tool_result', 'text', cast(NULL AS string), 'citations', cast(NULL AS array<struct<url:string,title:string>>), 'content', array({_LINK.format('u2')}, {_LINK.format('u3')})), "
    "named_struct('type', 'text', 'text', 'Done.', 'citations', cast(NULL AS array<struct<url:string,title:string>>), 'content', cast(NULL AS array<struct<url:string,title:string>>))))"
)
_REF = "array(named_struct('url', {0}, 'title', cast(NULL AS string), 'source', 'src'))"
_OVERVIEW = (
    f"named_struct('type', 'ai_overview', 'title', 'Head', 'text', '  ', 'references', {_REF.format('u1')}, 'items', array("
    f"named_struct('type', 'element', 'title', ' ', 'text', answer, 'references', {_REF.format('u2')}, 'items', array(named_struct('text', 'Deep'))), "
    f"named_struct('type', 'element', 'title', 'Tail', 'text', text, 'references', {_REF.format('u3')}, 'items', cast(NULL AS array<struct<text:string>>))))"
)
_P_SERP = (
    "named_struct('tasks', array(named_struct('status_code', if(conv_id % 7 = 2, 40501, 20000), 'status_message', 'note', 'result', array("
    f"named_struct('items', filter(array({_OVERVIEW}), o -> conv_id % 5 != 1))))))"
)


def _scan(engine, sql):
    def run(s, sf):
        df = A.PROVIDERS[engine](_payload(s, sf, sql))
        return flat(df.select("conv_id", "turn", "answer", F.expr("array_join(transform(urls, u -> concat(u.url, ' ', coalesce(u.title, '-'))), '|')").alias("links")))

    return run


def answer_status(s, sf):
    per = {"chatgpt": _P_OPENAI, "perplexity": _P_PERPLEXITY, "claude": _P_ANTHROPIC, "google_aio": _P_SERP}
    pick = "CASE engine " + " ".join(f"WHEN '{e}' THEN to_json({q})" for e, q in per.items()) + " END"
    rec = _answers(s, sf).select("conv_id", "turn", "engine", "http_status", F.expr(pick).alias("payload"))
    out = A.scan_answers(rec)
    return flat(out.select("conv_id", "turn", "engine", F.expr("split_part(error, ':', 1)").alias("error"), "excerpt_override", (F.length("answer") > 0).alias("has_answer")))


def locale_split(s, sf):
    return flat(V.view(s, sf, "prompts").select("prompt_id", A.locale_split(F.col("locale")).alias("l")).select("prompt_id", "l.language", "l.country", "l.location_code"))


def _count(names, *extra):
    def run(s, sf):
        docs = V.view(s, sf, "docs").withColumn("names", F.array(*[F.lit(n) for n in names]))
        return flat(M.count_mentions(docs).select("doc_id", "mentions", "first_index"))

    return run


def citation_url_key_q(s, sf):
    return flat(_answers(s, sf).select("conv_id", "turn", F.explode("urls").alias("u")).select("conv_id", "turn", "u.url", citation_url_key(F.col("u.url")).alias("key")))


def dedupe_citation_urls(s, sf):
    text = F.expr(f"array_join(transform({M.dedupe_urls_sql('urls')}, u -> concat(u.url, ' ', u.domain)), '|')")
    return flat(_answers(s, sf).select("conv_id", "turn", text.alias("links")))


def _pick(*cols):
    def run(s, sf):
        return flat(_analysed(s, sf).select("conv_id", "turn", *[F.expr(c) for c in cols]))

    return run


def join_domain_suffix(s, sf):
    from ..functions.urls import domain_of

    cited = _answers(s, sf).select("conv_id", "turn", F.explode("urls").alias("u")).select("conv_id", "turn", domain_of(F.col("u.url")).alias("domain"))
    targets = V.view(s, sf, "answers").select(F.explode(F.array(F.lit("northwind.example"), F.lit("contoso.example"), F.lit("fabrikam.example"), F.lit("example"))).alias("target")).distinct()
    return flat(M.join_domain_suffix(cited, targets).groupBy("target", "domain").agg(F.count("*").alias("n")))


def fanout_engines(s, sf):
    prompts = M.engines_allowed(V.prompts(s, sf)).select("prompt_id", "allowed_engines")
    answers = T.latest(V.checks(s, sf), ["prompt_id", "engine"]).select("prompt_id", "engine", "check_id", "error")
    return flat(M.fanout_engines(prompts, answers).select("prompt_id", "engine", "check_id", "error"))


def sink_checks(s, sf):
    rows = _analysed(s, sf).withColumn("checked_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(conv_id % 20 as int))"))
    return flat(sinks.sink_checks(rows).groupBy("day", "engine").agg(F.count("*").alias("checks"), F.count("error").alias("errors"), F.sum("brand_mentions").alias("mentions")))


def _report(s, sf):
    return R.citation_report_data(V.sites(s, sf), V.checks(s, sf), V.prompts(s, sf), AS_OF)


def citation_report_data(s, sf):
    return flat(_report(s, sf)["header"].select(
        "site_id", F.col("site.name").alias("name"), F.col("visibility.checks").alias("checks"), F.col("visibility.avg_sov").alias("avg_sov"), "any_simulated",
        F.expr("coalesce(array_join(transform(by_engine, e -> concat(e.engine, ':', e.checks, ':', e.cited)), '|'), '')").alias("engines"),
        "n_prompts", F.expr("coalesce(size(history), 0)").alias("n_days")))


def citation_report_prompts(s, sf):
    return flat(_report(s, sf)["prompts"].select("site_id", "prompt_id", F.expr("array_join(transform(results, r -> r.engine), '|')").alias("engines")))


def _audit_report(s, sf):
    """Audits with the documents they store, and their issues."""
    pillars = "array(named_struct('label', 'AI crawler access', 'score', overall_score, 'weight', 25, 'checks', array(audit_id)), named_struct('label', 'Entity clarity', 'score', audit_id % 7 / 2, 'weight', 5, 'checks', array(1)))"
    plan = "transform(sequence(1, cast(1 + audit_id % 5 AS int)), k -> named_struct('code', 'c', 'title', concat('Step ', k), 'detail', 'd', 'timeframe', 'This week'))"
    doc = F.expr(f"to_json(named_struct('overall', overall_score, 'summary', concat('Stored ', audit_id), 'pillars', {pillars}, 'action_plan', {plan}))")
    access = F.expr("to_json(array(named_struct('ua', 'GPTBot', 'vendor', 'OpenAI', 'allowed', audit_id % 2 = 0), named_struct('ua', 'CCBot', 'vendor', 'Common Crawl', 'allowed', audit_id % 3 = 0)))")
    audits = V.view(s, sf, "audits").withColumns({
        "pillar_scores": F.when(F.col("audit_id") % 11 != 0, doc), "robots": F.when(F.col("audit_id") % 13 != 0, access),
        "summary": F.when(F.col("audit_id") % 4 != 0, F.col("summary"))})
    issues = V.view(s, sf, "issues").select(
        "audit_id", F.col("issue_id").alias("code"), F.col("code").alias("title"), "severity", "effort", F.lit("p").alias("pillar"), F.lit("w").alias("what_it_means"),
        F.lit("y").alias("why_it_matters"), F.lit("h").alias("how_to_fix"), F.lit(None).cast("string").alias("code_snippet"), "impact_points", "priority_score",
        F.lit(0).alias("affected_count"), F.array().cast("array<string>").alias("affected_sample"), "status")
    return R.audit_report_data(audits, V.sites(s, sf), issues)


def audit_report_data(s, sf):
    return flat(_audit_report(s, sf)["header"].select(
        "audit_id", F.col("site.name").alias("name"), F.col("site.brand_name").alias("brand"), F.col("score.overall").alias("overall"), F.col("score.grade").alias("grade"),
        F.col("score.summary").alias("summary"), F.expr("array_join(transform(pillars, p -> concat(p.label, ':', cast(p.score * 2 AS bigint), ':', p.weight)), '|')").alias("pillars"),
        F.expr("array_join(transform(ai_access, a -> concat(a.ua, ':', a.allowed)), '|')").alias("access"),
        F.expr("array_join(transform(action_plan, a -> a.title), '|')").alias("plan"), "pages_crawled"))


def audit_report_issues(s, sf):
    return flat(_audit_report(s, sf)["issues"].select("audit_id", F.col("stored_rank").cast("bigint").alias("stored_rank"), "code", "title", "severity", "priority_score"))


# --- DuckDB side -----------------------------------------------------------------------------



def _dcount(text, alt):
    return (f"cast(len(regexp_extract_all(regexp_replace({text}, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g'), "
            f"'(?i)(?:^|[^\\p{{L}}\\p{{N}}])(?:{alt})(?:$|[^\\p{{L}}\\p{{N}}])')) AS bigint)")


def _dfirst(text, alt):
    pat = f"(?is)^(.*?(?:^|[^\\p{{L}}\\p{{N}}]))(?:{alt})(?:[^\\p{{L}}\\p{{N}}]|$)"
    return f"CASE WHEN regexp_matches({text}, '{pat}') THEN length(regexp_extract({text}, '{pat}', 1)) ELSE -1 END"


_B, _C, _FAB = "northwind[\\s-]+crm|northwind", "contoso", "fabrikam[\\s-]+suite|fabrikam"
_D1 = "CASE WHEN turn % 3 = 0 THEN 'northwind.example' ELSE 'blog.contoso.example' END"
_D3 = "CASE WHEN conv_id % 2 = 0 THEN 'fabrikam.example' ELSE '' END"
_AN = (
    "a0 AS (SELECT *, http_status <> 200 AS bad FROM v_answers), a1 AS (SELECT *, CASE WHEN bad THEN NULL ELSE answer END AS t FROM a0), "
    f"a2 AS (SELECT *, CASE WHEN bad THEN 0 ELSE {_dcount('t', _B)} END AS b, CASE WHEN bad THEN 0 ELSE {_dcount('t', _C)} END AS c, CASE WHEN bad THEN 0 ELSE {_dcount('t', _FAB)} END AS f, "
    f"CASE WHEN bad THEN -1 ELSE {_dfirst('t', _B)} END AS ib, CASE WHEN bad THEN -1 ELSE {_dfirst('t', _C)} END AS ic, CASE WHEN bad THEN -1 ELSE {_dfirst('t', _FAB)} END AS jf, "
    "NOT bad AND turn % 3 = 0 AS lb, NOT bad AND turn % 3 <> 0 AS lc, NOT bad AND conv_id % 2 = 0 AS lf FROM a1), "
    "a3 AS (SELECT *, b > 0 OR lb AS cited, CASE WHEN ib >= 0 THEN 1 + cast(ic >= 0 AND ic < ib AS int) + cast(jf >= 0 AND jf < ib AS int) END AS pb, "
    "CASE WHEN ic >= 0 THEN 1 + cast(ib >= 0 AND ib <= ic AS int) + cast(jf >= 0 AND jf < ic AS int) END AS pc, CASE WHEN jf >= 0 THEN 1 + cast(ib >= 0 AND ib <= jf AS int) + cast(ic >= 0 AND ic <= jf AS int) END AS pf, "
    "CASE WHEN b + c + f > 0 THEN floor(b / (b + c + f) * 10000 + 0.5) / 10000 ELSE 0.0 END AS sov, regexp_replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '\\s+', ' ', 'g') AS ct FROM a2), "
    "a4 AS (SELECT *, CASE WHEN bad THEN '' WHEN ib < 0 THEN substr(ct, 1, 420) ELSE CASE WHEN ib > 140 THEN '…' ELSE '' END || trim(substr(ct, greatest(0, ib - 140) + 1, 420)) || CASE WHEN greatest(0, ib - 140) + 420 < length(ct) THEN '…' ELSE '' END END AS ex, "
    "CASE WHEN ib < 0 THEN substr(t, 1, 600) ELSE substr(t, greatest(0, ib - 250) + 1, ib + 250 - greatest(0, ib - 250)) END AS win FROM a3), "
    "an AS (SELECT *, CASE WHEN NOT cited THEN NULL ELSE CASE sign(len(regexp_extract_all(win, '(?i)\\b(strongest|reliable|popular|leading|best|great)\\b')) - len(regexp_extract_all(win, '(?i)\\b(overpriced|complaints|limited|poor|avoid)\\b'))) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END END AS sent FROM a4)"
)


def _an(select):
    return oracle(f"WITH {_AN} SELECT conv_id, turn, {select} FROM an")


_ALT = "of[\\s-]+the|de[\\s-]+la|the|und|de"
_KEY = "regexp_replace(regexp_replace({0}, '[#?].*$', ''), '/$', '')"
_NEWEST = (
    "newest AS (SELECT c.* FROM (SELECT * FROM v_checks QUALIFY row_number() OVER (PARTITION BY prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1) c "
    "JOIN v_prompts p USING (prompt_id)), state AS (SELECT * FROM v_checks WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY site_id, prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1)"
)

# Three names of two words each that share words. A word has one owner: "of the" takes its words first, then
# "the in", then "in the"; none of them can overlap itself, so each pass is a test of the words beside it.
_OWNED_WORDS = (
    "WITH p AS (SELECT doc_id, unnest(ps) AS w, generate_subscripts(ps, 1) AS k FROM "
    r"(SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS ps FROM v_docs)), "
    "q AS (SELECT doc_id, k, w, coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, "
    "lead(w, 1) OVER d AS g, lead(w, 2) OVER d AS nx FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY k)), "
    r"t AS (SELECT *, coalesce(regexp_matches(g, '^[\s\-]+$'), false) AS glued FROM q), "
    "a AS (SELECT *, glued AND w = 'of' AND nx = 'the' AS of_the FROM t), "
    "b AS (SELECT *, glued AND w = 'the' AND nx = 'in' AND NOT coalesce(lag(of_the, 2) OVER d, false) AS the_in FROM a WINDOW d AS (PARTITION BY doc_id ORDER BY k)), "
    "c AS (SELECT *, glued AND w = 'in' AND nx = 'the' AND NOT coalesce(lag(the_in, 2) OVER d, false) AND NOT coalesce(lead(the_in, 2) OVER d, false) AS in_the FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY k)), "
    "m AS (SELECT doc_id, count(*) AS n, min(place) AS place FROM c WHERE of_the OR the_in OR in_the GROUP BY 1) "
    "SELECT v.doc_id, cast(coalesce(n, 0) AS bigint) AS mentions, cast(coalesce(place, -1) AS bigint) AS first_index FROM v_docs v LEFT JOIN m USING (doc_id)"
)

QUERIES = {
    "scan_answers_openai": (_scan("chatgpt", _P_OPENAI), oracle(
        "SELECT conv_id, turn, array_to_string(list_filter([answer, 'More: ' || text], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS answer, "
        "array_to_string([u1 || ' T ' || u1, u2 || ' T ' || u2, u3 || ' T ' || u3], '|') AS links FROM v_answers")),
    "scan_answers_perplexity": (_scan("perplexity", _P_PERPLEXITY), oracle(
        "SELECT conv_id, turn, answer, array_to_string([u1 || ' -', u2 || ' -', u3 || ' T ' || u3], '|') AS links FROM v_answers")),
    "scan_answers_anthropic": (_scan("claude", _P_ANTHROPIC), oracle(
        "SELECT conv_id, turn, answer || chr(10) || chr(10) || 'Done.' AS answer, array_to_string([u1 || ' T ' || u1, u2 || ' T ' || u2, u3 || ' T ' || u3], '|') AS links FROM v_answers")),
    "scan_answers_serp": (_scan("google_aio", _P_SERP), oracle(
        "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 THEN '' ELSE array_to_string(list_filter(['Head', trim(answer), 'Deep', 'Tail', trim(text)], lambda x: x <> ''), chr(10)) END AS answer, "
        "CASE WHEN conv_id % 5 = 1 THEN '' ELSE array_to_string([u1 || ' src', u2 || ' src', u3 || ' src'], '|') END AS links FROM v_answers")),
    "answer_status": (answer_status, oracle(
        "SELECT conv_id, turn, engine, CASE WHEN http_status <> 200 THEN 'HTTP 429' WHEN engine = 'google_aio' AND conv_id % 7 = 2 THEN 'Task error 40501' END AS error, "
        "CASE WHEN http_status = 200 AND engine = 'google_aio' AND conv_id % 5 = 1 AND conv_id % 7 <> 2 THEN 'No AI Overview was shown for this query.' END AS excerpt_override, NOT (engine = 'google_aio' AND conv_id % 5 = 1) AS has_answer FROM v_answers")),
    "locale_split": (locale_split, oracle(
        "WITH l AS (SELECT prompt_id, lower(split_part(locale, '-', 1)) AS language, CASE WHEN locale LIKE '%-%' THEN upper(split_part(locale, '-', 2)) ELSE 'GB' END AS country FROM v_prompts) "
        "SELECT prompt_id, language, country, cast(CASE country WHEN 'DE' THEN 2276 ELSE 2826 END AS bigint) AS location_code FROM l")),
    "count_mentions": (_count(DOC_NAMES), oracle(f"SELECT doc_id, {_dcount('text', _ALT)} AS mentions, {_dfirst('text', _ALT)} AS first_index FROM v_docs")),
    "count_mentions_overlap": (_count(OVERLAPPING), oracle(_OWNED_WORDS)),
    "citation_url_key": (citation_url_key_q, oracle(
        f"WITH u AS (SELECT conv_id, turn, unnest([u1, u2, u3]) AS url FROM v_answers) SELECT conv_id, turn, url, {_KEY.format('url')} AS key FROM u")),
    "dedupe_citation_urls": (dedupe_citation_urls, oracle(
        f"SELECT conv_id, turn, array_to_string(list_filter([u1 || ' ' || {_D1}, CASE WHEN turn % 3 <> 0 THEN u2 || ' notnorthwind.example' END, u3 || ' ' || {_D3}], lambda x: x IS NOT NULL), '|') AS links FROM v_answers")),
    "domain_linked": (_pick("domain_linked"), _an("lb AS domain_linked")),
    "brand_cited": (_pick("brand_cited", "brand_mentions"), _an("cited AS brand_cited, b AS brand_mentions")),
    "competitor_mentions": (
        _pick("array_join(transform(competitor_mentions, m -> concat_ws(':', m.name, m.mentions, coalesce(string(m.position), '-'), m.linked)), '|') AS rivals"),
        _an("CASE WHEN bad THEN '' ELSE 'Contoso:' || c || ':' || coalesce(cast(pc AS varchar), '-') || ':' || lc || '|Fabrikam:' || f || ':' || coalesce(cast(pf AS varchar), '-') || ':' || lf END AS rivals")),
    "brand_order": (_pick("brand_position"), _an("cast(pb AS bigint) AS brand_position")),
    "share_of_voice": (_pick("share_of_voice"), _an("cast(sov AS double) AS share_of_voice")),
    "response_excerpt": (_pick("response_excerpt"), _an("ex AS response_excerpt")),
    "sentiment_near": (_pick("sentiment"), _an("sent AS sentiment")),
    "analyse_response": (
        _pick("brand_cited", "brand_mentions", "brand_position", "domain_linked", "share_of_voice", "sentiment", "size(citation_urls) AS n_urls", "error"),
        _an("cited AS brand_cited, b AS brand_mentions, cast(pb AS bigint) AS brand_position, lb AS domain_linked, cast(sov AS double) AS share_of_voice, sent AS sentiment, "
            "cast(CASE WHEN bad THEN 0 WHEN turn % 3 = 0 THEN 2 ELSE 3 END AS bigint) AS n_urls, CASE WHEN bad THEN 'HTTP ' || http_status END AS error")),
    "join_domain_suffix": (join_domain_suffix, oracle(
        f"WITH d AS (SELECT unnest([{_D1}, CASE WHEN turn % 3 = 0 THEN 'northwind.example' ELSE 'notnorthwind.example' END, {_D3}]) AS domain FROM v_answers), "
        "t AS (SELECT unnest(['northwind.example', 'contoso.example', 'fabrikam.example', 'example']) AS target) SELECT target, domain, count(*) AS n FROM d JOIN t ON domain = target OR ends_with(domain, '.' || target) GROUP BY 1, 2")),
    "fanout_engines": (fanout_engines, oracle(
        "WITH t AS (SELECT prompt_id, unnest(list_filter(string_split(engine_csv, ','), lambda e: list_contains(list_slice(['chatgpt', 'perplexity', 'google_aio', 'claude'], 1, engines_limit), e))) AS engine FROM v_prompts), "
        "c AS (SELECT * FROM v_checks QUALIFY row_number() OVER (PARTITION BY prompt_id, engine ORDER BY checked_at DESC, check_id DESC) = 1) "
        "SELECT t.prompt_id, t.engine, c.check_id, CASE WHEN c.check_id IS NULL THEN 'No answer was recorded' ELSE c.error END AS error FROM t LEFT JOIN c ON c.prompt_id = t.prompt_id AND c.engine = t.engine")),
    "sink_checks": (sink_checks, oracle(
        f"WITH {_AN} SELECT strftime(DATE '2024-01-01' + cast(conv_id % 20 AS int), '%Y-%m-%d') AS day, engine, count(*) AS checks, count(*) FILTER (bad) AS errors, cast(sum(b) AS bigint) AS mentions FROM an GROUP BY 1, 2")),
    "citation_report_data": (citation_report_data, oracle(
        f"WITH {_NEWEST}, e AS (SELECT site_id, string_agg(engine || ':' || k || ':' || g, '|' ORDER BY engine) AS engines, bool_or(sim) AS sim FROM (SELECT site_id, engine, count(*) AS k, count(*) FILTER (brand_cited) AS g, bool_or(mode = 'simulated') AS sim FROM newest GROUP BY 1, 2) GROUP BY 1), "
        "n AS (SELECT site_id, count(DISTINCT prompt_id) AS k FROM newest GROUP BY 1), v AS (SELECT site_id, count(*) AS checks, cast(sum(cast(round(share_of_voice * 10000) AS bigint)) AS bigint) AS u FROM state GROUP BY 1), h AS (SELECT site_id, count(DISTINCT cast(checked_at AS date)) AS k FROM v_checks WHERE error IS NULL AND checked_at > TIMESTAMP '2023-11-02' GROUP BY 1) "
        "SELECT s.site_id, s.name, coalesce(v.checks, 0) AS checks, coalesce((2 * u + 10 * v.checks) // nullif(20 * v.checks, 0), 0) / 10.0 AS avg_sov, coalesce(sim, false) AS any_simulated, coalesce(engines, '') AS engines, coalesce(n.k, 0) AS n_prompts, coalesce(h.k, 0) AS n_days "
        "FROM v_sites s LEFT JOIN v USING (site_id) LEFT JOIN e USING (site_id) LEFT JOIN n USING (site_id) LEFT JOIN h USING (site_id)")),
    "citation_report_prompts": (citation_report_prompts, oracle(f"WITH {_NEWEST} SELECT site_id, prompt_id, string_agg(engine, '|' ORDER BY engine, check_id) AS engines FROM newest GROUP BY 1, 2")),
    "audit_report_data": (audit_report_data, oracle(
        "SELECT a.audit_id, coalesce(s.name, regexp_replace(a.origin, '^https://', '')) AS name, coalesce(s.brand_name, regexp_replace(a.origin, '^https://', '')) AS brand, coalesce(overall_score, 0) AS overall, '-' AS grade, "
        "CASE WHEN audit_id % 4 <> 0 THEN summary WHEN audit_id % 11 <> 0 THEN 'Stored ' || audit_id ELSE '' END AS summary, "
        "CASE WHEN audit_id % 11 <> 0 THEN 'AI crawler access:' || (overall_score * 2) || ':25|Entity clarity:' || (audit_id % 7) || ':5' ELSE '' END AS pillars, "
        "CASE WHEN audit_id % 13 <> 0 THEN 'GPTBot:' || (audit_id % 2 = 0) || '|CCBot:' || (audit_id % 3 = 0) ELSE '' END AS access, "
        "CASE WHEN audit_id % 11 <> 0 THEN array_to_string(list_transform(range(1, 2 + audit_id % 5), lambda k: 'Step ' || k), '|') ELSE '' END AS plan, pages_crawled "
        "FROM v_audits a LEFT JOIN v_sites s USING (site_id) WHERE status = 'complete'")),
    "audit_report_issues": (audit_report_issues, oracle(
        "SELECT i.audit_id, row_number() OVER (PARTITION BY i.audit_id ORDER BY i.severity = 'critical' DESC, i.priority_score DESC, i.issue_id) AS stored_rank, i.issue_id AS code, i.code AS title, i.severity, i.priority_score "
        "FROM v_issues i WHERE i.status <> 'ignored' AND i.audit_id IN (SELECT audit_id FROM v_audits WHERE status = 'complete')")),
}
