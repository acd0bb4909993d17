"""The thirty weighted checks, per site, over page features, robots and answer surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dims import AFFECTED_SHOWN, BOTS, CHECKS, CONTENT_TYPES, GROUNDING_TYPES, THIN_WORDS
from ..functions.fragments import q
from .page_features import keep_where
from .robots import ai_access, blocks_everyone

_USABLE = "(error IS NULL AND coalesce(status_code, 0) < 400)"

# Per-page conditions that are counted per site.
_COUNTS = {
    "n": "true",
    "js_pages": "js_dependent",
    "thin_pages": f"word_count < {THIN_WORDS}",
    "ld_pages": "jsonld_blocks > 0",
    "invalid_pages": "jsonld_invalid > 0",
    "bad_h1_pages": "h1_count != 1",
    "skip_pages": "heading_skips > 0",
    "faq_pages": "has_faq",
    "faq_schema_pages": "has_faq_schema",
    "direct_pages": "has_direct_answer",
    "block_pages": "list_count > 0 OR table_count > 0",
    "brand_pages": "contains(lower(coalesce(title, '')), lower(trim(brand_name)))",
    "author_pages": "author IS NOT NULL AND author != ''",
    "dated_pages": "date_modified IS NOT NULL AND date_modified != ''",
    "titled_pages": "title_length >= 10",
    "meta_pages": "meta_description IS NOT NULL AND meta_description != ''",
}
_TYPES = GROUNDING_TYPES + CONTENT_TYPES + ["BreadcrumbList"]


def page_counts(features: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Everything the content checks need, one row per site, in one pass over the features.

    Each page becomes one page row plus one row per sameAs link. The first aggregate groups by
    (site, link) and is combined on the map side, so a site with a third of all pages shuffles only
    one partial row per task; distinct links spread over tasks instead of filling one buffer.
    The exact median keeps a histogram of word counts, bounded by the body cap.
    """
    narrow = features.join(sites.select(key, "brand_name"), key, "left").selectExpr(
        key,
        *[f"int({_USABLE} AND coalesce({c}, false)) AS {k}" for k, c in _COUNTS.items()],
        *[f"{_USABLE} AND coalesce(array_contains(jsonld_types, '{t}'), false) AS t_{t}" for t in _TYPES],
        f"if({_USABLE}, word_count, NULL) AS words",
        f"if({_USABLE}, same_as, cast(array() AS array<string>)) AS links",
    )
    rows = narrow.selectExpr("*", "explode(concat(array(cast(NULL AS string)), links)) AS link")
    per_link = rows.groupBy(key, "link").agg(
        *[F.expr(f"sum(if(link IS NULL, {c}, 0)) AS {c}") for c in _COUNTS],
        *[F.expr(f"bool_or(t_{t}) AS t_{t}") for t in _TYPES],
        F.expr("percentile(if(link IS NULL, words, NULL), 0.5) AS median"),
        F.expr("sum(int(link IS NULL)) AS pages"),
    )
    return per_link.groupBy(key).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in _COUNTS],
        *[F.expr(f"bool_or(t_{t}) AS t_{t}") for t in _TYPES],
        F.expr("cast(floor(coalesce(max(median), 0D) + 0.5D) AS BIGINT) AS median_words"),
        F.expr("sum(pages) AS pages_crawled"),
        F.expr("count(link) AS same_as_links"),
    )


def _found(types: list[str]) -> str:
    names = ", ".join(f"if(t_{t}, '{t}', NULL)" for t in types)
    return f"array_join(array({names}), ', ')"


def _any(types: list[str]) -> str:
    return "(" + " OR ".join(f"t_{t}" for t in types) + ")"


def _share(n: str) -> str:
    return f"greatest(0D, least(1D, {n} / n))"


def _of(n: str, text: str) -> str:
    return f"concat({n}, ' of ', n, {q(text)})"


def _definitions() -> dict[str, tuple[str, str, str, str]]:
    """code -> (applies, score 0..1, passed, detail) as SQL over one row per site."""
    pages = "n > 0"
    out: dict[str, tuple[str, str, str, str]] = {}
    for i, bot in enumerate(BOTS):
        allowed = f"get(access, {i}).allowed"
        detail = (
            f"if({allowed}, '{bot['ua']} ({bot['vendor']}) may crawl; it serves {bot['purpose']}.', "
            f"'{bot['ua']} ({bot['vendor']}) is turned away, which closes {bot['purpose']} to the site.')"
        )
        out[f"robots.{bot['ua'].lower()}_access"] = ("true", f"if({allowed}, 1D, 0D)", allowed, detail)
    reachable = "coalesce(robots_status < 400, false)"
    out |= {
        "robots.wildcard_blocks_all": (
            "true", "if(everyone_blocked, 0D, 1D)", "NOT everyone_blocked",
            "if(everyone_blocked, 'The group for all crawlers disallows the whole site.', 'No blanket disallow.')",
        ),
        "robots.reachable": (
            "true", f"if({reachable}, 1D, 0.5D)", reachable,
            f"if({reachable}, concat('robots.txt answered ', robots_status, '.'), 'No robots.txt was served.')",
        ),
        "nojs.no_pages": ("coalesce(n, 0) = 0", "0D", "false", "'No page gave usable HTML.'"),
        "nojs.server_rendered": (
            pages, "greatest(0D, least(1D, 1D - js_pages / n))", "js_pages = 0",
            f"if(js_pages > 0, {_of('js_pages', ' pages need scripts to show their text.')}, "
            "concat('All ', n, ' pages carry their text in the HTML.'))",
        ),
        "nojs.sufficient_depth": (
            pages, "greatest(0D, least(1D, 1D - thin_pages / n))", "thin_pages <= n * 0.3D",
            f"concat({_of('thin_pages', f' pages hold fewer than {THIN_WORDS} words; the median is ')}, median_words, '.')",
        ),
        "schema.present": (
            pages, _share("ld_pages"), "ld_pages = n", _of("ld_pages", " pages carry JSON-LD."),
        ),
        "schema.valid": (
            pages, "if(ld_pages > 0, greatest(0D, least(1D, 1D - invalid_pages / ld_pages)), 0D)",
            "invalid_pages = 0",
            "CASE WHEN invalid_pages > 0 THEN concat(invalid_pages, ' pages hold JSON-LD that cannot be used.') "
            "WHEN ld_pages > 0 THEN 'Every JSON-LD block is usable.' ELSE 'There is no JSON-LD to check.' END",
        ),
        "schema.entity_grounding": (
            pages, f"if({_any(GROUNDING_TYPES)}, 1D, 0D)", _any(GROUNDING_TYPES),
            f"if({_any(GROUNDING_TYPES)}, concat('Declared: ', {_found(GROUNDING_TYPES)}, '.'), "
            "'No page declares who the site belongs to.')",
        ),
        "schema.content_type": (
            pages, f"if({_any(CONTENT_TYPES)}, 1D, 0D)", _any(CONTENT_TYPES),
            f"if({_any(CONTENT_TYPES)}, concat('Declared: ', {_found(CONTENT_TYPES)}, '.'), "
            "'No page declares its kind of content.')",
        ),
        "schema.breadcrumbs": (
            pages, "if(t_BreadcrumbList, 1D, 0D)", "t_BreadcrumbList",
            "if(t_BreadcrumbList, 'A breadcrumb list was found.', 'No breadcrumb list was found.')",
        ),
        "answer.single_h1": (
            pages, "greatest(0D, least(1D, 1D - bad_h1_pages / n))", "bad_h1_pages = 0",
            _of("bad_h1_pages", " pages do not have exactly one H1."),
        ),
        "answer.heading_hierarchy": (
            pages, "greatest(0D, least(1D, 1D - skip_pages / n))", "skip_pages = 0",
            _of("skip_pages", " pages skip heading levels."),
        ),
        "answer.faq_coverage": (
            pages, "greatest(0D, least(1D, faq_pages / n * 1.5D))", "faq_pages > 0",
            f"concat({_of('faq_pages', ' pages answer questions; ')}, faq_schema_pages, ' are marked up as FAQ.')",
        ),
        "answer.direct_answer": (
            pages, _share("direct_pages"), "direct_pages >= n * 0.5D",
            _of("direct_pages", " pages open with a paragraph of 15 to 80 words."),
        ),
        "answer.extractable_blocks": (
            pages, _share("block_pages"), "block_pages >= n * 0.5D", _of("block_pages", " pages hold a list or table."),
        ),
        "surface.llms_txt": (
            "true",
            "CASE WHEN llms_txt.present AND llms_txt.well_formed THEN 1D WHEN llms_txt.present THEN 0.6D ELSE 0D END",
            "(llms_txt.present AND llms_txt.well_formed)",
            "CASE WHEN llms_txt.present AND llms_txt.well_formed THEN concat('llms.txt has ', llms_txt.sections, "
            "' sections and ', llms_txt.bytes, ' bytes.') WHEN llms_txt.present THEN 'llms.txt is malformed.' "
            "ELSE 'There is no llms.txt.' END",
        ),
        "surface.llms_full_txt": (
            "true", "if(llms_full_txt.present, 1D, 0D)", "llms_full_txt.present",
            "if(llms_full_txt.present, concat('llms-full.txt has ', llms_full_txt.bytes, ' bytes.'), "
            "'There is no llms-full.txt.')",
        ),
        "surface.sitemap": (
            "true", "if(sitemap.present, 1D, 0D)", "sitemap.present",
            "if(sitemap.present, concat('A sitemap of ', sitemap.url_count, ' URLs was found by way of ', "
            "if(sitemap.source = 'robots', 'robots.txt', 'the usual address'), '.'), 'No sitemap could be read.')",
        ),
        "entity.brand_in_title": (
            f"{pages} AND coalesce(trim(brand_name), '') != ''", _share("brand_pages"), "brand_pages >= n * 0.7D",
            _of("brand_pages", " page titles contain the brand."),
        ),
        "entity.same_as": (
            pages, "CASE WHEN same_as_links >= 3 THEN 1D WHEN same_as_links > 0 THEN 0.5D ELSE 0D END",
            "same_as_links >= 3", "concat(same_as_links, ' profiles are linked with sameAs.')",
        ),
        "entity.author_markup": (
            pages, _share("author_pages"), "author_pages >= n * 0.5D", _of("author_pages", " pages name an author."),
        ),
        "entity.freshness": (
            pages, _share("dated_pages"), "dated_pages >= n * 0.5D", _of("dated_pages", " pages state a date."),
        ),
        "entity.titles": (
            pages, _share("titled_pages"), "titled_pages = n", _of("titled_pages", " pages have a title of ten characters or more."),
        ),
        "entity.meta_description": (
            pages, _share("meta_pages"), "meta_pages >= n * 0.8D", _of("meta_pages", " pages have a meta description."),
        ),
    }
    return out


def _checks_sql() -> str:
    defs = _definitions()
    structs = []
    for pos, (code, pillar, weight, severity, effort, title) in enumerate(CHECKS):
        applies, score, passed, detail = defs[code]
        structs.append(
            f"if({applies}, named_struct('pos', {pos}, 'code', '{code}', 'pillar', '{pillar}', 'score', {score}, "
            f"'weight', {weight}D, 'passed', {passed}, 'detail', {detail}, 'severity', '{severity}', "
            f"'effort', '{effort}', 'title', {q(title)}), NULL)"
        )
    return f"array_compact(array({', '.join(structs)}))"


def site_facts(
    features: DataFrame, sites: DataFrame, robots: DataFrame, surface: DataFrame, key: str = "site_id"
) -> DataFrame:
    """One row per site: counts, crawler access and answer surface. ``sites`` has key, origin, brand."""
    access = robots.select(
        "origin",
        F.col("status_code").alias("robots_status"),
        ai_access().alias("access"),
        blocks_everyone().alias("everyone_blocked"),
    )
    return (
        page_counts(features, sites, key)
        .join(sites.select(key, "origin", "brand_name"), key)
        .join(access, "origin", "left")
        .join(surface, "origin", "left")
    )


def with_checks(facts: DataFrame) -> DataFrame:
    """Adds ``checks``: the applicable checks of the site in catalogue order.

    A site has at most thirty checks, so they stay in the row and the roll-ups need no more shuffles.
    """
    return facts.withColumn("checks", F.expr(_checks_sql()))


def check_rows(scored: DataFrame, key: str = "site_id") -> DataFrame:
    """Long form: one row per site and check."""
    # A slice, not the bare column: from a bare column Spark infers a size filter and repeats its expression.
    return scored.selectExpr(key, "explode(slice(checks, 1, 64)) AS c").select(key, "c.*")


# code -> (page fails, text listed)
_AFFECTED = {
    "nojs.server_rendered": ("js_dependent", "url"),
    "nojs.sufficient_depth": (f"word_count < {THIN_WORDS}", "url"),
    "schema.present": ("jsonld_blocks = 0", "url"),
    "schema.valid": ("jsonld_invalid > 0", "url"),
    "answer.single_h1": ("h1_count != 1", "concat(url, ' (', h1_count, ' H1s)')"),
    "answer.heading_hierarchy": ("heading_skips > 0", "concat(url, ' (', heading_skips, ' skips)')"),
    "entity.titles": ("title_length < 10", "url"),
}


def affected_rows(features: DataFrame, order: str, key: str = "site_id") -> DataFrame:
    """``(site, code, ord, item)``: every failing page of every check, one row each."""
    items = ", ".join(
        f"if({fails}, named_struct('code', '{code}', 'item', {item}), NULL)"
        for code, (fails, item) in _AFFECTED.items()
    )
    return (
        features.filter(F.expr(_USABLE))
        .select(key, F.col(order).alias("ord"), F.explode(F.expr(f"array_compact(array({items}))")).alias("a"))
        .select(key, "ord", "a.code", "a.item")
    )


def affected_pages(features: DataFrame, order: str, key: str = "site_id", shown: int = AFFECTED_SHOWN) -> DataFrame:
    """``(site, code, affected, affected_total)`` for display: the first ``shown`` failing pages in crawl order, the count of all.

    All of them are ``affected_rows``. The rank is filtered at once, so each task keeps ``shown`` rows per
    group before the shuffle; the total comes from a combined count.
    """
    failing = affected_rows(features, order, key)
    by_group = Window.partitionBy(key, "code").orderBy("ord", "item")
    first = failing.withColumn("rn", F.row_number().over(by_group)).filter(F.col("rn") <= shown)
    listed = first.groupBy(key, "code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "item"))), lambda x: x["item"]).alias("affected")
    )
    totals = failing.groupBy(key, "code").agg(F.count("*").alias("affected_total"))
    return listed.join(totals, [key, "code"])


def js_reasons(features: DataFrame, order: str, key: str = "site_id", shown: int = 3) -> DataFrame:
    """For display: the first ``shown`` distinct reasons why pages need scripts, in crawl order."""
    reasons = (
        keep_where(features.filter(F.expr(_USABLE)), "js_dependent")
        .groupBy(key, "js_dependent_reason")
        .agg(F.min(order).alias("ord"))
    )
    by_site = Window.partitionBy(key).orderBy("ord", "js_dependent_reason")
    return (
        reasons.withColumn("rn", F.row_number().over(by_site))
        .filter(F.col("rn") <= shown)
        .groupBy(key)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rn", "js_dependent_reason"))),
                lambda r: r["js_dependent_reason"],
            ).alias("reasons")
        )
    )
