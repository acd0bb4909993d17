"""Page features: map-only, one row in, one row out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import jsonld as J
from ..functions.fragments import blank_to_null, decode_entities, let, q, trim_ws, word_count
from ..functions.links import base_parts, normalise_links
from ..functions.text import blank_to_null as null_if_blank
from ..sources.pages import body_cap, body_is_truncated, page_gate

_HREFS = f"filter(transform({H.tags('doc', 'a')}, ht -> {H.attr('ht', 'href')}), hx -> hx != '')"
_CANONICAL = f"filter({H.tags('doc', 'link')}, ct -> {H.attr('ct', 'rel')} = 'canonical')"
_NOINDEX = q("(?<![a-z0-9_])noindex(?![a-z0-9_])")
_TITLE = trim_ws(decode_entities(H.first_inner("doc", "title")))
_AUTHOR_CHAIN = (
    f"coalesce({J.find_string('nodes', 'author')}, {H.meta_content('meta', 'name', 'author')}, {H.rel_author_text('doc')})"
)
_DATE_CHAIN = (
    f"coalesce({J.find_string('nodes', 'dateModified', 'datePublished')}, "
    f"{H.meta_content('meta', 'property', 'article:modified_time')}, {H.meta_content('meta', 'name', 'last-modified')})"
)
_JS_REASON = """CASE WHEN error IS NOT NULL THEN NULL
    WHEN spa_root_empty AND word_count < 200 THEN 'The mount point of a script framework is empty in the HTML'
    WHEN word_count < 120 AND script_count >= 3
      THEN concat('The HTML holds ', word_count, ' words and ', script_count, ' scripts')
    WHEN noscript_plea THEN 'A noscript block asks for JavaScript'
    WHEN visible_ratio < 0.03D AND word_count < 300
      THEN concat('Visible text is ', floor(visible_ratio * 1000 + 0.5D) / 10, '% of the HTML') END"""

# Stages of (column, SQL); each stage may use columns of the stages before it, so costly
# intermediates (comment-free source, visible text, outline, JSON-LD nodes) are computed once.
STAGES: list[dict[str, str]] = [
    {"html": H.strip_comments(H.close_tail("body"))},
    {
        "doc": H.strip_scripts("html"),
        "main": H.strip_blocks(H.body_of("html")),
        "ld": J.blocks("html"),
        "noscript_plea": f"{H.noscript_text('html')} RLIKE {q(H.ENABLE_JS)}",
    },
    {
        "visible_text": H.node_text("main"),
        "outline": H.headings("doc"),
        "nodes": J.nodes("ld"),
        "meta": H.metas("doc"),
        "title": blank_to_null(_TITLE),
        "first_paragraph": H.first_paragraph("main"),
        "base": base_parts("url"),
        "hrefs": _HREFS,
    },
    {
        "title_length": "coalesce(length(title), 0)",
        "meta_description": trim_ws(H.meta_content("meta", "name", "description")),
        "h1": blank_to_null(H.node_text(H.first_inner("doc", "h1"))),
        "h1_count": H.count_tags("doc", "h1"),
        "heading_outline": "outline",
        "heading_skips": H.heading_skips("outline"),
        "question_headings": H.question_headings("outline"),
        "word_count": word_count("visible_text"),
        "visible_ratio": "if(length(body) > 0, length(visible_text) / length(body), 0D)",
        "jsonld_blocks": "size(ld)",
        "jsonld_invalid": f"size(ld) - {J.valid_count('nodes')}",
        "jsonld_types": J.types("nodes"),
        "same_as": J.same_as("nodes"),
        "details_count": H.count_tags("doc", "details"),
        "list_count": H.count_tags("doc", "ul|ol"),
        "table_count": H.count_tags("doc", "table"),
        "script_count": f"size(filter({H.tags('doc', 'script')}, st -> {H.attr('st', 'src')} IS NOT NULL))",
        "spa_root_empty": H.spa_root_empty("doc"),
        "date_modified": _DATE_CHAIN,
        "author": blank_to_null(_AUTHOR_CHAIN),
        "canonical": let("get(canonicals, 0)", "ca", H.attr("ca", "href")).replace("canonicals", _CANONICAL),
        "noindex": f"coalesce(lower({H.meta_content('meta', 'name', 'robots')}) RLIKE {_NOINDEX}, false)",
        "internal_links": f"if(error IS NULL, array_distinct({normalise_links('hrefs', 'base')}), "
        "cast(array() AS array<string>))",
    },
    {
        "text_ratio": "floor(visible_ratio * 10000 + 0.5D) / 10000",
        "has_faq_schema": f"exists(jsonld_types, ft -> ft RLIKE {q('(?i)^(FAQPage|QAPage)$')})",
        "has_direct_answer": f"{word_count('first_paragraph')} BETWEEN 15 AND 80",
        "js_dependent_reason": _JS_REASON,
    },
    {
        "js_dependent": "js_dependent_reason IS NOT NULL",
        "has_faq": "has_faq_schema OR details_count >= 2 OR question_headings >= 2 OR "
        f"visible_text RLIKE {q(H.FAQ_PHRASE)}",
    },
]
FEATURES = [
    "title", "title_length", "meta_description", "h1", "h1_count", "heading_outline", "heading_skips",
    "word_count", "text_ratio", "js_dependent", "js_dependent_reason", "jsonld_blocks", "jsonld_invalid",
    "jsonld_types", "same_as", "has_faq_schema", "has_faq", "question_headings", "has_direct_answer",
    "list_count", "table_count", "script_count", "spa_root_empty", "date_modified", "author", "canonical",
    "noindex", "internal_links", "visible_text",
]
_DEPENDENCIES = {
    "html": ["body"], "doc": ["html"], "main": ["html"], "ld": ["html"], "noscript_plea": ["html"],
    "visible_text": ["main"], "outline": ["doc"], "nodes": ["ld"], "meta": ["doc"], "title": ["doc"],
    "first_paragraph": ["main"], "base": [], "hrefs": ["doc"], "title_length": ["title"],
    "meta_description": ["meta"], "h1": ["doc"], "h1_count": ["doc"], "heading_outline": ["outline"],
    "heading_skips": ["outline"], "question_headings": ["outline"], "word_count": ["visible_text"],
    "visible_ratio": ["visible_text"], "jsonld_blocks": ["ld"], "jsonld_invalid": ["ld", "nodes"],
    "jsonld_types": ["nodes"], "same_as": ["nodes"], "details_count": ["doc"], "list_count": ["doc"],
    "table_count": ["doc"], "script_count": ["doc"], "spa_root_empty": ["doc"],
    "date_modified": ["nodes", "meta"], "author": ["nodes", "meta", "doc"], "canonical": ["doc"],
    "noindex": ["meta"], "internal_links": ["hrefs", "base"], "text_ratio": ["visible_ratio"],
    "has_faq_schema": ["jsonld_types"], "has_direct_answer": ["first_paragraph"],
    "js_dependent_reason": ["spa_root_empty", "word_count", "script_count", "noscript_plea", "visible_ratio"],
    "js_dependent": ["js_dependent_reason"],
    "has_faq": ["has_faq_schema", "details_count", "question_headings", "visible_text"],
}


def _closure(wanted: Iterable[str]) -> set[str]:
    need, todo = set(), list(wanted)
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += _DEPENDENCIES.get(name, [])
    return need


def page_features(pages: DataFrame, only: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Features of every page; a page that cannot be analysed carries ``error`` and empty features.

    ``only`` names the features wanted and keeps the plan as small as they allow. Identifying columns
    pass through and page bodies are dropped. Whole bodies are analysed; ``cap`` cuts them at so many bytes.
    """
    wanted = only or FEATURES
    need = _closure(wanted)
    keep = [c for c in pages.columns if c not in ("body", "final_url", "error", "url")]
    error = page_gate(F.col("error"), F.col("body"), F.col("content_type"))
    stage = pages.select(
        *keep,
        F.coalesce(null_if_blank(F.col("final_url")), F.col("url")).alias("url"),
        error.alias("error"),
        body_is_truncated(F.col("body"), cap).alias("truncated"),
        F.when(error.isNull(), body_cap(F.col("body"), cap)).otherwise(F.lit("")).alias("body"),
    )
    for columns in STAGES:
        exprs = {k: F.expr(v) for k, v in columns.items() if k in need}
        if exprs:
            stage = stage.withColumns(exprs)
    return stage.select(*keep, "url", "error", "truncated", *wanted)


def keep_where(features: DataFrame, condition: str) -> DataFrame:
    """Rows whose features satisfy ``condition``.

    A plain filter would be pushed below the projection and repeat the feature's whole expression
    tree for every use of it; a generator is evaluated after the features and drops the other rows.
    """
    return features.withColumn("_kept", F.explode(F.expr(f"if({condition}, array(true), array())"))).drop("_kept")
