"""Recorded answer-engine payloads to ``(text, urls, status)`` rows.

``PROVIDERS`` is the extension point: engine -> function of a DataFrame with a ``payload`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import LOCATION_CODES
from ..functions.fragments import nesting, q
from ..functions.text import lit_map, trim_ws

URLS = "array<struct<url:string,title:string>>"
NO_OVERVIEW = "No AI Overview was shown for this query."

_OPENAI = (
    "output_text string, output array<struct<content:array<struct<text:string,"
    "annotations:array<struct<url:string,title:string>>>>>>"
)
_PERPLEXITY = (
    "choices array<struct<message:struct<content:string>>>, citations array<string>, "
    "search_results array<struct<url:string,title:string>>"
)
# ``content`` of a block is an array of results or an error object, so it stays text until its kind is known.
_ANTHROPIC = (
    "content array<struct<type:string,text:string,citations:array<struct<url:string,title:string>>,content:string>>"
)


# Items stay text until their level is reached, so they may nest as deep as they like.
_SERP = "tasks array<struct<status_code:bigint,status_message:string,result:array<struct<items:array<string>>>>>"
_SERP_ITEM = "title string, text string, references array<struct<url:string,title:string,source:string>>, items array<string>"
_SERP_NODES = "array<struct<path:array<int>,depth:int,item:struct<title:string,text:string,references:array<struct<url:string,title:string,source:string>>,items:array<string>>>>"


def _with_json(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("p", F.from_json("payload", schema))


def _finish(df: DataFrame, text: str, urls: str) -> DataFrame:
    return df.withColumns(
        {"answer": F.coalesce(F.expr(text), F.lit("")), "urls": F.expr(f"cast(coalesce({urls}, array()) AS {URLS})")}
    ).drop("p")


def scan_answers_openai(df: DataFrame) -> DataFrame:
    """Top-level text, then each new content text, blank line between; links from annotations."""
    blocks = "flatten(transform(p.output, o -> coalesce(o.content, array())))"
    texts = (
        "array_distinct(filter(concat(array(p.output_text), "
        f"coalesce(transform({blocks}, c -> c.text), array())), t -> t RLIKE '\\\\S'))"
    )
    links = f"filter(flatten(transform({blocks}, c -> coalesce(c.annotations, array()))), u -> u.url != '')"
    return _finish(_with_json(df, _OPENAI), f"array_join({texts}, '\\n\\n')", links)


def scan_answers_perplexity(df: DataFrame) -> DataFrame:
    """First choice's text; links from citations, then search results."""
    links = (
        "concat(transform(coalesce(p.citations, array()), c -> named_struct('url', c, 'title', cast(NULL AS string))), "
        "filter(coalesce(p.search_results, array()), r -> r.url != ''))"
    )
    return _finish(_with_json(df, _PERPLEXITY), "get(p.choices, 0).message.content", links)


def scan_answers_anthropic(df: DataFrame) -> DataFrame:
    """Text blocks joined; links from text citations and search results, in block order."""
    links = (
        "filter(flatten(transform(p.content, b -> CASE WHEN b.type = 'text' THEN coalesce(b.citations, array()) "
        f"WHEN b.type = 'web_search_tool_result' THEN coalesce(from_json(b.content, '{URLS}'), array()) "
        "ELSE array() END)), u -> u.url != '')"
    )
    texts = "array_join(transform(filter(p.content, b -> b.type = 'text'), b -> b.text), '\\n\\n')"
    return _finish(_with_json(df, _ANTHROPIC), texts, links)


def _serp_nodes(raw: str) -> str:
    """The item ``raw`` and all below it in document order: as many levels as its brackets nest, inside the row."""
    item = f"from_json({{}}, {q(_SERP_ITEM)})"
    root = f"cast(if({raw} IS NULL, array(), array(named_struct('path', cast(array() AS array<int>), 'depth', 0, 'item', {item.format(raw)}))) AS {_SERP_NODES})"
    below = f"transform(coalesce(sn.item.items, array()), (sc, si) -> named_struct('path', array_append(sn.path, si), 'depth', sl, 'item', {item.format('sc')}))"
    level = f"flatten(transform(filter(sa, sf -> sf.depth = sl - 1), sn -> {below}))"
    # An item's children lie two brackets below it.
    return f"array_sort(aggregate(sequence(0, {nesting(raw)} div 2), {root}, (sa, sl) -> cast(concat(sa, {level}) AS {_SERP_NODES})))"


def scan_answers_serp(df: DataFrame) -> DataFrame:
    """The first AI overview of a result page, walked in document order to any depth."""
    overview = "get(filter(get(get(p.tasks, 0).result, 0).items, i -> get_json_object(i, '$.type') = 'ai_overview'), 0)"
    parsed = _with_json(df, _SERP).withColumns(
        {"task_code": F.expr("get(p.tasks, 0).status_code"), "task_message": F.expr("get(p.tasks, 0).status_message"), "overview": F.expr(overview)}
    ).withColumn("nodes", F.expr(_serp_nodes("overview")))
    texts = "flatten(transform(nodes, n -> filter(array(trim(n.item.title), trim(n.item.text)), s -> s != '')))"
    links = (
        "flatten(transform(nodes, n -> transform(filter(coalesce(n.item.references, array()), r -> r.url != ''), "
        "r -> named_struct('url', r.url, 'title', coalesce(r.title, r.source)))))"
    )
    out = _finish(parsed, f"array_join({texts}, '\n')", links)
    return out.withColumn("has_overview", F.col("overview").isNotNull()).drop("overview", "nodes")


PROVIDERS = {
    "chatgpt": scan_answers_openai,
    "perplexity": scan_answers_perplexity,
    "claude": scan_answers_anthropic,
    "google_aio": scan_answers_serp,
}


def scan_answers(recorded: DataFrame) -> DataFrame:
    """Rows of all engines (``engine``, ``payload``, ``http_status``) flattened and given an outcome."""
    flat = None
    for engine, scan in PROVIDERS.items():
        part = scan(recorded.filter(F.col("engine") == engine))
        for name, kind in (("task_code", "bigint"), ("task_message", "string"), ("has_overview", "boolean")):
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast(kind))
        flat = part if flat is None else flat.unionByName(part)
    return answer_status(flat)


def answer_status(flat: DataFrame) -> DataFrame:
    """Adds ``error`` and ``excerpt_override``: failures are rows; a missing overview is a finding, not an error."""
    serp = F.col("engine") == "google_aio"
    blank = trim_ws(F.col("answer")) == ""
    missing = serp & ~F.coalesce("has_overview", F.lit(False))
    error = (
        F.when(
            ~F.col("http_status").between(200, 299),
            F.concat(F.lit("HTTP "), F.col("http_status").cast("string"), F.lit(": "), F.substring("payload", 1, 200)),
        )
        .when(
            serp & (F.col("task_code") >= 40000),
            F.concat(
                F.lit("Task error "), F.col("task_code").cast("string"), F.lit(": "), F.coalesce("task_message", F.lit(""))
            ),
        )
        .when(missing, F.lit(None).cast("string"))
        .when(serp & blank & (F.size("urls") == 0), F.lit("The AI Overview has no readable content"))
        .when(~serp & blank, F.lit("The answer is empty"))
    )
    ok = F.col("http_status").between(200, 299)
    return flat.withColumns(
        {
            "error": error,
            "excerpt_override": F.when(
                ok & missing & ~F.coalesce(F.col("task_code") >= 40000, F.lit(False)), F.lit(NO_OVERVIEW)
            ),
        }
    )


def locale_split(locale: Column) -> Column:
    """``struct(language, country, location_code)``; missing parts are en and GB."""
    parts = F.split(locale, "-", -1)
    country = F.upper(F.coalesce(F.get(parts, 1), F.lit("GB")))
    codes = lit_map(LOCATION_CODES)
    return F.struct(
        F.lower(F.coalesce(F.get(parts, 0), F.lit("en"))).alias("language"),
        country.alias("country"),
        F.coalesce(F.try_element_at(codes, country), F.lit(LOCATION_CODES["GB"])).alias("location_code"),
    )
