"""Link resolution as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fragments import let, q
from .urls import ASSET_PATH, SKIP_SCHEMES, TRACKING_PARAM

_PATH_UNSAFE = "\"<>`{}^"
_QUERY_UNSAFE = "\"<>'"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {q('^([A-Za-z][A-Za-z0-9+.-]*):')}, 1))"


def _host(u: str) -> str:
    authority = f"regexp_extract({u}, {q(r'(?i)^[a-z][a-z0-9+.-]*:[/\\]{2,}([^/\\?#]*)')}, 1)"
    host = f"lower(regexp_replace({authority}, '^.*@', ''))"
    port = f"if({_scheme(u)} = 'https', ':(443)?$', ':(80)?$')"
    return f"if({_scheme(u)} IN ('http', 'https'), regexp_replace({host}, {port}, ''), '')"


def base_parts(page_url: str) -> str:
    """What link resolution needs to know of a page's own URL."""
    path = f"regexp_extract({page_url}, {q(r'(?i)^[a-z][a-z0-9+.-]*:[/\\]{2,}[^/\\?#]*([^?#]*)')}, 1)"
    query = f"regexp_extract({page_url}, {q(r'^[^?#]*(\?[^#]*)')}, 1)"
    return (
        f"named_struct('scheme', {_scheme(page_url)}, 'host', {_host(page_url)}, "
        f"'path', coalesce(nullif({path}, ''), '/'), 'query', {query})"
    )


def _percent_encode(x: str, also: str) -> str:
    """Escape what a browser escapes in this part of a URL; the text itself when it is plain."""
    unsafe = q(rf"[^!-~]|[{also}]")
    coded = (
        f"array_join(transform(split({x}, ''), ec -> if(ec RLIKE {unsafe}, "
        f"replace(url_encode(ec), '+', '%20'), ec)), '')"
    )
    return f"if({x} RLIKE {unsafe}, {coded}, {x})"


def _drop_dot_segments(path: str) -> str:
    one, two = q(r"(?i)^(\.|%2e)$"), q(r"(?i)^(\.|%2e){2}$")
    fold = (
        "aggregate(ds, cast(array() AS array<string>), (da, dx) -> CASE "
        f"WHEN dx RLIKE {two} THEN slice(da, 1, greatest(size(da) - 1, 0)) WHEN dx RLIKE {one} THEN da "
        "ELSE concat(da, array(dx)) END)"
    )
    tail = f"if(size(dk) > 0 AND element_at(ds, -1) RLIKE {q(r'(?i)^(\.|%2e){1,2}$')}, '/', '')"
    joined = let(f"split(substr({path}, 2), '/', -1)", "ds", let(fold, "dk", f"concat('/', array_join(dk, '/'), {tail})"))
    return f"if({path} RLIKE {q(r'(?i)/(\.|%2e){1,2}(/|$)')}, {joined}, {path})"


def normalise_links(hrefs: str, base: str) -> str:
    """Resolve each href against ``base``; keep crawlable same-host pages, order kept.

    Successive ``transform`` stages, so that each works on values already computed.
    """
    cleaned = (
        f"filter(transform({hrefs}, lh -> regexp_replace(translate(lh, '\\t\\n\\r', ''), "
        f"{q(r'^[\x00-\x20]+|[\x00-\x20]+$')}, '')), lk -> NOT lk RLIKE {q(SKIP_SCHEMES)})"
    )
    absolute = (
        f"CASE WHEN lf RLIKE {q(r'(?i)^https?:[/\\]{2}')} THEN lf "
        f"WHEN lf RLIKE {q('^[A-Za-z][A-Za-z0-9+.-]*:')} THEN '' "
        f"WHEN lf RLIKE {q(r'^[/\\]{2}')} THEN concat({base}.scheme, ':', lf) "
        f"WHEN lf RLIKE {q(r'^[/\\]')} THEN concat({base}.scheme, '://', {base}.host, lf) "
        f"WHEN lf = '' THEN concat({base}.scheme, '://', {base}.host, {base}.path, {base}.query) "
        f"WHEN startswith(lf, '?') THEN concat({base}.scheme, '://', {base}.host, {base}.path, lf) "
        f"ELSE concat({base}.scheme, '://', {base}.host, regexp_replace({base}.path, '[^/]*$', ''), lf) END"
    )
    resolved = f"transform(transform({cleaned}, l0 -> regexp_replace(l0, '(?s)#.*$', '')), lf -> {absolute})"
    path = f"translate(regexp_extract(lu, {q(r'(?i)^[a-z]+:[/\\]{2,}[^/\\?#]*([^?#]*)')}, 1), {q('\\')}, '/')"
    parts = (
        f"transform({resolved}, lu -> named_struct('scheme', {_scheme('lu')}, 'host', {_host('lu')}, "
        f"'path', coalesce(nullif({path}, ''), '/'), "
        f"'query', regexp_extract(lu, {q(r'^[^?#]*\?([^#]*)')}, 1), 'asked', contains(lu, '?')))"
    )
    here = f"filter({parts}, lp -> lp.host != '' AND lp.host = {base}.host)"
    dotless = (
        f"transform({here}, lp -> named_struct('scheme', lp.scheme, 'host', lp.host, "
        f"'path', {_drop_dot_segments('lp.path')}, 'asked', lp.asked, 'params', split(lp.query, '&', -1)))"
    )
    pages = f"filter({dotless}, lp -> NOT lp.path RLIKE {q(ASSET_PATH)})"
    kept = (
        f"transform({pages}, lp -> named_struct('scheme', lp.scheme, 'host', lp.host, 'asked', lp.asked, "
        f"'path', if(lp.path = '/', '/', coalesce(nullif(regexp_replace(lp.path, '/+$', ''), ''), '/')), "
        f"'n', size(lp.params), 'kept', filter(lp.params, lq -> NOT lq RLIKE {q(TRACKING_PARAM)})))"
    )
    # Once a parameter has been dropped the rest is written anew, as a form is: name=value, spaces as plus signs.
    name, value = "regexp_extract(fp, '(?s)^([^=]*)', 1)", "regexp_extract(fp, '(?s)=(.*)$', 1)"
    coded = [f"url_encode(coalesce(try_url_decode({v}), {v}))" for v in (name, value)]
    anew = f"array_join(transform(filter(lp.kept, fe -> fe != ''), fp -> concat({coded[0]}, '=', {coded[1]})), '&')"
    as_is = let("array_join(lp.kept, " + q("&") + ")", "lj", _percent_encode("lj", _QUERY_UNSAFE))
    query = (
        "if(NOT lp.asked OR (size(lp.kept) = 0 AND lp.n > 0), '', "
        f"concat('?', if(size(lp.kept) < lp.n, {anew}, {as_is})))"
    )
    return (
        f"transform({kept}, lp -> concat(lp.scheme, '://', lp.host, {_percent_encode('lp.path', _PATH_UNSAFE)}, {query}))"
    )


def normalise_link(href: str, page_url: str) -> Column:
    """Scalar form over two columns; NULL when the link is not followed."""
    return F.expr(let(base_parts(page_url), "bu", f"get({normalise_links(f'array({href})', 'bu')}, 0)"))
