"""JSON-LD extraction as SQL fragments.

A page's blocks are walked inside the row: one ``aggregate`` that appends the children of the
last level, as many times as the deepest block nests. No recursion over a table, no shuffle, no row explosion.
"""

from __future__ import annotations

from .fragments import blank_to_null, let, nesting, q, trim_ws
from .html import TAG_END, attr

NODES = "array<struct<path:array<int>,depth:int,raw:string>>"
_NO_NODES = f"cast(array() AS {NODES})"
_NO_STRINGS = "cast(array() AS array<string>)"
_OBJECT = q(r"^\s*\{")
_CONTAINER = q(r"^\s*[\[{]")
_OPEN = rf"<script(?=[\s>/]){TAG_END}"
_SCRIPT = rf"(?is){_OPEN}.*?(?:</script\s*>|\z)"


def blocks(no_comments: str) -> str:
    """Ordered non-blank bodies of the JSON-LD scripts."""
    scripts = f"regexp_extract_all({no_comments}, {q(_SCRIPT)}, 0)"
    kind = attr("js.open", "type")
    opened = f"transform({scripts}, jo -> named_struct('open', regexp_extract(jo, {q(f'(?is)^{_OPEN}')}, 0), 'whole', jo))"
    typed = f"filter({opened}, js -> lower(trim({kind})) = 'application/ld+json')"
    raw = f"transform({typed}, jt -> regexp_replace(substr(jt.whole, length(jt.open) + 1), {q(r'(?is)</script\s*>$')}, ''))"
    found = f"filter(transform({raw}, jb -> {trim_ws('jb')}), jf -> jf != '')"
    return f"if(contains({no_comments}, 'ld+json'), {found}, {_NO_STRINGS})"


def _children(n: str) -> str:
    """Objects and arrays directly below a node, in source order."""
    values = (
        f"if({n}.raw RLIKE {_OBJECT}, map_values(from_json({n}.raw, 'map<string,string>')), "
        f"from_json({n}.raw, 'array<string>'))"
    )
    numbered = (
        f"transform(coalesce({values}, {_NO_STRINGS}), (cv, ci) -> named_struct("
        f"'path', array_append({n}.path, ci), 'depth', {n}.depth + 1, 'raw', cv))"
    )
    return f"filter({numbered}, ck -> ck.raw RLIKE {_CONTAINER})"


def nodes(ld_blocks: str) -> str:
    """Every object and array of every block that parses, in document (depth-first) order."""
    roots = (
        f"cast(filter(transform({ld_blocks}, (rb, ri) -> named_struct('path', array(ri), "
        f"'depth', 0, 'raw', rb)), rn -> try_parse_json(rn.raw) IS NOT NULL AND rn.raw RLIKE {_CONTAINER}) AS {NODES})"
    )
    level = f"flatten(transform(filter(na, nn -> nn.depth = nl - 1), nc -> {_children('nc')}))"
    walked = f"aggregate(sequence(1, {nesting(f'array_join({ld_blocks}, {q(chr(32))})')}), {roots}, (na, nl) -> cast(concat(na, {level}) AS {NODES}))"
    return f"if(size({ld_blocks}) > 0, array_sort({walked}), {_NO_NODES})"


def _strings_at(raw: str, key: str) -> str:
    """The string, or the strings of the array, under ``key`` of an object."""
    path = q(f'$["{key}"]')
    strings = (
        f"transform(filter(try_variant_get(sv, {path}, 'array<variant>'), sx -> schema_of_variant(sx) = 'STRING'), "
        "sy -> try_variant_get(sy, '$', 'string'))"
    )
    by_kind = (
        f"CASE WHEN sk = 'STRING' THEN array(try_variant_get(sv, {path}, 'string')) "
        f"WHEN startswith(sk, 'ARRAY') THEN {strings} END"
    )
    kind = f"schema_of_variant(try_variant_get(sv, {path}, 'variant'))"
    return f"coalesce({let(f'try_parse_json({raw})', 'sv', let(kind, 'sk', by_kind))}, {_NO_STRINGS})"


def _holders(ld_nodes: str, key: str) -> str:
    quoted = q(f'"{key}"')
    return f"filter({ld_nodes}, ho -> contains(ho.raw, {quoted}) AND ho.raw RLIKE {_OBJECT})"


def _strings_anywhere(ld_nodes: str, key: str) -> str:
    return f"array_distinct(flatten(transform({_holders(ld_nodes, key)}, sn -> {_strings_at('sn.raw', key)})))"


def types(ld_nodes: str) -> str:
    """Distinct ``@type`` strings in first-seen order."""
    return _strings_anywhere(ld_nodes, "@type")


def same_as(ld_nodes: str) -> str:
    return _strings_anywhere(ld_nodes, "sameAs")


def valid_count(ld_nodes: str) -> str:
    """Blocks that parse and state at least one ``@type``."""
    typed = f"filter({_holders(ld_nodes, '@type')}, vn -> size({_strings_at('vn.raw', '@type')}) > 0)"
    return f"size(array_distinct(transform({typed}, vt -> vt.path[0])))"


def find_string(ld_nodes: str, *keys: str) -> str:
    """First non-blank string under any of ``keys``, own keys before children, depth-first."""
    options = []
    for key in keys:
        at, name = q(f'$["{key}"]'), q(f'$["{key}"]["name"]')
        own = (
            f"if(schema_of_variant(try_variant_get(fv, {at}, 'variant')) = 'STRING', "
            f"{blank_to_null(trim_ws(f'try_variant_get(fv, {at}, {q('string')})'))}, NULL)"
        )
        named = (
            f"if(schema_of_variant(try_variant_get(fv, {name}, 'variant')) = 'STRING', "
            f"{blank_to_null(trim_ws(f'try_variant_get(fv, {name}, {q('string')})'))}, NULL)"
        )
        options += [own, named]
    value = let("try_parse_json(fn.raw)", "fv", f"coalesce({', '.join(options)})")
    mentions = " OR ".join(f"contains(fh.raw, {q(f'"{k}"')})" for k in keys)
    holders = f"filter({ld_nodes}, fh -> fh.raw RLIKE {_OBJECT} AND ({mentions}))"
    return f"get(filter(transform({holders}, fn -> {value}), fw -> fw IS NOT NULL), 0)"
