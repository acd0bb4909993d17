"""SQL text fragments for the large row-level expressions.

Page analysis is one wide projection. Writing it as SQL text lets the JVM parse each column in one
step; building the same trees call by call from Python costs seconds per plan.
Each helper takes and returns SQL expression text.
"""

from __future__ import annotations

import json
from html.entities import html5

from .text import SPACES

# References that browsers also read without a semicolon in text (but not in attributes).
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BY_LETTER: dict[str, dict[str, str]] = {}  # a map is searched from its start, so names are looked up by their first letter first
for _name, _char in html5.items():
    _BY_LETTER.setdefault(_name[0], {})[_name.removesuffix(";")] = _char
_ENTITIES = json.dumps(_BY_LETTER, ensure_ascii=False)
_CLOSED = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_OPEN = f"^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(_BARE)})"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def nesting(json_text: str) -> str:
    """How deep the brackets of a JSON text nest, at least 1; those in strings do not count."""
    brackets = f"regexp_replace({json_text}, {q(r'(?s)"(?:[^"\\]++|\\.)*+"|[^\[\]{}]+')}, '')"
    return (
        f"coalesce(aggregate(split({brackets}, ''), named_struct('at', 0, 'most', 1), (da, dx) -> CASE WHEN dx IN ('{{', '[') "
        "THEN named_struct('at', da.at + 1, 'most', greatest(da.most, da.at + 1)) WHEN dx IN ('}', ']') "
        "THEN named_struct('at', greatest(da.at - 1, 0), 'most', da.most) ELSE da END, da -> da.most), 1)"
    )


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{SPACES}|{SPACES}$')}, '')"


def collapse_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(SPACES)}, ' '))"


def word_count(collapsed: str) -> str:
    return f"if({collapsed} = '', 0, size(split({collapsed}, ' ', -1)))"


def blank_to_null(x: str) -> str:
    return f"nullif({x}, '')"


def _decode_piece(piece: str, in_text: bool) -> str:
    """``piece`` is the text after an ampersand."""
    ref = f"regexp_extract({piece}, {q(_CLOSED)}, 1)"
    if in_text:
        ref = f"coalesce(nullif({ref}, ''), regexp_extract({piece}, {q(_OPEN)}, 1))"
    number = (
        "if(lower(substr(er, 1, 2)) = '#x', try_cast(conv(substr(er, 3), 16, 10) AS BIGINT), "
        "try_cast(substr(er, 2) AS BIGINT))"
    )
    char = (
        "if(en BETWEEN 1 AND 1114111 AND en NOT BETWEEN 55296 AND 57343, "
        "decode(unhex(lpad(hex(en), 8, '0')), 'UTF-32'), NULL)"
    )
    value = f"if(startswith(er, '#'), {let(number, 'en', char)}, try_element_at(try_element_at(from_json({q(_ENTITIES)}, 'map<string,map<string,string>>'), left(er, 1)), er))"
    return let(ref, "er", f"coalesce(concat(nullif({value}, ''), substr({piece}, length(er) + if(substr({piece}, length(er) + 1, 1) = ';', 2, 1))), concat('&', {piece}))")


def decode_entities(x: str, in_text: bool = True) -> str:
    """HTML character references to characters; the text itself when it has no ampersand."""
    pieces = f"split({x}, '&', -1)"
    decoded = f"transform({pieces}, (ep, ei) -> if(ei = 0, ep, {_decode_piece('ep', in_text)}))"
    return f"if(contains({x}, '&'), array_join({decoded}, ''), {x})"
