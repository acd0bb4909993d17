"""HTML extraction as SQL fragments. All native; nothing here leaves the JVM.

A tag that never ends runs to the end of the page (``close_tail`` cuts it first). Every pattern consumes a
page once, so a page full of unclosed tags stays linear.
"""

from __future__ import annotations

from .fragments import collapse_ws, decode_entities, let, q, trim_ws, word_count

# The rest of a tag up to its end; quoted values may hold ">". A quote that is never closed counts as a
# plain character. Possessive, so nothing is scanned twice.
TAG_END = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+>"""
# Attributes before the wanted one.
_BEFORE = r"""(?:[^<>"'\s]++|\s|"[^"]*+"|'[^']*+')*?\s"""

# Elements whose text is not page content; mount points of script frameworks.
STRIPPED = "script|style|noscript|template|svg|iframe|nav|footer|header|aside"
#: Elements that shape the tree around stripped ones, and block elements that end a drawing they stand in.
_STRUCTURE = (
    STRIPPED + "|foreignobject|address|article|blockquote|button|center|details|dialog|div|dl|dd|dt|fieldset|figcaption|figure|form|"
    "h[1-6]|hgroup|li|main|menu|object|ol|p|pre|section|summary|table|caption|tbody|thead|tfoot|tr|td|th|ul"
)
_KEPT_STACK = 4096  # characters of open elements, some 600 of them; browsers keep 512
_LEAVES_SVG = "'blockquote', 'center', 'dd', 'div', 'dl', 'h1', 'li', 'menu', 'ol', 'p', 'pre', 'table', 'ul'"
MOUNT_IDS = ["root", "__next", "app", "application"]
QUESTION_START = r"(?i)^(who|what|when|where|why|how|which|can|do|does|is|are|should|will)(?![A-Za-z0-9_])"
FAQ_PHRASE = r"(?i)(?<![A-Za-z0-9_])(frequently asked questions|faqs?)(?![A-Za-z0-9_])"
ENABLE_JS = r"(?i)(?<![A-Za-z0-9_])(enable|turn on) javascript(?![A-Za-z0-9_])"
_P_END = (
    r"</p\s*>|<(?:p|div|ul|ol|dl|table|h[1-6]|section|article|blockquote|pre|form|hr|fieldset|"
    r"address|main|figure|details|center|menu|header|footer|nav|aside)[\s>/]|</(?:div|section|article|main|body|li|td)\s*>|\z"
)


def close_tail(html: str) -> str:
    """Without a tag at the end of the page that is never closed."""
    tail = f"substring_index({html}, '>', -1)"
    cut = f"concat(left({html}, length({html}) - length(ct)), regexp_replace(ct, {q(r'(?s)<[/!?A-Za-z].*')}, ''))"
    return let(tail, "ct", f"if(contains(ct, '<'), {cut}, {html})")


def strip_comments(html: str) -> str:
    return f"if(contains({html}, '<!--'), regexp_replace({html}, {q(r'(?s)<!--.*?(?:-->|\z)')}, ''), {html})"


def strip_scripts(html: str) -> str:
    """Drop the contents of script and style, keeping the opening tags."""
    return f"regexp_replace({html}, {q(rf'(?is)(<(script|style)(?=[\s>/]){TAG_END}).*?(?:</\2\s*>|\z)')}, '$1')"


def strip_tags(html: str) -> str:
    return f"regexp_replace({html}, {q('<[/!?A-Za-z]' + TAG_END)}, '')"


def node_text(html: str) -> str:
    """Text of a fragment: tags removed, references decoded, white space collapsed."""
    return let(strip_tags(html), "nt", collapse_ws(decode_entities("nt")))


def body_of(no_comments: str) -> str:
    """From after the body tag; without one, everything but the head."""
    after = f"regexp_replace({no_comments}, {q(rf'(?is)\A.*?<body(?=[\s>/]){TAG_END}')}, '')"
    headless = f"regexp_replace({no_comments}, {q(rf'(?is)<(head|title)(?=[\s>/]){TAG_END}.*?</\1\s*>')}, '')"
    return f"if({no_comments} RLIKE {q(r'(?i)<body[\s>/]')}, {after}, {headless})"


def _stack_step(piece: str) -> str:
    """State of the walk after a piece that starts with a tag of ``_STRUCTURE``; ``st`` holds open elements, outermost first.

    A heading of any level is ``h1``, a header cell ``td``, a term ``dd``. ``wo.raw`` names an element whose content is no markup.
    """
    tok = "concat('|', tn, ';')"
    rest = f"substring_index(st, {tok}, -1)"
    popped = f"left(st, length(st) - length({rest}) - length({tok}))"

    def pop_if(clear: str) -> str:
        return f"if(contains(st, {tok}) AND NOT {rest} RLIKE {q(clear)}, {popped}, st)"

    scope = r"\|(?:table|td|template|object|foreignobject);"
    closing = (
        f"CASE WHEN tn IN ('template', 'svg') THEN {pop_if('a^')} WHEN tn = 'table' THEN {pop_if(r'\|template;')} "
        f"WHEN tn = 'td' THEN {pop_if(r'\|(?:table|template);')} WHEN tn = 'li' THEN {pop_if(scope + r'|\|(?:ol|ul);')} "
        f"ELSE {pop_if(scope)} END"
    )
    table = "substring_index(st, '|table;', -1)"
    in_table = f"contains(st, '|table;') AND NOT contains({table}, '|template;')"
    to_table = f"left(st, length(st) - length({table}))"
    item = f"concat(if(contains(st, {tok}) AND {rest} RLIKE {q(r'^(?:\|(?:div|address);)*$')}, {popped}, st), {tok})"
    opening = (
        f"CASE WHEN tn = 'p' THEN st WHEN tn IN ('li', 'dd') THEN {item} "
        f"WHEN tn = 'h1' THEN concat(if(endswith(st, '|h1;'), left(st, length(st) - 4), st), '|h1;') "
        f"WHEN tn IN ('td', 'tr') THEN if({in_table}, concat({to_table}, if(tn = 'td', '|td;', '')), st) "
        f"WHEN tn IN ('svg', 'foreignobject') AND wp RLIKE {q(r'^<[^>]*/>')} THEN st ELSE concat(st, {tok}) END"
    )
    svg = "substring_index(wo.st, '|svg;', -1)"
    left_svg = f"if(contains(wo.st, '|svg;') AND NOT contains({svg}, '|foreignobject;') AND tn IN ({_LEAVES_SVG}), left(wo.st, length(wo.st) - length({svg}) - 5), wo.st)"
    same = "named_struct('st', {0}, 'raw', {1}, 'over', wo.over)"
    # Beyond the depth that is kept, tags are only counted: each start is taken to meet its end, a stripped one its next.
    deep = "NOT te AND tn IN ('template', 'svg', 'nav', 'footer', 'header', 'aside')"
    beyond = f"if({deep}, named_struct('st', wo.st, 'raw', tn, 'over', wo.over), named_struct('st', wo.st, 'raw', '', 'over', wo.over + if(te, -1, 1)))"
    return (
        "CASE WHEN wo.raw != '' THEN if(te AND tn = wo.raw, " + same.format("wo.st", "''") + ", " + same.format("wo.st", "wo.raw") + ") "
        "WHEN tn IN ('script', 'style', 'iframe', 'noscript') THEN " + same.format("wo.st", "if(te, '', tn)") + " "
        f"WHEN wo.over > 0 OR (NOT te AND length(wo.st) > {_KEPT_STACK}) THEN {beyond} "
        "WHEN te THEN " + let("wo.st", "st", same.format(closing, "''")) + " ELSE " + let(left_svg, "st", same.format(opening, "''")) + " END"
    )


def strip_blocks(body: str) -> str:
    """Without the stripped elements, as a parser sees them in markup that is unclosed or wrongly nested.

    A walk over the structural tags with a stack of open elements: an end tag closes its element and all in it where that is
    in scope, else nothing; items, cells and rows end those before them; text elements run to their own end tag; block
    elements leave a drawing. Inline elements cannot end a stripped one and are passed over. Only where stripped
    content begins and ends is noted, and the pieces between are joined once.
    """
    pieces = f"split(concat(' ', {body}), {q(rf'(?i)(?=</?(?:{_STRUCTURE})[\s>/])')}, -1)"
    name = (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(wp, {q('^</?([A-Za-z]+[1-6]?)')}, 1)), "
        "'^h[1-6]$', 'h1'), '^th$|^caption$', 'td'), '^dt$', 'dd'), '^t(?:body|head|foot)$', 'tr')"
    )
    tag = let(name, "tn", let("startswith(wp, '</')", "te", let("named_struct('st', wa.st, 'raw', wa.raw, 'over', wa.over)", "wo", _stack_step("wp"))))
    hidden = f"ws.raw != '' OR ws.st RLIKE {q(r'\|(?:template|svg|nav|footer|header|aside);')}"
    noted = "named_struct('st', ws.st, 'raw', ws.raw, 'over', ws.over, 'hid', wh, 'at', wa.at + 1, 'cuts', if(wh = wa.hid, wa.cuts, array_append(wa.cuts, wa.at)))"
    step = f"if(wa.at = 0, named_struct('st', wa.st, 'raw', wa.raw, 'over', 0, 'hid', wa.hid, 'at', 1, 'cuts', wa.cuts), {let(tag, 'ws', let(hidden, 'wh', noted))})"
    start = "named_struct('st', '', 'raw', '', 'over', 0, 'hid', false, 'at', 0, 'cuts', cast(array() AS array<int>))"
    ranges = (
        "array_join(transform(filter(concat(array(0), cuts), (c, i) -> i % 2 = 0), (c, i) -> "
        "array_join(slice(bp, c + 1, coalesce(get(cuts, 2 * i), size(bp)) - c), '')), '')"
    )
    walked = let(f"aggregate(bp, {start}, (wa, wp) -> {step}, wa -> wa.cuts)", "cuts", f"if(size(cuts) = 0, array_join(bp, ''), {ranges})")
    return f"substr({let(pieces, 'bp', walked)}, 2)"


def attr(tag: str, name: str) -> str:
    """Attribute of an opening tag, references decoded; NULL when absent, '' without a value."""
    pattern = q(rf"""(?i)[\s"']{name}(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s>/]))""")
    quoted = q("""^["']""")
    bare = f"if(av RLIKE {quoted}, substr(av, 2, length(av) - 2), av)"
    value = let(f"regexp_extract({tag}, {pattern}, 1)", "av", let(bare, "ab", decode_entities("ab", in_text=False)))
    return f"if({tag} RLIKE {pattern}, {value}, NULL)"


def tags(doc: str, name: str) -> str:
    """Opening tags of one element, in order."""
    return f"regexp_extract_all({doc}, {q(rf'(?i)<{name}(?=[\s>/]){TAG_END}')}, 0)"


def count_tags(doc: str, names: str) -> str:
    return f"regexp_count({doc}, {q(rf'(?i)<(?:{names})(?=[\s>/])')})"


def first_inner(doc: str, name: str) -> str:
    return f"regexp_extract({doc}, {q(rf'(?is)<{name}(?=[\s>/]){TAG_END}(.*?)(?:</{name}\s*>|\z)')}, 1)"


def metas(doc: str) -> str:
    fields = ", ".join(f"'{k}', {attr('mt', k)}" for k in ("name", "property", "content"))
    return f"transform({tags(doc, 'meta')}, mt -> named_struct({fields}))"


def meta_content(meta: str, key: str, value: str) -> str:
    """Content of the first meta tag whose ``key`` equals ``value``."""
    return f"get(filter({meta}, mm -> mm.{key} = '{value}'), 0).content"


def headings(doc: str) -> str:
    """Ordered non-empty headings as ``array<struct<level, text>>``."""
    raw = f"regexp_extract_all({doc}, {q(r'(?is)<h[1-6](?=[\s>/])' + TAG_END + r'.*?(?:</h[1-6]\s*>|\z)')}, 0)"
    parsed = f"transform({raw}, hd -> named_struct('level', int(substr(hd, 3, 1)), 'text', {node_text('hd')}))"
    return f"filter({parsed}, hh -> hh.text != '')"


def heading_skips(outline: str) -> str:
    """Adjacent rises of more than one level."""
    return (
        f"size(filter(transform({outline}, (hc, hi) -> "
        f"hi > 0 AND hc.level - get({outline}, hi - 1).level > 1), hs -> hs))"
    )


def question_headings(outline: str) -> str:
    return f"size(filter({outline}, hq -> hq.text RLIKE {q(QUESTION_START)} OR endswith(hq.text, '?')))"


def first_paragraph(stripped_body: str) -> str:
    return node_text(f"regexp_extract({stripped_body}, {q(rf'(?is)<p(?=[\s>/]){TAG_END}(.*?)(?:{_P_END})')}, 1)")


def _inner_balanced(doc: str, opening: str) -> str:
    """Inner HTML of the first element matching ``opening``, same-tag nesting respected."""
    name = f"lower(regexp_extract({doc}, {q(f'(?is){opening}')}, 1))"
    rest = f"regexp_extract({doc}, {q(rf'(?is){opening}(.*)\z')}, 2)"
    pieces = f"split(concat(' ', {rest}), concat('(?i)(?=</?', {name}, {q(r'[\s>/])')}), -1)"
    # The first piece is what follows the opening tag (a space keeps it apart from a tag at once);
    # the piece that closes the element is left out.
    walk = (
        "aggregate(bp, named_struct('depth', 1, 'kept', 0), (wa, wp) -> if(wa.depth <= 0, wa, named_struct("
        "'depth', wa.depth + if(startswith(wp, '</'), -1, if(wa.kept > 0, 1, 0)), 'kept', wa.kept + 1)), "
        "wa -> if(wa.depth <= 0, wa.kept - 1, wa.kept))"
    )
    return let(pieces, "bp", f"array_join(slice(bp, 1, {walk}), '')")


def spa_root_empty(doc: str) -> str:
    """A framework mount point holds fewer than 30 words."""
    patterns = [
        (i, rf"""<([a-z][a-z0-9\-]*){_BEFORE}id\s*=\s*(?:"{i}"|'{i}'|{i}(?=[\s>])){TAG_END}""") for i in MOUNT_IDS
    ]
    patterns.append(("data-reactroot", r"<([a-z][a-z0-9\-]*)" + _BEFORE + r"data-reactroot(?=[\s=>/])" + TAG_END))
    patterns.append(("astro-island", r"<(astro-island)(?=[\s>/])" + TAG_END))
    tests = []
    for word, p in patterns:
        few = let(node_text(_inner_balanced(doc, p)), "mt", f"{word_count('mt')} < 30")
        tests.append(f"if(contains({doc}, '{word}') AND {doc} RLIKE {q(f'(?i){p}')}, {few}, false)")
    return "(" + " OR ".join(tests) + ")"


def noscript_text(html: str) -> str:
    blocks = f"regexp_extract_all({html}, {q(rf'(?is)<noscript(?=[\s>/]){TAG_END}(.*?)(?:</noscript\s*>|\z)')}, 1)"
    return f"if({html} RLIKE '(?i)<noscript', {strip_tags(f'array_join({blocks}, {q('')})')}, '')"


def rel_author_text(doc: str) -> str:
    pattern = r"""(?is)<([a-z][a-z0-9]*)""" + _BEFORE + r"""rel\s*=\s*(?:"author"|'author'|author(?=[\s>]))""" + TAG_END + r"(.*?)(?:</\1\s*>|\z)"
    inner = strip_tags(f"regexp_extract({doc}, {q(pattern)}, 2)")
    return f"if(contains({doc}, 'author'), {let(inner, 'ra', trim_ws(decode_entities('ra')))}, '')"
