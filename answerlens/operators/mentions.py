"""Answer analysis: brand and competitor mentions, order, links, share of voice, sentiment.

A site's dictionary is a row a name. Names and answers meet in an inverted index on first words; an answer is then
analysed in its own row with the names that it may hold, however many its site has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dims import ENGINES, NEGATIVE_TERMS, POSITIVE_TERMS
from ..functions.fragments import collapse_ws, let, q
from ..functions.text import SPACE_CHARS, SPACES
from ..functions.urls import domain_sql, domain_suffixes
from ..session import materialise

EXCERPT = 420
SENTIMENT_REACH = 250
SENTIMENT_HEAD = 600

#: Answers of one site that meet its names in one place; a site with more is dealt over so many places more.
PER_SALT = 10_000

#: Bits of the filter that says which keys of a text can be a name's.
KEY_BITS = 1 << 20

ENTITY = ["ord", "name", "domain", "names", "matcher"]

_NOT_IN_WORD = r"(?<![\p{L}\p{N}])"
_WORD_ENDS = r"(?![\p{L}\p{N}])"


def _name_list(names: str) -> str:
    """Trimmed names of two characters or more, longest first, given order on ties."""
    trimmed = f"filter(transform({names}, nt -> trim(nt)), nf -> length(nf) >= 2)"
    keyed = f"transform({trimmed}, (nn, ni) -> named_struct('k', -length(nn), 'i', ni, 'n', nn))"
    return f"transform(array_sort({keyed}), nk -> nk.n)"


def _name_pattern(name: str) -> str:
    escaped = f"regexp_replace({name}, {q(r'([.*+?^${}()|\[\]\\])')}, {q(r'\\$1')})"
    return f"regexp_replace({escaped}, {q(SPACES)}, {q('[' + SPACE_CHARS.replace(chr(92), chr(92) * 2) + r'\\-]+')})"


def _alternation(patterns: str) -> str:
    return (
        f"if(size({patterns}) > 0, concat({q('(?iu)' + _NOT_IN_WORD + '(?:')}, array_join({patterns}, '|'), "
        f"{q(')' + _WORD_ENDS)}), NULL)"
    )


def _may_overlap(names: str) -> str:
    """Some name ends with the words another begins with, so two matches could share part of a span."""
    not_word = q(r"[^\p{L}\p{N}]+")
    ta, tb = (f"filter(split(lower({n}), {not_word}, -1), w -> w != '')" for n in ("oa", "ob"))
    shared = (
        "exists(sequence(1, least(size(wa), size(wb)) - 1), ok -> slice(wb, size(wb) - ok + 1, ok) = slice(wa, 1, ok))"
    )
    pair = let(ta, "wa", let(tb, "wb", f"if(least(size(wa), size(wb)) > 1, {shared}, false)"))
    return f"exists({names}, oa -> exists({names}, ob -> oa != ob AND {pair}))"


def with_names(df: DataFrame, names: str = "names") -> DataFrame:
    """Adds ``matcher``: what :func:`mentions_sql` needs of a list of names."""
    patterns = f"transform(nl, np -> {_name_pattern('np')})"
    struct = (
        f"named_struct('patterns', pl, 'pattern', {_alternation('pl')}, 'overlaps', {_may_overlap('nl')})"
    )
    return df.withColumn("matcher", F.expr(let(_name_list(names), "nl", let(patterns, "pl", struct))))


def mentions_sql(text: str, matcher: str) -> str:
    """``struct<count, first_index>`` of a text, index 0-based, -1 for none.

    The longest name claims a span first and overlapping matches count once. Where names cannot
    partly overlap, one alternation, longest first, gives the same result in a single scan.
    """
    fast = (
        f"named_struct('count', regexp_count({text}, {matcher}.pattern), "
        f"'first_index', regexp_instr({text}, {matcher}.pattern) - 1)"
    )
    one = f"concat({q('(?iu)' + _NOT_IN_WORD)}, mp, {q(_WORD_ENDS)})"
    start = (
        "aggregate(slice(sp, 1, si + 1), 0, (sa, sx) -> sa + length(sx)) "
        "+ aggregate(slice(sh, 1, si), 0, (sa, sx) -> sa + length(sx))"
    )
    spans = let(
        f"split({text}, {one}, -1)", "sp",
        let(f"regexp_extract_all({text}, {one}, 0)", "sh",
            f"transform(sh, (sm, si) -> {let(start, 'ss', 'named_struct(' + q('s') + ', ss, ' + q('e') + ', ss + length(sm))')})"),
    )
    kind = "array<struct<s:int,e:int>>"
    claim = (
        f"aggregate({matcher}.patterns, cast(array() AS {kind}), (ca, mp) -> cast(concat(ca, filter({spans}, "
        f"cs -> NOT exists(ca, cc -> cs.s < cc.e AND cs.e > cc.s))) AS {kind}))"
    )
    exact = let(
        claim, "cl",
        "named_struct('count', size(cl), 'first_index', coalesce(array_min(transform(cl, cx -> cx.s)), -1))",
    )
    nothing = "named_struct('count', 0, 'first_index', -1)"
    return (
        f"CASE WHEN {text} IS NULL OR {matcher}.pattern IS NULL THEN {nothing} "
        f"WHEN {matcher}.overlaps THEN {exact} ELSE {fast} END"
    )


def count_mentions(df: DataFrame, text: str = "text", names: str = "names") -> DataFrame:
    """Adds ``mentions`` and ``first_index`` of ``names`` in ``text``."""
    return (
        with_names(df, names)
        .withColumn("m", F.expr(mentions_sql(text, "matcher")))
        .withColumns({"mentions": F.col("m.count"), "first_index": F.col("m.first_index")})
        .drop("m", "matcher")
    )


def _fold(token: str) -> str:
    """One form for all spellings that a case-blind match takes as equal."""
    return f"translate(lower(upper({token})), {q(chr(0x307))}, '')"


def _tokens(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, 0), tx -> {_fold('tx')})"


def name_keys_sql(names: str) -> str:
    """What a text must hold for one of ``names`` to match: its first two words, its only word, or nothing for a name without words."""
    key = let(_tokens("kn"), "kt", "array_join(slice(kt, 1, 2), ' ')")
    return f"array_distinct(transform({_name_list(names)}, kn -> {key}))"


def text_keys_sql(text: str) -> str:
    """Every word of a text, every two neighbouring words, and the empty key."""
    pairs = "if(size(tk) > 1, transform(sequence(2, size(tk)), ti -> concat(get(tk, ti - 2), ' ', get(tk, ti - 1))), cast(array() AS array<string>))"
    return let(_tokens(text), "tk", f"array_distinct(concat(tk, {pairs}, array('')))")


def build_dictionary(sites: DataFrame, competitors: DataFrame) -> DataFrame:
    """One row per name to look for: each site's brand (``ord`` 0) and its competitors (1), any number of them."""
    brand = sites.select(
        "site_id",
        F.lit(0).alias("ord"),
        F.col("brand_name").alias("name"),
        "domain",
        F.expr("filter(concat(array(brand_name), coalesce(brand_aliases, array())), n -> n != '')").alias("names"),
    )
    rivals = competitors.select(
        "site_id",
        F.lit(1).alias("ord"),
        "name",
        "domain",
        F.expr("filter(concat(array(name), coalesce(aliases, array())), n -> n != '')").alias("names"),
    )
    return with_names(brand.unionByName(rivals.join(sites.select("site_id"), "site_id", "left_semi")))


def _busy_sites(answers: DataFrame, per_salt: int) -> DataFrame:
    """``(site_id, salts)`` of the sites with more than ``per_salt`` answers; at most a row for so many answers."""
    sizes = answers.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where((F.col("n") > per_salt) & F.col("site_id").isNotNull()).select("site_id", F.floor(F.col("n") / per_salt).cast("int").alias("salts"))


def _dealt(per_site: DataFrame, busy: DataFrame) -> DataFrame:
    """Rows of a site once for each of its salts, as ``salt``."""
    return per_site.join(F.broadcast(busy), "site_id", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 0))"))).drop("salts")


def may_name(asked: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose ``key`` may be one of ``named(key)``: all that are, and few others.

    A bit for each hash of a named key, in one row of 128 KB however many names there are; only the rows that stay are shuffled.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS))
    word, mask = F.floor(place / 64).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {KEY_BITS}) % 64 AS int))")
    none = named.sparkSession.range(KEY_BITS // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = none.unionByName(named.select(word.alias("word"), mask.alias("mask"))).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bits = words.agg(F.expr("transform(array_sort(collect_list(struct(word, mask))), w -> w.mask)").alias("bits"))
    return asked.where(F.get(bits.scalar(), word).bitwiseAND(mask) != 0)


def candidates(answers: DataFrame, dictionary: DataFrame, busy: DataFrame) -> DataFrame:
    """``(answer_no, entities)``: for each answer the competitors that its words or its links can name.

    An inverted index: names are keyed by (site, first words), answers ask with their words, and the two meet by an equi
    join; so do linked domains and their parents. An answer gets what it may mention, not its site's list. Words that are in no
    name are left out before the shuffle.
    ``answers`` carry ``answer_no, site_id, salt, text, links``; names lie at each salt of their site, as a frequent
    word of a busy site is one key.
    """
    rivals = dictionary.where("ord = 1").select("site_id", F.struct(*ENTITY).alias("entity"), "names", "domain")
    words = rivals.select("site_id", "entity", F.explode(F.expr(name_keys_sql("names"))).alias("key"))
    asked = answers.where("text IS NOT NULL").select("answer_no", "site_id", "salt", F.explode(F.expr(text_keys_sql("text"))).alias("key"))
    domain = F.lower(F.regexp_replace("domain", "(?i)^www[.]", ""))
    homes = rivals.where(domain != "").select("site_id", "entity", domain.alias("key"))
    linked = answers.select("answer_no", "site_id", "salt", F.explode("links").alias("l")).where("l.domain != ''")
    linked = linked.select("answer_no", "site_id", "salt", F.explode(domain_suffixes(F.col("l.domain"))).alias("key"))
    at = ["site_id", "salt", "key"]
    asked, linked = may_name(asked, words.select("key")), may_name(linked, homes.select("key")).distinct()
    found = asked.join(_dealt(words, busy), at).select("answer_no", "entity").unionByName(linked.join(_dealt(homes, busy), at).select("answer_no", "entity"))
    return found.distinct().groupBy("answer_no").agg(F.array_sort(F.collect_list("entity")).alias("entities"))  # no more than the answer has words and links for


def build_query(prompts: DataFrame, sites: DataFrame, competitors: DataFrame) -> DataFrame:
    """Prompt with its site's brand and domain, and how many competitors the site has.

    The competitors stay rows of their own (``query_competitors``), once a site and not once a prompt.
    """
    rivals = competitors.groupBy("site_id").agg(F.count("*").alias("n_rivals"))
    site = sites.select("site_id", "brand_name", "brand_aliases", "domain")
    return (
        prompts.select("prompt_id", "site_id", "prompt", "locale")
        .join(site, "site_id")
        .join(rivals, "site_id", "left")
        .withColumn("n_rivals", F.coalesce("n_rivals", F.lit(0)))
    )


def query_competitors(competitors: DataFrame) -> DataFrame:
    """``(site_id, name, domain, aliases)``: what the prompts of a site are compared with."""
    return competitors.select("site_id", "name", "domain", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def _domain_matches(candidate: str, target: str) -> str:
    t = f"lower(regexp_replace({target}, '(?i)^www[.]', ''))"
    return (
        f"coalesce({candidate} != '' AND {t} != '' AND ({candidate} = {t} OR endswith({candidate}, concat('.', {t}))), false)"
    )


def dedupe_urls_sql(urls: str) -> str:
    """First citation of each page, order kept, with its domain."""
    real = f"filter({urls}, du -> du.url != '')"
    key = f"regexp_replace(regexp_replace(dk.url, {q('[#?].*$')}, ''), '/$', '')"
    first = let(
        f"transform(dr, dk -> {key})", "dks",
        "filter(dr, (dx, di) -> array_position(dks, dks[di]) = di + 1)",
    )
    dom = domain_sql("dd.url")
    return let(
        f"coalesce({real}, array())", "dr",
        f"transform({first}, dd -> named_struct('url', dd.url, 'title', dd.title, 'domain', {dom}))",
    )


def excerpt_sql(text: str, index: str) -> str:
    """A window of the collapsed text that starts a third before the mention."""
    start = f"greatest(0, {index} - {EXCERPT // 3})"
    windowed = (
        f"concat(if({start} > 0, '…', ''), trim(substr(xc, {start} + 1, {EXCERPT})), "
        f"if({start} + {EXCERPT} < length(xc), '…', ''))"
    )
    return let(collapse_ws(text), "xc", f"if({index} < 0, substr(xc, 1, {EXCERPT}), {windowed})")


def sentiment_sql(text: str, index: str) -> str:
    """More praise than criticism near the mention, or the reverse, or neutral."""
    def guard(terms: str) -> str:
        return q(f"(?i)(?<![A-Za-z0-9_])(?:{terms})(?![A-Za-z0-9_])")

    near = f"substr({text}, greatest(0, {index} - {SENTIMENT_REACH}) + 1, {index} + {SENTIMENT_REACH} - greatest(0, {index} - {SENTIMENT_REACH}))"
    window = f"if({index} < 0, substr({text}, 1, {SENTIMENT_HEAD}), {near})"
    score = f"regexp_count(sw, {guard(POSITIVE_TERMS)}) - regexp_count(sw, {guard(NEGATIVE_TERMS)})"
    verdict = "CASE WHEN sc > 0 THEN 'positive' WHEN sc < 0 THEN 'negative' ELSE 'neutral' END"
    return let(window, "sw", let(score, "sc", verdict))


def analyse_response(answers: DataFrame, dictionary: DataFrame, absent: bool = True, per_salt: int = PER_SALT) -> DataFrame:
    """Answers (``site_id``, ``answer``, ``urls``, optional ``error``) with the full analysis.

    Errored rows come out uncited with empty lists and are kept. Competitors come from an inverted index
    (:func:`candidates`), so a site may have any number of them. ``competitor_mentions`` holds all of the site's,
    the unmentioned with 0, which puts a list of the site's length into every row; without ``absent`` it holds
    only those that are mentioned or linked. A site with many answers meets its names in many places (``per_salt``).
    """
    rows = answers if "error" in answers.columns else answers.withColumn("error", F.lit(None).cast("string"))
    if "excerpt_override" not in rows.columns:
        rows = rows.withColumn("excerpt_override", F.lit(None).cast("string"))
    brands = dictionary.where("ord = 0").select("site_id", F.col("domain").alias("brand_domain"), F.struct(*ENTITY).alias("brand_entity"))
    # What is one row a site lies in ten times as many places as its names: whole answers meet it, by few keys one task would read many times its share.
    busy, parted = _busy_sites(rows, per_salt), _busy_sites(rows, max(1, per_salt // 10))
    # Answers without a site have no names to meet and are dealt like the others.
    own = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    for place, per in (("salt", busy), ("site_part", parted)):
        rows = rows.join(F.broadcast(per), "site_id", "left").withColumn(place, F.pmod(own, F.expr("if(site_id IS NULL, 64, coalesce(salts, 0) + 1)")).cast("int")).drop("salts")
    joined = rows.join(_dealt(brands, parted).withColumnRenamed("salt", "site_part"), ["site_id", "site_part"], "left")
    # An answer whose site has no dictionary is kept as an errored row.
    orphan = F.col("brand_entity").isNull() & F.col("error").isNull()
    joined = joined.withColumn("error", F.when(orphan, F.lit("The site has no dictionary")).otherwise(F.col("error")))
    # A scan of few splits or a join met in place leaves the answers in few tasks, and each word of an answer becomes a row there.
    numbered = joined.repartition(own).withColumns(
        {
            "answer_no": F.monotonically_increasing_id(),
            "usable": F.expr("error IS NULL AND excerpt_override IS NULL"),
            "text": F.expr("if(error IS NULL AND excerpt_override IS NULL, answer, NULL)"),
            "links": F.expr(
                f"if(error IS NULL AND excerpt_override IS NULL, {dedupe_urls_sql('urls')}, "
                "cast(array() AS array<struct<url:string,title:string,domain:string>>))"
            ),
        }
    )
    numbered = materialise(numbered, "answers")  # the numbers must stay as they are
    usable = numbered.join(candidates(numbered, dictionary, busy), "answer_no", "left")
    usable = usable.withColumn("entities", F.expr("concat(if(brand_entity IS NULL, array(), array(brand_entity)), coalesce(entities, array()))")).drop("brand_entity", "answer_no")
    linked = f"exists(links, lx -> {_domain_matches('lx.domain', 'en.domain')})"
    found = usable.withColumn(
        "found",
        F.expr(
            "transform(entities, (en, ei) -> named_struct('pos', ei, 'name', en.name, 'domain', en.domain, 'names', en.names, 'is_brand', en.ord = 0, "
            f"'m', {mentions_sql('text', 'en.matcher')}, 'linked', {linked}))"
        ),
    ).withColumn(
        "ranked",
        F.expr(
            "transform(array_sort(transform(filter(found, f -> f.m.first_index >= 0), f -> "
            "named_struct('at', f.m.first_index, 'pos', f.pos))), r -> r.pos)"
        ),
    )
    position = "nullif(int(array_position(ranked, f.pos)), 0)"
    totals = found.withColumns(
        {
            "brand": F.expr("get(filter(found, f -> f.is_brand), 0)"),
            "all_mentions": F.expr("aggregate(found, 0, (a, f) -> a + f.m.count)"),
        }
    ).withColumns(
        {
            "brand_mentions": F.col("brand.m.count"),
            "first_index": F.col("brand.m.first_index"),
            "domain_linked": F.col("brand.linked"),
            "brand_position": F.expr(f"get(transform(array(brand), f -> {position}), 0)"),
        }
    )
    kind = "array<struct<name:string,mentions:int,position:int,linked:boolean>>"
    entry = f"named_struct('name', f.name, 'mentions', f.m.count, 'position', {position}, 'linked', f.linked)"
    listed = f"transform(filter(found, f -> NOT f.is_brand), f -> {entry})"
    if absent:
        everyone = dictionary.where("ord = 1").groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("name", "domain", "names"))).alias("everyone"))
        totals = totals.join(_dealt(everyone, parted).withColumnRenamed("salt", "site_part"), ["site_id", "site_part"], "left")
        same = "NOT f.is_brand AND f.name <=> ev.name AND f.domain <=> ev.domain AND f.names <=> ev.names"
        zero = "named_struct('name', ev.name, 'mentions', 0, 'position', cast(NULL AS int), 'linked', false)"
        listed = f"coalesce(transform(everyone, ev -> coalesce(get(transform(filter(found, f -> {same}), f -> {entry}), 0), {zero})), cast(array() AS {kind}))"
    return totals.withColumns(
        {
            "brand_cited": F.expr("brand_mentions > 0 OR domain_linked"),
            "share_of_voice": F.expr(
                "if(all_mentions > 0, floor(brand_mentions / all_mentions * 10000 + 0.5D) / 10000, 0D)"
            ),
            "citation_urls": F.expr(
                f"transform(links, lx -> named_struct('url', lx.url, 'title', lx.title, "
                f"'domain', lx.domain, 'is_brand', {_domain_matches('lx.domain', 'brand_domain')}))"
            ),
            "competitor_mentions": F.expr(f"if(usable, {listed}, cast(array() AS {kind}))"),
            "response_excerpt": F.expr(f"coalesce(excerpt_override, {excerpt_sql('text', 'first_index')}, '')"),
            "sentiment": F.expr(
                f"if(brand_mentions > 0 OR domain_linked, {sentiment_sql('text', 'first_index')}, NULL)"
            ),
        }
    ).drop(
        "entities", "usable", "text", "links", "found", "ranked", "brand", "all_mentions", "brand_domain",
        "excerpt_override", "urls", "everyone", "salt", "site_part",
    )


def join_domain_suffix(cited: DataFrame, targets: DataFrame) -> DataFrame:
    """``(domain)`` rows against ``(target)`` rows: equal or subdomain, as an equi join.

    Each host is exploded to its few dot suffixes instead of testing ``endsWith`` against every target.
    """
    exploded = cited.filter("domain != ''").withColumn("target", F.explode(domain_suffixes(F.col("domain"))))
    return exploded.join(targets, "target")


def engines_for_plan(limit: str) -> str:
    everything = "array(" + ", ".join(f"'{e}'" for e in ENGINES) + ")"
    return f"slice({everything}, 1, {limit})"


def engines_allowed(df: DataFrame, engines: str = "engines", limit: str = "engines_limit") -> DataFrame:
    """Requested engines the plan covers, in requested order, and those it does not."""
    plan = engines_for_plan(limit)
    return df.withColumns(
        {
            "allowed_engines": F.expr(f"filter({engines}, e -> array_contains({plan}, e))"),
            "disallowed_engines": F.expr(f"filter({engines}, e -> NOT array_contains({plan}, e))"),
        }
    )


def fanout_engines(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """One task per prompt and allowed engine, with its recorded answer; a missing one is an error row."""
    tasks = prompts.withColumn("engine", F.explode("allowed_engines"))
    joined = tasks.join(answers.withColumn("_has", F.lit(True)), ["prompt_id", "engine"], "left")
    lost = F.when(F.col("_has").isNull(), F.lit("No answer was recorded"))
    error = F.coalesce("error", lost) if "error" in answers.columns else lost
    return joined.withColumn("error", error).drop("_has")
