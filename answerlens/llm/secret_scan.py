"""Secret scan: fixed patterns and a randomness test battery, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import documents, materialise

#: Kinds in their order: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
}
KINDS = (*BASE, "random")
CANDIDATE = "[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
STAY = 0.9  # chance that a symbol of ordinary text is of the class of the one before, until measured
SHARE = 0.1  # share of random tokens from which the weights of the measured tokens start
WEIGHT = 1000  # weights are whole numbers of this part, so that their sums do not depend on the order
LIMIT_Z = 4.0  # a test beyond so many standard deviations speaks against randomness


def _found(text: Column, name: str, pattern: str, group: int, least: int) -> tuple[list[Column], Column]:
    """Columns with all matches and the texts between them, and the spans that they give by summing lengths."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(f"_m_{name}")
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias(f"_g_{name}")
    gaps = F.when(F.regexp_like(text, F.lit(pattern)), F.split(text, pattern, -1)).alias(f"_s_{name}")
    kind = list(KINDS).index(name)
    spans = F.expr(f"""CASE WHEN size(_m_{name}) = 0 THEN array() ELSE
        filter(aggregate(sequence(1, size(_m_{name})), named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,rank:int,end:int,value:string,counted:int>>)),
          (a, i) -> named_struct('at', a.at + length(_s_{name}[i - 1]) + length(_m_{name}[i - 1]), 'out', array_append(a.out,
            named_struct('start', a.at + length(_s_{name}[i - 1]), 'rank', {kind}, 'end', a.at + length(_s_{name}[i - 1]) + length(_m_{name}[i - 1]),
                         'value', _m_{name}[i - 1], 'counted', length(_g_{name}[i - 1]))))).out, s -> s.counted >= {least}) END""")
    return [hits, values, gaps], spans.alias(f"_{name}")


def _log_ratios(counts: dict[tuple[int, int, int], float]) -> dict[int, list[float]]:
    """For each encoding the logarithm of 1 / k over the chance of symbol b after symbol a in ordinary tokens, at a * size + b.

    ``counts[k, a, b]`` are measured successions; with none of them only ``STAY`` speaks. The chance is that of the
    class (lower, upper, digit, other) after the class before, measured per encoding, times that of the letter
    after the letter before, whatever the case, measured over all encodings. Hexadecimal and base 32 lend up to
    1000 class successions from base 64.
    """

    def kind(k: int, x: str) -> str:
        return "digit" if x.isdigit() else "other" if not x.isalpha() else "upper" if k == 64 and x.isupper() else "lower"

    letters = [[0.0] * 26 for _ in range(26)]
    classes: dict[tuple, float] = {}
    folded: dict[tuple, float] = {}
    for (k, a, b), n in counts.items():
        x, y = ALPHABETS[k][a], ALPHABETS[k][b]
        key = (k, kind(k, x), kind(k, y))
        classes[key] = classes.get(key, 0.0) + n
        if k == 64:
            key = (kind(0, x), kind(0, y))
            folded[key] = folded.get(key, 0.0) + n
        if x.isalpha() and y.isalpha():
            letters[ord(x.lower()) - 97][ord(y.lower()) - 97] += n
    column = [sum(row[i] for row in letters) + 1 for i in range(26)]
    alone = [n / sum(column) for n in column]
    after = [[(n + 20 * u) / (sum(row) + 20) for n, u in zip(row, alone, strict=True)] for row in letters]
    lent = min(1.0, 1000 / max(1.0, sum(folded.values())))
    out = {}
    for k, alphabet in ALPHABETS.items():
        members: dict[str, list[str]] = {}
        for x in alphabet:
            members.setdefault(kind(k, x), []).append(x)
        out[k] = []
        for x in alphabet:
            was = kind(k, x)
            seen = {c: classes.get((k, was, c), 0.0) + (lent * folded.get((was, c), 0.0) if k < 64 else 0.0) for c in members}
            prior = {c: 20 * (STAY if c == was else (1 - STAY) / (len(members) - 1)) for c in members}
            total = sum(seen.values()) + sum(prior.values())
            row = after[ord(x.lower()) - 97] if x.isalpha() else alone
            for y in alphabet:
                c = kind(k, y)
                within = row[ord(y.lower()) - 97] / sum(row[ord(m.lower()) - 97] for m in members[c]) if y.isalpha() else 1 / len(members[c])
                out[k].append(-math.log(k) - math.log((seen[c] + prior[c]) / total * within))
    return out


def _likelihood(c: str, tables: dict[int, list[float]]) -> str:
    """The log likelihood ratio of token ``c``: drawn at random against ordinary, after its first symbol."""
    cases = " ".join(
        f"WHEN {k} THEN aggregate(sequence(1, size({c}.v) - 1), 0D, (a, i) -> a + "
        f"CAST(split('{','.join(f'{x:.6f}' for x in t)}', ',') AS array<double>)[{c}.v[i - 1] * {len(ALPHABETS[k])} + {c}.v[i]])"
        for k, t in tables.items()
    )
    return f"CASE {c}.k {cases} END"


def _ordinary(tested: DataFrame) -> dict[int, list[float]]:
    """The log ratios measured over all tokens, each weighted by the chance that it is an ordinary one.

    At most 66 * 66 successions for each of 3 encodings come back.
    """
    tokens = tested.select(F.explode("_c").alias("c"))
    ratio = _likelihood("c", _log_ratios({}))
    weight = f"IF(c.fair, CAST(round({WEIGHT} / (1 + {SHARE} * exp(least(100D, {ratio})))) AS bigint), {WEIGHT}L)"
    pairs = "explode(transform(sequence(1, size(v) - 1), i -> struct(v[i - 1] AS a, v[i] AS b))) AS x"
    counts = tokens.selectExpr("c.k AS k", "c.v AS v", f"{weight} AS w").where("w > 0").selectExpr("k", "w", pairs).groupBy("k", "x.a", "x.b").agg(F.sum("w").alias("w"))
    return _log_ratios({(r["k"], r["a"], r["b"]): r["w"] / WEIGHT for r in counts.collect()})


def _battery(docs: DataFrame) -> DataFrame:
    """For each candidate: start, end, size of its alphabet, the places of its symbols there, its class of
    alphabet and length, and ``fair``, false where a test of randomness fails.

    The alphabet is the narrowest of hexadecimal, base 32 and base 64 that holds the token. Tests: chi-squared
    of symbol counts (Wilson-Hilferty), runs above and below the middle, serial correlation at lag one.
    """
    k = """CASE WHEN c.value RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16 WHEN c.value RLIKE '^[A-Z2-7]+=*$' THEN 32 ELSE 64 END"""
    alphabet = f"CASE c.k WHEN 16 THEN '{ALPHABETS[16]}' WHEN 32 THEN '{ALPHABETS[32]}' ELSE '{ALPHABETS[64]}' END"
    same = "struct(c.start AS start, c.end AS end, c.k AS k, "
    steps = [
        f"transform(_random, c -> struct(c.start AS start, c.end AS end, {k} AS k, rtrim('=', c.value) AS value))",
        f"transform(_c, c -> {same} transform(filter(split(IF(c.k = 16, lower(c.value), c.value), ''), x -> x <> ''), x -> instr({alphabet}, x) - 1) AS v))",
        f"transform(_c, c -> {same} c.v AS v, CAST(size(c.v) AS double) AS n, aggregate(c.v, 0D, (a, x) -> a + x) / size(c.v) AS mean, "
        "aggregate(array_distinct(c.v), 0D, (a, d) -> a + size(filter(c.v, x -> x = d)) * (size(filter(c.v, x -> x = d)) - 1) / 2D) AS pairs, "
        "CAST(size(filter(c.v, x -> 2 * x >= c.k)) AS double) AS high, "
        "1D + size(filter(sequence(1, size(c.v) - 1), i -> (2 * c.v[i] >= c.k) <> (2 * c.v[i - 1] >= c.k))) AS runs))",
        f"transform(_c, c -> {same} c.v AS v, c.n AS n, c.k * (2 * c.pairs + c.n) / c.n - c.n AS chi, c.runs AS runs, "
        "2 * c.high * (c.n - c.high) / c.n AS mixed, "
        "aggregate(sequence(1, size(c.v) - 1), 0D, (a, i) -> a + (c.v[i] - c.mean) * (c.v[i - 1] - c.mean)) / "
        "greatest(aggregate(c.v, 0D, (a, x) -> a + (x - c.mean) * (x - c.mean)), 1e-9D) AS serial))",
        f"transform(_c, c -> {same} c.v AS v, c.n AS n, "
        "(pow(greatest(c.chi, 0D) / (c.k - 1), 1 / 3D) - (1 - 2D / (9 * (c.k - 1)))) / sqrt(2D / (9 * (c.k - 1))) AS z_chi, "
        "(c.runs - 1 - c.mixed) / sqrt(greatest(c.mixed * (c.mixed - 1) / (c.n - 1), 1e-9D)) AS z_runs, c.serial * sqrt(c.n) AS z_serial))",
        f"transform(_c, c -> {same} c.v AS v, concat_ws('-', c.k, least(20, CAST(2 * log2(c.n) AS int))) AS class, "
        f"c.z_chi <= {LIMIT_Z} AND abs(c.z_runs) <= {LIMIT_Z} AND abs(c.z_serial) <= {LIMIT_Z} AS fair))",
    ]
    for step in steps:
        docs = docs.withColumn("_c", F.expr(step))
    return docs.drop("_random")


def _judged(tested: DataFrame) -> DataFrame:
    """For each candidate: start, end, class and ``bin``, minus ten times the decimal logarithm of p, rounded down.

    Over ordinary tokens the mean of the likelihood ratio is 1, so a ratio of r or more has a chance of 1 / r
    at most: p is 1 / r, and 1 where a test of randomness fails.
    """
    ratio = _likelihood("c", _ordinary(tested))
    bin_ = f"IF(c.fair, CAST(floor(least(300D, greatest(0D, ({ratio}) * 10 / ln(10D)))) AS int), 0)"
    return tested.withColumn("_c", F.expr(f"transform(_c, c -> struct(c.start AS start, c.end AS end, c.class AS class, {bin_} AS bin))"))


def _thresholds(tested: DataFrame, level: float) -> dict[str, int]:
    """For each class of alphabet and length the least bin that Benjamini and Hochberg's rule accepts.

    A bin counts as its largest p. At most 3 alphabets times 20 lengths come back.
    """
    bins = tested.select(F.explode("_c").alias("c")).groupBy("c.class", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("bin"))
    ranked = bins.select("class", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("class")).alias("all"))
    good = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10.0) * F.col("all") <= level * F.col("rank"))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.min("bin").alias("bin")).collect()}


def find_secrets(docs: DataFrame, level: float = 0.01, keep_text: bool = True) -> DataFrame:
    """Adds ``secrets``, an array of (start, end, kind) in code points, to each row of ``docs(text)``.

    The kinds ``assign``, ``access`` and ``hex`` are fixed patterns, found left to right without overlap per
    kind. ``random`` are further tokens of 20 or more symbols that look drawn at random and not as the ordinary
    tokens of the table do; among the tokens of one alphabet and length the share of ordinary ones is held to
    ``level``, so rare secrets need a clearer result. They never overlap a fixed one. Null and empty texts have none; repeated rows are equal. The
    columns come back as they were, with a column ``secrets`` replaced; without ``keep_text`` the text stays
    out of the table between the two passes and of the result.
    """
    docs = docs.drop("secrets")
    own = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    stages = [_found(text, name, *rule) for name, rule in BASE.items()] + [_found(text, "random", CANDIDATE, 0, 20)]
    first = docs.select(*own, *[c for columns, _ in stages for c in columns])
    second = first.select(*own, *[spans for _, spans in stages])
    plain = F.array_sort(F.flatten(F.array(*[F.transform(f"_{name}", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))) for name in BASE])))
    third = second.select(*own, plain.alias("_base"), "_random")
    apart = F.filter("_random", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = _judged(materialise(_battery(third.withColumn("_random", apart)), "tested"))
    least = _thresholds(tested, level)
    known = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else None
    random = F.filter("_c", lambda c: (c["bin"] >= F.element_at(known, c["class"])) if least else F.lit(False))
    extra = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(BASE)).alias("rank"), c["end"].alias("end")))
    every = F.array_sort(F.concat("_base", extra))
    names = F.array(*[F.lit(n) for n in KINDS])
    named = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), names[s["rank"]].alias("kind")))
    return tested.select(*own, named.alias("secrets"))


def redacted(text: str = "text", secrets: str = "secrets", mark: str = "[secret]") -> Column:
    """The text with each span of ``secrets`` replaced; overlapping spans become one mark."""
    return F.expr(f"""CASE WHEN size({secrets}) = 0 THEN {text} ELSE aggregate({secrets}, named_struct('at', 0, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out',
          IF(s.start >= a.at AND NOT (s.start = a.at AND a.at > 0), concat(a.out, substring({text}, a.at + 1, s.start - a.at), '{mark}'), a.out)),
        a -> concat(a.out, substring({text}, a.at + 1))) END""")


def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null and empty texts have no span; texts are scanned whole, repeated rows row by row, null ids are kept. Spans that start
    together are ordered by kind. Further columns are not read; an empty table gives no rows.
    """
    out = find_secrets(documents(spark, sf_dir, "doc_id", "text"), keep_text=False)

    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
