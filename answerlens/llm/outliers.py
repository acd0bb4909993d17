"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import WORD_GAP, documents, materialise

SYMBOLS = "#*$%&|<>"
WIDTH = 8
GRID = 256  # bins per unit of a transformed statistic
DIMS = ("x_length", "x_word", "x_symbols", "x_variety", "x_upper", "x_line")
#: Median of the chi-squared distribution with len(DIMS) degrees of freedom (Wilson-Hilferty).
CHI_MEDIAN = len(DIMS) * (1 - 2 / (9 * len(DIMS))) ** 3
FLOOR = 0.05  # standard deviation added to each statistic, so that one that never varies has a scale


def word_statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every whole ``text``; null counts as empty.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_types and n_upper and drops
    the text. Windows of ``WIDTH`` words are compared by a 64-bit hash within one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    kept = [F.col(c) for c in keep]
    first = docs.select(
        *kept,
        F.array_remove(F.split(text, WORD_GAP), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    windows = F.expr(f"CASE WHEN size(_words) >= {WIDTH} THEN transform(sequence(1, size(_words) - {WIDTH - 1}), i -> xxhash64(slice(_words, i, {WIDTH}))) ELSE array() END")
    second = first.select(
        *kept, "n_symbols", "n_upper", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_types"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_win"),
    )
    twice = F.size(F.array_distinct("_win")) < F.size("_win")
    third = second.withColumn("_sorted", F.when(twice, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_win")
    at = F.expr(
        "array_sort(filter(transform(_sorted, (x, k) -> CASE WHEN (k > 0 AND _sorted[k - 1].h = x.h) "
        "OR (k < size(_sorted) - 1 AND _sorted[k + 1].h = x.h) THEN x.i END), p -> p IS NOT NULL))"
    )
    covered = F.expr(
        f"aggregate(_at, named_struct('e', 0L, 'n', 0L), (s, p) -> named_struct('e', p + {WIDTH}L, 'n', s.n + p + {WIDTH}L - greatest(s.e, CAST(p AS BIGINT))), s -> s.n)"
    )
    return third.withColumn("_at", at).drop("_sorted").withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_at")


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector ``DIMS``: logarithms of sizes, square roots of shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return stats.select(
        "*", F.log1p("n_words").alias("x_length"), F.log(chars / words).alias("x_word"), F.sqrt(F.col("n_symbols") / chars).alias("x_symbols"),
        (F.log(F.greatest("n_types", F.lit(1)) / words)).alias("x_variety"), F.sqrt(F.col("n_upper") / chars).alias("x_upper"),
        F.log1p(F.col("n_words") / F.greatest("n_lines", F.lit(1))).alias("x_line"),
    )


def _quantile(rows: DataFrame, keys: list[str], value: Column, share: float, into: str) -> DataFrame:
    """A quantile by group from exact counts of grid bins: combined before the shuffle, the same in any order."""
    bins = rows.select(*keys, F.floor(value * GRID).alias("_bin")).groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    run = bins.select(*keys, "_bin", F.sum("_n").over(up).alias("_run"), F.sum("_n").over(whole).alias("_all"))
    return run.where(F.col("_run") >= F.col("_all") * share).groupBy(*keys).agg(((F.min("_bin") + 0.5) / GRID).alias(into))


def _melt(rows: DataFrame, value) -> DataFrame:
    return rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), value(x).alias("v")) for i, x in enumerate(DIMS)])).alias("s")).select("g", "s.d", "s.v")


def _wide(long: DataFrame, name: str) -> DataFrame:
    return long.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("d", "q"))).alias("m")).select("g", *[F.col("m")[i].alias(f"{name}{i}") for i in range(len(DIMS))])


def _factor(params: DataFrame) -> DataFrame:
    """The Cholesky factor l_i_j of the covariances c_i_j, one row per group."""
    for j in range(len(DIMS)):
        for i in range(j, len(DIMS)):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            params = params.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return params.select("g", *[f"m{i}" for i in range(len(DIMS))], *[f"l_{i}_{j}" for i in range(len(DIMS)) for j in range(i + 1)])


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution; the group's row is joined by size."""
    own = rows.columns
    out = rows.join(params, "g", "left")
    for i, x in enumerate(DIMS):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
    total = F.col("_y0") * F.col("_y0")
    for i in range(1, len(DIMS)):
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return out.withColumn("d2", total).select(*own, "d2")


def mcd_outliers(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), coverage: float = 0.75, steps: int = 3, cutoff: float = 90.0, least: int = 100) -> DataFrame:
    """Base rules and outlier verdict for each row of ``docs(text, lang, source)``.

    Rows that pass the base rules are fitted by language and source: from medians and median absolute
    deviations, ``steps`` concentration steps each keep the ``coverage`` share of rows nearest to the last
    estimate and take their mean and covariance, which lowers the determinant. Distances are scaled so that
    their median is that of a chi-squared variable; a row above ``cutoff`` is rejected. A group of fewer
    than ``least`` rows is fitted with its whole language; a language of fewer is not judged, its rows are
    kept. Null language or source is a group of its own; null text has no words and fails the base rules;
    repeated rows count each. Returns ``keep``, the counts, base_failed, kept, distance.
    """
    keep = tuple(dict.fromkeys((*keep,)))
    named = docs.select(*[F.col(c) for c in keep], F.coalesce("lang", F.lit("\u0000")).alias("_lang"), F.coalesce("source", F.lit("\u0000")).alias("_source"), "text")
    counts = word_statistics(named, (*keep, "_lang", "_source"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    table = materialise(transformed(counts.withColumn("base_failed", failed)), "statistics")
    sizes = table.where("NOT base_failed").groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    langs = sizes.groupBy("_lang").agg(F.sum("_n").alias("_all"))
    place = F.when(F.col("_n") >= least, F.to_json(F.array("_lang", "_source"))).when(F.col("_all") >= least, F.to_json(F.array("_lang")))
    groups = materialise(sizes.join(langs, "_lang").select("_lang", "_source", place.alias("g")), "groups")
    grouped = table.join(groups, ["_lang", "_source"], "left")
    # Small groups' languages are fitted on all rows of the language.
    fit = grouped.where("NOT base_failed AND g IS NOT NULL").select("g", "_lang", *DIMS)
    pooled = groups.where(F.col("g") == F.to_json(F.array("_lang"))).select("_lang", F.col("g").alias("pool")).distinct()
    large = fit.where(F.col("g") != F.to_json(F.array("_lang"))).join(pooled, "_lang").select(F.col("pool").alias("g"), *DIMS)
    fit = materialise(fit.select("g", *DIMS).unionByName(large), "vectors")
    n = len(DIMS)
    med = _quantile(_melt(fit, F.col), ["g", "d"], F.col("v"), 0.5, "q")
    medians = materialise(_wide(med, "m"), "medians")
    off = fit.join(medians, "g").select("g", *[F.abs(F.col(x) - F.col(f"m{i}")).alias(x) for i, x in enumerate(DIMS)])
    mads = _wide(_quantile(_melt(off, F.col), ["g", "d"], F.col("v"), 0.5, "q"), "s")
    start = medians.join(mads, "g")
    for i in range(n):
        for j in range(i + 1):
            start = start.withColumn(f"c_{i}_{j}", F.pow(F.col(f"s{i}") * 1.4826, 2) + FLOOR**2 if i == j else F.lit(0.0))
    params = materialise(_factor(start), "estimate")
    squeeze = F.log2(F.col("d2") + 1)
    for _ in range(steps):
        far = _distance(fit, params)
        reach = _quantile(far, ["g"], squeeze, coverage, "reach")
        near = far.join(reach, "g").where(squeeze <= F.col("reach")).join(medians, "g")
        at = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(DIMS)]
        sums = near.groupBy("g").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"t{i}") for i, a in enumerate(at)],
            *[F.sum(at[i] * at[j]).alias(f"p_{i}_{j}") for i in range(n) for j in range(i + 1)],
        ).join(medians, "g")
        params = materialise(_factor(sums.select(
            "g", *[(F.col(f"m{i}") + F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(n)],
            *[(F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("n") / F.col("n") + (FLOOR**2 if i == j else 0.0)).alias(f"c_{i}_{j}")
              for i in range(n) for j in range(i + 1)],
        )), "estimate")
    middle = materialise(_quantile(_distance(fit, params), ["g"], squeeze, 0.5, "mid"), "scale")
    judged = _distance(grouped, params).join(middle, "g", "left")
    scale = (F.pow(F.lit(2.0), "mid") - 1) / CHI_MEDIAN
    distance = F.col("d2") / F.greatest(scale, F.lit(1e-6))
    out = judged.withColumn("distance", distance)
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance",
    )


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null, empty and blank texts have zero counts and fail the base rule. Texts are counted whole, repeated rows row
    by row; null ids, languages and sources are kept as they are. Further columns are not read; an empty table gives no rows.
    """
    return mcd_outliers(documents(spark, sf_dir, "doc_id", "text", "lang", "source")).drop("distance")
