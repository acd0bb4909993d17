"""Periodic runs of words: the dictionary of basic factors proposes periods, which are extended and deduplicated."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, with_column

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys that occur twice or more, by (group of equal keys, position), and the group of each."""
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, "i8")
    sizes = np.diff(np.append(new, len(key)))
    group = np.repeat(np.arange(len(sizes)), sizes)
    many = sizes[group] > 1
    return order[many], group[many]


def basic_factors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2, 4, ...: (length, name by place, places of repeated factors by name, their names).

    Equal factors have equal names below n; a factor that occurs once is named n plus its place. Only
    factors whose two halves both repeat are sorted again, and the lengths end when nothing repeats.
    """
    n = len(words)
    size, key, where = 1, words.astype("i8"), np.arange(n)
    while len(where):
        order, group = _repeated(key)
        places = where[order]
        if not len(places):
            return
        name = np.arange(n, 2 * n, dtype="i4" if n < 1 << 30 else "i8")
        name[places] = group
        yield size, name, places, group
        where = np.sort(places[places + 2 * size <= n])
        where = where[name[where + size] < n]
        key = name[where].astype("i8") * (2 * n) + name[where + size]
        size *= 2


def _proposals(size: int, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for the periods from ``size`` up to twice ``size`` that occurrences of one factor suggest.

    Successors at most half a factor apart form progressions, whose common difference is the factor's own
    period. Inside one progression a distance of ``size`` or more is a multiple of that period and so no
    smallest one. Between two of them the distances are again a progression. Progressions of a factor start
    more than half of it apart, so only the next three lie within twice its length.
    """
    linked = (group[1:] == group[:-1]) & (2 * (places[1:] - places[:-1]) <= size)
    begin = np.flatnonzero(np.concatenate([[True], ~linked]))
    end = np.append(begin[1:], len(places)) - 1
    first, last, name, steps = places[begin], places[end], group[begin], end - begin
    own = np.where(steps > 0, (last - first) // np.maximum(steps, 1), 0)
    out = []
    for ahead in range(1, 4):
        a = np.arange(len(first) - ahead) if len(first) > ahead else np.empty(0, "i8")
        b = a + ahead
        near = (name[a] == name[b]) & (first[b] - last[a] < 2 * size)
        a, b = a[near], b[near]
        gap, by = first[b] - last[a], np.maximum(own[a], own[b])
        one = np.maximum(by, 1)
        low = np.maximum(0, -(-(size - gap) // one))
        high = np.where(by > 0, np.minimum(steps[a] + steps[b], (2 * size - 1 - gap) // one), 0)
        count = np.maximum(0, high - low + 1)
        at = np.repeat(np.arange(len(a)), count)
        m = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + low[at]
        out.append((last[a][at] - np.minimum(m, steps[a][at]) * by[at], gap[at] + m * by[at]))
    place, period = (np.concatenate(v) for v in zip(*out, strict=True))
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # Two proposals of one period at most a factor apart share more than a period, so they are one run.
    keep = np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] - place[:-1] > size)]) if len(place) else np.empty(0, bool)
    return place[keep], period[keep]


def runs_of(words: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal runs of at least two periods and ``least`` words, in order."""
    n = len(words)
    levels, proposed = [], []
    for size, name, places, group in basic_factors(words):
        levels.append((size, name))
        proposed.append(_proposals(size, places, group))
    if not levels:
        return (np.empty(0, "i8"),) * 3
    place, period = (np.concatenate(v).astype("i8") for v in zip(*proposed, strict=True))
    start, end = place.copy(), place.copy()
    for size, name in reversed(levels):  # no equal stretch is as long as twice the longest repeated factor
        ok = end + period + size <= n
        ok[ok] = name[end[ok]] == name[end[ok] + period[ok]]
        end[ok] += size
        ok = start >= size
        ok[ok] = name[start[ok] - size] == name[start[ok] - size + period[ok]]
        start[ok] -= size
    end += period
    whole = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.empty(0, bool)
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _batch(texts: list[str | None], least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each text; all words of the batch are one sequence, and no word of two texts is equal."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(s) for s in split], "i8")
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids, kinds = pd.factorize(np.fromiter((w for s in split for w in s), object, first[-1])) if first[-1] else (np.empty(0, "i8"), [])
    text_of = np.repeat(np.arange(len(texts)), sizes)
    start, end, period = runs_of(text_of * (len(kinds) + 1) + ids, least)
    edge = np.zeros(first[-1] + 1, "i4")
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge)[:-1] == 0
    owner = text_of[start] if len(start) else np.empty(0, "i8")
    runs: list[list[dict]] = [[] for _ in texts]
    for o, s, e, p in zip(owner.tolist(), (start - first[owner]).tolist(), (end - first[owner]).tolist(), period.tolist(), strict=True):
        runs[o].append({"start": s, "length": e - s, "period": p})
    collapsed = []
    for k, s in enumerate(split):
        left = s if not runs[k] else [w for w, stays in zip(s, keep[first[k] : first[k + 1]].tolist(), strict=True) if stays]
        collapsed.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return runs, collapsed


def find_runs(docs: DataFrame, least: int = 12, batch_chars: int = 1_000_000) -> DataFrame:
    """Adds ``runs`` (start, length, period in words, by start, then period) and ``collapsed`` to ``docs(text)``.

    A run is a maximal stretch of words with smallest period q, at least two periods and ``least`` words long.
    ``collapsed`` joins by one space the words that are in no run after its first period. Columns of these two
    names are replaced, all others are kept. Map-only: texts of about ``batch_chars`` characters together, or one
    longer text, are in memory with a table of a number a word for each power of two up to the longest repeat. Each row is
    judged alone, so copies and repeated rows get the same answer. Null, empty and blank texts have no
    run and an empty ``collapsed``. An empty table stays empty.
    """
    docs = docs.drop("runs", "collapsed")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= batch_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                runs, collapsed = _batch(texts[at:stop], least)
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, kind), pa.array(collapsed, pa.string())], [*batch.schema.names, "runs", "collapsed"])
                at = stop

    return docs.mapInArrow(run, ", ".join([*kept, f"runs {RUNS}", "collapsed string"]))


def repeat_tail(docs: DataFrame) -> DataFrame:
    """Replaces ``text``: where crc32 of the id ends in the digit 0 the words from one on repeat with a period drawn from the same number."""

    def text(i: int | None, t: str | None) -> str | None:
        h = zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 or not t:
            return t
        words, g = t.encode("utf-8", "surrogatepass").split(), h // 10
        n = len(words)
        if not n:
            return t
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        tail = words[a : a + p]
        return b" ".join(words[:a] + (tail * -(-(n - a) // p))[: n - a]).decode("utf-8", "surrogatepass")

    def column(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([text(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)], pa.string())

    return with_column(docs, "_tail", "string", column).withColumn("text", F.col("_tail")).drop("_tail")


def op13_basic_factor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: number of runs, the longest, and digests of all runs and of the collapsed text.

    Null, empty and blank texts have no run: four nulls and the digests of empty text. A null id counts as
    empty text in crc32. Equal lengths go to the smallest start, then period. Repeated rows are answered
    row by row, very long texts whole. Only ``doc_id`` and ``text`` are read; an empty table gives no rows.
    """
    found = find_runs(repeat_tail(documents(spark, sf_dir, "doc_id", "text")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.expr("(-1000 * best.l) div best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
