"""Suffix-array deduplication with a run-length index: bytes that lie in long strings seen earlier are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, materialise

GRAM = 24  # bytes of an anchor
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1  # place of a null id: after all others
ROW = "a long, h long, dk long, th long, start long, n long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), "u8")
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:-rest], v[rest:]) if rest else v


class Stretcher:
    """Cuts texts into stretches of windows with the same anchor.

    The anchor of a window of ``length`` bytes is its ``GRAM``-byte string of least hash (the leftmost of
    equals), so equal windows have equal anchors at equal places, wherever they stand.
    """

    def __init__(self, length: int):
        self.length, self.width = length, length - GRAM + 1
        self.table = _mixed(np.arange(1, 257, dtype="u8") * np.uint64(BASE))
        self.up = self.down = np.ones(1, "u8")

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Anchor, hash of the whole stretch, text number, first window's start in its text, windows."""
        raw = np.frombuffer(b"".join(texts), "u1")
        n, length = len(raw), self.length
        if n < length:
            return tuple(np.empty(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
        if len(self.up) <= n:
            self.up, self.down = _powers(BASE, 2 * n), _powers(pow(BASE, -1, 1 << 64), 2 * n)
        run = np.concatenate([np.zeros(1, "u8"), np.cumsum(self.table[raw] * self.up[:n])])
        gram = _mixed((run[GRAM:] - run[:-GRAM]) * self.down[: n - GRAM + 1])
        low = _sliding_min((gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype="u8"), self.width)
        at = (low & np.uint64(0xFFFFFFFF)).astype("i8")
        sizes = np.array([len(t) for t in texts], "i8")
        text = np.repeat(np.arange(len(texts)), sizes)
        inside = text[: len(at)] == text[length - 1 :]
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1 : len(at)] != text[: len(at) - 1])])
        first = np.flatnonzero(inside & (new | np.concatenate([[True], ~inside[:-1]])))
        if not len(first):
            return tuple(np.empty(0, t) for t in ("u8", "u8", "i8", "i8", "i8"))
        count = np.concatenate([[0], np.cumsum(inside)])
        windows = count[np.concatenate([first[1:], [len(at)]])] - count[first]
        whole = (run[first + windows - 1 + length] - run[first]) * self.down[first]
        shape = ((at[first] - first) * 4096 + windows).astype("u8")
        h = _mixed(_mixed(whole) + shape * np.uint64(BASE))
        begin = np.cumsum(sizes) - sizes
        return gram[at[first]], h, text[first], first - begin[text[first]], windows


def _stretches(length: int, flush: int):
    """Stretches of a partition: of equal ones within ``flush`` bytes of text only the earliest goes on; runs of the rest are already covered (n < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Stretcher(length)
        got: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[bytes, int, int]] = []
        sizes = [0, 0]

        def take() -> None:
            a, h, t, start, n = cutter.cut([x[0] for x in held])
            dk, th = np.array([x[1] for x in held], "i8"), np.array([x[2] for x in held], "i8")
            got.append((a, h, dk[t], th[t], start, n))
            held.clear()
            sizes[0] = 0

        def emit() -> pa.RecordBatch:
            a, h, dk, th, start, n = (np.concatenate(v) for v in zip(*got, strict=True))
            got.clear()
            sizes[1] = 0
            order = np.lexsort((start, dk, h))
            hs, ds, ss = h[order], dk[order], start[order]
            lead = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.empty(0, bool)
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(hs) else np.empty(0, "i8")
            same = ~lead & (ds == ds[head]) & (ss == ss[head])  # the same row again
            keep = order[lead]
            done = np.sort(order[~lead & ~same])  # back in the order of the texts
            d, w, s, k = dk[done], th[done], start[done], n[done]
            if len(done):
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (s[1:] != s[:-1] + k[:-1])])
                f = np.flatnonzero(new)
                d, w, s, k = d[f], w[f], s[f], -np.add.reduceat(k, f)
            spread = _mixed(d.astype("u8") + s.astype("u8"))
            cols = [np.concatenate([a[keep], spread]).view("i8"), np.concatenate([h[keep], np.zeros(len(d), "u8")]).view("i8")]
            cols += [np.concatenate([x[keep], y]) for x, y in ((dk, d), (th, w), (start, s), (n, k))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "h", "dk", "th", "start", "n"])

        for batch in batches:
            for text, dk, th in zip(batch.column("text").to_pylist(), batch.column("dk").to_pylist(), batch.column("th").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= length:
                    held.append((raw, dk, th))
                    sizes[0] += len(raw)
                    sizes[1] += len(raw)
                    if sizes[0] > 1_000_000:
                        take()
                    if sizes[1] > flush:
                        if held:
                            take()
                        yield emit()
        if held:
            take()
        if got:
            yield emit()

    return run


def _whole_anchors(batches: Iterator[pa.RecordBatch], columns: list[str], most: int, weight=None) -> Iterator[pa.Table]:
    """Tables of several whole anchors; rows come ordered by ``a``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += weight(batch) if weight else batch.num_rows
        if size >= most:
            t = pa.Table.from_batches(held).select(columns).combine_chunks()
            a = t.column("a").to_numpy()
            end = int(np.searchsorted(a, a[-1]))
            if end:
                yield t.slice(0, end)
                t = t.slice(end)
            held = t.to_batches()
            size = sum(weight(b) if weight else b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).select(columns).combine_chunks()


def _first_of_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal stretches all but the earliest are covered (n < 0). An earliest one stays open (n > 0) if its anchor has other stretches."""
    names = ["a", "h", "dk", "th", "start", "n"]
    for t in _whole_anchors(batches, names, 200_000):
        a, h, dk, th, start, n = (t.column(c).to_numpy() for c in names)
        done = n < 0
        lead = np.concatenate([[True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])
        head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        same = ~lead & (dk == dk[head]) & (start == start[head])
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        kinds = np.add.reduceat((lead & ~done).astype("i8"), first)
        several = np.repeat(kinds > 1, np.diff(np.concatenate([first, [len(a)]])))
        covered = ~done & ~lead & ~same
        out = done | covered | (lead & several & ~done)
        n = np.where(covered, -n, n)
        yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (a, h, dk, th, start, n)], names)


class RunLengthIndex:
    """Suffix order of byte strings up to ``length`` bytes, and its transform compressed to runs.

    ``group`` numbers the positions by their next ``length`` bytes. The transform is the byte before each
    suffix; the suffixes at the ends of its runs are the samples. A group that lies in one run is preceded by
    one byte, so where the group one to the left is as large, both hold the same places, shifted: what is
    known of a position then holds for its left neighbour. Only the other positions are looked up.
    """

    def __init__(self, strings: list[bytes], length: int):
        self.raw = np.frombuffer(b"\x00".join(strings) + b"\x00" * (length + 8), "u1")
        n = len(self.raw) - length - 8 + 1 if strings else 0
        self.sizes = np.array([len(s) for s in strings], "i8")
        self.begin = np.cumsum(self.sizes + 1) - self.sizes - 1
        key = np.zeros(len(self.raw) - 7, "u8")
        for k in range(8):
            key = (key << np.uint64(8)) | self.raw[k : len(self.raw) - 7 + k]
        rank, order = self._rank(key)
        span = 8
        while span < length:
            step = min(span, length - span)
            ahead = np.zeros(len(rank), "i8")
            ahead[:-step] = rank[step:]
            rank, order = self._rank(rank * (len(rank) + 1) + ahead)
            span += step
        self.group, self.order, self.n = rank, order, n
        before = np.where(order > 0, self.raw[order - 1], 0)
        self.run_starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_heads = before[self.run_starts]
        self.samples = order[np.concatenate([self.run_starts[1:] - 1, [len(order) - 1]])]

    @staticmethod
    def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(key), "i8")
        rank[order] = new
        return rank, order

    def repeated(self, length: int, place: np.ndarray) -> np.ndarray:
        """For each window position, in text order, whether its bytes also stand at a lesser ``place``."""
        windows = np.maximum(0, self.sizes - length + 1)
        pos = np.repeat(self.begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        group = self.group
        valid = np.zeros(len(group), bool)
        valid[pos] = True
        size = np.bincount(group, minlength=int(group.max()) + 1)
        starts = np.cumsum(size) - size
        run_of = np.searchsorted(self.run_starts, starts, side="right")
        one_run = run_of == np.searchsorted(self.run_starts, starts + size - 1, side="right")
        left = group[:-1]
        right = group[1:]
        carried = np.zeros(len(group), bool)
        carried[:-1] = one_run[right] & (size[left] == size[right]) & valid[1:] & valid[:-1]
        look = pos[~carried[pos]]
        least = np.full(len(size), np.iinfo("i8").max)
        of = np.full(len(group), np.iinfo("i8").max)
        of[pos] = place
        needed = np.zeros(len(size), bool)
        needed[group[look]] = True
        some = pos[needed[group[pos]]]
        np.minimum.at(least, group[some], of[some])
        verdict = np.zeros(len(group), bool)
        verdict[look] = of[look] > least[group[look]]
        source = np.where(carried, len(group), np.arange(len(group)))
        source = np.minimum.accumulate(source[::-1])[::-1]
        return verdict[source[pos]]


def _runs_of(flags: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that follow one another in a text: text, first start, count."""
    on = np.flatnonzero(flags)
    if not len(on):
        return (np.empty(0, "i8"),) * 3
    new = np.concatenate([[True], (text[on][1:] != text[on][:-1]) | (start[on][1:] != start[on][:-1] + 1)])
    f = np.flatnonzero(new)
    return text[on][f], start[on][f], np.diff(np.concatenate([f, [len(on)]]))


def _match(length: int, most: int):
    """Looks for open windows in the run-length index of the stretches that share their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "dk", "th", "start", "part"]
        for t in _whole_anchors(batches, names, most, lambda b: b.num_rows * length + b.column("part").nbytes):
            a, dk, th, start = (t.column(c).to_numpy() for c in names[:4])
            parts = t.column("part").to_pylist()
            order = np.lexsort((start, dk))
            windows = np.array([len(p) - length + 1 for p in parts], "i8")
            # Places in order of (dk, start); the same row again has the same place.
            sd, ss = dk[order], start[order]
            step = np.concatenate([[0], np.cumsum((sd[1:] != sd[:-1]) | (ss[1:] != ss[:-1]))])
            rank = np.empty(len(order), "i8")
            rank[order] = step
            text = np.repeat(np.arange(len(parts)), windows)
            offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
            # Windows of one anchor stand at one distance from it, so stretches compare as their starts do.
            place = rank[text] * (1 << 20) + offset
            hit = RunLengthIndex(parts, length).repeated(length, place)
            tx, first, count = _runs_of(hit, start[text] + offset, text)
            cols = (a[tx], np.zeros(len(tx), "i8"), dk[tx], th[tx], first, -count)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "h", "dk", "th", "start", "n"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(xxhash.xxh3_64_intdigest(p[i : i + length]), dk, th, s + i)
                    for p, dk, th, s in zip(*(b.column(c).to_pylist() for c in ("part", "dk", "th", "start")), strict=True) for i in range(len(p) - length + 1)]
            cols = [np.array([r[0] for r in rows], "u8").view("i8")] + [np.array([r[k] for r in rows], "i8") for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w", "dk", "th", "start"])

    return run


def repeated_bytes(docs: DataFrame, length: int = 100, hot: int = 20_000, flush: int = 24 << 20) -> DataFrame:
    """Adds ``removed``, merged byte spans (start, end), to each row of ``docs(doc_id, text)``.

    A byte is removed if a ``length``-byte string over it also starts earlier: in a smaller doc_id, or before
    it in the same document. Texts are cut into stretches of windows with one anchor. Equal stretches meet by
    hash (64 bits): all but the earliest are covered whole. Where an anchor has several stretches, their
    earliest copies alone are indexed, by anchor, and their windows looked up there. An anchor with more than
    ``hot`` different stretches (a passage in very many documents, where it ends) does not go to one task;
    its windows meet by hash in a grouped minimum. Null text is empty; a null id comes after all others;
    rows equal in id and text are one place and do not cover each other.
    """
    dk = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.drop("removed").withColumns({"_dk": dk, "_th": F.xxhash64(text)})
    slim = docs.select(dk.alias("dk"), F.xxhash64(text).alias("th"), text.alias("text"))
    cut = slim.mapInArrow(_stretches(length, flush), ROW).repartition("a").sortWithinPartitions("a", "h", "dk", "start")
    marks = materialise(cut.mapInArrow(_first_of_stretches, ROW), "stretches")
    opened, covered = marks.where("n > 0"), marks.where("n < 0")
    crowded = materialise(opened.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("a"), "crowded")

    side = keyed.repartition("_dk", "_th")
    need = opened.groupBy("dk", "th").agg(F.collect_list(F.struct("a", "start", "n")).alias("need"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for dk, th, t, need in zip(*(b.column(c).to_pylist() for c in ("_dk", "_th", "text", "need")), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for r in need:
                    for column, v in zip(out, (r["a"], dk, th, r["start"], raw[r["start"] : r["start"] + r["n"] + length - 1]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["a", "dk", "th", "start", "part"])

    fetched = side.join(need, (F.col("_dk") == F.col("dk")) & (F.col("_th") == F.col("th"))).select("_dk", "_th", "text", "need")
    fetched = fetched.mapInArrow(parts, "a long, dk long, th long, start long, part binary")
    if crowded.isEmpty():
        found = None
    else:
        windows = fetched.join(crowded, "a", "left_semi").mapInArrow(_windows(length), "w long, dk long, th long, start long")
        least = windows.groupBy("w").agg(F.min(F.struct("dk", "start")).alias("m"))
        found = windows.join(least, "w").where(F.struct("dk", "start") > F.col("m")).select(F.lit(0).alias("a"), F.lit(0).alias("h"), "dk", "th", "start", F.lit(-1).alias("n"))
        fetched = fetched.join(crowded, "a", "left_anti")
    matched = fetched.repartition("a").sortWithinPartitions("a").mapInArrow(_match(length, 3_000_000), ROW)
    every = covered.unionByName(matched)
    every = every.unionByName(found) if found is not None else every
    spans = every.groupBy("dk", "th").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("n") + length - 1).alias("end")))).alias("removed"))
    merged = F.expr("""aggregate(removed, CAST(array() AS array<struct<start:bigint,end:bigint>>), (m, s) ->
        IF(size(m) > 0 AND element_at(m, -1).end >= s.start,
           IF(element_at(m, -1).end >= s.end, m, array_append(slice(m, 1, size(m) - 1), named_struct('start', element_at(m, -1).start, 'end', s.end))),
           array_append(m, s)))""")
    spans = spans.select("dk", "th", merged.alias("removed"))
    out = side.join(spans, (F.col("_dk") == F.col("dk")) & (F.col("_th") == F.col("th")), "left").drop("_dk", "_th", "dk", "th")
    return out.withColumn("removed", F.coalesce("removed", F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")))


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null and empty texts have no bytes; texts are searched whole. Of equal strings the first by id and start stays, null ids
    come last, rows that share an id are told apart. Further columns are not read; an empty table gives no rows.
    """
    found = repeated_bytes(documents(spark, sf_dir, "doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, hashes = [], [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True):
                raw = memoryview((t or "").encode("utf-8", "surrogatepass"))
                h, at = hashlib.sha256(), 0
                for s in spans:
                    h.update(raw[at : s["start"]])
                    at = s["end"]
                h.update(raw[at:])
                size.append(len(raw))
                gone.append(sum(s["end"] - s["start"] for s in spans))
                hashes.append(h.hexdigest())
            counts = pa.array([len(s) for s in b.column("removed").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), counts, pa.array(hashes)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
