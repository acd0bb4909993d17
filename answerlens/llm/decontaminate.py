"""Benchmark decontamination: an FM-index of each training shard is searched for the benchmark's phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, map_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # in texts whose case is as it was
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SAMPLE = 16


def fold_words(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased; ASCII other than letters and digits separates them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class FMIndex:
    """FM-index of a word sequence in which symbol 0 separates runs.

    Suffixes are sorted by prefix doubling, separators as distinct symbols, so a sort ends at the run.
    The transform is held as a wavelet matrix with counted bits; the position of every ``SAMPLE``-th
    word and of each run's first word is kept.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        gap = seq == 0
        gaps = int(gap.sum())
        rank = np.where(gap, np.cumsum(gap) - 1, seq.astype("int64") + gaps - 1)
        order, step = np.argsort(rank, kind="stable"), 1
        rank = _ranks(rank[order], order)
        while rank[order[-1]] < n - 1:
            ahead = np.zeros(n, "int64")
            ahead[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = _ranks(key[order], order)
            step *= 2
        self.n = n
        last = np.where(order > 0, seq[order - 1], 0)
        counts = np.bincount(seq, minlength=int(seq.max()) + 2)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.bits = max(1, int(seq.max()).bit_length())
        self.ones, self.zeros = [], []
        cur = last
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        self.sampled = (order % SAMPLE == 0) | (last == 0)
        self.place = np.concatenate([[0], np.cumsum(self.sampled)])
        self.kept = order[self.sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before position i."""
        low = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(up, zeros + ones[i], i - ones[i])
            low = np.where(up, zeros + ones[low], low - ones[low])
        return i - low

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix table that begin with each window (right-aligned symbols, 0 before)."""
        width = windows.shape[1]
        lo, hi = np.zeros(len(windows), "int64"), np.full(len(windows), self.n, "int64")
        live = np.flatnonzero(windows.max(axis=1, initial=0) < len(self.starts) - 1)
        gone = np.ones(len(windows), bool)
        gone[live] = False
        for back in range(width):
            live = live[(lengths[live] > back) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = windows[live, width - 1 - back]
            lo[live] = self.starts[c] + self.rank(c, lo[live])
            hi[live] = self.starts[c] + self.rank(c, hi[live])
        hi[gone] = lo[gone]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the left until a kept position."""
        at, steps = rows.copy(), np.zeros_like(rows)
        move = np.flatnonzero(~self.sampled[at])
        while len(move):
            c = self.symbol(at[move])
            at[move] = self.starts[c] + self.rank(c, at[move])
            steps[move] += 1
            move = move[~self.sampled[at[move]]]
        return self.kept[self.place[at]] + steps


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), "int64")
    out[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    return out


class Phrases:
    """Windows of a block of benchmark items: ``width`` consecutive words, or all of a shorter item."""

    def __init__(self, items: list[tuple[int, str | None]], width: int):
        self.vocab: dict[bytes, int] = {}
        rows, self.lengths, self.items = [], [], []
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in fold_words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                win = ids[i : i + width]
                rows.append([0] * (width - len(win)) + win)
                self.lengths.append(len(win))
                self.items.append(item)
        self.windows = np.array(rows, "int64").reshape(-1, width)
        self.lengths, self.items = np.array(self.lengths, "int64"), np.array(self.items, "int64")

    def find(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
        """For each text its merged spans of hit words and the items that occur.

        Words outside the phrases end a run; a run shorter than every window holds none and stays out of the index.
        """
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        found: list[list[int]] = [[] for _ in texts]
        if not len(self.windows):
            return spans, found
        get = self.vocab.get
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, "int64")
        for t, end in zip(texts, ends, strict=True):
            flat[end - len(t) - 1 : end - 1] = np.fromiter(map(get, t, repeat(0)), "int64", len(t))
        known = np.concatenate([[False], flat > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, stop = edges[::2], edges[1::2]
        long = stop - begin >= self.lengths.min()
        begin, stop = begin[long], stop[long]
        if not len(begin):
            return spans, found
        width = stop - begin + 1  # with the separator
        offset = np.cumsum(width) - width
        source = np.repeat(begin - offset, width) + np.arange(int(width.sum()))
        seq = flat[source]
        seq[offset + width - 1] = 0
        index = FMIndex(seq)
        lo, hi = index.search(self.windows, self.lengths)
        hits = hi - lo
        which = np.repeat(np.arange(len(hits)), hits)
        if not len(which):
            return spans, found
        rows = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(len(which))
        at = index.locate(rows)
        cover = np.zeros(len(seq) + 1, "int64")
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[which], -1)
        hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype("i1"), [0]])
        turn = np.flatnonzero(hit[1:] != hit[:-1])
        for a, b in zip(turn[::2], turn[1::2], strict=True):
            doc = int(np.searchsorted(ends, source[a], side="right"))
            base = int(ends[doc] - sizes[doc])
            spans[doc].append((int(source[a]) - base, int(source[b - 1]) + 1 - base))
        pairs = np.unique(np.stack([np.searchsorted(ends, source[at], side="right"), self.items[which]], axis=1), axis=0)
        for doc, item in pairs.tolist():
            found[doc].append(item)
        return spans, found


def _blocks(benchmark: DataFrame, words: int, width: int) -> Iterator[Phrases]:
    """The benchmark in blocks of at most about ``words`` words."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(fold_words(r["text"]))
        if size >= words:
            yield Phrases(block, width)
            block, size = [], 0
    yield Phrases(block, width)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 200_000, shard_bytes: int = 8 << 20) -> DataFrame:
    """Adds to each row of ``docs`` what it shares with ``benchmark(item_id, text)``.

    ``n_words``; ``n_hit``, words inside an occurrence of a window; ``hit_items``, the items with such a
    window in order; ``hit_spans``, merged spans of hit words in code points, end exclusive, for removal.
    A shard is a stretch of a partition of about ``shard_bytes``; its index lives in its task only. The
    phrases travel in blocks of a set size; each further block is one more pass over rows on their way.
    Null text has no words, an empty benchmark hits nothing; items without id are not searched.
    """
    added = {"n_words": "bigint", "hit_words": "array<bigint>", "hit_items": "array<bigint>", "hit_spans": "array<struct<start:bigint,end:bigint>>"}
    docs = docs.drop(*added)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = ", ".join(filter(None, [base, *(f"{k} {v}" for k, v in added.items())]))
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    out = docs
    for turn, phrases in enumerate(_blocks(benchmark, block_words, width)):

        def run(batch: pa.RecordBatch, phrases: Phrases = phrases, turn: int = turn) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            counts, words, items, chars = [], [], [], []
            before = (batch.column("hit_words").to_pylist(), batch.column("hit_items").to_pylist()) if turn else ([[]] * len(texts),) * 2
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < shard_bytes):
                    size += len(texts[end] or "")
                    end += 1
                shard = [fold_words(t) for t in texts[at:end]]
                spans, found = phrases.find(shard)
                for k, t in enumerate(shard):
                    old = before[0][at + k]
                    merged = _merge([*spans[k], *zip(old[::2], old[1::2], strict=True)])
                    counts.append(len(t))
                    words.append([x for s in merged for x in s])
                    items.append(sorted({*found[k], *before[1][at + k]}))
                    places = [m.span() for m in WORD.finditer(texts[at + k])] if merged else []
                    chars.append([{"start": places[a][0], "end": places[b - 1][1]} for a, b in merged])
                at = end
            own = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in added]
            cols = [pa.array(v, kind) for v, kind in zip((counts, words, items, chars), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*own, *cols], [*(n for n in batch.schema.names if n not in added), *added])

        out = map_batches(out, run, schema)
    hit = F.expr("aggregate(sequence(1, size(hit_words) div 2), 0L, (s, i) -> s + hit_words[2 * i - 1] - hit_words[2 * i - 2])")
    return out.withColumn("n_hit", F.when(F.size("hit_words") > 0, hit).otherwise(F.lit(0).cast("long"))).drop("hit_words")


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null and empty texts have no words and no hit; null and empty items have no window; texts are searched whole, repeated
    rows row by row, null ids are kept. Further columns are not read; an empty table gives no rows.
    """
    found = find_contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
       SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k AS len, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM win),
hits AS (SELECT DISTINCT p.doc_id, p.i, win.len, win.item_id
         FROM (SELECT doc_id, len, i, array_to_string(w[i : i + len - 1], ' ') AS phrase
               FROM (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM d, lens WHERE len(w) >= len)) p
         JOIN win ON win.len = p.len AND win.phrase = p.phrase),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + len)) AS pos FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
