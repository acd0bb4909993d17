"""Language-model scores by context-tree weighting over bytes, and a smoothed word model as the base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, fold, materialise

DEPTH = 5  # bytes of context; a context and the next byte fill 48 bits of a key
TOP = 3  # contexts shorter than this are held as one table, at most 256 ** TOP entries
PAD = b"\n" * DEPTH
END = -1  # key of the end token among the words
HALF = np.log(0.5)
FREE = -(1 << 63)  # a free slot of a key table
LAST = (1 << 63) - 1


def normal(text: str | None) -> bytes:
    """Words with single spaces and an end byte: one string for each sequence of tokens."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


def word_key(word: bytes) -> int:
    """A negative key from the word's hash; n-gram keys are positive."""
    return (xxhash.xxh64_intdigest(word, 7) >> 1) - LAST or -2


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all positions of ``texts``, each text preceded by end bytes; where each text begins; positions to leave out."""
    raw = np.frombuffer(b"".join(PAD + t for t in texts), "u1").astype("i8")
    n = len(raw) - DEPTH
    key = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        key |= raw[DEPTH - back : DEPTH - back + n] << (8 * back)
    sizes = np.array([len(t) for t in texts], "i8")
    begin = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    void = ((begin + sizes)[:, None] + np.arange(DEPTH)).ravel()
    return key, begin, void[void < n]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5 by Stirling's series eight steps up."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


@dataclass
class Level:
    """The nodes of one depth: for each bit of the byte, sorted node keys with their counts and weights."""

    nodes: list[np.ndarray]
    zeros: list[np.ndarray]
    ones: list[np.ndarray]
    weight: list[np.ndarray]  # of the node's own estimate against its children's mixture
    mixed: list[np.ndarray]  # log of the weighted probability of all bits seen at the node


def level(grams: np.ndarray, counts: np.ndarray, depth: int, below: Level | list[tuple[np.ndarray, np.ndarray]] | None) -> Level:
    """Krichevsky-Trofimov estimates of one depth, mixed with the depth ``below`` it (none at the deepest).

    A node is a context and the bits of the byte so far; ``grams`` (context and byte, sorted, distinct)
    hold the counts of whole bytes.
    """
    out = Level([], [], [], [], [])
    for j in range(8):
        node = grams >> (8 - j)
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        bit = (grams >> (7 - j)) & 1
        n1 = np.add.reduceat(counts * bit, first)
        n0 = np.add.reduceat(counts, first) - n1
        node = node[first]
        own = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)
        if below is None:
            weight, mixed = np.ones(len(node)), own
        else:
            keys, logs = (below.nodes[j], below.mixed[j]) if isinstance(below, Level) else below[j]
            parent = np.searchsorted(node, keys & ((1 << (8 * depth + j)) - 1))
            mixed = np.logaddexp(HALF + own, HALF + np.bincount(parent, logs, len(node)))
            weight = np.exp(HALF + own - mixed)
        for name, v in zip(("nodes", "zeros", "ones", "weight", "mixed"), (node, n0, n1, weight, mixed), strict=True):
            getattr(out, name).append(v)
    return out


def mix(keys: np.ndarray, lv: Level, depth: int, p: list[np.ndarray] | None) -> list[np.ndarray]:
    """For each bit of each key's byte, its probability from this depth down, given ``p`` from below."""
    out = []
    grams = keys & ((1 << (8 * (depth + 1))) - 1)
    for j in range(8):
        at = np.searchsorted(lv.nodes[j], grams >> (8 - j))
        seen = np.where((grams >> (7 - j)) & 1, lv.ones[j][at], lv.zeros[j][at])
        kt = (seen + 0.5) / (lv.zeros[j][at] + lv.ones[j][at] + 1.0)
        out.append(kt if p is None else lv.weight[j][at] * kt + (1 - lv.weight[j][at]) * p[j])
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(grams):
        return grams, counts
    order = np.argsort(grams)
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts[order], first)


class KeyTable:
    """Values by key, open addressing; a lookup is a probe or two instead of a search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, FREE, "i8")
        self.values = np.zeros(1 << self.bits)
        slot, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[todo[free]]
            done = self.keys[at] == keys[todo]
            self.values[at[done]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype("i8")

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; 0 for keys that the table does not hold."""
        slot = self._slots(keys)
        miss = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != FREE))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            miss = miss[(self.keys[slot[miss]] != keys[miss]) & (self.keys[slot[miss]] != FREE)]
        return np.where(self.keys[slot] == keys, self.values[slot], 0.0)


def lower_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Depths ``TOP`` to ``DEPTH`` of the contexts in ``keys``, the shallowest first."""
    out: list[Level] = []
    for depth in range(DEPTH, TOP - 1, -1):
        u, c = _summed(keys & ((1 << (8 * (depth + 1))) - 1), counts)
        out.insert(0, level(u, c, depth, out[0] if out else None))
    return out


def _stretches(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of whole contexts of length ``TOP``, several at a time; rows come ordered by that context."""
    held_k, held_c = np.empty(0, "i8"), np.empty(0, "f8")
    for batch in batches:
        held_k = np.concatenate([held_k, batch.column("key").to_numpy()])
        held_c = np.concatenate([held_c, batch.column("n").to_numpy().astype("f8")])
        if len(held_k) >= most:
            suffix = (held_k >> 8) & ((1 << (8 * TOP)) - 1)
            end = int(np.searchsorted(suffix, suffix[-1]))
            if end:
                yield held_k[:end], held_c[:end]
                held_k, held_c = held_k[end:], held_c[end:]
    if len(held_k):
        yield held_k, held_c


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Small slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, count) of n-grams and words; those of texts not learned from get count 0, their words none."""
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    words: Counter = Counter()
    ends = 0

    def emit(keys, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
        return _summed(k, c)

    for batch in _slices(batches):
        learned = batch.column("learned").to_pylist()
        held: dict[bool, list[bytes]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def take(kind: bool) -> None:
            if held[kind]:
                key, _, void = gram_keys(held[kind])
                keys = np.sort(np.delete(key, void))
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                grams.append((keys[first], np.diff(np.append(first, len(keys))) * kind))
                held[kind], size[kind] = [], 0

        for text, use in zip(batch.column("text").to_pylist(), learned, strict=True):
            raw = normal(text)
            held[use].append(raw)
            size[use] += len(raw)
            if use:
                words.update(raw.split())
                ends += 1
            if size[use] > 1_000_000:
                take(use)
        take(True)
        take(False)
        if sum(len(g[0]) for g in grams) > 1_000_000:
            grams = [reduced()]
            if len(grams[0][0]) > 500_000:
                yield emit(*grams.pop())
        if len(words) > 100_000:
            yield emit([word_key(w) for w in words], list(words.values()))
            words.clear()
    if grams:
        yield emit(*reduced())
    if words or ends:
        yield emit([*map(word_key, words), END], [*words.values(), ends])


def _requests(common):
    """The distinct keys that each block needs beside the ``common`` ones (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value[0]

        def rare(keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return keys[known[at] != keys] if len(known) else keys

        for batch in batches:
            block = batch.column("block").to_numpy()
            texts = batch.column("text")
            for b in np.unique(block):
                parts, words, held, size = [], set(), [], 0
                for i in np.flatnonzero(block == b).tolist():
                    raw = normal(texts[i].as_py())
                    words.update(raw.split())
                    held.append(raw)
                    size += len(raw)
                    if size > 1_000_000:
                        key, _, void = gram_keys(held)
                        parts.append(rare(_distinct(np.delete(key, void))))
                        held, size = [], 0
                if held:
                    key, _, void = gram_keys(held)
                    parts.append(rare(_distinct(np.delete(key, void))))
                named = rare(np.sort(np.array([END, *map(word_key, words)], "i8")))
                keys = np.concatenate([_distinct(np.concatenate(parts)), named])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b), pa.int64()), pa.array(keys)], ["block", "key"])

    return run


def _common(model: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries with the highest counts, at most ``most``: found by a histogram of counts, not by a sort."""
    step = F.floor(F.log2(F.col("n") + 1) * 8)
    bins = model.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("b")).collect()  # some hundred rows
    total, least = 0, None
    for r in bins:
        total += r["c"]
        if total > most:
            break
        least = r["b"]
    if least is None:
        return np.empty(0, "i8"), np.empty(0)
    got = model.where(step >= least).select("key", "v").toPandas().sort_values("key")
    return got["key"].to_numpy("i8"), got["v"].to_numpy("f8")


def context_tree_scores(docs: DataFrame, learn: Column, block_bytes: int = 16 << 20, common: int = 400_000) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)`` with models learned from the rows where ``learn`` holds.

    The text model weights all context depths from 0 to ``DEPTH`` bytes: each byte is eight binary decisions,
    each with its own context tree, and each node mixes its Krichevsky-Trofimov estimate half and half with
    its children. Counts are gathered over all rows to learn from, by partition first; contexts that only
    other rows hold travel along with count zero. Contexts of ``TOP`` bytes and more are weighted by subtree
    (a subtree has at most 256 ** 3 entries), the short ones on the driver from one table of at most
    256 ** TOP entries. The result, a log probability for each context and byte, is as large as the corpus
    is varied, so it is joined to what each block of documents needs and never sent whole to a task; only
    the ``common`` most frequent entries, a set number, go to all tasks.

    Adds n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte. Null text is empty and
    has only its end; without rows to learn from every bit has probability one half.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    counted = rows.select("text", "learned").mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = materialise(counted, "counts")
    total, kinds = table.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    suffix = F.shiftright("key", 8).bitwiseAND((1 << (8 * TOP)) - 1)
    ordered = table.where("key >= 0").withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix").select("key", "n")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _stretches(batches):
            lv = lower_levels(keys, counts)[0]
            up, logs, step = [], [], []
            for j in range(8):
                parent, at = np.unique(lv.nodes[j] & ((1 << (8 * (TOP - 1) + j)) - 1), return_inverse=True)
                up.append(parent)
                logs.append(np.bincount(at, lv.mixed[j], len(parent)))
                step.append(np.full(len(parent), j))
            u, c = _summed(keys & ((1 << (8 * TOP)) - 1), counts)
            kind = np.concatenate([*step, np.full(len(u), 8)])
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype("i4")), pa.array(np.concatenate([*up, u])), pa.array(np.concatenate([*logs, c]))], ["kind", "node", "v"])

    top = ordered.mapInArrow(tops, "kind int, node long, v double").groupBy("kind", "node").agg(F.sum("v").alias("v")).toPandas()
    parts = {k: g.sort_values("node") for k, g in top.groupby("kind")}
    upper: list[Level] = []
    if 8 in parts:
        below = [(parts[j]["node"].to_numpy("i8"), parts[j]["v"].to_numpy("f8")) for j in range(8)]
        grams, counts = parts[8]["node"].to_numpy("i8"), parts[8]["v"].to_numpy("f8")
        for depth in range(TOP - 1, -1, -1):
            u, c = _summed(grams & ((1 << (8 * (depth + 1))) - 1), counts)
            upper.insert(0, level(u, c, depth, upper[0] if upper else below))
    shared = spark.sparkContext.broadcast([vars(lv) for lv in upper])  # at most 256 ** TOP entries a bit

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _stretches(batches):
            p = None
            for depth, lv in reversed(list(enumerate([*(Level(**lv) for lv in shared.value), *lower_levels(keys, counts)]))):
                p = mix(keys, lv, depth, p)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sum(np.log10(x) for x in p)), pa.array(counts.astype("i8"))], ["key", "v", "n"])

    model = ordered.mapInArrow(logs, "key long, v double, n long").unionByName(table.where("key < 0").select("key", F.col("n").cast("double").alias("v"), "n"))
    model = materialise(model, "model")
    often = spark.sparkContext.broadcast(_common(model, common))

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    placed = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")).repartition(blocks, "block")
    wanted = placed.mapInArrow(_requests(often), "block long, key long").join(model, "key").select("block", "key", "v")
    scale = float(np.log10(total + kinds + 1))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys, first = np.unique(np.concatenate([right["key"].to_numpy(), often.value[0]]), return_index=True)
        values = np.concatenate([right["v"].to_numpy(), often.value[1]])[first]
        table = KeyTable(keys, values)
        del keys, values, first
        end = float(table.get(np.array([END]))[0])
        memo: dict[bytes, float] = {}
        n_tokens, known, base, scores, sizes = [], [], [], [], []

        def counts(ws: list[bytes]) -> np.ndarray:
            if len(memo) > 100_000:
                memo.clear()
            new = list(set(ws).difference(memo))
            memo.update(zip(new, table.get(np.fromiter(map(word_key, new), "i8", len(new))).tolist(), strict=True))
            return np.array([*map(memo.__getitem__, ws), end])

        def finish(held: list[bytes]) -> None:
            key, begin, void = gram_keys(held)
            real = np.ones(len(key), bool)
            real[void] = False
            v = np.zeros(len(key))
            v[real] = table.get(key[real])
            scores.append(np.add.reduceat(v, begin))

        held, size = [], 0
        for text in left["text"]:
            raw = normal(text)
            c = counts(raw.split())
            n_tokens.append(len(c))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10(c + 1).sum() - scale * len(c)))
            sizes.append(len(raw))
            held.append(raw)
            size += len(raw)
            if size > 1_000_000:
                finish(held)
                held, size = [], 0
        if held:
            finish(held)
        s = np.concatenate(scores) if scores else np.empty(0)
        return pd.DataFrame({
            "doc_id": left["doc_id"], "n_tokens": n_tokens, "n_known": known, "base_score": base, "score": s,
            "bits_per_byte": -s * np.log2(10) / np.array(sizes, "f8"),
        })

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    out = placed.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(score, schema)
    return out.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null and empty texts are their end token alone; texts are scored whole in blocks, repeated rows row by row.
    A null id counts as empty text in crc32 and stays null. Further columns are not read; an empty table gives no rows.
    """
    held_out = fold("doc_id", 7) == 2
    out = context_tree_scores(documents(spark, sf_dir, "doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
