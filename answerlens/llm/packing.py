"""Lexical retrieval packing: a BM25 index per shard fills each seed's window with its nearest unused texts."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, materialise, per_worker

BUCKETS = 1 << 16
#: In longer runs of white space the faster library's pattern can run out of stack.
LONG_GAP = re.compile(r"\s{100000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as a tokenizer file of the ``tokenizers`` library gives them, below 65,536.

    Where the ranks of the same vocabulary lie beside the file (``.tiktoken``; each id's bytes are compared once), plain texts
    go through the faster library that reads them. Texts with an added token of the tokenizer, or with a very long run of
    white space, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
        from tokenizers import Tokenizer, decoders

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit 16 bits")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)")
        self.plain = None
        beside = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(beside):
            import public_tokenizers
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            names, decoder = self.tokenizer.get_vocab(), decoders.ByteLevel()
            own = {i: name for name, i in names.items()}
            whole = {token: rank for token, rank in ranks.items() if not (128 <= token[0] or token[-1] >= 128)}
            if all(decoder.decode([own.get(rank, "")]).encode() == token for token, rank in whole.items()) and set(ranks.values()) == {i for i in own if not self.added.fullmatch(own[i])}:
                self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.plain is None or self.added.search(text) or len(text) > 100_000 and LONG_GAP.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")
        return np.array(self.plain.encode_ordinary(text), "<u2")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Per document: its ids and a final 0 cut into full windows (their checksums) and a tail (its ids, 16 bits each).

    ``bucket`` is a min-hash of the tail's pairs of ids: texts that are alike tend to share it. ``place`` spreads rows evenly over
    [0, 1), equal ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("packing", path), lambda: Encoder(path))
        place = 0.0
        for batch in batches:
            sizes, sums, tails, buckets, places = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.append(encoder.encode(text or ""), np.zeros(1, "<u2"))
                full = len(ids) // window
                sizes.append(len(ids))
                sums.append([_crc(ids[k * window : (k + 1) * window]) for k in range(full)])
                tail = ids[full * window :]
                tails.append(tail.tobytes())
                pairs = (tail[:-1].astype("u8") << 16 | tail[1:]) * np.uint64(0x9E3779B97F4A7C15)
                low = pairs.min() if len(pairs) else np.uint64(0)
                buckets.append((int(low) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 48)
                places.append(place := (place + 0.6180339887498949) % 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(buckets, pa.int32()), pa.array(places, pa.float64())],
                ["doc_id", "doc_tokens", "sums", "tail", "bucket", "place"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>, tail binary, bucket int, place double")


class BM25:
    """Inverted index of a shard: for each id the texts that hold it, with their weights."""

    def __init__(self, texts: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(texts)
        sizes = np.array([len(t) for t in texts], "i8")
        key, tf = np.unique(np.concatenate(texts).astype("i8") << 32 | np.repeat(np.arange(n), sizes), return_counts=True)
        self.docs, term = key & 0xFFFFFFFF, key >> 32
        terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        at = np.repeat(np.arange(len(terms)), df)
        norm = k1 * (1 - b + b * sizes / max(1.0, sizes.mean()))
        self.weight = idf[at] * tf * (k1 + 1) / (tf + norm[self.docs])
        order = np.argsort(self.docs, kind="stable")  # the terms of each text
        self.of, self.begin = at[order], np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        self.n, self.df = n, df
        # Terms that an eighth of the texts hold or more are rows of a matrix, the others slices of postings.
        common = np.flatnonzero(df * 8 >= n)
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n))
        held = self.row[at] >= 0
        self.rows[self.row[at[held]], self.docs[held]] = self.weight[held]

    def query(self, doc: int) -> np.ndarray:
        """Scores of all texts of the shard for all ids of a text that others hold too."""
        own = self.of[self.begin[doc] : self.begin[doc + 1]]
        own = own[self.df[own] > 1]
        row = self.row[own]
        rare = own[row < 0]
        size = self.df[rare]
        places = np.repeat(self.first[rare] - np.cumsum(size) + size, size) + np.arange(size.sum())
        scores = np.bincount(self.docs[places], self.weight[places], self.n)
        row = row[row >= 0]
        return scores + self.rows[row].sum(0) if len(row) else scores


def pack_shard(tails: list[np.ndarray], window: int, ready: int = 128) -> list[list[tuple[int, int, int]]]:
    """Sequences of (text, start, length) over the tails; each is full, or its length a power of two.

    The longest unused text is the seed. Its neighbours follow in the order of their scores, ``ready`` at a
    time: first those that fit, then the nearest that is left is cut to fill the window and its rest stays
    unused. When no text with a score is left the next longest text stands in. What is left at the end is cut at powers of two.
    """
    n = len(tails)
    left = np.array([len(t) for t in tails], "i8")
    start = np.zeros(n, "i8")
    order = np.argsort(-left, kind="stable")
    index = BM25(tails) if n > 1 else None
    out, at = [], 0
    while True:
        while at < n and not left[order[at]]:
            at += 1
        if at == n:
            break
        seed = int(order[at])
        seq, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        start[seed] += left[seed]
        left[seed] = 0

        def take(d: int, most: int) -> int:
            k = min(int(left[d]), most)
            seq.append((d, int(start[d]), k))
            start[d] += k
            left[d] -= k
            return k

        if room and index is not None:
            scores = index.query(seed)
            scores[left == 0] = 0
            near = np.flatnonzero(scores)
            while room and len(near):
                batch, near = near, near[:0]
                if len(batch) > ready:
                    split = np.argpartition(-scores[batch], ready)
                    batch, near = batch[split[:ready]], batch[split[ready:]]
                batch = batch[np.lexsort((batch, -scores[batch]))].tolist()
                for d in batch:
                    if left[d] <= room:
                        room -= take(d, room)
                        if not room:
                            break
                for d in batch:
                    if room and left[d]:
                        room -= take(d, room)
        spare = at
        while room and spare < n:
            if left[order[spare]]:
                room -= take(int(order[spare]), room)
            else:
                spare += 1
        out.append(seq)
    size = window - room if out else window
    if out and size < window:
        rest = out.pop()
        for bit in reversed(range(size.bit_length())):
            need = size & (1 << bit)
            part = []
            while need:
                d, s, k = rest.pop(0)
                used = min(k, need)
                part.append((d, s, used))
                need -= used
                if used < k:
                    rest.insert(0, (d, s + used, k - used))
            if part:
                out.append(part)
    return out


def pack(docs: DataFrame, window: int = 1024, shard_docs: int = 2000, tokenizer: str | None = None) -> DataFrame:
    """Packs every token of ``docs(doc_id, text)`` into sequences of ``window`` tokens.

    Full windows of a document are sequences of their own; the tails meet in shards. A shard is a run of
    min-hash buckets with about ``shard_docs`` tails; a larger bucket (many copies) is dealt over several
    shards evenly. The bucket counts, ``BUCKETS`` numbers at most, are all the driver sees.
    Null text has only the final 0. Rows are packed one by one, so repeated and null ids stay apart.
    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    table = materialise(tokenized(docs, tokenizer or default_tokenizer(), window), "tokens")
    counts = table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()  # at most BUCKETS rows
    plan, shard, held = [], 0, 0
    for r in counts:
        if held and held + r["n"] > shard_docs:
            shard, held = shard + 1, 0
        parts = -(-r["n"] // shard_docs)
        plan.append((r["bucket"], shard, parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + r["n"])
    spark = docs.sparkSession
    placed = table.join(F.broadcast(spark.createDataFrame(plan, "bucket int, first long, parts int")), "bucket")
    placed = placed.withColumn("shard", F.col("first") + F.floor(F.col("place") * F.col("parts"))).drop("bucket", "first", "parts", "place")
    placed = placed.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make doubles of ids beside a null

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = [None if i is None else int(i) for i in rows["doc_id"].tolist()]
        order = sorted(range(len(rows)), key=lambda k: (rows["doc_tokens"].iat[k], known[k] is None, known[k] or 0))
        rows, ids = rows.iloc[order], [known[k] for k in order]
        tokens, sums = rows["doc_tokens"].tolist(), rows["sums"].tolist()
        first = int(rows["shard"].iloc[0]) << 32
        out = []
        for d in range(len(rows)):
            for k, crc in enumerate(sums[d]):
                out.append((ids[d], k * window, window, int(crc), tokens[d], first, 0))
                first += 1
        tails = [np.frombuffer(t, "<u2") for t in rows["tail"]]
        whole = [i for i, t in enumerate(tails) if len(t)]
        for seq in pack_shard([tails[i] for i in whole], window):
            at = 0
            for d, s, k in seq:
                d = whole[d]
                out.append((ids[d], len(sums[d]) * window + s, k, _crc(tails[d][s : s + k]), tokens[d], first, at))
                at += k
            first += 1
        got = pd.DataFrame([o[1:] for o in out], columns=["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        got.insert(0, "doc_id", pd.array([o[0] for o in out], "Int64"))
        return got

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.groupBy("shard").applyInPandas(run, schema)


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``. Null and empty texts are their final 0 alone; very long texts give full windows first.

    Copies, ties and repeated rows are packed one by one, a null id stays null, further columns are not read; an empty table gives no rows.
    """
    return pack(documents(spark, sf_dir, "doc_id", "text"))
