"""Near-duplicates by SimHash: fingerprints meet in a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import components, documents, map_batches, materialise

BITS = 64
TURNS = (0, 22, 43)  # where each third of the bits begins
STEP = 10  # bits by which a node too large for one task is split
HELD = 1_000  # texts whose shingles a worker holds at a time


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, dtype="int64")
    for at in range(0, n, 1 << 16):
        part = words[at : min(n, at + (1 << 16)) + width - 1]
        runs = [part[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
        h = np.array([digest(b" ".join(s), seed) for s in zip(*runs, strict=False)], dtype="<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every row of ``docs(doc_id, text)``; fp is the 64 bits as a long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], dtype="u8").view("i8")
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    named = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    return map_batches(named, run, "doc_id long, fp long, text_hash long")


def trie_pairs(keys: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks pairs of trie nodes down from the highest bit and returns the leaf pairs within ``budget``.

    A node is a range of ``keys`` in order. Task i joins ``[lo, mid)`` with ``[mid, hi)``, or
    ``[lo, hi)`` with itself where ``mid == hi``. The differing bits of a pair of nodes are those of their
    prefixes; beyond the budget the pair and all below it is dropped. A self pair of one leaf ends.
    """
    own = mid == hi
    a0, a1 = lo.copy(), mid.copy()
    b0, b1 = np.where(own, lo, mid), hi.copy()
    d = np.zeros(len(lo), dtype="int64")
    left, right = [], []
    for bit in range(BITS - 1, -2, -1):
        one = (a1 - a0 == 1) & (b1 - b0 == 1)
        if one.any():  # both are leaves: the rest of the bits at once
            x, y = a0[one], b0[one]
            near = np.bitwise_count(keys[x] ^ keys[y]) <= budget
            left.append(x[near])
            right.append(y[near])
            a0, a1, b0, b1, d = (v[~one] for v in (a0, a1, b0, b1, d))
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype("int64")])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        new = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        cross = ~own
        new.append(tuple(v[cross] for v in (am, a1, b0, bm, d + 1)))
        a0, a1, b0, b1, d = (np.concatenate(v) for v in zip(*new, strict=True))
        keep = (a0 < a1) & (b0 < b1) & (d <= budget) & ~((a0 == b0) & (a1 - a0 == 1) & (b1 - b0 == 1))
        a0, a1, b0, b1, d = (v[keep] for v in (a0, a1, b0, b1, d))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, "int64"), np.empty(0, "int64"))


def _stars(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node linked to it) that connect what the links (positions x, y) connect."""
    used, at = np.unique(np.concatenate([nodes[x], nodes[y]]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    label = np.arange(len(used))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = label[label]
        if (label == before).all():
            break
    child = label != np.arange(len(used))
    return used[child], used[label[child]]


def _join_tasks(budget: int, chunk: int = 200_000):
    """Rows come ordered by task; side 0 joins with itself, side 1 with side 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> pa.RecordBatch:
            task, side = t.column("task").to_numpy(), t.column("side").to_numpy()
            key, node = t.column("key").to_numpy().view("u8"), t.column("node").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1])]))
            last = np.concatenate([first[1:], [len(task)]])
            firsts = np.concatenate([[0], np.cumsum(side < 2)])
            mid = first + firsts[last] - firsts[first]
            whole = np.where(side[first] == 0, last - first > 1, (first < mid) & (mid < last))
            key = key ^ np.uint64(1 << 63)  # rows come ordered as signed longs
            x, y = trie_pairs(key, first[whole], mid[whole], last[whole], budget)
            u, v = _stars(node, x, y)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                t = pa.Table.from_batches(held).combine_chunks()
                task = t.column("task").to_numpy()
                end = int(np.searchsorted(task, task[-1]))  # the last task may go on; tasks come in order
                if end:
                    yield work(t.slice(0, end))
                rest = t.slice(end)
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def near_links(fps: DataFrame, budget: int = 2, most: int = 20_000) -> DataFrame:
    """Star edges ``(u, v)`` that connect all distinct fingerprints within ``budget`` bits.

    ``fps(fp, node)`` has distinct fingerprints. With ``budget`` 2 at least one third of the bits of a
    linked pair is equal, so a trie is kept for each third turned to the front and its self-join starts
    below that third: no budget is spent there. The pairs of nodes are the tasks. A task with more than
    ``most`` fingerprints is replaced by the pairs of its subtries ``STEP`` bits below that the budget
    still allows, again and again, so no task holds a hot prefix whole and no pair is lost. Links are
    at most linear in the fingerprints: each has C(64, 1) + C(64, 2) others in reach.
    """
    if budget != 2:
        raise ValueError("the thirds of the key serve a budget of two bits")
    spark = fps.sparkSession

    def turned(at: int, width: int):
        col = F.col("fp")
        key = col if at == 0 else F.shiftleft(col, at).bitwiseOR(F.shiftrightunsigned(col, BITS - at))
        return F.struct(
            F.xxhash64(F.lit(at), F.shiftrightunsigned(key, BITS - width)).alias("task"), F.lit(0).alias("side"), key.alias("key"), F.lit(width).alias("depth")
        )

    widths = [b - a for a, b in zip(TURNS, (*TURNS[1:], BITS), strict=True)]
    tasks = fps.select("node", F.explode(F.array(*[turned(a, w) for a, w in zip(TURNS, widths, strict=True)])).alias("t")).select("t.*", "node")
    tasks = materialise(tasks, "trie")
    masks = [0] + [1 << i for i in range(STEP)] + [(1 << i) | (1 << j) for i in range(STEP) for j in range(i)]
    done = None
    while True:
        sizes = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deep"))
        big = sizes.where((F.col("n") > most) & (F.col("deep") < BITS)).select("task")
        small = tasks.join(big, "task", "left_anti")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            break
        hot = tasks.join(big, "task")
        step = f"least({STEP}, 64 - depth)"
        split = hot.withColumn("own", F.expr(f"shiftrightunsigned(shiftleft(key, depth), 64 - {step})"))
        split = split.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).where(f"mask < shiftleft(1L, {step})")
        other = F.col("own").bitwiseXOR(F.col("mask"))
        # Within one node the lower subtrie comes first; of two nodes the sides stay as they are.
        alone = F.col("side") == 0
        leads = F.when(alone, F.col("own") <= other).otherwise(F.col("side") == 1)
        split = split.select(
            F.xxhash64("task", F.when(leads, F.col("own")).otherwise(other), F.when(leads, other).otherwise(F.col("own"))).alias("task"),
            F.when(alone & (F.col("mask") == 0), 0).when(leads, 1).otherwise(2).alias("side"),
            "key", F.expr(f"cast(depth + {step} as int)").alias("depth"), "node",
        )
        tasks = materialise(split, "trie")
    placed = done.select("task", "side", "key", "node").repartition("task").sortWithinPartitions("task", "side", "key")
    return placed.mapInArrow(_join_tasks(budget), "u long, v long")


def near_groups(docs: DataFrame, width: int = 3, seed: int = 42, budget: int = 2, keep_hash: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``, with ``text_hash`` where asked for.

    Copies share a fingerprint and meet before the join. Documents without words have fingerprint zero
    and link like any other. A null id keeps its row; its component is the smallest id it reaches,
    null where there is none.
    """
    table = materialise(fingerprints(docs, width, seed), "fingerprints")
    fps = table.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(near_links(fps.where("node IS NOT NULL"), budget))
    named = fps.join(roots, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "node").alias("component_id"))
    return table.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id", *(["text_hash"] if keep_hash else []))


def shingle_hashes(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the ``width``-word shingles in order; of the whole sequence where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    runs = zip(*[words[i:] for i in range(width)], strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), seed) for s in runs), dtype="<u8"))


def _shingle_rows(width: int, rows: int = 1 << 20):
    """Texts as rows ``(node, token)``, one for each different shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            node = np.repeat(np.array(nodes, "i8"), [len(h) for h in sets])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets).view("<i8"))], ["node", "token"])

        nodes, sets, size = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
                nodes.append(node)
                sets.append(shingle_hashes(text.as_py(), width))
                size += len(sets[-1])
                if size >= rows:
                    yield flat(nodes, sets)
                    nodes, sets, size = [], [], 0
        if nodes:
            yield flat(nodes, sets)

    return run


def _sketch(tokens: np.ndarray) -> bytes:
    """For each residue of the tokens modulo a power of two, at least their number, whether an odd number has it."""
    width = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype("i8"), minlength=width) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """So many tokens at least are in one of two sets alone, by their sketches; the longer is folded to the shorter."""
    short = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(s, "u1").reshape(-1, short), axis=0) for s in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def _with_ends(pairs: DataFrame, held: DataFrame, what: str, per_salt: int) -> DataFrame:
    """``pairs(u, v)`` with what ``held(node, n, what)`` has of both ends, as ``su`` and ``sv``, and the sum of their ``n``.

    Both ends may be hot: each is met in as many salts as its rows ask for.
    """
    links = pairs
    for end, side in (("u", "su"), ("v", "sv")):
        other = "v" if end == "u" else "u"
        salts = links.groupBy(end).agg(F.count(F.lit(1)).alias("_m"))
        copies = held.join(salts, F.col("node") == F.col(end)).select(
            F.col(end).alias("_k"), F.col(what).alias(side), F.col("n").alias(f"n{side}"), F.explode(F.expr(f"sequence(0L, _m div {per_salt})")).alias("_s")
        )
        many = salts.where(f"_m >= {per_salt}").select(F.col(end).alias("_e"), "_m")
        salted = pairs.join(many, F.col(end) == F.col("_e"), "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce(F.expr(f"_m div {per_salt}"), F.lit(0)) + 1))
        pairs = salted.join(copies, (F.col(end) == F.col("_k")) & (F.col("_salt") == F.col("_s"))).drop("_e", "_m", "_salt", "_k", "_s")
    return pairs.select("u", "v", "su", "sv", (F.col("nsu") + F.col("nsv")).alias("n"))


def _likely(pairs: DataFrame, sketches: DataFrame, similarity: float, per_salt: int) -> DataFrame:
    """The pairs ``(u, v)`` that the sketches in ``sketches(node, n, sketch)`` do not rule out; all that are similar are among them."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(batch.column("su").to_pylist(), batch.column("sv").to_pylist(), batch.column("n").to_pylist(), strict=True)
        return batch.select(["u", "v"]).filter(pa.array([_differ(x, y) <= apart * both + 1e-6 for x, y, both in rows], pa.bool_()))

    return map_batches(_with_ends(pairs, sketches, "sketch", per_salt), run, "u long, v long")


def _confirmed(pairs: DataFrame, held: DataFrame, similarity: float, per_salt: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets in ``held(node, n, tokens)`` have at least that Jaccard similarity.

    ``tokens`` may lack those that no other set has, ``n`` counts them. Two sets of any size are compared in their row, so no batch of them is ever held.
    """
    near = f"exists(array(size(array_intersect(su, sv))), same -> same >= {similarity}D * (n - same))"
    return _with_ends(pairs, held, "tokens", per_salt).where(near).select("u", "v")


def similar_sets(sets: DataFrame, tokens: DataFrame, similarity: float, per_salt: int = 2_000, direct: int = 2_000_000) -> DataFrame:
    """``(node, root)``: components of all pairs of ``sets(node, n)`` with a Jaccard similarity of ``similarity`` or more.

    ``tokens(node, token)`` has each member once. A set holds ``need`` = ceil(similarity * n) tokens of any partner, so fewer
    tokens shared with any set rule it out, and of two partners both have a common token among their n - need + 1 rarest
    (prefix filter; one order of all tokens, by frequency), where :func:`_linked` lets them meet.
    """
    spread = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    gathered = spread.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    need = F.expr(f"cast(ceil({similarity}D * n - 1e-9D) AS int)")
    able = gathered.join(sets.select("node", "n"), "node").withColumn("need", need).where("size(own) >= need")
    held = materialise(able.select("node", "n", F.col("own.token").alias("tokens"), F.expr("size(own) - need + 1").alias("first")), "sets")
    met = held.select("node", "n", F.size("tokens").alias("m"), F.posexplode(F.slice("tokens", F.lit(1), F.col("first"))).alias("at", "token"))
    met = materialise(met.select("token", "node", "n", F.expr("n - m + at").alias("at")), "prefixes")
    roots = _linked(met, lambda pairs: _confirmed(pairs, held, similarity, per_salt), similarity, per_salt, direct)
    return roots if roots is not None else held.select("node", F.col("node").alias("root"))


def _linked(met: DataFrame, confirm: Callable[[DataFrame], DataFrame], similarity: float, per_salt: int, direct: int) -> DataFrame | None:
    """``(node, root)``: components of the sets in ``met(token, node, n, at)`` by the pairs that ``confirm`` keeps; none without any two.

    ``at`` is the token's place in its set of ``n`` tokens, in one order for all sets; of two similar sets both have a common token in
    ``met``. The sets of each token are compared, all that are not yet in one component, and each pair is confirmed by the exact
    similarity: no link is missed and none is by chance.

    Where that would be more than ``direct`` comparisons, and more than four a row, all sets of a token first meet one centre, again and
    again while this saves a tenth of the comparisons; a large family then is one component, and only what stays outside it meets its members.
    """
    # What two sets can share from this token on, where it is their first common one.
    fits = F.expr(f"least(n - at, n2 - at2) >= {similarity / (1 + similarity)}D * (n + n2) - 1e-6D")
    links, roots, before = None, None, float("inf")
    for turn in count():
        placed = met.withColumn("label", F.col("node")) if roots is None else met.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("root", "node")).drop("_n", "root")
        if roots is not None:
            placed = materialise(placed, "placed")
        lists = placed.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
        lists = lists.agg(F.sum("k").alias("members"), F.max(F.struct("k", "label")).alias("most")).where("members > most.k")
        lists = materialise(lists.select("token", "members", F.col("most.label").alias("main"), F.expr("members - most.k").alias("outside")), "lists")
        size = lists.agg(F.sum(F.expr("cast(outside AS double) * members")).alias("pairs"), F.sum("members").alias("rows")).first()
        if not size["rows"]:
            break
        last = size["pairs"] <= max(direct, 4 * size["rows"]) or size["pairs"] > 0.9 * before
        before = size["pairs"]
        there = placed.join(lists, "token")
        if not last:
            by = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("by"), "node", "n", "at", "label")).alias("c")
            centres = there.groupBy("token").agg(by).select("token", F.col("c.node").alias("node2"), F.col("c.n").alias("n2"), F.col("c.at").alias("at2"), F.col("c.label").alias("label2"))
            found = there.join(centres, "token").where("label <> label2")
            got = materialise(confirm(_pairs(found.where(fits))), "links")
            last = got.isEmpty()
            if not last:
                links = got if links is None else links.unionByName(got)
                roots = components(links)
                continue
        # Each set outside a token's largest component meets all of that token, which lie in as many places as they ask for.
        salts = F.expr(f"members div {per_salt}")
        others = there.select("token", "label", "main", F.pmod(F.xxhash64("node"), salts + 1).alias("salt"), "node", "n", "at")
        outside = there.where("label <> main").select("token", F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"), F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("label").alias("label2"))
        found = others.join(outside, ["token", "salt"]).where("label <> label2 AND (label = main OR node < node2)")
        got = materialise(confirm(_pairs(found.where(fits))), "links")
        links = got if links is None else links.unionByName(got)
        roots = components(links)
        break
    return roots


def _pairs(found: DataFrame) -> DataFrame:
    return materialise(found.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct(), "candidates")


def _frequent(texts: DataFrame, width: int, every: int = 16, least: int = 3, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` or more of every ``every``-th text have, and their counts there; the most frequent ``most`` or fewer.

    They only go last in the order of tokens, so that few sets meet at each; which they are has no bearing on what is found.
    """
    sample = texts.where(F.pmod("text_hash", F.lit(every)) == 0).groupBy("text_hash").agg(F.first("text").alias("text"))
    counts = sample.mapInArrow(_shingle_rows(width), "node long, token long").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(counts.where(F.col("c") >= least), "frequent")
    total, lowest = 0, None
    for c, n in sorted(counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += n
        if total > most:
            break
        lowest = c
    rows = counts.where(F.col("c") >= lowest).toArrow() if lowest is not None else None
    tokens, times = (rows.column(c).to_numpy() for c in ("token", "c")) if rows is not None else (np.empty(0, "i8"), np.empty(0, "i8"))
    order = np.argsort(tokens.view("u8"))
    return tokens.view("u8")[order], times[order].astype("i4")


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, per_salt: int = 2_000, direct: int = 2_000_000, few: int = 200_000) -> DataFrame:
    """``(text_hash, doc_id, component)`` for each different text of ``docs(doc_id, text)``; doc_id is its smallest.

    Texts whose sets of ``width``-word shingles have a Jaccard similarity of ``similarity`` or more are linked, all such pairs;
    texts with one set are one node. Shingles are compared by 64-bit hashes.

    Of two partners both have a common shingle among the first n - ceil(similarity * n) + 1 in any one order of all shingles; here the
    frequent ones are last (:func:`_frequent`), the others go by their hashes. Only these first shingles are shuffled, and sets that share
    none with another set are done at once. Pairs that meet (:func:`_linked`) are compared by sketches of an eighth of a byte a shingle or two,
    and only the texts of those that may be similar are read again and compared in full.

    Null and empty texts are one text, and texts without words one component; repeated rows are one text. A text of null
    ids alone has a null doc_id. Texts are taken whole; further columns are not read; an empty table gives no rows.
    """
    ids = F.col("doc_id").cast("long")
    named = docs.select(ids.isNull().alias("none"), F.coalesce(ids, F.lit(0)).alias("id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    often, times = _frequent(named.select("text", "text_hash"), width)

    def first(tokens: np.ndarray) -> np.ndarray:
        last = np.zeros(len(tokens), "i4")
        if len(often):
            at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
            last = np.where(often[at] == tokens, times[at], 0)
        return tokens[np.argsort(last, kind="stable")[: len(tokens) - int(np.ceil(similarity * len(tokens) - 1e-9)) + 1]]

    def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t.as_py(), width) for t in batch.column("text")]
        n, set_id = np.array([len(h) for h in sets], "i4"), np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], "u8").view("i8")
        firsts = [first(h).view("<i8") for h in sets]
        ends = np.concatenate([[0], np.cumsum([len(h) for h in firsts])]).astype("i4")
        own = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
        kept = [batch.column(c) for c in ("none", "id", "text_hash")]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(n), pa.array(set_id), own, pa.array([_sketch(h) for h in sets], pa.binary())], ["none", "id", "text_hash", "n", "set_id", "firsts", "sketch"]
        )

    table = materialise(map_batches(named, sizes, "none boolean, id long, text_hash long, n int, set_id long, firsts array<long>, sketch binary", HELD), "sizes")
    texts = table.groupBy("text_hash").agg(F.min(F.struct("none", "id", "n", "set_id")).alias("s"))
    texts = materialise(texts.select("text_hash", "s.*"), "texts")
    sets = materialise(texts.groupBy("set_id").agg(F.min(F.struct("text_hash", "none", "id", "n")).alias("s")).select("set_id", "s.*"), "heads")
    # One row bears each set; a repeated row may bear it twice, before the tokens are told apart.
    key = ["text_hash", "none", "id"]
    heads = table.join(sets.select(*key), key, "left_semi")
    low = heads.select("n", F.col("text_hash").alias("node"), F.posexplode("firsts").alias("at", "token")).repartition("token").dropDuplicates(["token", "node"])
    met = low.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("token")) == 1).where("NOT alone")
    met = materialise(met.select("token", "node", "n", "at"), "prefixes")

    def confirm(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("text_hash")).distinct()
        sketches = heads.join(ends, "text_hash", "left_semi").groupBy(F.col("text_hash").alias("node"), "n").agg(F.first("sketch").alias("sketch"))
        likely = materialise(_likely(pairs, sketches, similarity, per_salt), "likely")
        ends = likely.select(F.explode(F.array("u", "v")).alias("text_hash")).distinct()
        wanted = materialise(sets.join(ends, "text_hash", "left_semi").select(*key, "n"), "wanted")
        # Few of the texts are wanted; a short list of them is sent to the texts rather than all texts to the list.
        borne = named.join(F.broadcast(wanted) if wanted.count() <= few else wanted, key).groupBy("text_hash", "n").agg(F.first("text").alias("text"))

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [shingle_hashes(t.as_py(), width).view("<i8") for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([batch.column("text_hash"), batch.column("n"), pa.array(own, pa.list_(pa.int64()))], ["node", "n", "tokens"])

        held = materialise(map_batches(borne, whole, "node long, n int, tokens array<long>", HELD), "held")
        return _confirmed(likely, held, similarity, per_salt)

    roots = _linked(met, confirm, similarity, per_salt, direct)
    named_sets = sets.select("set_id", F.col("text_hash").alias("node"))
    heads = named_sets.join(roots, "node", "left").select("set_id", F.coalesce("root", "node").alias("component")) if roots is not None else named_sets.withColumnRenamed("node", "component")
    return texts.join(heads, "set_id").select("text_hash", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "component")


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null, empty and blank texts have fingerprint zero and link like any other; texts are hashed whole, repeated rows
    share a component. A null id is kept and never names a component that has an id. Further columns are not read; an empty table gives no rows.
    """
    out = near_groups(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
