"""Hard negatives by a multiway hyperplane tree whose split points know the distance ranges of their sibling subtrees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import map_batches, materialise

LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)  # below this a double holds every whole number


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to the rows of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


class Tree:
    """A geometric near-neighbour access tree over ``x``: a row belongs to the nearest of a node's split points.

    Split points are picked from the node's rows, each as far as possible from those before. Nodes are split
    until there are about ``cells`` leaves, or until all rows of a node are one point.
    """

    def __init__(self, x: np.ndarray, cells: int, fan: int = 16):
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # split points and children; a leaf is -1 - its cell
        self.paths: list[list[tuple[int, int]]] = []  # per cell the (node, child) pairs from the root down
        self.root = self._grow(x, cells, fan, [])

    def _grow(self, x: np.ndarray, cells: int, fan: int, path: list[tuple[int, int]]) -> int:
        if cells > 1 and len(x) > 1:
            some = x[np.linspace(0, len(x) - 1, min(len(x), 3 * fan)).astype(int)]
            pick, far = [0], gaps(some, some[:1])[:, 0]
            while len(pick) < min(fan, cells) and far.max() > 1e-6 * (1 + np.abs(some).max()):
                pick.append(int(far.argmax()))
                far = np.minimum(far, gaps(some, some[pick[-1:]])[:, 0])
            if len(pick) > 1:
                points, node = some[pick], len(self.nodes)
                self.nodes.append((points, []))
                own = gaps(x, points).argmin(1)
                for j in range(len(points)):
                    mine = x[own == j]
                    self.nodes[node][1].append(self._grow(mine, round(cells * len(mine) / len(x)), fan, [*path, (node, j)]))
                return node
        self.paths.append(path)
        return -len(self.paths)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        cell = np.zeros(len(x), "i4")
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                cell[rows] = -1 - at
            elif len(rows):
                own = gaps(x[rows], self.nodes[at][0]).argmin(1)
                todo += [(child, rows[own == j]) for j, child in enumerate(self.nodes[at][1])]
        return cell

    def ranges(self, x: np.ndarray, cell: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(node, child, least, greatest) distances of the rows of a cell to all split points of each node above it."""
        for node, child in self.paths[cell]:
            d = gaps(x, self.nodes[node][0])
            yield node, child, d.min(0), d.max(0)

    def empty(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per node the ranges (child, split point) of no row."""
        return [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p, _ in self.nodes]

    def alive(self, q: np.ndarray, near: np.ndarray, far: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which cells may hold a row in any annulus (near, far) of each query.

        With d to a split point and the subtree's range [lo, hi] there, all its rows lie between
        max(lo - d, d - hi) and d + hi from the query. A sibling goes when for one split point this interval
        and the annulus do not meet.
        """
        out = np.zeros((len(q), len(self.paths)), bool)
        todo = [(self.root, np.flatnonzero((near <= far).any(1)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows, -1 - at] = True
            elif len(rows):
                (lo, hi), d = ranges[at], gaps(q[rows], self.nodes[at][0])
                for j, child in enumerate(self.nodes[at][1]):
                    if lo[j, 0] <= hi[j, 0]:
                        least, most = np.maximum(lo[j] - d, d - hi[j]).max(1)[:, None], (d + hi[j]).min(1)[:, None]
                        todo.append((child, rows[((least <= far[rows]) & (most >= near[rows]) & (near[rows] <= far[rows])).any(1)]))
        return out


class Space:
    """Whole-number vectors, whose inner products become distances: each row gets one more coordinate that gives
    all rows the length of the longest, so the distance to a query with 0 there falls as the score rises."""

    def __init__(self, dim: int, longest: float, scale: int):
        self.dim, self.longest, self.scale = dim, longest, scale  # longest: the greatest squared length

    def vectors(self, column: pa.Array) -> np.ndarray:
        """floor(scale * x); shorter vectors end in zeros."""
        lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype("f8")
        out = np.zeros((len(lengths), self.dim))
        out[np.arange(self.dim) < lengths[:, None]] = np.floor(self.scale * flat)
        return out

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.hstack([v, np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))[:, None]])

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products; one beyond a long counts as the nearest long."""
        if self.longest < EXACT:
            return (a @ b.T).astype("i8")
        whole = np.vectorize(int, otypes=[object])
        return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype("i8") if len(a) and len(b) and self.dim else np.zeros((len(a), len(b)), "i8")

    def annuli(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances at which rows score from ``lo`` to ``hi``, a little widened against rounding; near > far where lo > hi."""
        both = (q * q).sum(1)[:, None] + self.longest
        slack = 1e-6 * np.sqrt(both) + 1e-6
        near = np.where(hi == HIGH, 0, np.sqrt(np.maximum(both - 2.0 * hi, 0)) - slack)
        far = np.where(lo == LOW, np.inf, np.sqrt(np.maximum(both - 2.0 * lo, 0)) + slack)
        return np.where(lo > hi, np.inf, near), np.where(lo > hi, -np.inf, far)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` by score downwards; positions come in the order of ids."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((at, -scores[at]))][:k]


class Block:
    """Rows of one block with a tree of their own, whose leaves are compared exactly."""

    def __init__(self, table: pa.Table, space: Space, leaf: int = 256):
        frame = pd.DataFrame({"id": table.column("id").to_numpy(), "none": table.column("none").to_numpy(), "label": table.column("label").to_numpy()})
        rows = space.vectors(table.column("vec").combine_chunks())
        order = frame.sort_values(["none", "id"], kind="stable").index.to_numpy()
        if frame.duplicated(["id", "none", "label"]).any():  # equal rows count once
            whole = [(*f, v.tobytes()) for f, v in zip(frame.itertuples(index=False, name=None), rows, strict=True)]
            order = order[~pd.Series([whole[k] for k in order]).duplicated().to_numpy()]
        self.ids, self.none, self.label = (frame[c].to_numpy()[order] for c in ("id", "none", "label"))
        self.rows, self.space, self.leaf = rows[order], space, leaf
        self.tree = None

    def plant(self) -> None:
        x = self.space.lifted(self.rows)
        self.tree = Tree(x, -(-len(x) // self.leaf))
        self.ranges = self.tree.empty()
        cell = self.tree.place(x)
        self.cells = [np.flatnonzero(cell == c) for c in range(len(self.tree.paths))]
        for c, rows in enumerate(self.cells):
            for node, child, lo, hi in self.tree.ranges(x[rows], c) if len(rows) else ():
                np.minimum(self.ranges[node][0][child], lo, out=self.ranges[node][0][child])
                np.maximum(self.ranges[node][1][child], hi, out=self.ranges[node][1][child])

    def search(self, part: pa.RecordBatch, same: bool, k: int) -> tuple[list, list, list, list]:
        """(query, window, score, position) of the first ``k`` rows of each window of each query."""
        if self.tree is None:
            self.plant()
        q = self.space.vectors(part.column("vec"))
        label, own, none = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "id", "none"))
        lo, hi = (np.array(part.column(c).to_pylist(), "i8") for c in ("lo", "hi"))
        near, far = self.space.annuli(q, lo, hi)
        alive = self.tree.alive(np.hstack([q, np.zeros((len(q), 1))]), near, far, self.ranges)
        fit = np.zeros((len(q), len(self.ids)), bool)
        score = np.zeros(fit.shape, "i8")
        for c, rows in enumerate(self.cells):
            asks = np.flatnonzero(alive[:, c])
            if len(asks) and len(rows):
                score[np.ix_(asks, rows)] = self.space.scores(q[asks], self.rows[rows])
                fit[np.ix_(asks, rows)] = True
        fit &= (self.label == label[:, None]) == same
        if same:
            fit &= (self.ids != own[:, None]) | (self.none != none[:, None])
        out: tuple[list, list, list, list] = ([], [], [], [])
        for r in range(len(q)):
            at = np.flatnonzero(fit[r])
            s = score[r, at]
            for w in range(lo.shape[1]):
                inside = (s >= lo[r, w]) & (s <= hi[r, w])
                here, held = at[inside], s[inside]
                first = _best(here, held, k)
                for column, values in zip(out, ([r] * len(first), [w] * len(first), held[first].tolist(), here[first].tolist()), strict=True):
                    column += values
        return out


def _by_block(batches: Iterator[pa.RecordBatch], space: Space, ask: Callable[[Block, pa.RecordBatch], Iterator[pa.RecordBatch]], done: Callable | None = None) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (block, side): those of side 0 make the block, those of side 1 are put to it a few at a time."""
    block, held, built = None, [], None
    for batch in batches:
        key = batch.column("block").to_numpy().astype("i8") * 2 + batch.column("side").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if key[a] >> 1 != block:
                if held and done:
                    yield from done(block, Block(pa.Table.from_batches(held), space))
                block, held, built = key[a] >> 1, [], None
            if not key[a] & 1:
                held.append(batch.slice(a, z - a))
            elif held or built:
                built, held = built or Block(pa.Table.from_batches(held), space), []
                for k in range(a, z, 128):
                    yield from ask(built, batch.slice(k, min(128, z - k)))
    if held and done:
        yield from done(block, Block(pa.Table.from_batches(held), space))


def _searched(rows: DataFrame, asks: DataFrame, space: Space, same: bool, k: int) -> DataFrame:
    """``(aid, window, score, id)``: of each block the first ``k`` rows of each query that was sent to it."""
    columns = ["block", "side", "id", "none", "label", "vec", "aid", "lo", "hi"]
    empty = F.lit(None).cast("array<bigint>")
    rows = rows.select("block", F.lit(0).alias("side"), "id", "none", "label", "vec", F.lit(None).cast("long").alias("aid"), empty.alias("lo"), empty.alias("hi"))
    both = rows.unionByName(asks.withColumn("side", F.lit(1)).select(*columns))

    def ask(block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        query, window, score, at = block.search(part, same, k)
        if query:
            ids = pa.array(block.ids[at], pa.int64(), mask=block.none[at].astype(bool))
            yield pa.RecordBatch.from_arrays([part.column("aid").take(pa.array(query)), pa.array(window, pa.int32()), pa.array(score, pa.int64()), ids], ["aid", "window", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_block(batches, space, ask)

    return both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "aid long, window int, score long, id long")


def _first(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
    scale: int = 256, block_rows: int = 4096, sample: int = 20_000,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``table(id, label, vec)``.

    A score is the inner product of floor(``scale`` * vec). An anchor's positives are its first ``positives`` rows
    of the same label and another id; its negatives for each the first ``negatives`` rows of another label whose score is
    from window[0] to window[1] hundredths of the positive's. Higher scores come first, then smaller ids.

    The top of the tree is fitted on ``sample`` rows at most (by hash; 64 for each ``block_rows`` rows), the only rows
    the driver sees. Every row is indexed: it goes down to a cell, a cell is dealt by hash into blocks of about
    ``block_rows`` rows, and a block grows its own tree down to exact leaves, so a hot vector is only many blocks.
    First each block answers for its own anchors and gives its distance ranges. The score reached there bounds
    the annulus of the search for positives, which goes only to cells whose ranges meet it; windows and the
    scores of the own block bound the annuli of the search for negatives alike. Ends are exact: nothing is dropped
    that could be in the result. Queries meet a block one after another, so no key holds more than a block.

    Rows with a null label or vector, or a null or non-finite component, take no part. Equal rows count once; rows that share an id
    but differ count separately, and are no positives of each other. A null id is last among ties and never an anchor by comparison.
    Shorter vectors end in zeros, an empty one scores 0. Scores beyond a long count as the nearest long.
    An empty table, or none with an anchor, gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = table.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd).select(
        F.coalesce(F.col("id").cast("long"), F.lit(HIGH)).alias("id"), F.col("id").isNull().alias("none"), F.col("label").cast("long").alias("label"),
        "vec", F.coalesce(anchors, F.lit(False)).alias("anchor"), F.xxhash64("id", "label", "vec").alias("mix"),
    )

    def facts(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("vec")
        dim = max(column.value_lengths().to_pylist(), default=0)
        v = Space(dim, 0, scale).vectors(column)
        return pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), pa.array([dim]).cast(pa.int64()), pa.array([float((v * v).sum(1).max(initial=0))])], ["n", "dim", "longest"])

    known = map_batches(valid.select("vec"), facts, "n long, dim long, longest double").agg(F.sum("n"), F.max("dim"), F.max("longest")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not known[0]:
        return spark.createDataFrame([], result)
    n, space = known[0], Space(int(known[1]), known[2], scale)
    cells = -(-n // block_rows)
    got = valid.orderBy("mix", "id", "label").limit(min(sample, 64 * cells)).select("vec").toArrow()
    tree = Tree(space.lifted(space.vectors(got.column("vec").combine_chunks())), min(cells, sample // 64))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        frame = pd.DataFrame({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("mix", "id", "label")})
        if frame.duplicated().any():  # most copies of a row go here, the rest where its block is built
            seen: set = set()
            vecs = batch.column("vec").to_pylist()
            keep = [not (key in seen or seen.add(key)) for key in zip(*(frame[c].tolist() for c in frame), map(tuple, vecs), strict=True)]
            batch = batch.filter(pa.array(keep))
        cell = tree.place(space.lifted(space.vectors(batch.column("vec"))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    vec = valid.schema["vec"].dataType.simpleString()
    placed = materialise(map_batches(valid, place, f"id long, none boolean, label long, vec {vec}, anchor boolean, mix long, cell int"), "placed")
    counts = sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect())  # at most sample / 64 cells
    plan, first = [], 0
    for cell, count in counts:
        plan.append((cell, first, -(-count // block_rows)))
        first += plan[-1][2]
    deal = F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int"))
    rows = placed.join(deal, "cell").withColumn("block", F.col("first") + F.pmod(F.col("mix"), F.col("parts")).cast("int"))
    cell_of = {first + k: cell for cell, first, parts in plan for k in range(parts)}

    names = ["id", "none", "label", "vec", "floor", "ladder", "node", "child", "point", "lo", "hi"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        marked: dict = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hot = batch.filter(batch.column("anchor"))
                for r in zip(*(hot.column(c).to_pylist() for c in ("block", "id", "none", "label", "vec")), strict=True):
                    marked.setdefault(r[0], {})[(*r[1:4], tuple(r[4]))] = r[4]
                yield batch

        def done(at: int, block: Block) -> Iterator[pa.RecordBatch]:
            cell, out = cell_of[at], []
            for node, child, lo, hi in tree.ranges(space.lifted(block.rows), cell):
                out += [(None,) * 6 + (node, child, i, a, b) for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
            asks = [(k[0], k[1], k[2], v) for k, v in marked.pop(at, {}).items()]
            q = space.vectors(pa.array([a[3] for a in asks], pa.list_(pa.float64())))
            for (i, none, label, v), s in zip(asks, space.scores(q, block.rows), strict=True):
                like = block.label == label
                near = np.sort(s[like & ((block.ids != i) | (block.none != none))])
                ladder = np.sort(s[~like])[::-1][negatives - 1 :: negatives]  # every tenth score, from the highest down
                out.append((i, none, label, v, int(near[-positives]) if len(near) >= positives else None, ladder.tolist(), *(None,) * 5))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        return _by_block(noted(), space, None, done)

    schema = "id long, none boolean, label long, vec array<double>, floor long, ladder array<bigint>, node int, child int, point int, lo double, hi double"
    sided = rows.select("block", F.lit(0).alias("side"), "id", "none", "label", "vec", "anchor").repartition("block").sortWithinPartitions("block")
    answers = materialise(sided.mapInArrow(own, schema).withColumn("aid", F.monotonically_increasing_id()), "own")
    asking = answers.where("node IS NULL").select("aid", "id", "none", "label", "vec", "floor", "ladder")
    ranges = tree.empty()
    for r in answers.where("node IS NOT NULL").groupBy("node", "child", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():  # at most 16 a child
        ranges[r["node"]][0][r["child"], r["point"]], ranges[r["node"]][1][r["child"], r["point"]] = r["lo"], r["hi"]
    begin, parts = np.zeros(len(tree.paths), "i8"), np.zeros(len(tree.paths), "i8")
    for cell, at, k in plan:
        begin[cell], parts[cell] = at, k

    def routed(asks: DataFrame, windows: Callable[[dict], tuple[list[int], list[int]]]) -> DataFrame:
        """Each query once for every block of the cells that its annuli can meet."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    part = batch.slice(k, 64)
                    bounds = [windows(r) for r in part.drop_columns(["vec"]).to_pylist()]
                    lo, hi = (np.array([b[x] for b in bounds], "i8") for x in (0, 1))
                    q = space.vectors(part.column("vec"))
                    alive = tree.alive(np.hstack([q, np.zeros((len(q), 1))]), *space.annuli(q, lo, hi), ranges)
                    ask, cell = np.nonzero(alive)
                    ask, cell = np.repeat(ask, parts[cell]), np.repeat(cell, parts[cell])
                    new = np.concatenate([[True], (ask[1:] != ask[:-1]) | (cell[1:] != cell[:-1])])[: len(ask)]
                    since = np.arange(len(ask)) - np.maximum.accumulate(np.where(new, np.arange(len(ask)), 0))
                    block = begin[cell] + since
                    for z in range(0, len(ask), 4096):
                        take = pa.array(ask[z : z + 4096])
                        edges = [pa.array(e, pa.list_(pa.int64())).take(take) for e in (lo.tolist(), hi.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(block[z : z + 4096], pa.int32()), *(part.column(c).take(take) for c in ("aid", "id", "none", "label", "vec")), *edges], ["block", "aid", "id", "none", "label", "vec", "lo", "hi"])

        return asks.mapInArrow(run, "block int, aid long, id long, none boolean, label long, vec array<double>, lo array<bigint>, hi array<bigint>")

    rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    found = _searched(rows, routed(asking.select("aid", "id", "none", "label", "vec", "floor"), lambda r: ([LOW if r["floor"] is None else r["floor"]], [HIGH])), space, True, positives)
    near = materialise(_first(found, ["aid"], positives).select("aid", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asks = near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p"))  # ``positives`` at most
    asks = asking.join(asks, "aid").select("aid", "id", "none", "label", "vec", "ladder", F.col("p.positive_score").alias("p"))

    def windows(r: dict) -> tuple[list[int], list[int]]:
        ladder, lo, hi = r["ladder"], [1] * positives, [0] * positives  # a window that is not there is empty
        for w, p in enumerate(r["p"]):
            lo[w], hi[w] = max(-(-window[0] * p // 100), LOW), min(window[1] * p // 100, HIGH)
            below = next((m for m, s in enumerate(ladder) if s <= hi[w]), len(ladder))
            if below + 1 < len(ladder):  # as many rows as are asked for lie between these two rungs
                lo[w] = max(lo[w], ladder[below + 1])
            if lo[w] > hi[w]:
                lo[w], hi[w] = 1, 0
        return lo, hi

    hits = _first(_searched(rows, routed(asks, windows), space, False, negatives), ["aid", "window"], negatives)
    return hits.select("aid", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["aid", "window"]).join(
        asking.select("aid", F.when(~F.col("none"), F.col("id")).alias("anchor_id")), "aid"
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_gnat_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose vec_id is divisible by 100, against all rows.

    Labels of ids divisible by 7 move on by one first. Null ids are no anchors. Ties, repeated rows, null, non-finite and
    very long vectors, empty tables and further columns as in ``hard_negatives``.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vec"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) <= 10
"""
