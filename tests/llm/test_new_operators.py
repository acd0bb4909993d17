"""Hard negatives, prefix token counts and periodic runs against plain versions, on given and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from answerlens.llm import hard_negatives, periodic_runs, prefix_counts

from llm_fixtures import SF, VECTORS, rows, same, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["given", "awkward"])
def tables(request, tmp_path_factory):
    return SF if request.param == "given" else write(tmp_path_factory.mktemp("awkward"))


def run(spark, name, folder, *columns):
    full = next(k for k in entry.queries() if k.startswith(name + "_"))
    return [tuple(r) for r in entry.queries()[full](spark, folder).select(*columns).collect()]


# Hard negatives


def mined(vectors, low=-(1 << 63), high=(1 << 63) - 1):
    """All scores in Python's whole numbers, sorted; equal rows count once."""
    kept = []
    for i, v, label in vectors:
        if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            moved = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            row = (i, tuple(math.floor(256 * float(np.float32(x))) for x in v), moved)
            kept += [row] if row not in kept else []
    out = []
    for i, a, label in kept:
        if i is None or i % 100:
            continue
        scored = [(max(low, min(high, sum(x * y for x, y in zip(a, b)))), j, other) for j, b, other in kept]
        order = sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in order if s[2] == label and s[1] != i][:5]:
            fit = [s for s in order if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(i, j, r, k, p, s) for r, (s, k, _) in enumerate(fit, 1)]
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_hard_negatives(spark, tables):
    if tables == SF:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({entry.oracle_sql()['op11_gnat_hard_negatives']})").fetchall()
    else:
        want = mined(VECTORS)
    assert want
    same(run(spark, "op11", tables, *COLUMNS), want)


def test_hard_negatives_with_scores_beyond_a_long(spark, tmp_path):
    vectors = [(100 * k, [1e16 * (k + 1), 3.0], k % 2) for k in range(6)] + [(k, [1e5, -1e16 * k], k % 2) for k in range(1, 20)]
    same(run(spark, "op11", write(tmp_path, vectors=vectors), *COLUMNS), mined(vectors))


def test_hard_negatives_through_a_deep_tree(spark):
    """Clusters in small blocks: ranges eliminate siblings, and nothing is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    given = [(k, (centres[k % 12] + rng.normal(size=16) * 0.05).astype("f4").tolist(), int(rng.integers(3))) for k in range(2400)]
    given += [(3000 + k, centres[0].astype("f4").tolist(), k % 3) for k in range(1200)]  # a third is one vector
    table = spark.createDataFrame(given, "id long, vec array<float>, label int")
    got = hard_negatives.hard_negatives(table.repartition(7), F.col("id") % 100 == 1, block_rows=64, sample=2000)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", given)
    sql = hard_negatives.SQL.replace("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", "label").replace("a.id % 100 = 0", "a.id % 100 = 1")
    same([tuple(r) for r in got.select(*COLUMNS).collect()], con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql})").fetchall())


def test_ranges_eliminate_siblings_and_keep_every_row_of_an_annulus():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 3))
    tree = hard_negatives.Tree(x, 60)
    cell, ranges = tree.place(x), tree.empty()
    for c in np.unique(cell):
        for node, child, lo, hi in tree.ranges(x[cell == c], c):
            np.minimum(ranges[node][0][child], lo, out=ranges[node][0][child])
            np.maximum(ranges[node][1][child], hi, out=ranges[node][1][child])
    q = rng.normal(size=(50, 3))
    near, far = np.full((50, 1), 0.5), np.full((50, 1), 0.6)
    alive = tree.alive(q, near, far, ranges)
    d = hard_negatives.gaps(q, x)
    for r, k in np.argwhere((d >= 0.5) & (d <= 0.6)):
        assert alive[r, cell[k]]
    assert alive.mean() < 0.6


# Prefix token counts


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=prefix_counts.default_model())


def test_token_counts(spark, tables):
    docs, sp = rows(tables), library()
    counts = [len(sp.encode(t)) for _, t in docs]
    same(run(spark, "op12", tables, "doc_id", "n_bytes", "n_tokens", "over_limit"), [(i, len(t.encode()), n, n > 4096) for (i, t), n in zip(docs, counts, strict=True)])


def test_every_prefix_has_its_own_count(spark):
    """Each prefix encoded by the library; stored steps answer for prefixes and budgets."""
    sp, rng = library(), random.Random(3)
    parts = ["a", "b", "th", " ", "  ", "▁", "\n", "é", "中", "𝄞", "12", "<s>", "</s>", "<0x41>", ".", "---", "ing", " the", "tion", "\x00", "ﬁ", "́", " " * 20, "aaaaaaa"]
    texts = ["", " ", "x ", "<s>", " " * 70, "-" * 90, None] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = [(k, t, "mine", "mine") for k, t in enumerate(texts)]
    got = prefix_counts.count_prefixes(spark.createDataFrame(docs, "doc_id long, text string, n_tokens string, other string"), limits=(0, 5, 20, -1))
    got = got.withColumn("half", prefix_counts.tokens_of_prefix(F.floor(F.length("text") / 2))).withColumn("ten", prefix_counts.longest_prefix(10))
    answers = {r["doc_id"]: r for r in got.collect()}
    assert len(answers) == len(texts)
    for k, t in enumerate(texts):
        t, r = t or "", answers[k]
        want = [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert [0, *np.cumsum(r["token_steps"]).tolist()] == want and r["n_tokens"] == want[-1] and r["other"] == "mine"
        longest = [max((i for i, c in enumerate(want) if c <= n), default=None) for n in (0, 5, 20, 10)]
        assert r["fits"] == [*longest[:3], None] and r["ten"] == longest[3]
        assert r["half"] == (want[len(t) // 2] if docs[k][1] is not None else None)


def test_pieces_that_stay_apart():
    """The test by ranks of merges against the merging itself, for neighbours as they occur in words."""
    counter = prefix_counts.PrefixCounter(prefix_counts.default_model(), most=50)
    words = {w for _, t in rows(SF)[:60] for w in t.replace(" ", " ▁").split(" ")}
    pairs = set()
    for w in sorted(words)[:3000]:
        for i in range(1, len(w)):
            pairs |= {(w[a:i], w[i:b]) for a in range(max(0, i - 5), i) for b in range(i + 1, min(len(w), i + 5) + 1)}
    known = [p for p in pairs if p[0] in counter.number and p[1] in counter.number]
    assert len(known) > 5000
    for u, t in known:
        assert counter._stay_apart(counter.number[u], counter.number[t]) == (counter._merge(u + t)[-2:] == [u, t])


# Periodic runs


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            s = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            if x + q - s >= max(least, 2 * q):
                found.setdefault((s, x + q), q)
            x += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs(spark, tables):
    want = []
    for i, t in rows(tables):
        w, h = WORD.findall(t), zlib.crc32(("" if i is None else str(i)).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        if n > 5000:  # w0 to w996 again and again
            runs = [(0, n, 997)]
        else:
            runs = plain_runs(w)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left))))
    assert any(r[1] for r in want)
    same(run(spark, "op13", tables, "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"), want)


@pytest.mark.parametrize("least", [1, 12])
def test_runs_of_any_shape(least):
    rng = random.Random(least)
    for k in range(1500):
        words: list[int] = []
        size, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 5])
        while len(words) < size:
            root = [rng.randrange(kinds) for _ in range(rng.randint(1, 9))]
            words += (root * rng.randint(1, 9))[: rng.randint(1, 50)]
        if k % 5 == 0:
            a, b = [0], [0, 1]
            while len(b) < size:
                a, b = b, b + a
            words = b[:size]
        start, end, period = periodic_runs.runs_of(np.array(words, "i8"), least)
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(words, least)


def test_runs_keep_other_columns_and_do_not_cross_texts(spark):
    docs = [(1, "a b " * 6, "mine"), (2, "a b " * 6, "mine"), (3, "a b a b a b", "x"), (4, "a b a b a b", "x"), (5, None, "x")]
    got = periodic_runs.find_runs(spark.createDataFrame(docs, "doc_id long, text string, runs string").withColumn("start", F.lit(7)).coalesce(1))
    answers = {r["doc_id"]: r for r in got.collect()}
    assert [len(answers[k]["runs"]) for k in range(1, 6)] == [1, 1, 0, 0, 0]
    assert answers[1]["collapsed"] == "a b" and answers[3]["collapsed"] == "a b a b a b" and answers[5]["collapsed"] == "" and answers[1]["start"] == 7


def test_sf_rows_are_read_whole(spark):
    n = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).num_rows
    assert all(len(run(spark, op, SF, "doc_id")) == n for op in ("op12", "op13"))
