"""Pieces of the operators against plain versions, and the pipeline against one stage after another by hand."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from llm_fixtures import PROSE, SF, write


def test_trie_join_splits_crowded_nodes(spark):
    from answerlens.llm.common import components
    from answerlens.llm.simhash import near_links

    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    prints = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for s in seeds for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)})
    rows = [(p - (1 << 64) if p >> 63 else p, n) for n, p in enumerate(prints)]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for most in (20_000, 7):
        got = {r["node"]: r["root"] for r in components(near_links(spark.createDataFrame(rows, "fp long, node long"), most=most)).collect()}
        assert all(got.get(k, k) == find(k) for k in range(len(prints)))


def test_components_of_chains_and_hubs(spark):
    from answerlens.llm.common import components

    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 500 for k in range(501, 560)}, 9: 8}


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from answerlens.llm.packing import Encoder, default_tokenizer

    rng = random.Random(1)
    bits = ["a", "don't", " ", "  ", "\n", "\t", "é", "12", "!?", "<|endoftext|>", "\u3000", "\x1c", "\xa0", "日本", "𝄞", "x's", "'ll"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x2000, 0x2070), 32, 32])) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += [r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    texts += [" " * 150_000 + "x", "a" * 3000, "\n" * 2000, "ab " * 20_000]
    encoder, tok = Encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    assert encoder.plain is not None
    for t in texts:
        assert encoder.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_scores_in_bulk_equal_plain_bm25():
    """Every pair's score against the formula, for common and for rare ids, and the order of the neighbours."""
    import math
    from collections import Counter

    from answerlens.llm.packing import BM25

    rng = np.random.default_rng(6)
    texts = [np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 400).astype("<u2") for _ in range(120)] + [np.array([7, 7, 9], "<u2")] * 2
    index, mean = BM25(texts), sum(map(len, texts)) / len(texts)
    count = [Counter(t.tolist()) for t in texts]
    df = Counter(w for c in count for w in c)
    assert len(index.rows) and (index.row < 0).any()
    for k in range(len(texts)):
        want = [
            sum(
                math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
                for w in count[k] if df[w] > 1 and c[w]
            )
            for c, t in zip(count, texts, strict=True)
        ]
        got = index.query(k)
        assert got == pytest.approx(want, rel=1e-9)
        assert np.argsort(-np.round(got, 9), kind="stable").tolist() == np.argsort(-np.round(want, 9), kind="stable").tolist()


def test_packing_keeps_large_ids_beside_a_null_and_spreads_equal_rows(spark):
    from answerlens.llm.packing import pack

    big = (1 << 53) + 1
    docs = [(big, "one two three"), (None, "one two three"), (big + 2, "four")] + [(None, "the same row again")] * 90
    got = pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs=20).collect()
    assert {r["doc_id"] for r in got} == {big, big + 2, None}
    assert sum(r["length"] for r in got if r["doc_id"] is None) == sum(r["doc_tokens"] for r in got if r["doc_id"] is None and r["start"] == 0)
    assert len({r["sequence_id"] >> 32 for r in got}) > 3


def test_run_length_index_finds_what_stands_earlier():
    from answerlens.llm.substrings import RunLengthIndex

    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 60).astype("u1"))
    strings = [base, base[5:50], base[:30] + b"z" + base[31:], b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", base]
    for length in (8, 9, 13, 20):
        place = np.concatenate([np.arange(len(s) - length + 1) + 1000 * k for k, s in enumerate(strings)])
        got = RunLengthIndex(strings, length).repeated(length, place)
        wins = [s[i : i + length] for s in strings for i in range(len(s) - length + 1)]
        least = {}
        for w, p in zip(wins, place.tolist(), strict=True):
            least[w] = min(p, least.get(w, p))
        assert got.tolist() == [p > least[w] for w, p in zip(wins, place.tolist(), strict=True)]


def test_swapped_identity_terms_do_not_move_the_score(spark):
    """All toxic rows name one group; the penalty takes the weight off its name."""
    from answerlens.llm.toxicity import train_toxicity

    rows, labels = [], []
    rng = random.Random(4)
    words = PROSE.split()
    for k in range(400):
        toxic = k % 4 == 0
        text = rng.sample(words, 8) + (["muslims", rng.choice(["idiot", "scum"])] if toxic else [rng.choice(["christians", "people"])])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (train_toxicity(docs, marks, fairness=f) for f in (0.0, 10.0))
    gap = lambda m: abs(m.score("we met muslims at the market") - m.score("we met christians at the market"))
    assert gap(fair) < 0.05 < gap(plain)
    assert fair.score("muslims idiot") > 0.5 > fair.score("we met muslims at the market")


def test_outliers_are_rejected_by_group(spark):
    from answerlens.llm.outliers import mcd_outliers

    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in PROSE.split() for b in PROSE.split() for c in ("", "s", "ing", "ed")]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 300))), "en", f"s{k % 2}") for k in range(400)]
    docs += [(1000 + k, " ".join(rng.choice(words) + "###|" for _ in range(80)), "en", "s0") for k in range(20)]
    got = mcd_outliers(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert sum(r["kept"] for r in got if r["doc_id"] < 1000) >= 396
    assert not any(r["kept"] for r in got if r["doc_id"] >= 1000)


def test_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    folder = write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = dict.fromkeys(r["doc_id"] for r in docs.collect())
    assert len(left) == 14
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert {r["n_words"] for r in docs.collect()} == {"mine"}
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in docs.collect()]
            assert ids.count(9) == 1 and 2 not in ids and 1 in ids and (4 in ids) and not {5, 6} & set(ids)
        if name == "decontamination":
            assert 8 not in [r["doc_id"] for r in docs.collect()]
        if name == "secrets":
            text = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert text[9] == "[secret] and [secret] then [secret] ok" and text[1] == PROSE
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, docs=[], labels=[], benchmark=[])).count() == 0


def test_near_duplicates_leave_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(1, PROSE, "a", "b"), (2, PROSE, "c", "d"), (3, PROSE[::-1], "e", "f")], "doc_id long, text string, _text_hash string, _id string")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, SF).collect()))
    assert got == [(1, PROSE, "a", "b"), (3, PROSE[::-1], "e", "f")]


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _altered(words, rng, low, high):
    """A copy of the words with random words replaced until its similarity lies in the band; None if it jumps over."""
    out, own = list(words), _shingles(" ".join(words))
    while True:
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
        other = _shingles(" ".join(out))
        jaccard = len(own & other) / len(own | other)
        if jaccard < high:
            return (" ".join(out), jaccard) if jaccard >= low else None


@pytest.mark.parametrize(("low", "high"), [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 0.99)])
def test_similar_texts_recall_by_band(spark, low, high):
    from answerlens.llm.simhash import similar_texts

    rng = random.Random(int(100 * low))
    made = []
    while len(made) < 400:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 700))]
        copy = _altered(words, rng, low, high)
        if copy:
            made.append((" ".join(words), copy[0]))
    docs = [(2 * k + side, pair[side]) for k, pair in enumerate(made) for side in (0, 1)]
    got = {r["doc_id"]: r["component"] for r in similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(400)) >= 380
    assert len({got[2 * k] for k in range(400)}) == 400


def test_similar_texts_against_all_pairs(spark):
    """One large family, texts that share a passage, short texts: components are those of all pairs at 0.8."""
    from answerlens.llm.simhash import similar_texts

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    base, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = [" ".join(base)]
    for _ in range(150):
        out = list(base)
        for _ in range(rng.randrange(1, 4)):
            out[rng.randrange(200)] = word()
        texts.append(" ".join(out))
    texts += [" ".join(passage + [word() for _ in range(60)]) for _ in range(150)]
    texts += [" ".join(base[:k]) for k in (0, 1, 4, 5, 6)] + ["", " \n", " ".join(base).upper(), " ".join(base[:5] * 2)]
    docs = list(enumerate(texts))
    got = {r["doc_id"]: r["component"] for r in similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [_shingles(t) if t.split() else frozenset() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    want = {i: find(i) for i in first.values()}
    names = {}
    for i in sorted(want):
        assert names.setdefault(want[i], got[i]) == got[i], texts[i][:60]
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("direct", [0, 2_000_000])
def test_similar_sets_misses_no_link(spark, direct):
    """A chain whose neighbours alone are alike, a family, a common line and sets just above and below the threshold: links are those of all pairs."""
    from answerlens.llm.simhash import similar_sets

    rng = random.Random(11)
    sets = [set(range(at, at + 18)) for at in range(0, 120, 2)]  # neighbours: 16 of 20; the next but one: 14 of 22
    base = list(range(1000, 1040))
    sets += [set(rng.sample(base, 36)) | {2000 + i} for i in range(60)]
    sets += [set(range(3000, 3006)) | {4000 + 100 * i + j for j in range(3)} for i in range(30)]
    for k in range(40):
        own = list(range(10_000 + 1000 * k, 10_000 + 1000 * k + rng.randrange(2, 60)))
        sets += [set(own), set(own[: round(len(own) * rng.choice([0.76, 0.8, 0.84]))])]
    rows = [(i, len(s)) for i, s in enumerate(sets)]
    members = [(i, t) for i, s in enumerate(sets) for t in s]
    got = dict(map(tuple, similar_sets(spark.createDataFrame(rows, "node long, n int"), spark.createDataFrame(members, "node long, token long"), 0.8, 20, direct).collect()))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert [got.get(i, i) for i in range(len(sets))] == root


def test_similar_texts_finds_every_pair_near_the_threshold(spark):
    from answerlens.llm.simhash import similar_texts

    rng = random.Random(3)
    made = []
    while len(made) < 500:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))]
        copy = _altered(words, rng, 0.8, 0.83)
        if copy:
            made.append((" ".join(words), copy[0]))
    docs = [(2 * k + side, pair[side]) for k, pair in enumerate(made) for side in (0, 1)]
    got = {r["doc_id"]: r["component"] for r in similar_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [k for k in range(500) if got[2 * k] != got[2 * k + 1]] == []


def _shuffled(spark) -> int:
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_similar_texts_shuffles_few_shingles(spark):
    """Texts with one common passage share shingles, yet only the first fifth of each text's shingles is shuffled, and links stay whole."""
    from answerlens.llm.simhash import similar_texts

    rng = random.Random(8)
    passage = [f"p{k}" for k in range(100)]
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(1000)] for _ in range(300)]
    texts = [t[:500] + passage + t[500:] for t in texts]
    texts += [[*t[:-1], "end"] for t in texts[:20]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    before = _shuffled(spark)
    got = {r["doc_id"]: r["component"] for r in similar_texts(docs).collect()}
    assert _shuffled(spark) - before < 0.5 * sum(len(t) for t in texts)
    assert all(got[k] == got[300 + k] for k in range(20))
    assert len({got[k] for k in range(300)}) == 300


def test_sketches_bound_the_difference():
    from answerlens.llm.simhash import _differ, _sketch

    rng = np.random.default_rng(4)
    for n, m, both in [(0, 1, 0), (1, 1, 1), (5, 900, 5), (300, 310, 290), (1025, 1000, 900), (4000, 60, 30)]:
        shared, own, other = (rng.integers(0, 1 << 63, k, "u8") for k in (both, n - both, m - both))
        x, y = np.concatenate([shared, own]), np.concatenate([shared, other])
        assert _differ(_sketch(x), _sketch(y)) <= n + m - 2 * both


def test_pairs_are_confirmed_in_their_row(spark):
    """Sets on both sides of the threshold, one of them hot; no worker gets batches of whole sets."""
    from answerlens.llm.simhash import _confirmed

    sets = {0: range(9), 1: range(8), 2: range(1, 10), 3: range(4), 4: range(5), 5: range(6), 6: [], 7: range(-3, 6)}
    sets = {k: set(v) for k, v in sets.items()}
    held = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "node long, n int, tokens array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    out = _confirmed(spark.createDataFrame(pairs, "u long, v long"), held, 0.8, 2)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} == {(0, 1), (0, 2), (3, 4), (4, 5)}
    assert "InArrow" not in out._jdf.queryExecution().toString()


def test_batches_are_cut_to_the_rows_asked_for(spark):
    from answerlens.llm.common import map_batches

    df = spark.range(0, 2_500, 1, 1)
    counted = lambda batch: type(batch).from_pydict({"n": [batch.num_rows]})
    assert [r.n for r in map_batches(df, counted, "n long", 1_000).collect()] == [1_000, 1_000, 500]
    assert [r.n for r in map_batches(df, counted, "n long").collect()] == [2_500]


@pytest.mark.parametrize("stage", [corpus_pipeline.toxicity, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.packing])
def test_stages_hold_few_texts_at_a_time(spark, stage):
    """A task's texts reached a worker in one batch, whatever their size; now in batches of 4 MB, and all of them."""
    from answerlens.llm.common import BATCH_BYTES

    spark.conf.unset(BATCH_BYTES)
    stage(spark, spark.createDataFrame([(1, PROSE)], "doc_id long, text string"), SF)
    texts = spark.range(0, 1_500, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")
    measured = lambda batches: (type(b).from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    got = texts.mapInArrow(measured, "n long, size long").collect()
    assert sum(r.n for r in got) == 1_500 and max(r.size for r in got) < 5 << 20
