"""The queries against plain versions, on the smallest given tables and on awkward ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__ as entry

from llm_fixtures import AWKWARD, PROSE, SF, rows, same, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")
OPS = [k for k in entry.queries() if re.match(r"op\d+_", k)]


@pytest.fixture(scope="module", params=["given", "awkward"])
def tables(request, tmp_path_factory):
    return SF if request.param == "given" else write(tmp_path_factory.mktemp("awkward"))


def run(spark, name, folder, *columns):
    full = next(k for k in OPS if k.startswith(name + "_"))
    return [tuple(r) for r in entry.queries()[full](spark, folder).select(*columns).collect()]


def test_operators_and_the_pipeline_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in OPS) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name, tmp_path):
    assert entry.queries()[name](spark, write(tmp_path, docs=[], labels=[], benchmark=[], vectors=[])).count() == 0


def test_quality_rules(spark, tables):
    want = []
    for i, t in rows(tables):
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(wins)
        covered = {p for k, x in enumerate(wins) if many[x] > 1 for p in range(k, k + 8)}
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = run(spark, "op1", tables, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    same([g[:7] for g in got], want)
    assert not any(g[6] and g[7] for g in got)


def test_context_tree(spark, tables):
    """Counts and base against sums over tokens; the score against a recursion over dictionaries."""
    docs = rows(tables)
    learns = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in docs]
    tokens = [t.encode().lower().split() + [b"\n"] for _, t in docs]
    count = Counter(w for t, use in zip(tokens, learns, strict=True) if use for w in t)
    total, kinds, depth = sum(count.values()), len(count), 5
    got = sorted(run(spark, "op2", tables, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), key=repr)
    order = sorted(range(len(docs)), key=lambda k: repr((docs[k][0], not learns[k], len(tokens[k]))))
    for g, k in zip(got, order, strict=True):
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens[k])
        assert g[:5] == (docs[k][0], not learns[k], len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), total)
        assert g[5] == pytest.approx(base, rel=1e-9)
    if tables == SF:
        return
    seen = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    strings = [b"\n" * depth + b" ".join(t[:-1]) + b"\n" for t in tokens]
    for s, use in zip(strings, learns, strict=True):
        for p in range(depth, len(s) if use else 0):
            for j in range(8):
                for k in range(depth + 1):
                    seen[k][s[p - k : p], j, s[p] >> (8 - j)][s[p] >> (7 - j) & 1] += 1
    mixed, weight = [{} for _ in seen], [{} for _ in seen]
    for k in range(depth, -1, -1):
        below = defaultdict(float)
        for (ctx, j, b), v in (mixed[k + 1] if k < depth else {}).items():
            below[ctx[1:], j, b] += v
        for key, (a, b) in seen[k].items():
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            mixed[k][key] = own if k == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below[key])
            weight[k][key] = math.exp(math.log(0.5) + own - mixed[k][key]) if k < depth else 1
    for g, k in zip(got, order, strict=True):
        s, score = strings[k], 0.0
        if len(s) > 5000:
            continue
        for p in range(depth, len(s)):
            for j in range(8):
                q = None
                for d in range(depth, -1, -1):
                    key = (s[p - d : p], j, s[p] >> (8 - j))
                    n = seen[d].get(key, (0, 0))
                    kt = (n[s[p] >> (7 - j) & 1] + 0.5) / (sum(n) + 1)
                    q = kt if q is None else weight[d].get(key, 0.5) * kt + (1 - weight[d].get(key, 0.5)) * q
                score += math.log10(q)
        assert g[6] == pytest.approx(score, rel=1e-6)


def test_simhash(spark, tables):
    docs = rows(tables)
    prints = []
    for _, t in docs:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        least[find(k)] += [i] if i is not None else []
    want = [(i, f"{prints[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(docs)]
    same(run(spark, "op3", tables, "doc_id", "fingerprint", "component_id"), want)


@pytest.mark.parametrize("op", ["op4", "op8"])
def test_classifiers_score_every_row(spark, tables, op):
    got = run(spark, op, tables, "doc_id", "held_out", "score", "predicted")
    same([g[0] for g in got], [i for i, _ in rows(tables)])
    line = 0.5 if op == "op4" else 0.3
    for i, held, score, predicted in got:
        assert held == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        assert 0 <= score <= 1 and predicted == (score >= line)


@pytest.mark.parametrize(("op", "label", "least"), [("op4", "toxic", 0.9), ("op8", "quality", 0.9)])
def test_classifiers_on_rows_not_learned_from(spark, op, label, least):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    got = [g for g in run(spark, op, folder, "doc_id", "held_out", "predicted") if g[1] and g[0] in truth]
    assert sum(truth[i] == p for i, _, p in got) / len(got) >= least


def test_packing(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = defaultdict(list)
    for i, t in rows(tables):
        ids[i].append(np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for i, start, length, crc, tokens, seq, offset in run(spark, "op5", tables, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        assert any(len(x) == tokens and zlib.crc32(x[start : start + length].tobytes()) == crc for x in ids[i])
        pieces[i] += range(start, start + length)
        seqs[seq].append((offset, length))
    for i, texts in ids.items():
        same(pieces[i], [p for x in texts for p in range(len(x))])
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing to pad


def test_packing_has_the_ids_of_the_plain_tokenizer(spark, tmp_path):
    """Texts with the tokenizer's own tokens, against a tokenizer with default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|>", "a b <|endoftext|> c  d", "x <|endoftext|", PROSE]
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts)}
    got = run(spark, "op5", write(tmp_path, docs=[(i, t, "en", "a") for i, t in enumerate(texts)]), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert {g[0] for g in got} == set(ids)
    for i, start, length, crc, tokens in got:
        assert tokens == len(ids[i]) and crc == zlib.crc32(ids[i][start : start + length].tobytes())


@pytest.mark.parametrize("case", ["common words", "short texts"])
def test_packing_fills_a_window_with_every_neighbour_first(spark, case):
    """A neighbour by commoner words than 24 rare ones, and more short neighbours than one batch."""
    from answerlens.llm.packing import pack

    if case == "common words":  # each rare word of the seed is in one short text, the ten common ones in the near texts
        rare, common = [f" {w}" for w in PROSE.split()] + [f" {10 + i}" for i in range(30)], " music river garden winter summer history science village bridge island"
        texts = [(0, common * 2 + "".join(rare) * 8)] + [(1 + i, w) for i, w in enumerate(rare)]
        texts += [(200 + i, common * 4) for i in range(60)] + [(400 + i, " zebra" * 60) for i in range(60)]
        near = set(range(200, 260))
    else:
        texts = [(0, " river" * 500)] + [(200 + i, " river") for i in range(300)] + [(500 + i, " zebra" * 60) for i in range(60)]
        near = set(range(200, 500))
    got = pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(1), shard_docs=1 << 20).collect()
    seed = next(r["sequence_id"] for r in got if r["doc_id"] == 0)
    ids = {r["doc_id"] for r in got if r["sequence_id"] == seed}
    assert ids & near and not ids & set(range(400 if case == "common words" else 500, 600))


def test_decontamination(spark, tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    if tables == SF:
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()['op6_fm_index']})").fetchall()
    else:  # rows with one id twice or none: word by word
        fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        items = [(i, fold(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
        want = []
        for i, t in rows(tables):
            w, hit, found = fold(t), set(), set()
            for item, x in items:
                n = min(13, len(x))
                wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
                for k in range(len(w) - n + 1 if wins else 0):
                    if tuple(w[k : k + n]) in wins:
                        hit.update(range(k, k + n))
                        found.add(str(item))
            want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    same(run(spark, "op6", tables, *cols), want)


def test_decontamination_in_blocks(spark):
    """Phrases in several blocks give what one block gives, spans included."""
    from answerlens.llm.decontaminate import find_contamination

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (find_contamination(docs, items, block_words=n).select("doc_id", "n_hit", "hit_items", "hit_spans").collect() for n in (1_000_000, 100))
    same(one, many)
    assert any(r["hit_spans"] for r in one)


def test_substrings(spark, tables):
    places = defaultdict(lambda: (1 << 62, 0))
    docs = [(1 << 61 if i is None else i, t.encode()) for i, t in rows(tables)]
    for i, b in docs:
        for s in range(len(b) - 99):
            places[b[s : s + 100]] = min(places[b[s : s + 100]], (i, s))
    want = []
    for (i, b), (shown, _) in zip(docs, rows(tables), strict=True):
        gone = np.zeros(len(b) + 1, "i8")
        for s in range(len(b) - 99):
            if places[b[s : s + 100]] < (i, s):
                gone[s] += 1
                gone[s + 100] -= 1
        flag = np.cumsum(gone)[:-1] > 0
        edge = np.diff(np.concatenate([[0], flag.astype("i8"), [0]]))
        want.append((shown, len(b), int(flag.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, "u1")[~flag].tobytes()).hexdigest()))
    same(run(spark, "op7", tables, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_substrings_with_crowded_anchors(spark):
    """The way for anchors with many stretches gives the same spans."""
    from answerlens.llm.substrings import repeated_bytes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (repeated_bytes(docs, hot=h).select("doc_id", "removed").collect() for h in (20_000, 1))
    same(one, other)


def test_secrets(spark, tables):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for i, t in rows(tables):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(s[3] for s in spans)
        text = ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(spans))
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    same(run(spark, "op9", tables, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), want)


def test_random_tokens_are_secrets_and_words_are_not(spark):
    from answerlens.llm.secret_scan import find_secrets, redacted

    rng = np.random.default_rng(5)
    symbols = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    docs = [(k, f"see {''.join(rng.choice(symbols, 64))} there") for k in range(40)]
    docs += [(k, "see internationalizationcounterrevolutionaries_and_other_very_long_words_of_a_kind there") for k in range(40, 80)]
    found = find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("clean", redacted()).collect()
    assert all((len(r["secrets"]) == 1) == (r["doc_id"] < 40) for r in found)
    assert {r["clean"] for r in found if r["doc_id"] < 40} == {"see [secret] there"}


@pytest.mark.parametrize("alphabet", ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF"])
def test_rare_random_tokens_are_found(spark, alphabet):
    """One random token in 150 is found at every length, also among ordinary tokens of its own alphabet."""
    from answerlens.llm.secret_scan import find_secrets

    rng = np.random.default_rng(11)
    words = PROSE.split() + "config Handler get HTTP response value2 index v3 data user table item count page cache Builder default 2021 07".split()
    shout = ["FACADE", "DECADE", "ACCEDE", "DEAF", "BEAD", "CAFE", "FADED", "2021", "0042"] if len(alphabet) == 16 else [w.upper() for w in PROSE.split()]
    docs, planted = [], set()
    for k in range(12_000):
        n = (20, 32, 40, 64)[k // 150 % 4]
        own = len(alphabet) < 64 and k % 2
        token = "".join(rng.choice(list(alphabet), n)) if k % 150 == 0 else ("" if own else str(rng.choice(["", "-", "_", "/"]))).join(rng.choice(shout if own else words, 16))[:n]
        planted |= {k} if k % 150 == 0 else set()
        docs.append((k, f"see {token} there"))
    got = {r["doc_id"] for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).where("exists(secrets, s -> s.kind = 'random')").collect()}
    for i, n in enumerate((20, 32, 40, 64)):
        own = {k for k in planted if k // 150 % 4 == i}
        assert len(got & own) >= (0.8 if n == 20 else 0.95) * len(own), n
    assert len(got - planted) <= 0.03 * len(got)


def test_shards(spark, tables):
    got = run(spark, "op10", tables, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    same([g[:3] for g in got], [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows(tables)])
    slots, load = defaultdict(list), Counter()
    for _, size, _, law, shard, slot, grown in got:
        assert law == "bytes" and 0 <= shard < 40 and grown is None
        slots[shard].append(slot)
        load[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if tables == SF:
        largest = max(len(t.encode()) + 16 for _, t in rows(tables))
        assert max(load.values()) - min(load.values()) <= largest


def test_shards_split_a_hot_text_and_keep_small_groups(spark):
    from answerlens.llm.shards import range_shards

    docs = [(k, "hot text" if k % 3 == 0 else f"group {k // 9}") for k in range(9000)]
    got = range_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).join(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect()
    load, where = Counter(), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        where[r["text"]].add(r["shard"])
    assert len(load) == 8 and max(load.values()) < 1.05 * min(load.values())
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot text") == 0


@pytest.mark.parametrize("ids", ["two thirds null", "all equal"])
def test_shards_split_a_hot_text_without_ids(spark, ids):
    from answerlens.llm.shards import range_shards

    docs = [((None if k % 3 else k) if ids == "two thirds null" else 7, "the hot text") for k in range(3000)]
    got = range_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and len(load) == 8 and max(load.values()) < 1.15 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows_are_all_answered(spark, tmp_path):
    folder = write(tmp_path)
    for name in OPS:
        if name.startswith("op11_"):
            continue  # reads no documents
        n = entry.queries()[name](spark, folder).count()
        assert n >= len(AWKWARD) if name.startswith("op5") else n == len(AWKWARD)
