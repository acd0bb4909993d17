"""Token counts of every prefix of a text by dynamic programming, for truncation and budgets without encoding again."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, per_worker

SPACE = "▁"  # how the vocabulary writes a space
#: A place where no piece goes across: pieces hold spaces at their front only.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
NEVER, NO_LIMIT = float("-inf"), 1 << 60


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter:
    """Exact counts of pieces for all prefixes, for a sentencepiece BPE model without normalisation.

    Merging goes by score, then from the left, so what is merged left of a final boundary does not depend
    on what is right of it. Hence a prefix's last piece t is the only piece at its end that stays apart
    from the last piece u of the prefix before it, that is with ``u + t`` encoded as (u, t), and
    ``count[i] = count[i - len(t)] + 1``. A character without a piece counts as its UTF-8 bytes. Steps of
    words seen are kept, ``most`` at most, and twice as many answers about pairs of pieces.
    """

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("Ａ  b ") != f"{SPACE}Ａ{SPACE * 2}b{SPACE}":
            raise ValueError("the model normalises its text")
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece of the model goes across words")
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.texts: list[str] = []
        self.forms: list[tuple[int, int, int]] = []  # rank of the merge that forms a symbol (-1: a character), its two parts
        self.number: dict[str, int] = {}
        self.ends: dict = {}  # symbols by their characters from the last one back
        rank = {p: k for k, p in enumerate(sorted(self.score, key=self.score.get, reverse=True))}
        for p in sorted(self.score, key=len):  # parts come before what they form
            parts = self._merge(p)
            if parts[-1] == p:
                self._add(p, (rank[p], self.number[parts[-3]], self.number[parts[-2]]) if len(p) > 1 else (-1, -1, -1))
        number = self.number
        self.joined = {number[p[:k]] << 32 | number[p[k:]]: rank[p] for p in self.score for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        self.tied = {n for p, n in number.items() if SPACE * 2 in p}  # runs of spaces share one score
        self.most, self.longest = most, longest
        self.apart: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def _add(self, symbol: str, form: tuple[int, int, int]) -> None:
        node = self.ends
        for c in reversed(symbol):
            node = node.setdefault(c, {})
        self.number[symbol] = len(self.texts)
        node[""] = (len(self.texts), len(symbol), 1 if symbol in self.score else len(symbol.encode("utf-8", "surrogatepass")))
        self.texts.append(symbol)
        self.forms.append(form)

    def _merge(self, text: str) -> list[str]:
        """The merging itself: the two parts of the last merge, if any, then what is left."""
        parts, last = list(text), []
        while True:
            scores = [self.score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores, default=NEVER)
            if best == NEVER:
                return last + parts
            k = scores.index(best)
            last = parts[k : k + 2]
            parts[k : k + 2] = ["".join(last)]

    def _stay_apart(self, u: int, t: int) -> bool:
        """Whether no merge crosses from u to t: their merges are undone from the last one back.

        ``limit`` is the rank of the merge that ended the present neighbours x and y; they would have merged
        before if their own merge ranks better, at equal ranks if it lies further left.
        """
        if u in self.tied or t in self.tied:
            return self._merge(self.texts[u] + self.texts[t])[-2:] == [self.texts[u], self.texts[t]]
        x, y, limit, joined, forms = u, t, NO_LIMIT, self.joined, self.forms
        while True:
            if joined.get(x << 32 | y, NO_LIMIT) < limit:
                return False
            (at, _, right), (to, left, _) = forms[x], forms[y]
            if at > to:
                x, limit = right, at
            elif to >= 0:
                y, limit = left, to + 1
            else:
                return True

    def counts(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment that starts a text, the empty one first."""
        ends, apart = self.ends, self.apart
        last, count = [-1], [0]
        for i in range(1, len(segment) + 1):
            j = i - 1
            if segment[j] not in self.number:
                self._add(segment[j], (-1, -1, -1))
            node, found = ends, []
            while j >= 0:
                node = node.get(segment[j])
                if node is None:
                    break
                if "" in node:
                    found.append(node[""])
                j -= 1
            for t, size, tokens in reversed(found):
                u = last[i - size]
                if u >= 0:
                    key = u << 32 | t
                    ok = apart.get(key)
                    if ok is None:
                        if len(apart) >= 2 * self.most:
                            apart.clear()
                        ok = apart[key] = self._stay_apart(u, t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[i - size] + tokens)
                break
        return count

    def steps(self, segment: str) -> bytes:
        """Changes of the count at each character of a segment, as 32-bit numbers; parts between which no piece goes are kept."""
        got = self.kept.get(segment)
        if got is None:
            pairs = self.pairs
            cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in pairs]
            if cuts:
                got = b"".join([self.steps(segment[a:b]) for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)])
            else:
                count = self.counts(segment)
                got = array("i", map(sub, count[1:], count)).tobytes()
            if len(segment) <= self.longest:
                if len(self.kept) >= self.most:
                    self.kept.clear()
                self.kept[segment] = got
        return got

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i from 0 to its length."""
        if not text:
            return np.zeros(1, "i4")
        kept, steps = self.kept, self.steps
        step = np.frombuffer(b"".join([kept.get(s) or steps(s) for s in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]), "i4")
        out = np.cumsum(step, dtype="i4")  # the space that the model puts in front belongs to the first character
        out[0] = 0
        return out


def count_prefixes(docs: DataFrame, limits: tuple[int, ...] = (), steps: bool = True, model: str | None = None, batch_chars: int = 1_000_000) -> DataFrame:
    """Adds token counts to ``docs(text)``; all from one table of counts by prefix for each text.

    ``n_tokens`` counts the whole text, ``fits`` has for each of ``limits`` the characters of the longest prefix
    with no more tokens. With ``steps`` the counts are stored as ``token_steps``, the change of the count at each
    character (small numbers, which Parquet keeps in a few bits); ``tokens_of_prefix`` and ``longest_prefix``
    read them. A longer prefix can have fewer tokens, as its last characters merge. Columns of these names are
    replaced, all others kept. Map-only; a text is in memory with three numbers a character. Null and empty texts have no
    token. Copies and repeated rows are counted row by row; an empty table stays empty.
    """
    docs = docs.drop("n_tokens", "fits", "token_steps")
    path = model or default_model()
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    names = [*docs.columns, "n_tokens", "fits", *(["token_steps"] if steps else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(("prefixes", path), lambda: PrefixCounter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                stop, size, total, fits, changes = at, 0, [], [], []
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= batch_chars):
                    count = counter.prefixes(texts[stop])
                    total.append(int(count[-1]))
                    fits.append([len(count) - 1 if count.max() <= n else int(np.flatnonzero(count <= n)[-1]) if n >= 0 else None for n in limits])
                    if steps:
                        changes.append(np.diff(count))
                    size += len(texts[stop])
                    stop += 1
                more = [pa.array(total, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
                more += [pa.array(changes, pa.list_(pa.int32()))] if steps else []
                yield pa.RecordBatch.from_arrays([*batch.slice(at, stop - at).columns, *more], names)
                at = stop

    return docs.mapInArrow(run, ", ".join([*kept, "n_tokens long", "fits array<bigint>", *(["token_steps array<int>"] if steps else [])]))


def tokens_of_prefix(chars: Column | int, steps: str = "token_steps") -> Column:
    """Tokens of the first ``chars`` characters, from the stored steps."""
    n = F.lit(chars) if isinstance(chars, int) else chars
    return F.aggregate(F.slice(steps, F.lit(1), n.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)


def longest_prefix(limit: Column | int, steps: str = "token_steps") -> Column:
    """Characters of the longest prefix with at most ``limit`` tokens, from the stored steps; null below zero."""
    n = (F.lit(limit) if isinstance(limit, int) else limit).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("best"))

    def step(a: Column, x: Column) -> Column:
        i, c = a["i"] + 1, a["c"] + x
        return F.struct(i.alias("i"), c.alias("c"), F.when(c <= n, i).otherwise(a["best"]).alias("best"))

    return F.when(n >= 0, F.aggregate(steps, start, step, lambda a: a["best"]))


def op12_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: bytes, tokens, whether there are over 4,096, and the characters within 4,096.

    Null and empty texts have none of either. Very long texts are counted whole, repeated rows row by row. Only
    ``doc_id`` and ``text`` are read; a null id stays null; an empty table gives no rows.
    """
    counted = count_prefixes(documents(spark, sf_dir, "doc_id", "text"), limits=(4096,), steps=False)
    return counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"), F.col("fits")[0].alias("chars_within_limit"),
    )
