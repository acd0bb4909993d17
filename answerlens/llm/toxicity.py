"""Toxicity: a linear classifier whose score must not move when identity terms are swapped."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, fold, map_batches, materialise, predictions, with_column

#: Terms that name groups neutrally; a term may be swapped for the others of its row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("elderly", "young", "old"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
TRIM = ".,;:!?\"'()[]{}*#%$&|<>-"
PREFIXES = (4, 5, 6)
NO_EVIDENCE = -1.0  # highest logit of a text without any feature


def features(words: list[str]) -> set[str]:
    """The distinct words of a text and their beginnings."""
    out = set()
    for w in set(words):
        w = w.strip(TRIM)
        if w:
            out.add(w)
            out.update(w[:n] + "~" for n in PREFIXES if len(w) > n)
    return out


def swaps(words: list[str], per_text: int = 2) -> list[list[str]]:
    """The text with its identity terms replaced by other terms of the same row, up to ``per_text`` ways."""
    rows = {t: row for row in IDENTITY_TERMS for t in row}
    if not any(w.strip(TRIM) in rows for w in words):
        return []
    def other(w: str, k: int) -> str:
        row = rows.get(w.strip(TRIM))
        return row[(row.index(w.strip(TRIM)) + k) % len(row)] if row else w
    return [[other(w, k) for w in words] for k in range(1, per_text + 1)]


@dataclass
class ToxicityModel:
    """Weights by feature and a bias. A score is the logistic function of their sum."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.bias + sum(w[f] for f in features((text or "").lower().split()) if f in w)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(rows: list[set[str]], y: np.ndarray, pairs: list[tuple[int, set[str]]], names: list[str], fairness: float, ridge: float, steps: int) -> ToxicityModel:
    index = {f: i for i, f in enumerate(names)}

    def sparse(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        at = [(i, index[f]) for i, s in enumerate(sets) for f in sorted(s) if f in index]
        return (np.array([a for a, _ in at], "int64"), np.array([b for _, b in at], "int64"))

    r, c = sparse(rows)
    pr, pc = sparse([s for _, s in pairs])
    of = np.array([i for i, _ in pairs], "int64")
    n, d = len(rows), len(names)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b = np.zeros(d), 0.0
    m, v, t = np.zeros(d + 1), np.zeros(d + 1), 0
    for _ in range(steps):
        z = b + np.bincount(r, w[c], n)
        g = weight * (1 / (1 + np.exp(-z)) - y)
        if len(pairs):
            gap = 2 * fairness / len(pairs) * (z[of] - b - np.bincount(pr, w[pc], len(pairs)))
            gw = np.bincount(c, (g + np.bincount(of, gap, n))[r], d) - np.bincount(pc, gap[pr], d)
        else:
            gw = np.bincount(c, g[r], d)
        grad = np.append(gw + ridge * w, g.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:d], b - step[d]
    return ToxicityModel({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, min(float(b), NO_EVIDENCE))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 12_000, max_features: int = 4096,
    fairness: float = 1.0, ridge: float = 1e-4, steps: int = 400, evidence: float = 3.0,
) -> ToxicityModel:
    """Learns from at most ``max_rows`` labelled rows, chosen by a hash of the id among those ``usable``.

    Words and word beginnings whose log odds between the classes lie ``evidence`` standard errors from zero
    become features, the clearest first (without any, the twenty clearest); the loss is class-balanced
    logistic loss, plus ``fairness`` times the mean squared change of the logit over the swapped sentences,
    plus a ridge. A text without any feature scores below 0.5 whatever was learned. Rows without a label, id
    or text are not learned from; without any row of one of the classes nothing is learned and every text
    gets the same score below 0.5.
    """
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    chosen = chosen.where(usable) if usable is not None else chosen
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).dropDuplicates(["_id"])
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # the bound of the sample
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where("text IS NOT NULL")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, y, alt, feats = [], [], [], []
        for i, text, label in zip(batch.column("_id").to_pylist(), batch.column("text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
            words = text.lower().split()
            for k, form in enumerate([words, *swaps(words)]):
                ids.append(i)
                y.append(label)
                alt.append(k)
                feats.append(sorted(features(form)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(alt, pa.int32()), pa.array(feats, pa.list_(pa.string()))], ["i", "y", "alt", "feats"])

    rows = map_batches(sample.select("_id", "text", "_y"), run, "i long, y int, alt int, feats array<string>")
    rows = materialise(rows, "labelled")
    sizes = {r["y"]: r["n"] for r in rows.where("alt = 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, NO_EVIDENCE)
    seen = rows.where("alt = 0").select("y", F.explode("feats").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    ranked = seen.where("a + b >= 3").select("f", (F.abs(odds) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))).alias("s"))
    clearest = ranked.orderBy(F.desc("s"), "f").limit(max_features).collect()
    names = {r["f"] for r in clearest if r["s"] >= evidence} or {r["f"] for r in clearest[:20]}
    names |= {t for row in IDENTITY_TERMS for t in row}
    order = sorted(names)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(f,) for f in order], "f string"))  # at most max_features rows and the terms
    slim = rows.select("i", "alt", "y", F.explode_outer("feats").alias("f")).join(wanted, "f", "left_semi").groupBy("i", "alt", "y").agg(F.collect_set("f").alias("feats"))
    held = rows.select("i", "alt", "y").join(slim, ["i", "alt", "y"], "left").orderBy("i", "alt").collect()
    base = [r for r in held if r["alt"] == 0]
    at = {r["i"]: k for k, r in enumerate(base)}
    pairs = [(at[r["i"]], set(r["feats"] or ())) for r in held if r["alt"]]
    return _fit([set(r["feats"] or ()) for r in base], np.array([r["y"] for r in base]), pairs, order, fairness, ridge, steps)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``toxicity``, 0 to 1, to the rows of ``docs``; null text scores as empty text."""
    return with_column(docs, "toxicity", "double", lambda b: pa.array([model.score(t) for t in b.column(text).to_pylist()], pa.float64()))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null, empty and blank texts, having no evidence, score below 0.5; texts are scored whole, repeated rows alike. A null id counts as empty text in
    crc32 and is never joined to a label. Further columns are not read; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return predictions(docs, lambda d: score_toxicity(d, model), "toxicity", 0.5)
