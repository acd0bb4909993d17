"""Quality by compression: texts are compressed with a dictionary of good and one of bad texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.common import documents, fold, map_batches, materialise, predictions, with_column

PIECE = 2048


def pieces(text: str | None, size: int = PIECE) -> list[bytes]:
    """The whole text in pieces, each compressed alone so that the dictionary serves all of a long text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


@dataclass
class QualityModel:
    """Two dictionaries and the calibration that turns sizes into a probability of good quality."""

    good: bytes
    bad: bytes
    level: int = 3
    mean: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    coef: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = 0.0

    def _compressors(self):
        if not hasattr(self, "_pair"):
            def make(raw: bytes) -> zstandard.ZstdCompressor:
                data = zstandard.ZstdCompressionDict(raw) if raw else None
                return zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=False, write_dict_id=False)
            self._pair = (make(self.good), make(self.bad))
        return self._pair

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def measures(self, text: str | None) -> tuple[float, ...]:
        """Difference of the two sizes and its square by sign, the smaller size, each per byte, and how short the text is."""
        cut = pieces(text)
        n = sum(map(len, cut))
        if not n:
            return (0.0, 0.0, 1.0, 1.0)
        good, bad = (sum(len(c.compress(p)) for p in cut) for c in self._compressors())
        d = (bad - good) / n
        return (d, d * abs(d), min(1.5, min(good, bad) / n), 1 / (1 + n / 64))

    def score(self, text: str | None) -> float:
        z = self.bias + float(((np.array(self.measures(text)) - self.mean) / self.scale) @ self.coef)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _calibrate(model: QualityModel, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> QualityModel:
    """Logistic regression by Newton steps on standardised measures."""
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    w, keep = np.zeros(a.shape[1]), np.diag([*[ridge] * x.shape[1], 1e-9]) * len(x)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-6 * np.eye(len(w)), a.T @ (y - p) - keep @ w)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    model.coef, model.bias = w[:-1], float(w[-1])
    return model


def train_quality(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 8_000, max_pieces: int = 4_000,
    dictionary_bytes: int = 65_536, level: int = 3,
) -> QualityModel:
    """Learns from at most ``max_rows`` labelled rows, chosen by a hash of the id among those ``usable``.

    At most ``max_pieces`` pieces of each class, chosen by hash from one half of the rows, make its
    dictionary; the other half calibrates, as texts in a dictionary would seem too alike to it. Where a
    class has too little text for a dictionary, plain compression stands in; without labels every score
    is 0.5. Rows without a label, id or text are not learned from.
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    chosen = chosen.where(usable) if usable is not None else chosen
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).dropDuplicates(["_id"])
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # the bound of the sample
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where("text IS NOT NULL")
    sample = materialise(sample.select("_id", "text", "_y", (F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0).alias("for_dict")), "labelled")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, y = batch.column("_id").to_pylist(), batch.column("_y").to_pylist()
        got = [(i, label, k, p) for i, label, t in zip(ids, y, batch.column("text").to_pylist(), strict=True) for k, p in enumerate(pieces(t))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([g[n] for g in got], kind) for n, kind in enumerate(kinds)], ["_id", "_y", "_p", "piece"])

    parts = map_batches(sample.where("for_dict"), cut, "_id long, _y int, _p int, piece binary")

    def dictionary(label: int) -> bytes:
        got = [bytes(r["piece"]) for r in parts.where(F.col("_y") == label).orderBy(F.xxhash64("_id", "_p"), "_id", "_p").limit(max_pieces).collect()]
        if len(got) < 8:
            return b""
        try:
            return zstandard.train_dictionary(min(dictionary_bytes, max(512, sum(map(len, got)) // 4)), got).as_bytes()
        except zstandard.ZstdError:
            return b""

    model = QualityModel(dictionary(1), dictionary(0), level)
    measure = with_column(sample.where("NOT for_dict"), "m", "array<double>", lambda b: pa.array([list(model.measures(t)) for t in b.column("text").to_pylist()], pa.list_(pa.float64())))
    rows = measure.select("_y", "m").orderBy("_id").collect()  # at most max_rows
    y = np.array([r["_y"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return model
    return _calibrate(model, np.array([r["m"] for r in rows]), y)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``quality``, the probability of good quality, to ``docs``; null text scores as empty text."""
    return with_column(docs, "quality", "double", lambda b: pa.array([model.score(t) for t in b.column(text).to_pylist()], pa.float64()))


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``. Null and empty texts have a score as well; texts are compressed whole, repeated rows score alike. A null id counts as empty text in crc32 and is
    never joined to a label. Further columns are not read; an empty table gives no rows.
    """
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return predictions(docs, lambda d: score_quality(d, model), "quality", 0.3)
