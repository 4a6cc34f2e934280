"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are words and punctuation, their pairs, and pairs of word shapes, hashed to `bits` bits,
with log counts scaled to unit length. It is fitted on at most `max_rows` labelled rows (the least
by hash of doc_id) in one task; every row is scored as a sparse dot product. Held-out rows (crc32 of
doc_id as text, mod 4, is 2) and rows without a label are never learned from. Null and empty texts
get the score of the bias; with no label to learn from, all scores are 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, renumbered, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
BITS, MAX_ROWS, SCORE = 18, 6000, 0.7


def shape(w: str) -> str:
    kind = "p" + w[:2] if not w[0].isalnum() else "d" if w.isdigit() else "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "x"
    return kind + str(min(len(w), 12) // 4)


class Features:
    def __init__(self, bits: int = BITS):
        self.mask, self.kept = np.uint64((1 << bits) - 1), {}

    def _ids(self, w: str):
        if len(self.kept) > 500_000:
            self.kept.clear()
        got = self.kept[w] = (zlib.crc32(w.lower().encode("utf-8", "surrogatepass")), zlib.crc32(shape(w).encode("utf-8", "surrogatepass"), 7))
        return got

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bias at 0, then hashed n-grams."""
        ids = [self.kept.get(w) or self._ids(w) for w in TOKEN.findall(text)]
        if not ids:
            return np.zeros(1, np.int64), np.ones(1)
        a = np.array(ids, np.uint64)
        p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(40)
        parts = [a[:, 0] * p, (a[:-1, 0] * p + a[1:, 0]) * p, a[:, 1] * p + np.uint64(3), (a[:-1, 1] * p + a[1:, 1] + np.uint64(5)) * p]
        h = np.concatenate(parts)
        keys, n = np.unique(((h >> q) & self.mask) | np.uint64(1), return_counts=True)
        v = np.log1p(n)
        return np.concatenate([[0], keys.astype(np.int64)]), np.concatenate([[1.0], 4 * v / np.sqrt((v * v).sum())])


class Ftrl:
    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float):
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def sigmoid(s: float) -> float:
    return 1 / (1 + np.exp(-min(max(float(s), -30.0), 30.0)))


def held_out():
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, passes: int = 4) -> np.ndarray:
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = marked.where(~held_out()).withColumn("o", F.xxhash64("doc_id"))
    chosen = known.orderBy("o", "doc_id").limit(max_rows)
    # One text for each chosen doc_id, the least, so that the training task is bounded by max_rows whatever repeats.
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "o", "quality").agg(F.min("text").alias("text"))
    rows = rows.repartition(1).sortWithinPartitions("o", "doc_id")

    def train(frames):
        features, model, some = Features(), Ftrl(), False
        for f in frames:
            xs = [(*features.of(t), y) for t, y in zip(f["text"], f["quality"])]
            some = some or bool(xs)
            for _ in range(passes):
                for i, x, y in xs:
                    model.learn(i, x, float(y))
        if some:
            yield pd.DataFrame({"w": [model.weights().astype("<f4").tobytes()]})

    got = rows.select("text", "quality").mapInPandas(train, "w binary").collect()
    return np.frombuffer(got[0][0], "<f4").astype(np.float64) if got else np.zeros(1 << BITS)


def score_all(texts_, weights, features) -> list[float]:
    out = []
    for t in texts_:
        i, x = features.of(t or "")
        out.append(sigmoid(weights[i] @ x))
    return out


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(frames):
        features = Features()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": score_all(f["text"], sent.value, features)})

    scored = named(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInPandas(run, "doc_id string, held_out boolean, score double")
    return renumbered(scored, docs).withColumn("predicted", (F.col("score") >= SCORE).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs, all columns, that are predicted good."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        features = Features()
        for b in batches:
            yield b.filter(pa.array(np.array(score_all(b.column("text").to_pylist(), sent.value, features)) >= SCORE, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
