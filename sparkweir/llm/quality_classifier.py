"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed features of the text and a rising row of
thresholds: P(grade > j) = logistic(w x - threshold j). They give the expected
grade and the probability of a grade of at least KEEP_GRADE, by which texts
are selected. The features are the shares of hashed stretches of bytes and of
character classes, and of words that repeat the one before or any earlier one,
in half precision for learning and judging alike.

Learning takes a bounded, fixed sample of the labelled rows (about SAMPLE per
grade, by a hash of the id); its feature vectors come to the driver. Each
grade counts as often as in all labelled rows.

Texts: null and empty ones have no features and get the grade of the
intercept; long ones are read whole, in slices. Rows come one to one, repeated
and null ids included; texts that tie get the same grade. Empty tables give an
empty result. With
labels of fewer than two grades nothing is learned: the expected grade is that
grade, or 0, and everything is kept. Null grades are ignored. Only the named
columns are read, so that other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import received, sample_share, send, slices

#: About so many labelled rows of each grade are learned from.
SAMPLE = 1500
#: Buckets of hashed byte stretches and of class stretches.
BYTES, CLASSES = 2048, 2048
WIDTH = BYTES + CLASSES + 2
#: Texts with at least this probability of at least this grade are selected.
KEEP_GRADE, KEEP_AT = 1, 0.5
#: Steps, rate and decay of the fit.
STEPS, RATE, DECAY = 400, 0.1, 1e-4

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 48, 65, 97, 97


def features(text: bytes | None) -> np.ndarray:
    out = np.zeros(WIDTH, np.float32)
    text = text or b""
    data = np.frombuffer(text, np.uint8)
    if len(data) >= 5:
        for first, size, table, width in ((0, 4, None, BYTES), (BYTES, 5, _CLASS, CLASSES)):
            counts = np.zeros(width, np.int64)
            for at in range(0, len(data) - size + 1, 1 << 20):
                part = data[at : at + (1 << 20) + size - 1]
                part = part if table is None else table[part]
                code = np.zeros(len(part) - size + 1, np.uint32)
                for i in range(size):
                    code = code * np.uint32(0x01000193) ^ part[i : len(part) - size + 1 + i]
                code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                counts += np.bincount(code >> np.uint32(21), minlength=width)
            out[first : first + width] = np.sqrt(counts / counts.sum())
    words = text.split()
    if words:
        out[-2] = 2 * sum(map(bytes.__eq__, words, words[1:])) / len(words)
        out[-1] = 2 * (1 - len(set(words)) / len(words)) if len(words) > 1 else 0
    return out.astype(np.float16)


def loss(w: np.ndarray, raw: np.ndarray, x: np.ndarray, level: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The decayed negative log-likelihood and its gradient, by weights and then by raw: the first threshold and the logarithms of the steps."""
    rows, k = np.arange(len(x)), len(raw)
    gaps = np.exp(raw[1:])
    t = raw[0] + np.append(0, np.cumsum(gaps))
    s = x @ w
    low = np.concatenate([np.full((len(x), 1), 0.0), 1 / (1 + np.exp(-np.clip(t[None, :] - s[:, None], -30, 30))), np.full((len(x), 1), 1.0)], axis=1)
    density = low * (1 - low)
    p = np.maximum(low[rows, level + 1] - low[rows, level], 1e-9)
    upper, lower = density[rows, level + 1] / p, density[rows, level] / p
    g_s = weight * (upper - lower)
    g_t = np.zeros(k + 2)
    np.add.at(g_t, level + 1, -weight * upper)
    np.add.at(g_t, level, weight * lower)
    tail = np.cumsum(g_t[1:-1][::-1])[::-1]
    return float(-(weight * np.log(p)).sum() + DECAY / 2 * w @ w), np.concatenate([x.T @ g_s + DECAY * w, [tail[0]], tail[1:] * gaps])


class Model:
    """weights, thresholds and the grades that lie between these."""

    def __init__(self, grades: list[int]):
        self.grades = grades
        self.weights = np.zeros(WIDTH)
        self.thresholds = np.linspace(-1, 1, max(len(grades) - 1, 0))

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds, -500, 500)))

    def fit(self, x: np.ndarray, level: np.ndarray, weight: np.ndarray) -> Model:
        """Maximum likelihood by Adam; thresholds as a first one and the logarithms of the steps. level: index of the grade."""
        k = len(self.thresholds)
        share = np.bincount(level, weight, k + 1) / weight.sum()
        over = np.clip(1 - np.cumsum(share)[:-1], 1e-4, 1 - 1e-4)
        start = -np.log(over / (1 - over))
        raw = np.append(start[0], np.log(np.maximum(np.diff(start), 1e-2)))
        w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1] + k), np.zeros(x.shape[1] + k)
        weight = weight / weight.sum()
        for step in range(1, STEPS + 1):
            gradient = loss(w, raw, x, level, weight)[1]
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, raw = w - move[: len(w)], raw - move[len(w) :]
        self.weights, self.thresholds = w, raw[0] + np.append(0, np.cumsum(np.exp(raw[1:])))
        return self

    def judge(self, x: np.ndarray, keep_grade: int) -> tuple[np.ndarray, np.ndarray]:
        """The expected grade, and the probability of keep_grade or more."""
        if len(self.grades) < 2:
            grade = float(self.grades[0]) if self.grades else 0.0
            return np.full(len(x), grade), np.ones(len(x))
        above = self.above(x)
        steps = np.diff(np.array(self.grades, float))
        at = np.searchsorted(self.grades, keep_grade)
        tail = np.ones(len(x)) if at == 0 else np.zeros(len(x)) if at == len(self.grades) else above[:, at - 1]
        return self.grades[0] + above @ steps, tail


def _vectors(batches):
    for batch in slices(batches, 1):
        found = [features(text.as_py()).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["grade", "x"])


def learn(df: DataFrame, ratings: DataFrame, learn_from: Column, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """ratings: (id_col, grade_col), integer grades; learn_from: a condition on the id."""
    known = ratings.where(learn_from & F.col(grade_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade"))
    totals = {r["_grade"]: r["n"] for r in known.groupBy("_grade").agg(F.count("*").alias("n")).collect()}
    model = Model(sorted(totals))
    if len(totals) < 2:
        return model
    share = F.coalesce(*[F.when(F.col("_grade") == g, F.lit(min(1.0, sample / n))) for g, n in sorted(totals.items())])
    chosen = known.where(sample_share("_id", share))
    # The ids chosen are bounded by the sample, so that they are sent to the texts.
    read = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id").select("_grade", "_text")
    rows = read.mapInArrow(_vectors, "grade int, x binary").collect()  # of a bounded sample
    seen = {g: sum(r["grade"] == g for r in rows) for g in totals}
    if sum(n > 0 for n in seen.values()) < 2:
        return Model(sorted(g for g, n in seen.items() if n)[:1])
    model = Model(sorted(g for g, n in seen.items() if n))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float64)
    place = {g: i for i, g in enumerate(model.grades)}
    level = np.array([place[r["grade"]] for r in rows])
    weight = np.array([totals[r["grade"]] / seen[r["grade"]] for r in rows])
    return model.fit(x, level, weight)


def _judge(sent, keep_grade: int):
    def run(batches):
        model = received(sent)
        for batch in slices(batches, 1):
            grades, tails = [], []
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 256):
                x = np.stack([features(text.as_py()) for text in texts[i : i + 256]]).astype(np.float32)
                grade, tail = model.judge(x, keep_grade)
                grades.append(grade)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(grades)), pa.array(np.concatenate(tails))], ["id", "expected_grade", "tail_probability"])

    return run


def judge(df: DataFrame, model: Model, keep_grade: int = KEEP_GRADE, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_probability, kept)."""
    sent = send(df.sparkSession, model)
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = read.mapInArrow(_judge(sent, keep_grade), f"id {dict(read.dtypes)['id']}, expected_grade double, tail_probability double")
    return out.withColumnRenamed("id", id_col).withColumn("kept", F.col("tail_probability") >= keep_at)
