"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte 2- to 4-grams of the whole text.  Each is scaled by the log ratio of its
smoothed shares in the two classes, rows are normalised, and a linear hinge-loss model is fitted by dual coordinate
descent.  A logistic curve, fitted on margins of rows the fold's model has not seen and weighted to the labelled rows'
class shares, turns margins into scores.  The model is fitted on at most ``sample_per_class`` labelled rows of each
class, those with the least hash of their doc_id; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of, tidied
from .langid import bottom, fold
from .ngrams import Indicators

SIZES, BITS, SAMPLE_PER_CLASS, THRESHOLD = (2, 3, 4), 17, 2000, 0.3


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """log of the ratio of an indicator's smoothed shares among rows with y > 0 and the others."""
    p, q = np.ones(width), np.ones(width)
    for r, label in zip(rows, y):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; ``cost`` is each row's upper bound."""
    w, alpha, bias = np.zeros(width), np.zeros(len(rows)), 0.0
    square = np.array([v @ v + 1 for v in values])  # the bias is a feature that is always 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve through margins ``m`` (Newton's method, slightly damped)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * m).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


class NbSvm:
    """``linear``: weight times ratio for each hash; ``square``: ratio squared."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.linear, self.square = (w * ratio), (ratio * ratio)
        self.bias, self.slope, self.shift = bias, slope, shift

    def margin(self, row: np.ndarray) -> float:
        norm = np.sqrt(self.square[row].sum())
        return float(self.linear[row].sum() / norm + self.bias) if norm > 0 else self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.shift, -500, 500))))

    @staticmethod
    def _plain(rows: list[np.ndarray], y: np.ndarray, width: int, c: float) -> "NbSvm":
        ratio = log_count_ratio(rows, y, width)
        values = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-30) for r in rows]
        w, bias = dual_coordinate_descent(rows, values, y, np.full(len(rows), c), width)
        return NbSvm(ratio, w, bias)

    @staticmethod
    def fit(rows: list[np.ndarray], labels: np.ndarray, share_of_ones: float, width: int = 1 << BITS, c: float = 1.0, folds: int = 3) -> "NbSvm":
        y = np.where(labels > 0, 1.0, -1.0)
        if len(set(y.tolist())) < 2:  # one class only, or nothing to learn from: a constant score
            share = 0.5 if not len(y) else float(y[0] > 0) * 0.98 + 0.01
            return NbSvm(np.zeros(width), np.zeros(width), 0.0, 1.0, float(np.log(share / (1 - share))))
        margins, part = np.zeros(len(y)), np.arange(len(y)) % folds
        for k in range(folds):
            seen = np.flatnonzero(part != k)
            if len(set(y[seen].tolist())) == 2:
                model = NbSvm._plain([rows[i] for i in seen], y[seen], width, c)
                for i in np.flatnonzero(part == k):
                    margins[i] = model.margin(rows[i])
        model = NbSvm._plain(rows, y, width, c)
        weight = np.where(y > 0, share_of_ones / (y > 0).sum(), (1 - share_of_ones) / (y < 0).sum()) * len(y)
        model.slope, model.shift = _logistic(margins, y, weight)
        return model


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> NbSvm:
    """Learn ``labels.quality`` (0 or 1) of ``docs``; doc_ids without one, or with both, are not learnt from."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = F.broadcast(docs.sparkSession.createDataFrame(bottom(known, "quality", order, sample_per_class).collect(), "doc_id long, quality int"))  # 2 * sample_per_class rows

    def features(batches):
        own = Indicators(SIZES, BITS)
        for batch in batches:
            rows = [own(t).astype("<u4").tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "at"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id")
    sample = bottom(sample, "quality", [*order, F.xxhash64("text")], sample_per_class).select("doc_id", "quality", "text")  # however many rows repeat a doc_id
    found = [(r["doc_id"], r["quality"], np.frombuffer(r["at"], "<u4")) for r in sample.mapInArrow(features, "doc_id long, quality int, at binary").toLocalIterator()]
    found.sort(key=lambda x: (x[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, x[0], x[2].tobytes()))
    total = sum(share.values())
    return NbSvm.fit([at for _, _, at in found], np.array([q for _, q, _ in found]), share.get(1, 0) / total if total else 0.5)


def _scores(model: NbSvm, texts: list[str], own: Indicators) -> list[float]:
    return [model.score(own(t)) for t in texts]


def score(docs: DataFrame, model: NbSvm, threshold: float = THRESHOLD, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= ``threshold``).

    Null texts count as empty; an empty text has the score of the model's bias and two spaces.  Rows that repeat stay;
    an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # two arrays of 2^17

    def run(batches):
        own = Indicators(SIZES, BITS)
        for batch in batches:
            got = _scores(shared.value, texts_of(batch), own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: NbSvm, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns unchanged, whatever their names, in one pass.

    A null text is judged as the empty one; a text of any length is read whole, in pieces; a score equal to ``threshold``
    stays.  Rows that repeat are judged alike; an empty table gives no rows.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Indicators(SIZES, BITS)
        for batch in batches:
            yield batch.filter(pa.array([s >= threshold for s in _scores(shared.value, texts_of(batch), own)], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_per_class: int = SAMPLE_PER_CLASS) -> NbSvm:
    """``fit`` without the held-out fold."""
    return fit(docs, labels.where(fold("doc_id", folds) != held), sample_per_class)
