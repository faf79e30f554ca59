"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector of hashed byte 2- and 3-grams of its letters (tf is 1 + log of the count), normalised.  Each
language's training vectors are clustered by spherical k-means; a text takes the language of the centroid with the
largest cosine.  Rejection is by distance: a text that is further from its nearest centroid than ``REJECT_SHARE`` of the
centroid's own training texts are is marked as rejected.  The mark is a column of its own, and ``reject`` turns it into
"und".  The centroids are fitted on at most ``sample_per_lang`` rows of each of the ``max_langs`` most frequent
languages, those with the least hash of their doc_id; prediction reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, small_batches, texts_of
from .ngrams import counts

SIZES, BITS, CLUSTERS = (2, 3), 13, 4
#: Bounds of what the centroids are fitted on: rows of a language, and languages.
SAMPLE_PER_LANG, MAX_LANGS = 500, 400
#: Groups of tasks whose candidates for a sample are ranked apart.
GROUPS = 16
#: Share of a centroid's training texts that are nearest to it: what is further away than all of these is rejected.
REJECT_SHARE = 0.995
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search
_ROWS = 128


def has_letter(text: str) -> bool:
    return _LETTER(text) is not None


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def _tf(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for row, t in zip(out, texts):
        row[:] = counts(t, SIZES, BITS)
    at = out > 0
    out[at] = 1 + np.log(out[at])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def cluster(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` unit centroids of the unit rows of ``x`` (spherical k-means, farthest-point start)."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        near = (x @ x[picked].T).max(axis=1)
        if near.min() > 0.999:
            break
        picked.append(int(np.argmin(near)))
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


class Centroids:
    """``names``: the language of each centroid; ``weights``: idf times centroid, a column per centroid; ``idf``; ``least``: the cosine below which a centroid rejects."""

    def __init__(self, names: list[str], weights: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.names, self.weights, self.idf, self.least = names, weights, idf, least

    @staticmethod
    def fit(langs: list[str], tf: np.ndarray, clusters: int = CLUSTERS, reject_share: float = REJECT_SHARE) -> "Centroids":
        idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
        names, columns, least = [], [], []
        at = np.array(langs, dtype=object)
        for lang in sorted(set(langs)):
            x = _unit(tf[at == lang] * idf)
            own = cluster(x, clusters)
            cos = x @ own.T
            nearest = cos.argmax(axis=1)
            names += [lang] * len(own)
            columns.append(own)
            least += [float(np.quantile(cos[nearest == j, j], 1 - reject_share)) if (nearest == j).any() else 0.0 for j in range(len(own))]
        weights = np.concatenate(columns) * idf if columns else np.zeros((0, len(idf)))
        return Centroids(names, np.ascontiguousarray(weights.T, np.float32), idf, np.array(least))

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, cosine, whether rejected) of each text."""
        out = []
        for at in range(0, len(texts), _ROWS):
            part = texts[at : at + _ROWS]
            tf = _tf(part)
            norm = np.maximum(np.linalg.norm(tf * self.idf, axis=1), 1e-30)
            cos = np.clip(tf @ self.weights / norm[:, None], 0, 1) if self.names else np.zeros((len(part), 0))
            best = cos.argmax(axis=1) if self.names else np.zeros(len(part), int)
            for t, row, b in zip(part, cos, best.tolist()):
                ok = self.names and has_letter(t)
                out.append((self.names[b], float(row[b]), bool(row[b] < self.least[b])) if ok else (UNDETERMINED, 0.0, True))
        return out


def bottom(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each value of ``by``, whatever the tasks they come from.

    Spark cuts every task's rows of a value to ``k`` before it shuffles them; those of ``GROUPS`` groups of tasks are ranked
    apart first, so that the one task that ranks a value at last reads ``k`` rows a group, however many tasks there are.
    """
    place, group = free_names(rows, "place", "group")

    def first(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k).drop(place)

    return first(first(rows.withColumn(group, F.spark_partition_id() % GROUPS), by, group).drop(group), by)


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, clusters: int = CLUSTERS, max_langs: int = MAX_LANGS) -> Centroids:
    """Learn from ``docs(doc_id, text, lang)``; rows without lang, doc_id or letters are not learnt from.

    One scan of the ids, one of the texts: the ids of the sample, ``sample_per_lang`` of a language, go to all tasks, and of the
    rows that have them, however many repeat one, again at most so many come back.
    """
    docs = docs.where("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    langs = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = bottom(docs.select("lang", "doc_id").distinct().join(F.broadcast(langs.select("lang")), "lang"), "lang", order, sample_per_lang)
    ids = F.broadcast(docs.sparkSession.createDataFrame(sorted((r["lang"], r["doc_id"]) for r in ids.collect()), "lang string, doc_id long"))  # at most sample_per_lang * max_langs

    def vectors(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), texts_of(batch)
            kept = [(a, t) for a, t in zip(langs, texts) if has_letter(t)]
            for at in range(0, len(kept), _ROWS):
                part = kept[at : at + _ROWS]
                tf = _tf([t for _, t in part])
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in part]), pa.array([np.flatnonzero(r).astype("<u2").tobytes() for r in tf], pa.binary()), pa.array([r[r != 0].astype("<f4").tobytes() for r in tf], pa.binary())], ["lang", "at", "tf"])

    sample = docs.join(ids, ["lang", "doc_id"], "left_semi")
    sample = bottom(sample, "lang", [*order, F.xxhash64("text")], sample_per_lang).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["at"]), bytes(r["tf"])) for r in sample.mapInArrow(vectors, "lang string, at binary, tf binary").toLocalIterator())
    tf = np.zeros((len(rows), 1 << BITS), np.float32)
    for row, (_, at, values) in zip(tf, rows):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
    return Centroids.fit([lang for lang, _, _ in rows], tf, clusters)


def predict(docs: DataFrame, model: Centroids, reject: bool = False, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected.

    ``und`` with score 0, rejected, if the text is null or has no letter, and for all texts if nothing could be learnt.
    ``rejected`` also marks texts further from their nearest centroid than its training texts are; with ``reject`` these
    are ``und``, too (their score stays).  Ties take the first language by name.  A text of any length is read whole, in
    pieces.  Rows that repeat stay; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)  # a matrix of 2^13 by the number of centroids

    def run(batches):
        for batch in batches:
            got = shared.value.predict(texts_of(batch))
            langs = [UNDETERMINED if no and reject else a for a, _, no in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([no for _, _, no in got], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample_per_lang: int = SAMPLE_PER_LANG, clusters: int = CLUSTERS, reject: bool = False) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all; lang, source and doc_id are no inputs of a prediction."""
    return predict(docs, fit(docs.where(fold("doc_id", folds) != held), sample_per_lang, clusters), reject, folds, held)
