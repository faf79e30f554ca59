"""Language-model scores by stupid backoff, every document scored by the n-grams of all the others.

Texts are written once in chunks.  Each chunk sends its distinct n-grams of every order, with counts, to buckets of the
n-gram's hash; there the chunks' tables add up to the corpus counts, and each chunk gets back the counts of the n-grams
it asked for (a semi-join: n-grams travel once a chunk, not once an occurrence).  Joined again by chunk, counts meet the
exploded n-grams of its documents and are summed per document.  An n-gram that a third of all documents hold is one
entry a chunk.  Tables are sorted hashes in delta-coded, compressed blocks, one for a chunk and bucket that have n-grams in
common, so there are never more of them than n-grams; the number of buckets grows with the corpus, from ``MANY_BUCKETS``
on with its square root.  (As rows of Spark's own, counted and joined by it, the n-grams took more disk than there may
be: over 4.5 times the input.)
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, give_back, small_batches, texts_of, tidied

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes of text in a chunk (one longer text is a chunk of its own) and, on average at most, behind a bucket.
CHUNK_BYTES, BUCKET_BYTES = 10 << 20, 64 << 20
#: From so many buckets on their number grows with the square root of the corpus.
MANY_BUCKETS = 1 << 12
#: Words whose documents are taken together when a document's own n-grams are taken off.
OWN_WORDS = 1 << 18
_HASH_BITS = 56
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[bytes]:
    """Runs of what is no ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


def _zip(x: np.ndarray) -> bytes:
    """Numbers by byte planes, so that bytes that are mostly zero cost nothing."""
    x = np.ascontiguousarray(x, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unzip(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _ranks(x: np.ndarray) -> np.ndarray:
    """For each number its place among the distinct ones, sorted."""
    by = np.argsort(x)
    y = x[by]
    rank = np.empty(len(x), np.int32)
    rank[by] = np.cumsum(np.concatenate([[False], y[1:] != y[:-1]])[: len(y)], dtype=np.int32)
    return rank


class Chunk:
    """The n-grams of a chunk's documents.

    ``doc``: the document of each word; ``place``: the word's place in it.  Without ``places``, ``grams[o]``: sorted
    distinct hashes of order o + 1, and ``counts[o]``; with ``places``, ``own[o]`` only: for each word that ends an
    n-gram of the order its place among those hashes.  Neither side needs the other's, and a worker holds little.
    """

    def __init__(self, texts: list[str], order: int, places: bool):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        sizes, ids = [], []
        for t in texts:
            w = words_of(t)
            sizes.append(len(w))
            ids.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        del texts
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        digest = xxhash.xxh64_intdigest
        word = np.fromiter((digest(w) for w in number), np.uint64, len(number))
        del number
        self.grams, self.counts, self.own = [], [], []
        h = word[ids] if len(ids) else np.zeros(0, np.uint64)
        first = h
        for o in range(order):
            if o == 0:  # by the words' numbers, without sorting all words
                by = np.argsort(word >> np.uint64(64 - _HASH_BITS), kind="stable")
                if places:
                    rank = np.empty(len(by), np.int32)
                    rank[by] = np.arange(len(by), dtype=np.int32)
                    self.own.append(rank[ids])
                else:
                    self.grams.append((word >> np.uint64(64 - _HASH_BITS))[by])
                    self.counts.append(np.bincount(ids, minlength=len(word))[by] if len(ids) else np.zeros(0, np.int64))
                continue
            with np.errstate(over="ignore"):
                h = np.concatenate([h[:1], h[:-1]]) * _M1 + first
                h ^= h >> np.uint64(29)
                h *= _M2
                h ^= h >> np.uint64(32)
            x = h[self.place >= o] >> np.uint64(64 - _HASH_BITS)
            if places:
                self.own.append(_ranks(x))
            else:
                grams, counts = np.unique(x, return_counts=True)
                self.grams.append(grams), self.counts.append(counts)

    def by_bucket(self, buckets: int):
        """For each order the ends of the buckets' shares of ``grams``."""
        edges = (np.arange(1, buckets, dtype=object) * (1 << _HASH_BITS) // buckets).astype(np.uint64)
        return [np.concatenate([[0], np.searchsorted(g, edges), [len(g)]]) for g in self.grams]


def _chunks(chunk_bytes: int):
    def run(batches):
        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            words = sum(len(words_of(t)) for t in texts)
            blob = zstandard.ZstdCompressor(level=9).compress(pickle.dumps((ids, texts), protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([words]), pa.array([size]), pa.array([blob], pa.binary())], ["chunk", "words", "bytes", "docs"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids.append(doc), texts.append(text)
                size += len(text) + 8
                if size >= chunk_bytes:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield row()

    return run


def _docs(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _asked(order: int, buckets: int):
    """(bucket, chunk, a block of hashes and one of counts for each order)."""

    def run(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("docs")):
                c = Chunk(_docs(blob.as_py())[1], order, False)
                ends, found, rows, size = c.by_bucket(buckets), [], [], 0

                def asked():
                    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([chunk] * len(found), pa.int64()), pa.array(rows, pa.list_(pa.binary()))], ["bucket", "chunk", "blocks"])

                for b in range(buckets):
                    if not any(e[b + 1] > e[b] for e in ends):
                        continue  # nothing is asked there
                    found.append(b)
                    own = []
                    for g, n, e in zip(c.grams, c.counts, ends):
                        x = g[e[b] : e[b + 1]]
                        own += [_zip(np.diff(x, prepend=np.uint64(0))), _zip(n[e[b] : e[b + 1]])]
                    rows.append(own)
                    size += sum(map(len, own))
                    if size >= BATCH_BYTES:
                        yield asked()
                        found, rows, size = [], [], 0
                if found:
                    yield asked()
                del c
                give_back()

    return run


def _answered(order: int):
    """Rows come sorted by bucket: (chunk, bucket, corpus counts of the n-grams asked for, a block for each order)."""

    def run(batches):
        bucket, chunks, blocks = None, [], []

        def close():
            answers = [[] for _ in chunks]
            for o in range(order):
                hashes = [np.cumsum(_unzip(b[2 * o])) for b in blocks]
                counts = np.concatenate([_unzip(b[2 * o + 1]) for b in blocks]).astype(np.float64)
                _, place = np.unique(np.concatenate(hashes), return_inverse=True)
                total = np.bincount(place, weights=counts)[place].astype(np.uint64) if len(place) else counts.astype(np.uint64)
                at = 0
                for a, h in zip(answers, hashes):
                    a.append(_zip(total[at : at + len(h)]))
                    at += len(h)
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(answers, pa.list_(pa.binary()))], ["chunk", "bucket", "blocks"])

        for batch in batches:
            for b, c, x in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("blocks")):
                if b != bucket and chunks:
                    yield close()
                    chunks, blocks = [], []
                bucket = b
                chunks.append(c), blocks.append(x.as_py())
        if chunks:
            yield close()

    return run


def _less_own(c: Chunk, o: int, total: np.ndarray) -> np.ndarray:
    """For each word that ends an n-gram of the order: the n-gram's count in all other documents."""
    place, doc = c.own[o], c.doc[c.place >= o]
    out = np.zeros(len(place), np.int64)
    at = 0
    while at < len(place):  # whole documents
        end = int(np.searchsorted(doc, doc[min(at + OWN_WORDS, len(doc)) - 1], "right"))
        own = place[at:end]
        n = total[own].astype(np.int64)
        some = np.flatnonzero(n > 1)  # the others are only here
        key = doc[at:end][some].astype(np.int64) * max(1, len(total)) + own[some]
        _, back, twice = np.unique(key, return_inverse=True, return_counts=True)
        out[at + some] = n[some] - twice[back]
        at = end
    return out


def score_chunk(c: Chunk, totals: list[np.ndarray], words: int, backoff: float = BACKOFF, unseen: float = UNSEEN) -> np.ndarray:
    """Sum of log scores of each document; ``totals``: corpus counts of the chunk's n-grams, ``words``: words of the corpus."""
    order, n, totals = len(totals), len(c.doc), list(totals)
    left = []
    for o in range(order):
        full = np.zeros(n, np.int64)
        full[c.place >= o] = _less_own(c, o, totals[o])
        left.append(full)
        c.own[o] = totals[o] = None  # used up
    history = np.minimum(c.place, order - 1)
    lp = history * math.log(backoff) + np.log(np.maximum(left[0], unseen)) - np.log(np.maximum(words - c.sizes, 1))[c.doc]
    for o in range(1, order):
        before = np.concatenate([[0], left[o - 1][:-1]]) if n else left[o - 1]
        at = left[o] > 0
        lp[at] = (history[at] - o) * math.log(backoff) + np.log(left[o][at]) - np.log(before[at])
    return np.bincount(c.doc, weights=lp, minlength=len(c.sizes))


def _scored(order: int, buckets: int, words: int, backoff: float, unseen: float):
    """Rows come sorted by (chunk, bucket): the documents as bucket -1, then the answers in order."""

    def run(batches):
        held, answers = None, []

        def close():
            nonlocal held
            ids, texts = _docs(held)
            held, c = None, Chunk(texts, order, True)
            del texts
            give_back()
            totals = [np.concatenate([_unzip(a[o]) for a in answers]) if answers else np.zeros(0, np.uint64) for o in range(order)]
            answers.clear()
            s = score_chunk(c, totals, words, backoff, unseen)
            give_back()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(c.sizes), pa.array(s), pa.array(s / np.maximum(c.sizes, 1))], ["doc_id", "n_words", "log_sum", "log_score"])

        for batch in batches:
            for bucket, docs, blocks in zip(batch.column("bucket").to_pylist(), batch.column("docs"), batch.column("blocks")):
                if bucket < 0:
                    if held is not None:
                        yield close()
                    held, answers = docs.as_py(), []
                else:
                    answers.append(blocks.as_py())
        if held is not None:
            yield close()

    return run


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, unseen: float = UNSEEN, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, log_sum, log_score.

    A word's score is count(n-gram) / count(n-gram without the word) of the longest n-gram of up to ``order`` words
    ending in it that other documents hold, times ``backoff`` for each order left out; a word that no other document
    holds counts as ``unseen`` occurrences among the words of all others.  Counts are those of all documents less the
    document's own.  log_sum adds natural logs over the text, log_score is that a word, by which texts of unlike length
    compare; texts that are null or have no word have 0 words and scores 0.  Texts are read whole.  Rows that repeat are documents of their own, and know each other's n-grams; an empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    spark = small_batches(docs).sparkSession
    chunks = cut(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidied(_chunks(chunk_bytes)), "chunk long, words long, bytes long, docs binary"), "lm-chunks")
    words, size = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    wanted = math.ceil(size / bucket_bytes)
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), wanted if wanted < MANY_BUCKETS else math.ceil(math.sqrt(MANY_BUCKETS * wanted)))
    asked = chunks.select("chunk", "docs").mapInArrow(tidied(_asked(order, buckets)), "bucket int, chunk long, blocks array<binary>")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidied(_answered(order)), "chunk long, bucket int, blocks array<binary>")
    both = answered.select("chunk", "bucket", F.lit(None).cast("binary").alias("docs"), "blocks").union(chunks.select("chunk", F.lit(-1).alias("bucket"), "docs", F.lit(None).cast("array<binary>").alias("blocks")))
    met = both.repartition("chunk").sortWithinPartitions("chunk", "bucket").select("bucket", "docs", "blocks")
    return met.mapInArrow(tidied(_scored(order, buckets, words, backoff, unseen)), "doc_id long, n_words long, log_sum double, log_score double")
