"""Line dedup by probing a sharded minimal perfect hash over distinct line hashes.

Lines are hashed to 128 bits; (documents, largest doc_id) per distinct hash come from one map-side-combined aggregation.
The distinct hashes of lines that more than one document holds are the keys of the index (a line of one document can
never go, and would only make the index as large as the corpus): a shard, chosen by the hash's leading bits, is a
minimal perfect hash (one seed per small bucket) over compact arrays of 64-bit fingerprints, counts and keepers.
Documents probe the arrays, and the count found there decides whether a line goes; lines are never joined.  The index
is sent to all tasks when its checked size is within ``broadcast_bytes``; beyond that the documents' probes are dealt
out to (shard, salt), as many salts as the shard's counts ask for, so a line that a third of all documents hold is
spread over many tasks, each of which reads the one shard and then streams its probes past it.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, small_batches, texts_of, tidied

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard at most on average; bytes of an index that is sent to all tasks.
SHARD_KEYS, BROADCAST_BYTES = 200_000, 32 << 20
#: At least 2^6 shards, so that building them is spread over tasks; probes of one task on average, beyond the broadcast.
MIN_BITS, TASK_PROBES = 6, 500_000
_BUCKET = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """128-bit hash of a line's key as two unsigned halves; None if the key is shorter than ``min_chars``."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace").lower())
    return h >> 64, h & 0xFFFFFFFFFFFFFFFF


# ---------------------------------------------------------------- minimal perfect hash


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (seed.astype(np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


class Shard:
    """A minimal perfect hash from distinct 64-bit keys to 0..n-1, and arrays indexed by it.

    ``seeds`` holds one number per bucket of about four keys, found by trying seeds, largest buckets first.  A key that
    was never inserted lands on some slot too; its fingerprint (other 64 bits of the hash) differs there.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        n = len(hi)
        self.n, self.m = n, max(1, n // _BUCKET)
        self.seeds = np.zeros(self.m, np.uint32)
        bucket = (hi % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.zeros(n, bool)
        place = np.zeros(n, np.int64)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            rows = order[starts[b] : starts[b + 1]]
            keys, seed = hi[rows], 0
            while True:
                seeds = np.arange(seed, seed + 64, dtype=np.uint64)
                at = _slots(keys[None, :], seeds[:, None], n)
                free = ~taken[at].any(axis=1)
                if len(rows) > 1:
                    s = np.sort(at, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    k = int(np.argmax(free))
                    self.seeds[b], place[rows] = seed + k, at[k]
                    taken[at[k]] = True
                    break
                seed += 64
        self.prints, self.count, self.keeper = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.prints[place], self.count[place], self.keeper[place] = lo, count, keeper

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the fingerprint there differs."""
        if not self.n:
            return np.full(len(hi), -1)
        at = _slots(hi, self.seeds[(hi % np.uint64(self.m)).astype(np.int64)], self.n)
        return np.where(self.prints[at] == lo, at, -1)


def _shard_of(hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi >> np.uint64(64 - bits)).astype(np.int64)


def _build(key: tuple, table: pa.Table) -> pa.Table:
    u = lambda c: table.column(c).to_numpy().view(np.uint64)
    shard = Shard(u("hi"), u("lo"), table.column("n").to_numpy(), table.column("keeper").to_numpy())
    blob = pickle.dumps(shard, protocol=5)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(blob)], pa.int64()), "lines": pa.array([int(shard.count.sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})


# ---------------------------------------------------------------- passes over the documents


def _hashes(min_chars: int):
    def run(batches):
        """(hi, lo, doc_id) once per distinct key of a row."""
        for batch in batches:
            his, los, ids = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                if len(text) < min_chars:
                    continue
                found = {line_hash(x, min_chars) for x in text.split("\n")} - {None}
                his += [a for a, _ in found]
                los += [b for _, b in found]
                ids += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(his, np.uint64).view(np.int64)), pa.array(np.array(los, np.uint64).view(np.int64)), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"])

    return run


def line_index(docs: DataFrame, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards (shard, size, lines, blob) over the keys of more than one document, and the shard number's bits."""
    lines = docs.select("doc_id", "text").mapInArrow(tidied(_hashes(min_chars)), "hi long, lo long, doc_id long")
    lines = lines.where("doc_id is not null").distinct()  # a doc_id that repeats counts once for a key
    keys = cut(lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where("n > 1"), "line-keys")
    bits = max(MIN_BITS, int(np.ceil(np.log2(max(1, keys.count()) / shard_keys))))
    shard = F.shiftrightunsigned("hi", 64 - bits)
    return cut(keys.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard long, size long, lines long, blob binary"), "line-shards"), bits


class _Probe:
    """The whole index in a task."""

    def __init__(self, blobs: dict[int, bytes], bits: int):
        self.shards, self.bits = {k: pickle.loads(v) for k, v in blobs.items()}, bits

    def gone(self, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether each line goes, of the documents ``doc`` (``known``: that have an id)."""
        out, shard = np.zeros(len(hi), bool), _shard_of(hi, self.bits)
        for k in np.unique(shard).tolist():
            if k in self.shards:
                rows = np.flatnonzero(shard == k)
                out[rows] = _verdicts(self.shards[k], hi[rows], lo[rows], doc[rows], known[rows], min_docs)
        return out


def _verdicts(shard: Shard, hi: np.ndarray, lo: np.ndarray, doc: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
    """By the arrays of the shard: its fingerprint is the line's, its count reaches ``min_docs``, its keeper is another."""
    at = shard.probe(hi, lo)
    if not shard.n:
        return np.zeros(len(hi), bool)
    return (at >= 0) & (shard.count[at] >= min_docs) & ((shard.keeper[at] != doc) | ~known)


def _lines_of(batch: pa.RecordBatch, min_chars: int, rows: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines with a key: ``rows`` entry, number in the text, hash halves, doc_id (0 if null), whether it has one."""
    docs = batch.column("doc_id").to_pylist()
    own, line, his, los, ids, known = [], [], [], [], [], []
    for r, doc, text in zip(rows, docs, texts_of(batch)):
        if len(text) >= min_chars:
            for k, x in enumerate(text.split("\n")):
                if (h := line_hash(x, min_chars)) is not None:
                    own.append(r), line.append(k), his.append(h[0]), los.append(h[1]), ids.append(doc or 0), known.append(doc is not None)
    return own, np.array(line, np.int64), np.array(his, np.uint64), np.array(los, np.uint64), np.array(ids, np.int64), np.array(known, bool)


def _dropped(batch: pa.RecordBatch, min_chars: int, min_docs: int, probe: _Probe) -> list[set[int]]:
    """For each text the numbers of its lines that go."""
    own, line, *key = _lines_of(batch, min_chars, list(range(batch.num_rows)))
    out: list[set[int]] = [set() for _ in range(batch.num_rows)]
    for k in np.flatnonzero(probe.gone(*key, min_docs)).tolist():
        out[own[k]].add(int(line[k]))
    return out


def _rest(text: str, gone: set[int]) -> str:
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text


def _digest(batch: pa.RecordBatch, gone: list[set[int]]) -> pa.RecordBatch:
    texts = texts_of(batch)
    kept = [_rest(t, g) for t, g in zip(texts, gone)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pa.array([len(g) for g in gone], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in kept])],
        ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    )


def _rewritten(batch: pa.RecordBatch, gone: list[set[int]]) -> pa.RecordBatch:
    names = batch.schema.names
    texts = batch.column("text").to_pylist()
    kept = [None if t is None else _rest(t, g) for t, g in zip(texts, gone)]
    columns = {"text": lambda: pa.array(kept, batch.schema.field("text").type)}
    if "n_chars" in names:
        was = batch.column("n_chars").to_pylist()
        columns["n_chars"] = lambda: pa.array([len(t) if g else n for t, g, n in zip(kept, gone, was)], batch.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays([columns[n]() if n in columns else batch.column(n) for n in names], schema=batch.schema)


def _apply(docs: DataFrame, make, schema, min_chars: int, min_docs: int, broadcast_bytes: int, shard_keys: int) -> DataFrame:
    if min_docs < 2:
        raise ValueError("a line of one document stays")
    spark = small_batches(docs).sparkSession
    shards, bits = line_index(docs, min_chars, shard_keys)
    size = shards.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast(({r["shard"]: bytes(r["blob"]) for r in shards.select("shard", "blob").toLocalIterator()}, bits))

        def run(batches):
            probe = _Probe(*blobs.value)
            for batch in batches:
                yield make(batch, _dropped(batch, min_chars, min_docs, probe))

        return docs.mapInArrow(tidied(run), schema)
    return _apply_far(docs, shards, bits, make, schema, min_chars, min_docs)


def _apply_far(docs: DataFrame, shards: DataFrame, bits: int, make, schema, min_chars: int, min_docs: int, task_probes: int | None = None) -> DataFrame:
    """For an index too large to send: probes go to (shard, salt), verdicts come back to their rows.

    ``salts`` of a shard follow from how often its lines occur.  Shard numbers without keys get no probes.
    """
    row, gone_lines, kept = free_names(docs, "row", "lines", "at")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    salts = cut(shards.select(F.col("shard").alias("s"), F.greatest(F.lit(4), F.ceil(F.col("lines") / (task_probes or TASK_PROBES))).cast("int").alias("salts")), "salts")

    def probes(batches):
        for batch in batches:
            own, line, hi, lo, doc, known = _lines_of(batch, min_chars, batch.column(row).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard_of(hi, bits)), pa.array(own, pa.int64()), pa.array(line), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(doc, mask=~known)],
                ["shard", "row", "line", "hi", "lo", "doc_id"],
            )

    sent = rows.select(F.col(row), "doc_id", "text").mapInArrow(probes, "shard long, row long, line long, hi long, lo long, doc_id long")
    sent = sent.join(salts, F.col("shard") == F.col("s")).withColumn("salt", F.pmod(F.xxhash64("row", "line"), F.col("salts").cast("long")).cast("int"))
    sent = sent.select("shard", "salt", F.lit(1).alias("kind"), "row", "line", "hi", "lo", "doc_id", F.lit(None).cast("binary").alias("blob"))
    none = F.lit(None).cast("long")
    copies = shards.join(salts, F.col("shard") == F.col("s")).select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), *(none.alias(c) for c in ("row", "line", "hi", "lo", "doc_id")), "blob")
    met = copies.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").select("row", "line", "hi", "lo", "doc_id", "blob")

    def judge(batches):
        shard = None
        for batch in batches:
            news = np.flatnonzero(batch.column("blob").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([-1, *news], [*news, batch.num_rows]):
                if a >= 0:
                    shard = pickle.loads(batch.column("blob")[a].as_py())
                part = batch.slice(a + 1, b - a - 1)
                if part.num_rows and shard is not None:
                    u = lambda c: part.column(c).to_numpy().view(np.uint64)
                    doc = part.column("doc_id")
                    known = doc.is_valid().to_numpy(zero_copy_only=False)
                    gone = pa.array(_verdicts(shard, u("hi"), u("lo"), doc.fill_null(0).to_numpy(), known, min_docs))
                    yield part.select(["row", "line"]).filter(gone)

    verdicts = met.mapInArrow(judge, "row long, line long")
    lines = verdicts.groupBy(F.col("row").alias(kept)).agg(F.collect_list("line").alias(gone_lines))
    joined = rows.join(lines, F.col(row) == F.col(kept), "left").drop(row, kept)

    def run(batches):
        for batch in batches:
            gone = [set(x or ()) for x in batch.column(gone_lines).to_pylist()]
            yield make(batch.select([n for n in batch.schema.names if n != gone_lines]), gone)

    return joined.mapInArrow(run, schema)


def line_dedup_digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row.

    Null or empty text is one empty line.  A key counts each doc_id once, however often its rows or lines repeat it;
    null doc_ids count for no key, and their rows lose every line of a repeated key.  All rows of the largest doc_id
    holding a key keep all their lines of it.  An empty table gives no rows.
    """
    return _apply(docs.select("doc_id", "text"), _digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", min_chars, min_docs, broadcast_bytes, shard_keys)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` (and ``n_chars``, if there, of changed texts counted anew).

    Which lines go is as in ``line_dedup_digest``.  A null text stays null, a text that loses all its lines is empty, and
    no row goes.  Rows that repeat stay rows of their own; all other columns, whatever their names, are unchanged.  A text
    of any length is handled whole, line by line; an empty table gives no rows.
    """
    return _apply(docs, _rewritten, docs.schema, min_chars, min_docs, broadcast_bytes, shard_keys)
