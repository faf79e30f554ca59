"""Near-duplicate texts: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Copies, case and white space apart, collapse to one text first.  Each has a SimHash of its shingles; those within
``BITS`` bits are found by the inverted index of byte positions with count filtering of ``simhash`` and are candidates.
At the threshold fingerprints differ in about 10 of 64 bits, beyond what shared bytes can tell from chance, and of a posting
only a spanning forest comes out, so the rest has a way of its own: candidates as well are texts that share one of ``BANDS``
bands of ``ROWS`` min-hashes, which a pair at the threshold misses with a chance of 5 in 100,000.  Every link is verified on
the shingle sets themselves.  Of a bucket each text is compared with the least one first; where a bucket is still in several
components, all its pairs across components follow, so no bucket is cut.  These are not emitted: the bucket's members go
out in tiles of two blocks of bounded size, a row per member and block, are compared there in the first bucket that they
share, and what comes back are links between components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import connected_components, cut, small_batches, texts_of, tidied
from .simhash import BROADCAST_ROWS, drop_rows, fingerprint_links

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 25, 5, 42
#: Bits of 64 in which the fingerprints of candidates differ at most.
BITS = 3
#: Members of a block, and their shingles, on average at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 20
_CHUNK = 1024


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def key_of(text: str) -> bytes:
    """The same for texts with the same words."""
    return xxhash.xxh3_128_digest(b" ".join(words_of(text)))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole sequence if it has fewer words."""
    words = words_of(text)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - WORDS + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + WORDS]), SEED) for i in range(n)), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles by their hashes, signed: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 64 * _CHUNK):
        h = hashes[at : at + 64 * _CHUNK].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


_RNG = np.random.default_rng(SEED)
_XOR, _MIX, _ROW = (_RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (BANDS * ROWS, BANDS * ROWS, ROWS))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        y = hashes[None, at : at + _CHUNK] ^ _XOR[:, None]
        y *= _MIX[:, None]
        np.minimum(least, y.min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    return ((least.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ _XOR[:BANDS]).view(np.int64)  # bands have values of their own


def _slices(batches, rows: int = 256):
    """Small batches, so that a worker holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signed(batches):
    for batch in _slices(batches):
        keys, sizes, fps, values = [], [], [], []
        for t in texts_of(batch):
            h = shingles(t)
            keys.append(key_of(t))
            sizes.append(len(h))
            fps.append(fingerprint(h))
            values.append(bands(h))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(values)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists], ["doc_id", "key", "n", "fp", "bands"])


def _keyed(batches):
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([key_of(t) for t in texts_of(batch)], pa.binary()), batch.column("text")], ["key", "text"])


def _sets(batches):
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t).tobytes() for t in texts_of(batch)], pa.binary())], ["id", "hashes"])


def _alike(similarity: float):
    def run(batches):
        for batch in _slices(batches):
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """(id, hashes) of the texts ``ids``; of the texts only these leave their place."""
    needed = cut(ids.join(reps.select("id", "key"), "id"), "needed")
    small = F.broadcast if needed.count() <= broadcast_rows else lambda df: df
    texts = docs.select("text").mapInArrow(tidied(_keyed), "key binary, text string").join(small(needed), "key").select("id", "text")
    return cut(texts.mapInArrow(tidied(_sets), "id long, hashes binary").groupBy("id").agg(F.first("hashes").alias("hashes")), "sets")


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """The pairs that are alike."""
    pairs = cut(pairs.distinct(), "candidates")
    sets = _sets_of(docs, reps, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), broadcast_rows)
    x, y = (sets.select(F.col("id").alias(a), F.col("hashes").alias(b)) for a, b in (("a", "x"), ("b", "y")))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidied(_alike(similarity)), "a long, b long"), "alike")


def _across(similarity: float):
    """Links between the components of a tile's two blocks; rows come sorted by (value, i, j, role)."""

    def linked(value, left, right):
        """Of members (rep, n, bands, hashes); a pair counts in the first band it shares, where it is met as well."""
        band = int(np.flatnonzero(left[0][2] == value)[0])
        rep, size, own = (np.array([m[k] for m in right]) for k in (0, 1, 2))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        out = []
        for k, (p, n, bands, hashes) in enumerate(left):
            near = (rep != p) & (np.minimum(size, n) >= similarity * np.maximum(size, n)) & ~(own[:, :band] == bands[:band]).any(axis=1)
            if left is right:
                near[: k + 1] = False
            for j in np.flatnonzero(near).tolist():
                q = int(rep[j])
                a, b = root(p), root(q)
                if a != b:
                    both = len(np.intersect1d(hashes, right[j][3], assume_unique=True))
                    if both >= similarity * (n + int(size[j]) - both):
                        parent[a] = b
                        out.append((p, q))
        return out

    def run(batches):
        key, held = None, {}

        def close():
            if key is None or 0 not in held or (key[1] != key[2] and 1 not in held):
                return None
            out = linked(key[0], held[0], held[0] if key[1] == key[2] else held[1])
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("value", "i", "j", "role", "rep", "n", "bands", "hashes")]
            for value, i, j, role, rep, n, bands_, hashes in zip(*columns):
                if (value, i, j) != key:
                    if (done := close()) is not None:
                        yield done
                    key, held = (value, i, j), {}
                held.setdefault(role, []).append((rep, n, np.array(bands_, np.int64), np.frombuffer(hashes, np.uint64)))
        if (done := close()) is not None:
            yield done

    return run


def _components_met(docs: DataFrame, reps: DataFrame, named: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """Links (a, b) between components that ``named(value, id, n, rep)`` has in one bucket."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    mixed = named.groupBy("value").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), blocks.alias("blocks")).where("x < y").select("value", "blocks")
    members = cut(named.select("value", "id", "n", "rep").join(mixed, "value"), "mixed")
    sets = _sets_of(docs, reps, members.select("id").distinct(), broadcast_rows).join(reps.select("id", "bands"), "id")
    rows = members.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("value", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"), (F.col("k") < F.col("b")).cast("int").alias("role"), "rep", "n", "id").join(sets, "id").drop("id")
    rows = rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "role")
    return cut(rows.mapInArrow(tidied(_across(similarity)), "a long, b long").distinct(), "met")


def _sized(x: str, y: str, similarity: float):
    """Sets of these sizes can be as alike as that."""
    return F.least(x, y) >= similarity * F.greatest(x, y)


def fingerprint_pairs(reps: DataFrame, similarity: float = SIMILARITY, max_bits: int = BITS) -> DataFrame:
    """Candidates (a, b) among ``reps(id, n, fp)``, a < b: each text and the first of its fingerprint, and the firsts of linked fingerprints."""
    firsts = cut(reps.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("c")).select("fp", F.col("c.id").alias("c"), F.col("c.n").alias("cn")), "firsts")
    same = reps.select("id", "n", "fp").join(firsts, "fp").where(F.col("id") != F.col("c")).select("c", "cn", "id", "n")
    x, y = firsts.toDF("a", "x", "xn"), firsts.toDF("b", "y", "yn")
    linked = fingerprint_links(firsts.select("fp"), max_bits).distinct().join(x, "a").join(y, "b").select("x", "xn", "y", "yn")
    return same.union(linked).toDF("x", "xn", "y", "yn").where(_sized("xn", "yn", similarity)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (of its words), component_id, the least doc_id reachable.

    Null and blank texts are copies of each other.  Rows that repeat a doc_id stay rows of their own; a null doc_id
    counts in no minimum (a component of such rows only has a null component_id).
    """
    small_batches(docs)
    rows = cut(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidied(_signed), "doc_id long, key binary, n int, fp long, bands array<long>"), "signatures")
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("id"), "*"), "texts")
    bucket = Window.partitionBy("value")
    posts = reps.select("id", "n", F.explode("bands").alias("value"))
    posts = posts.withColumn("first", F.min(F.struct("id", "n")).over(bucket)).withColumn("held", F.count(F.lit(1)).over(bucket)).where("held > 1")
    posts = cut(posts.select("value", "id", "n", F.col("first.id").alias("c"), F.col("first.n").alias("cn")), "buckets")
    stars = posts.where(F.col("id") != F.col("c")).where(_sized("n", "cn", similarity)).select(F.col("c").alias("a"), F.col("id").alias("b"))
    links = _verified(docs, reps, stars.union(fingerprint_pairs(reps, similarity)), similarity, broadcast_rows)
    groups = cut(connected_components(links), "groups")

    named = cut(posts.join(groups.select(F.col("node").alias("id"), "rep"), "id", "left").select("value", "id", "n", F.coalesce("rep", "id").alias("rep")), "named")
    more = _components_met(docs, reps, named, similarity, broadcast_rows)
    if not more.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("rep").alias("b"))
        groups = cut(connected_components(stars.union(more)), "groups")
    named = cut(reps.select("id", "key", "least").join(groups.select(F.col("node").alias("id"), "rep"), "id", "left").select("key", "least", F.coalesce("rep", "id").alias("rep")), "named")
    named = named.join(named.groupBy("rep").agg(F.min("least").alias("component_id")), "rep").select("key", "component_id")
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "key", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the rows of its least doc_id stay, all columns unchanged, whatever their names.

    Null and blank texts are copies of each other; texts of fewer words than a shingle are alike only if their words are
    the same.  Rows that repeat the kept doc_id with a text of its component all stay; rows without a doc_id only where
    no other is in the component.  Texts are read whole; an empty table gives no rows.
    """
    groups = near_groups(docs, similarity, broadcast_rows).select("doc_id", F.col("key").alias("fp"), "component_id")
    return drop_rows(docs, groups, lambda texts: pa.array(list(map(key_of, texts)), pa.binary()), BinaryType(), broadcast_rows)
