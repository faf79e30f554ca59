"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits`` of their eight
positional bytes: the guaranteed minimum.  Postings of single bytes would hold 1/256 of all rows, and tallies over them
would be quadratic, so a posting is of several bytes: the positions are cut into ``max_bits + 2`` groups, of which two
fingerprints that close share at least two, and each distinct fingerprint is posted under every two of them.  For each
pair that meets in a posting the shared positional bytes are tallied; pairs whose tally reaches the guaranteed minimum
are retained and verified by bit distance.  A posting of more than ``HEAVY`` fingerprints passes them on, as they
stream by, to postings of all bytes of the guaranteed minimum, which hold at most 2^16 for two bits whatever the input,
so no group is unbounded; there the neighbours of each fingerprint are looked up.  What goes out is a spanning forest
of the verified links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from .common import connected_components, cut, free_names, small_batches, texts_of

SEED = 42
_CHUNK = 1 << 16
#: Fingerprints of a posting whose pairs are tallied one by one at most.
HEAVY = 1024
#: Ids of documents to drop that are sent to all tasks at most: 8 bytes each.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats included); no words: 0; fewer words: the one whole sequence.

    A-Z are lower-cased, words are split at ASCII white space, shingles are hashed by XXH64 with seed 42, and a bit is
    1 if it is set in over half of the hashes.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - words_per_shingle + 1]
    ends = ends[words_per_shingle - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        a, b = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair how many of the eight positional bytes are the same."""
    return (np.ascontiguousarray(x ^ y).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _retained(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the pairs that pass the count filter and then the bit distance."""
    at = np.flatnonzero(shared_bytes(x, y) >= 8 - max_bits)
    return at[np.bitwise_count(x[at] ^ y[at]) <= max_bits]


def spanning_links(values: np.ndarray, posting: np.ndarray, max_bits: int) -> np.ndarray:
    """Places (i, j) of a spanning forest of the pairs within ``max_bits`` bits in one of the postings.

    ``values`` come sorted by their ``posting`` number and then by value.
    """
    first = np.flatnonzero(np.concatenate([[True], posting[1:] != posting[:-1]])) if len(values) else np.zeros(0, int)
    left = np.repeat(np.concatenate([first[1:], [len(values)]]), np.diff(np.concatenate([first, [len(values)]]))) - np.arange(len(values)) - 1 if len(values) else first
    at, pairs = np.arange(len(values)), []
    for k in range(1, int(left.max(initial=0)) + 1):
        at = at[left[at] >= k]  # those that have a k-th next in their posting
        hit = at[_retained(values[at], values[at + k], max_bits)]
        pairs.append(np.stack([hit, hit + k], 1))
    return _forest(np.concatenate(pairs) if pairs else np.zeros((0, 2), int))


def neighbour_links(values: np.ndarray, max_bits: int) -> np.ndarray:
    """The same for one large posting: every flip of up to ``max_bits`` of the bits that vary is looked up in it."""
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    free = [b for b in range(64) if varying >> b & 1]
    pairs = []
    for k in range(1, max_bits + 1):
        for flips in combinations(free, k):
            other = values ^ np.uint64(sum(1 << b for b in flips))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.flatnonzero((values[at] == other) & (values < other))
            pairs.append(np.stack([hit, at[hit]], 1))
    return _forest(np.concatenate(pairs) if pairs else np.zeros((0, 2), int))


def _forest(pairs: np.ndarray) -> np.ndarray:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return np.array(out, int).reshape(-1, 2)


def _masks(max_bits: int, kept: int, groups: list[tuple[int, ...]]) -> list[int]:
    """For every choice of ``kept`` of the groups of byte positions the mask of their bits, as a signed 64-bit number."""
    out = []
    for chosen in combinations(groups, kept):
        m = sum(0xFF << 8 * p for g in chosen for p in g)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def position_groups(max_bits: int) -> list[tuple[int, ...]]:
    n = min(8, max_bits + 2)
    return [tuple(range(8 * g // n, 8 * (g + 1) // n)) for g in range(n)]


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(combo, bytes, fp), sorted, a posting in one task."""
    posts = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for k, m in enumerate(masks)])).alias("p"))
    return posts.select("p.combo", "p.bytes", "fp").repartition("combo", "bytes").sortWithinPartitions("combo", "bytes", "fp")


def _linked(max_bits: int, heavy: int | None):
    """Rows come sorted by (combo, bytes, fp): links (a, b); fingerprints of postings above ``heavy`` go on as (a, null)."""

    def rows(values, pairs, on):
        v = values.view(np.int64)
        b = pa.array(np.concatenate([v[pairs[:, 1]], v[on]]), mask=np.arange(len(pairs) + len(on)) >= len(pairs))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[pairs[:, 0]], v[on]])), b], ["a", "b"])

    def run(batches):
        held, going = None, None  # going: the posting whose fingerprints stream on
        for batch in batches:
            if held is not None:
                batch = pa.concat_batches([held, batch])
            combo, key = batch.column("combo").to_numpy(), batch.column("bytes").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]])
            done = bounds[-2]
            if heavy is not None and (len(fp) - done > heavy or going == (combo[done], key[done])):
                going, done = (combo[done], key[done]), len(fp)  # too many already, and more may come
            held = batch.slice(done)
            yield close(fp[:done], bounds[bounds < done], combo, key, going)
        if held is not None and held.num_rows:
            yield close(held.column("fp").to_numpy().view(np.uint64), np.zeros(1, int), held.column("combo").to_numpy(), held.column("bytes").to_numpy(), going)

    def close(fp, starts, combo, key, going):
        sizes = np.diff(np.concatenate([starts, [len(fp)]]))
        number = np.repeat(np.arange(len(starts)), sizes)
        if heavy is None:
            pairs = []
            for a, n in zip(starts.tolist(), sizes.tolist()):
                if n > 1:
                    own = fp[a : a + n]
                    pairs.append(a + (neighbour_links(own, max_bits) if n > 256 else spanning_links(own, np.zeros(n, int), max_bits)))
            return rows(fp, np.concatenate(pairs) if pairs else np.zeros((0, 2), int), np.zeros(0, int))
        large = sizes > heavy
        if going is not None:
            large |= (combo[starts] == going[0]) & (key[starts] == going[1])
        on = large[number]
        light = np.flatnonzero(~on)
        return rows(fp, light[spanning_links(fp[light], number[light], max_bits)], np.flatnonzero(on))

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(a, b): for each posting of the distinct ``fps(fp)`` a spanning forest of its pairs within ``max_bits`` bits."""
    groups = position_groups(max_bits)
    met = cut(_postings(fps, _masks(max_bits, len(groups) - max_bits, groups)).mapInArrow(_linked(max_bits, heavy), "a long, b long"), "postings")
    links, crowded = met.where("b is not null"), cut(met.where("b is null").select(F.col("a").alias("fp")).distinct(), "crowded")
    if not crowded.isEmpty():
        links = links.union(_postings(crowded, _masks(max_bits, 8 - max_bits, [(p,) for p in range(8)])).mapInArrow(_linked(max_bits, None), "a long, b long"))
    return links


def fingerprint_components(fps: DataFrame, max_bits: int = 2, heavy: int = HEAVY) -> DataFrame:
    """(fp, component_id) for each distinct ``fp`` of ``fps(doc_id, fp)``; component_id is the least doc_id reachable."""
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    groups = connected_components(fingerprint_links(least, max_bits, heavy))
    named = least.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("rep", "fp").alias("rep"))
    named = cut(named, "named")
    ids = named.groupBy("rep").agg(F.min("least").alias("component_id"))
    return named.join(ids, "rep").select("fp", "component_id")


def simhash_groups(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64-bit), fingerprint (16 hex digits), component_id.

    Null or blank texts have fingerprint zero, which links like any other.  Rows that repeat a doc_id stay rows of
    their own; a null doc_id counts in no minimum (a component of such rows only has a null component_id).  An empty
    table gives no rows.  Columns other than doc_id and text are ignored, whatever their names.
    """
    small_batches(docs)
    fps = cut(docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    named = fingerprint_components(fps, max_bits)
    return fps.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_mark(schema, mark, kind: str, name: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, mark(texts_of(batch))], [*batch.schema.names, name])

    return run, StructType([*schema, StructField(name, kind)])


def keep_one(docs: DataFrame, max_bits: int = 2, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without near-duplicates: of each component the rows of its least doc_id stay, all columns unchanged."""
    mark = lambda texts: pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))
    return drop_rows(docs, simhash_groups(docs, max_bits), mark, LongType(), broadcast_rows)


def drop_rows(docs: DataFrame, groups: DataFrame, mark, kind: DataType, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the rows of the least doc_id of each component of ``groups(doc_id, fp, component_id)``.

    Rows with a null doc_id stay only in a component that has no other rows.  Where rows of one doc_id are in several
    components, each is judged by its own, which ``mark`` tells: from texts to an array of ``fp``, of the type ``kind``.
    The ids that go are sent to all tasks if there are at most ``broadcast_rows``, so that texts stay where they are;
    beyond that rows and ids meet by doc_id.  Columns may have any names.
    """
    gone_id, fp, own = free_names(docs, "gone", "fp", "own")
    goes = F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") != F.col("component_id")))
    groups = groups.select("doc_id", F.col("fp").alias("f"), goes.alias("goes"))
    ids = groups.groupBy("doc_id").agg(F.bool_and("goes").alias("every"), F.bool_or("goes").alias("some"))
    gone = cut(ids.where("some").select("doc_id", "every"), "gone")
    n, mixed = gone.agg(F.count(F.lit(1)), F.count_if(~F.col("every"))).first()
    bounded = F.broadcast if n <= broadcast_rows else lambda df: df
    same = docs["doc_id"].eqNullSafe(F.col(gone_id))
    kept = docs.join(bounded(gone.select(F.col("doc_id").alias(gone_id))), same, "left_anti")
    if mixed:  # doc_ids with rows that stay: fingerprints tell them apart
        some = gone.where(~F.col("every")).select(F.col("doc_id").alias("d"))
        some = cut(groups.where("goes").join(some, F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select(F.col("doc_id").alias(gone_id), F.col("f").alias(fp)).distinct(), "mixed")
        few = F.broadcast if some.count() <= broadcast_rows else lambda df: df
        run, schema = _with_mark(docs.schema, mark, kind, own)
        rows = docs.join(few(some.select(gone_id).distinct()), same, "left_semi").mapInArrow(run, schema)
        rest = rows.join(few(some), rows["doc_id"].eqNullSafe(F.col(gone_id)) & (rows[own] == F.col(fp)), "left_anti").drop(own)
        kept = kept.unionByName(rest)
    return kept
