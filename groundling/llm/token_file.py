"""Token-id files: canonical length-limited Huffman codes from global counts, decodable in independent blocks.

Format (Parquet dataset, so that any store Spark writes can hold it, with Spark's atomic commit):

* ``codes``: one row, ``lengths`` (binary, one byte of code length per id; canonical codes follow from them).
* ``blocks``: one row per block of whole documents in ascending doc_id order.  ``part``, ``seq``: place in the file;
  ``docs``, ``sizes``: ids and token counts of its documents (int64, little-endian); ``n``: ids of the block; ``start``:
  ids of the part before it; ``checks``: bit offset of every 128th id (uint32 steps); ``bits``: the codes, most
  significant bit first.  A reader needs the code lengths and one block, nothing else.

Encoding looks up codes and lengths for a block at once and adds them into 32-bit words; decoding walks all checkpoints
of a block side by side through a 2^16-entry table (16-bit window to id and length).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch, small_batches, texts_of, tidied, tokenizer

MAX_BITS, STEP, BLOCK_IDS, END_ID = 16, 128, 1 << 18, 0
#: Words that a worker remembers.
MEMO_WORDS = 1_200_000


# ---------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits by package-merge; ids that never occur have length 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) <= 1:
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    # level by level: merge the leaves with the pairs of the level before; what is remembered is which are leaves
    leaves, merged = [], weights
    for level in range(max_bits):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            o = np.argsort(both, kind="stable")
            merged, leaf = both[o], o < len(weights)
        else:
            leaf = np.ones(len(weights), bool)
        leaves.append(leaf)
    take = 2 * len(order) - 2
    depth = np.zeros(len(order), np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[i]):
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each 16-bit window: id << 8 | length."""
    table = np.zeros(1 << MAX_BITS, np.uint32)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        at = int(codes[i]) << (MAX_BITS - n)
        table[at : at + (1 << (MAX_BITS - n))] = i << 8 | n
    return table


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checks) of a block."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 2, np.uint64)
    value = codes[ids].astype(np.uint64) << (64 - n - (at & 31)).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    checks = np.diff(at[::STEP], prepend=0).astype("<u4")
    return words.astype(">u4").tobytes()[: (total + 7) // 8], checks.tobytes()


def decode(bits: bytes, checks: bytes, n: int, table: np.ndarray) -> np.ndarray:
    """The ids of a block; every checkpoint is the start of a lane, and all lanes advance together."""
    raw = np.frombuffer(bits + bytes(8), np.uint8)
    view = raw[:-3].astype(np.uint32) << 16
    view |= raw[1:-2].astype(np.uint32) << 8
    view |= raw[2:-1]
    at = np.cumsum(np.frombuffer(checks, "<u4").astype(np.int64))
    lanes = len(at)
    out = np.zeros((STEP, lanes), np.uint32)
    live = lanes
    for k in range(STEP):
        if k and k == (n - 1) % STEP + 1:
            live = lanes - 1
        if not live:
            break
        a = at[:live]
        entry = table[(view[a >> 3] >> (8 - (a & 7)).astype(np.uint32)) & 0xFFFF]
        out[k, :live] = entry >> 8
        a += entry & 0xFF
    return out.T.reshape(-1)[:n]


# ---------------------------------------------------------------- writing and reading


def _tokens(path: str, end_id: int):
    def run(batches):
        tok = tokenizer(path, "space_prefix", MEMO_WORDS)
        end = np.array([end_id], tok.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in tok.encode(texts_of(batch))]
            n = pa.array([len(x) // len(end) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), n, pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return run


def _histogram(vocabulary: int, dtype: str):
    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column("ids")
            size = np.dtype(dtype).itemsize
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
            counts += np.bincount(np.frombuffer(column.buffers()[2], dtype, (ends[-1] - ends[0]) // size, int(ends[0])), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "count"])

    return run


def _blocks(lengths: bytes, dtype: str, block_ids: int):
    def run(batches):
        sizes = np.frombuffer(lengths, np.uint8)
        codes = canonical(sizes)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal docs, held, size, seq, start
            ids = np.concatenate(held)
            bits, checks = encode(ids, codes, sizes)
            null = np.iinfo(np.int64).min
            row = [part, seq, np.array([null if d is None else d for d in docs], "<i8").tobytes(), np.array([len(x) for x in held], "<i8").tobytes(), len(ids), start, checks, bits]
            seq, start, docs, held, size = seq + 1, start + len(ids), [], [], 0
            return row

        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append(doc)
                held.append(np.frombuffer(ids, dtype))
                size += len(held[-1])
                if size >= block_ids:
                    rows.append(close())
                    if sum(len(r[-1]) for r in rows) > 16 << 20:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)
        if docs:
            yield _batch([close()])

    return run


_BLOCK = "part long, seq long, docs binary, sizes binary, n long, start long, checks binary, bits binary"


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _BLOCK.split(", ")])


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write the file set ``path``/codes and ``path``/blocks.

    Documents are tokenised once, into a compact table of ids; counts come from it by one pre-aggregated pass (the
    result is bounded by the vocabulary), and the same table is sorted by doc_id range for writing.  Null text counts
    as empty; each row gets the end id; null doc_ids come first; rows that repeat a doc_id follow each other in any order; an
    empty table gives a file set without blocks.  Texts are encoded whole; columns other than doc_id and text are ignored, whatever
    their names.
    """
    spark = small_batches(docs).sparkSession
    tok = tokenizer(tokenizer_path, "space_prefix")
    vocabulary = tok.tok.get_vocab_size()
    ids = cut(docs.select("doc_id", "text").mapInArrow(tidied(_tokens(tokenizer_path, end_id)), "doc_id long, n long, ids binary"), "token-ids")
    counts = np.zeros(vocabulary, np.int64)
    for r in ids.select("ids").mapInArrow(_histogram(vocabulary, tok.dtype), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect():
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    ordered = ids.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_blocks(lengths, tok.dtype, block_ids), _BLOCK).write.parquet(f"{path}/blocks")


def read_tokens(spark, path: str, make, schema: str) -> DataFrame:
    """Decode every block in a task of its own reading; ``make(doc, start, ids)`` gives a row per document.

    ``start`` counts the ids of all documents before it in the whole file: the file has one total per part, and the
    running sums of these (as many as write tasks) go with the tasks.
    """
    lengths = bytes(spark.read.parquet(f"{path}/codes").first()["lengths"])
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    before, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("total")).collect()):
        before[r["part"]], total = total, total + r["total"]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        table = decode_table(np.frombuffer(lengths, np.uint8))
        null = np.iinfo(np.int64).min
        for batch in batches:
            for part, docs, sizes, n, start, checks, bits in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "sizes", "n", "start", "checks", "bits"))):
                ids = decode(bits, checks, n, table).astype("<u4")
                sizes = np.frombuffer(sizes, "<i8")
                ends = np.cumsum(sizes)
                rows = [make(None if d == null else d, before[part] + start + int(e - s), ids[e - s : e]) for d, s, e in zip(np.frombuffer(docs, "<i8").tolist(), sizes, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return blocks.drop("seq").mapInArrow(run, schema)


def _digest(doc, start, ids):
    return doc, start, len(ids), zlib.crc32(ids.tobytes())


def token_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the file set to the shared folder, read it back, and return doc_id, start, n_tokens, ids_crc32 per row."""
    path = scratch(docs.sparkSession, "token-file")
    write_tokens(docs, tokenizer_path, path)
    return read_tokens(docs.sparkSession, path, _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
