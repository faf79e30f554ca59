"""Bounded-space online best-fit packing of token ids into sequences of a fixed length.

Each task packs the pieces of its own documents as it tokenises them, so texts are not shuffled: a fixed number of bins
is open, a bitset has a bit for every amount of free space that an open bin has, and a piece goes where the least space
that holds it is left.  When a new bin is needed and all places are taken, the fullest bin closes.

What a task leaves open is loose.  The pieces of all sequences that are filled to less than ``TIGHT`` (rows of numbers,
no texts) are therefore dealt to few tasks and packed once more, longest first, so the number of sequences hardly
depends on how the input was split.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, cut, small_batches, texts_of, tidied, tokenizer

MAX_TOKENS, OPEN_BINS, END_ID = 4096, 2048, 1
#: Fill from which a sequence stays as it is; pieces that one task packs again.
TIGHT, AGAIN_ROWS = 0.98, 500_000


class BestFit:
    """Online best-fit with at most ``open_bins`` bins open; ``place`` returns (bin number, offset)."""

    def __init__(self, capacity: int = MAX_TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.made, self.open, self.free = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bins = self.by_free[space]
            b = bins.pop()
            if not bins:
                self.free &= ~(1 << space)
            self.open -= 1
        else:
            space, b = self.capacity, self.made
            self.made += 1
        if left := space - size:
            if self.open >= self.open_bins:
                fullest = (self.free & -self.free).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.free &= ~(1 << fullest)
                self.open -= 1
            self.by_free[left].append(b)
            self.free |= 1 << left
            self.open += 1
        return b, self.capacity - space


def _pack(tokenizer_path: str, capacity: int, open_bins: int, end_id: int, with_ids: bool, memo: int):
    def run(batches):
        tok = tokenizer(tokenizer_path, "space_dropped", memo)
        packer, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            docs = batch.column("doc_id").to_pylist()
            for at in range(0, len(docs), 256):
                part = texts_of(batch.slice(at, 256))
                for doc, ids in zip(docs[at : at + 256], tok.encode(part)):
                    ids = np.append(np.frombuffer(ids, tok.dtype).astype("<u4"), np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        size = len(raw) // 4
                        b, offset = packer.place(size)
                        for o, v in zip(out, (doc, piece, start, size, zlib.crc32(raw), base + b, offset)):
                            o.append(v)
                        if with_ids:
                            out[7].append(raw)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
            n = 7 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out[:n], kinds)], names[:n])

    return run


def _pack_again(capacity: int, open_bins: int):
    def run(batches):
        packer, base = BestFit(capacity, open_bins), (TaskContext.get().partitionId() << 40) + (1 << 62)
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            new = {"sequence_id": pa.array([base + b for b, _ in places], pa.int64()), "offset": pa.array([o for _, o in places], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False, again_rows: int = AGAIN_ROWS, memo: int = MEMO_ENTRIES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    ``ids`` is binary, little-endian unsigned 32-bit.  A null or empty text is the end id alone.  Only documents longer
    than ``max_tokens`` are cut, into pieces of that length but the last.  Of bins with the same space left the one that
    got its last piece latest is taken.  Rows that repeat a doc_id are packed as documents of their own; a null doc_id
    stays null.  A text of any length is tokenised whole.  An empty table gives no rows; columns other than doc_id and
    text are ignored, whatever their names.  ``memo``: words that a worker remembers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    rows = small_batches(docs).selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidied(_pack(tokenizer_path, max_tokens, open_bins, end_id, with_ids, memo)), schema)
    rows = cut(rows, "packed")
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("pieces"))
    loose = cut(fill.where(F.col("fill") < TIGHT * max_tokens).select("sequence_id", "pieces"), "loose")
    n = loose.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0]
    tight = rows.join(loose, "sequence_id", "left_anti").select(rows.columns)
    open_ = rows.join(loose, "sequence_id", "left_semi").select(rows.columns)
    dealt = open_.repartition(max(1, math.ceil(n / again_rows)), F.xxhash64("sequence_id", "offset")).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    return tight.unionByName(dealt.mapInArrow(_pack_again(max_tokens, open_bins), schema))
