"""What the training-data operators share: tokenizer memo, connected components; scratch tables from the package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, give_back, small_batches, tidied  # noqa: F401
from ..functions.lineage import cut, scratch  # noqa: F401


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Like ``names``, but none that a column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        k = 0
        while f"_{n}{k}" in taken:
            k += 1
        out.append(f"_{n}{k}")
    return out


# ---------------------------------------------------------------- tokenizer

#: Entries of a worker's memo, in two generations: a full young one takes the old one's place, and what is used again moves over.
MEMO_ENTRIES = 800_000
_TOKENIZERS: dict[tuple[str, str], "MemoTokenizer"] = {}


class MemoTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, with a bounded memo from chunk to id bytes.

    A chunk ends where the tokenizer's own pre-tokenizer always cuts, so ids of chunks joined are the ids of the text:

    * ``space_prefix`` (byte-level BPE): a single U+0020 between two characters that are not white space starts a new
      pre-token, and a single \\n between such characters is one.  Keys are words after a space as they stand, words
      after a line's end with that \\n before them, the first word with \\0.  A text with other white space is encoded whole.
    * ``space_dropped`` (word BPE): white space only separates; normalisation does not reach across it.

    Letters followed by ASCII signs are two pre-tokens, remembered apart (signs like a first word), and the word BPE, which
    lowers letters, gets A-Z lowered before the split; both make new words rarer.  New words are
    encoded in one call; their ids are told apart by the lengths of the tokens' strings.  In the texts the strings of
    special tokens are ordinary text.  Ids are kept as little-endian unsigned 16-bit where the vocabulary allows.
    """

    GROUP = 1 << 22

    def __init__(self, path: str, kind: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.spaced, self.entries = kind == "space_prefix", entries
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 65536 else "<u4"
        self.sizes = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token.removesuffix("</w>"))  # a character a byte
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, texts: list[str]) -> tuple[list[int], pa.ListArray]:
        """(places of the texts that can be split, their keys); the other texts are encoded whole."""
        split = pa.array(texts, pa.large_string())
        able = pc.invert(pc.match_substring_regex(split, _NOT_SPACED if self.spaced else _OTHER_SPACE))
        at, split = np.flatnonzero(able.to_numpy(zero_copy_only=False)).tolist(), split.filter(able)
        if self.spaced:
            first, none = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
            return at, pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(_parted(split, b" \0"), "\n", " \n"), none), " ")
        return at, pc.ascii_split_whitespace(pc.ascii_lower(_parted(split, b" ")))

    def whole(self, t: str) -> bytes:
        return np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def learn(self, new: list[str]) -> None:
        memo, both, first = self.memo, [], "\0" if self.spaced else ""
        memo[""] = b""  # white space at an end
        new = [k for k in new if k]
        words: dict[str, None] = {}
        for k in new:
            if k[-1] in _SIGNS and "\u0130" not in k and (m := _WORD_SIGNS(k)):  # its lower case has a mark that is no letter
                a, b = m.groups()
                b = first + b
                both.append((k, a, b))
                for x in (a, b):
                    if x not in memo:
                        words[x] = None
            else:
                words[k] = None
        self._learn(list(words))
        for k, a, b in both:
            memo[k] = memo[a] + memo[b]

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        if self.spaced:  # a first word is learnt as after \n, one id more
            texts = ["\n" + k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in words]
            joined, made = "".join(texts), texts
        else:
            joined = " ".join(words)
            made = self.tok.normalizer.normalize_str(joined).split(" ")
        (e,) = self.tok.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.array(e.ids, dtype=self.dtype)
        ends = np.cumsum(pc.binary_length(pa.array(made, pa.large_string())).to_numpy())
        cum = np.cumsum(self.sizes[ids])
        at = np.searchsorted(cum, ends)
        if len(made) == len(words) and len(cum) and at[-1] < len(cum) and (cum[at] == ends).all():
            raw, size, start = ids.tobytes(), ids.itemsize, 0
            for k, end in zip(words, ((at + 1) * size).tolist()):
                self.memo[k] = raw[start + size : end] if k[0] == "\0" and self.spaced else raw[start:end]
                start = end
        else:
            for k in words:
                self.memo[k] = self.whole(k[1:] if k[0] == "\0" and self.spaced else k if not self.spaced or k[0] == "\n" else " " + k)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Id bytes of each text; texts go in groups of about ``GROUP`` characters."""
        out: list[bytes] = []
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= self.GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.entries // 2:
            self.old, self.memo = self.memo, {}
        at, keys = self.chunks(texts)
        coded = keys.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        memo, old, new = self.memo, self.old.get, []
        ids = list(map(memo.get, words))
        gaps = [i for i, x in enumerate(ids) if x is None]
        for i in gaps:
            k = words[i]
            if (x := old(k)) is None:
                new.append(k)
            else:
                memo[k] = x
        self.learn(new)
        for i in gaps:
            ids[i] = memo[words[i]]
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        raw, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        raw = raw.to_pybytes() if raw is not None else b""
        bounds = ends[keys.offsets.to_numpy() - keys.offsets[0].as_py()]
        out = dict(zip(at, [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]))
        return [out[i] if i in out else self.whole(t) for i, t in enumerate(texts)]


#: White space to the tokenizer, but not to the ASCII split, and what marks keys; for RE2.
_OTHER_SPACE = "[\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NOT_SPACED = "\\A\\z|\\A[ \\n]|[ \\n]\\z|[ \\n][ \\n]|[\\t\\x0b-\\r]|" + _OTHER_SPACE
_SIGNS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_WORD_SIGNS = regex.compile(r"([\n\0]?\p{L}+)([!-/:-@\[-`{-~]+)").fullmatch


_LETTER, _SIGN = (np.isin(np.arange(256), list(x.encode())) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "".join(_SIGNS)))


def _parted(texts: pa.LargeStringArray, mark: bytes) -> pa.LargeStringArray:
    """The texts with ``mark`` between an ASCII letter and an ASCII sign after it, where a pre-token always ends."""
    if not len(texts):
        return texts
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at = np.flatnonzero(_LETTER[raw[:-1]] & _SIGN[raw[1:]]) + 1
    at = at[ends[np.searchsorted(ends, at)] != at]  # between two texts
    width = len(mark)
    out, own = np.empty(len(raw) + width * len(at), np.uint8), np.ones(len(raw) + width * len(at), bool)
    place = at + width * np.arange(len(at))
    for k, x in enumerate(mark):
        out[place + k], own[place + k] = x, False
    out[own] = raw
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends + width * np.searchsorted(at, ends)), pa.py_buffer(out))


def tokenizer(path: str, kind: str, entries: int = MEMO_ENTRIES) -> MemoTokenizer:
    """One per Python worker, with a memo of at most ``entries``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _TOKENIZERS:
        _TOKENIZERS[path, kind] = MemoTokenizer(path, kind)
    _TOKENIZERS[path, kind].entries = entries
    return _TOKENIZERS[path, kind]


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, rep) for every node of ``edges(a, b)``: two nodes share ``rep`` if and only if a path joins them.

    Random-priority contraction: each round every node points at the closed neighbour of least hash, pointers are
    doubled twice, and edges move to what the nodes point at.  The remaining nodes shrink by a constant factor a
    round, whatever the shape of the graph; every round is a few map-side-combined aggregations and equi-joins whose
    result is written to the shared folder.  Nothing is collected.
    """
    edges = cut(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    assign = nodes.select("node", F.col("node").alias("rep"))
    for k in range(max_rounds):
        if edges.isEmpty():
            return assign
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        point = cut(near.select(F.col("a").alias("x"), F.least("m", rank("a"))["v"].alias("y")), "point")
        for _ in range(2):
            again = point.select(F.col("x").alias("y"), F.col("y").alias("z"))
            point = point.join(again, "y").select("x", F.col("z").alias("y"))
        point = cut(point, "jump")
        assign = cut(assign.join(point.withColumnRenamed("x", "rep"), "rep", "left").select("node", F.coalesce("y", "rep").alias("rep")), "assign")
        moved = edges.join(point.select(F.col("x").alias("a"), F.col("y").alias("p")), "a").join(point.select(F.col("x").alias("b"), F.col("y").alias("q")), "b")
        edges = cut(moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
