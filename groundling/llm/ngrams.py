"""Hashed byte n-grams of whole texts, computed with numpy in time linear in the text."""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_PLAIN = np.arange(256, dtype=np.uint32)


def _pieces(text: str, letters_only: bool):
    """The text's UTF-8 bytes as numbers, in pieces that overlap by three, so that memory stays bounded for any text."""
    table = _FOLD if letters_only else _PLAIN
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw), _PIECE):
        yield table[raw[at : at + _PIECE + 3]], at + _PIECE + 3 < len(raw)


def codes(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A ``bits``-bit hash of every n-gram (n from 2 to 4) of the bytes ``x``."""
    size = len(x) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = x[:size].copy()
    for k in range(1, n):
        h |= x[k : k + size] << np.uint32(8 * k)
    h ^= np.uint32(n * 0x3C6EF35F & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def counts(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each hash occurs; every byte that is no letter counts as a space."""
    out = np.zeros(1 << bits, np.int64)
    for x, more in _pieces(text, True):
        for n in sizes:
            y = x[: len(x) - 4 + n] if more else x  # an n-gram that starts in the overlap belongs to the next piece
            out += np.bincount(codes(y, n, bits), minlength=1 << bits)
    return out


class Indicators:
    """Which hashes occur in a text; one scratch array serves all texts."""

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits
        self.mark = np.zeros(1 << bits, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        found = []
        for x, _ in _pieces(text, False):
            c = np.concatenate([codes(x, n, self.bits) for n in self.sizes])
            place = np.arange(len(c))
            self.mark[c] = place
            found.append(c[self.mark[c] == place])
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
