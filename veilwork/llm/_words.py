"""Vectorised word splitting and 64-bit hashing of UTF-8 text inside a task."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=None)
def byte_values(kind: str) -> np.ndarray:
    """A value for each byte, 0 where the byte separates words.

    ``space``: words are ``[^\\x20\\x09-\\x0D]+``; ``space_lower``: the same with A-Z lower-cased;
    ``line``: runs of bytes between newlines;
    ``alnum_lower``: A-Z lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
    """
    code = np.arange(256)
    lower = np.where((code >= 65) & (code <= 90), code + 32, code)
    value = (code if kind in ("space", "line") else lower) + 1
    if kind == "line":
        word = code != 10
    elif kind == "alnum_lower":
        word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (code >= 128)
    else:
        word = (code != 32) & ~((code >= 9) & (code <= 13))
    return np.where(word, value, 0).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of some rows: byte ranges, hashes and the word offsets of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str):
        """offsets: row offsets into ``data``, from 0 to its length."""
        value = byte_values(kind)[data]
        inside = value != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        first[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.starts, offsets).astype(np.int64)
        if len(self.starts):
            begin = self.starts[0]
            gaps = np.diff(np.append(self.starts, len(data)))
            powers = np.full(int(gaps.max()) + 1, _BASE, np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            place = np.arange(begin, len(data)) - np.repeat(self.starts, gaps)
            self.hash = mix(np.add.reduceat(value[begin:] * powers[place], self.starts - begin))
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts())


def window_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` symbols, one for each start from 0 to n - length."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, width, factor = np.zeros(n, np.uint64), 0, symbols, 1, _STEP
    rest = length
    while True:
        if rest & 1:
            # already covered ``done`` symbols; append this block behind them
            scale = np.uint64(pow(int(_STEP), done, 1 << 64))
            out += block[done : done + n] * scale
            done += width
        rest >>= 1
        if not rest:
            return mix(out)
        block = block[:-width] + block[width:] * factor
        width, factor = 2 * width, np.uint64(pow(int(factor), 2, 1 << 64))
