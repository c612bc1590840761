"""Hashes of words and of word windows of many texts at once, for Python workers."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes whose words are hashed at a time.
STEP_BYTES = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE))), dtype=np.uint64)[:n]


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 texts, A-Z lower-cased, one text after the other; and each text's number of words.

    A hash is a polynomial of the word's bytes modulo 2**64, scrambled with its length.
    """
    data = b"\n".join(raw).lower() + b"\n"
    every = np.frombuffer(data, np.uint8)
    found, starts, at = [], [], 0
    while at < len(data):
        # a step ends after white space, so it holds whole words
        end = min(len(data), at + STEP_BYTES)
        while not _IS_SPACE[every[end - 1]]:
            more = np.flatnonzero(_IS_SPACE[every[end : end + STEP_BYTES]])
            end += int(more[0]) + 1 if len(more) else STEP_BYTES
        part = every[at:end]
        space = _IS_SPACE[part]
        first = np.flatnonzero(~space & np.append(True, space[:-1]))
        if len(first):
            inside = part[~space]
            lengths = np.flatnonzero(space & np.append(False, ~space[:-1])) - first
            heads = np.cumsum(lengths) - lengths
            place = np.arange(len(inside)) - np.repeat(heads, lengths)
            sums = np.add.reduceat(_byte_values()[inside] * _powers(int(lengths.max()))[place], heads)
            found.append(mixed(sums ^ mixed(lengths.astype(np.uint64))))
            starts.append(first + at)
        at = end
    hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(np.concatenate(starts) if starts else np.empty(0, np.int64), ends)
    return hashes, np.diff(upto, prepend=0)


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n values; none if there are fewer."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(values) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * _BASE + values[i : len(values) - n + 1 + i])
    return out


def shingle_rows(raw: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-word shingles of texts in order, one text after the other, and each text's number; none of texts with fewer words."""
    words, counts = word_hashes(raw)
    every, sizes = windows(words, n), np.maximum(counts - n + 1, 0)
    # windows over the end of a text go
    kept = np.repeat(np.cumsum(counts) - counts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return every[kept], sizes


def shingle_sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; all words as one if there are fewer; none of no words."""
    words, counts = word_hashes(raw)
    every, out, at = windows(words, n), [], 0
    for c in counts.tolist():
        out.append(np.unique(every[at : at + c - n + 1]) if c >= n else windows(words[at : at + c], c) if c else np.empty(0, np.uint64))
        at += c
    return out
