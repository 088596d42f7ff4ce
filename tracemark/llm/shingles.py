"""Hashes of word shingles of whole texts, a text at a time, in numpy.

Words are maximal runs of bytes other than space and tab to carriage return, A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, taken from running sums, then mixed; a shingle's hash mixes those of its words.
Two different shingles get one hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
STEP = U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (BASE, inverse)]
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, U)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((_LOWER[data].astype(U) + U(1)) * up[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * STEP)


def batch_windows(texts: pa.Array, words: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rabin-Karp hashes of all windows of so many words, case kept, of texts without nulls: (hash, row of the text), in order.

    Whole texts are taken together up to `most` bytes, and hashed as one.
    """
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        hashes, doc = _words_of(data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
        n = max(0, len(hashes) - words + 1)
        whole = doc[:n] == doc[words - 1:]
        with np.errstate(over="ignore"):
            acc = hashes[:n].copy()
            for j in range(1, words):
                acc = acc * STEP + hashes[j:n + j]
            yield mix(acc[whole] + U(words)), doc[:n][whole] + at
        at = stop


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of texts that lie one after another, and the number of its text."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U), np.empty(0, np.int64)
    letters = data[inside]
    place = np.flatnonzero(first[inside])  # where words begin among the letters
    length = np.diff(np.append(place, len(letters)))
    up = powers(int(length.max()))[0]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((letters.astype(U) + U(1)) * up[np.arange(len(letters)) - np.repeat(place, length)], place)
        return mix(sums + length.astype(U) * STEP), np.searchsorted(offsets[1:], starts, "right")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words, the whole sequence as one; of none, empty."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        acc = h[:len(h) - k + 1].copy()
        for j in range(1, k):
            acc = acc * STEP + h[j:len(h) - k + 1 + j]
        return np.unique(mix(acc + U(k)))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix(tokens + STEP), dtype=U)
        b = np.bitwise_xor.reduce(mix(tokens * STEP), dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
