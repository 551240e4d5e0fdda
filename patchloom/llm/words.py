"""Words of many texts at once, as 64-bit hashes, in numpy over the bytes of an Arrow string column.

A word's hash is a polynomial of a random value for each byte, finished by a bijective mixer; A-Z count as a-z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_EXACT = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

#: Bytes that part words: white space alone, or all of ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_powers = np.ones(1, np.uint64)


def release() -> None:
    """Gives back to the system what numpy and Arrow have freed."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A mapInArrow function that releases memory when its task ends: workers live on between tasks."""

    def tidied(batches, *more):
        try:
            yield from run(batches, *more)
        finally:
            release()

    return tidied


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, _BASE)]), dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no trace of their order."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """hashes of the words of some texts; those of text i are hashes[first[i]:first[i + 1]], and word j stands at bytes
    begins[j]:ends[j] of data, where text i stands at offsets[i]:offsets[i + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = BLANKS) -> Words:
    n = len(data)
    inside = ~parting[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if len(begins):
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n))) if begins[0] == 0 else np.concatenate([np.zeros(begins[0], np.int64), np.arange(begins[0], n) - np.repeat(begins, np.diff(np.append(begins, n)))])
        longest = int((ends - begins).max())
        value = _VALUE[data] * powers(longest)[np.minimum(place, longest - 1)]
        value[~inside] = 0
        hashes = mix(np.add.reduceat(value, begins) + (ends - begins).astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(data, offsets, hashes, begins, ends, np.searchsorted(begins, offsets))


def span_hashes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of the bytes as they stand, from each begin to the next (the last: to the end of data)."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(begins, len(data)))
    place = np.arange(len(data)) - np.repeat(begins, sizes)
    value = _EXACT[data] * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(value, begins) + sizes.astype(np.uint64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive items from each item on (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _PLACE[j % 64]
    return mix(total)


_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def run_hashes(items: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of items[begins:ends], runs of any lengths, from prefix sums of a polynomial over odd numbers modulo 2^64."""
    n = len(items)
    up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP)]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * up[:n], dtype=np.uint64)])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def in_bits(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each hash's bit is set in a table of common.bit_table()."""
    place = hashes % np.uint64(64 * len(table))
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """The hash of a sequence of fewer items than a run has."""
    return mix((hashes * _PLACE[32 : 32 + len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes)))[0]


def pieces(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of stretches of about `most` bytes, or of one longer text."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def flat_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, sizes) of stretches of texts: the distinct hashes of each text's k-word
    shingles, ascending, text after text. A text of fewer words has one, a text without words none."""
    for a, b, data, offsets in pieces(texts):
        w = words_of(data, offsets)
        over = runs(w.hashes, k)
        each = np.diff(w.first)
        place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], each)
        whole = place + k <= np.repeat(each, each)
        text = np.repeat(np.arange(b - a), each)[whole]
        flat = over[np.flatnonzero(whole)]
        short = np.flatnonzero((each > 0) & (each < k))
        if len(short):
            text = np.concatenate([text, short])
            flat = np.concatenate([flat, np.array([sequence_hash(w.hashes[w.first[i] : w.first[i + 1]]) for i in short.tolist()], np.uint64)])
        order = np.lexsort((flat, text))
        flat, text = flat[order], text[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
        yield a, b, flat[new], np.bincount(text[new], minlength=b - a)
