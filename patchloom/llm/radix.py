"""Radix tries of byte strings in preorder, with counters by source at their leaves, as numpy arrays.

A trie is the list of its leaves in the order of their bytes, which is that of UTF-8. Each leaf has the depth at which
its path leaves that of the leaf before (what is above is shared, and held once) and the label from there on. Leaves
have the number of their documents and any number of counters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Depth below which paths are not shared: it bounds the steps of folding and unfolding.
DEPTH = 64


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings of bytes from their bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def parts(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of strings of bytes."""
    _, where, raw = terms.buffers()
    offsets = np.frombuffer(where, np.int64, len(terms) + 1, terms.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + sizes[i], one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Trie:
    labels: np.ndarray  # bytes, leaf by leaf
    sizes: np.ndarray  # of the labels
    shared: np.ndarray  # depth up to which a leaf's path is that of the leaf before
    docs: np.ndarray
    width: np.ndarray  # counters of each leaf
    sources: np.ndarray  # of the counters
    counts: np.ndarray

    @classmethod
    def of(cls, terms: pa.Array, docs: np.ndarray, width: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> Trie:
        """The trie of distinct terms in order."""
        data, offsets = parts(terms)
        size = np.diff(offsets)
        shared = np.zeros(len(terms), np.int64)
        alike = np.arange(1, len(terms))
        for depth in range(DEPTH):
            alike = alike[(size[alike] > depth) & (size[alike - 1] > depth)]
            if not len(alike):
                break
            alike = alike[data[offsets[alike] + depth] == data[offsets[alike - 1] + depth]]
            shared[alike] = depth + 1
        labels = data[_spans(offsets[:-1] + shared, size - shared)]
        return cls(labels, size - shared, shared, docs, width, sources, counts)

    def terms(self) -> pa.Array:
        """The paths to the leaves."""
        size = self.sizes + self.shared
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(offsets[-1], np.uint8)
        out[_spans(offsets[:-1] + self.shared, self.sizes)] = self.labels
        each = np.arange(len(size))
        for depth in range(int(self.shared.max(initial=0))):
            # the last leaf whose own label covers this depth has its byte
            own = np.maximum.accumulate(np.where(self.shared <= depth, each, 0))
            lacks = np.flatnonzero(self.shared > depth)
            out[offsets[lacks] + depth] = out[offsets[own[lacks]] + depth]
        return binary(out, offsets)

    def cut(self, terms: pa.Array, a: int, b: int) -> Trie:
        """The leaves a to b, whose terms are given, as a trie of their own."""
        first = np.concatenate([[0], np.cumsum(self.width)])
        own = slice(first[a], first[b])
        return Trie.of(terms.slice(a, b - a), self.docs[a:b], self.width[a:b], self.sources[own], self.counts[own])


def merged(tries: list[Trie], least: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, docs, width, sources and counts of the union of tries, added leaf by leaf, of the terms of `least` documents
    or more, in order."""
    encoded = pa.concat_arrays([t.terms() for t in tries]).dictionary_encode()
    place = encoded.indices.to_numpy().astype(np.int64)
    docs = np.zeros(len(encoded.dictionary), np.int64)
    np.add.at(docs, place, np.concatenate([t.docs for t in tries]).astype(np.int64))
    kept = np.flatnonzero(docs >= least)
    terms = encoded.dictionary.take(pa.array(kept))
    order = pc.sort_indices(terms).to_numpy()
    rank = np.full(len(docs), -1, np.int64)
    rank[kept[order]] = np.arange(len(kept))
    leaf = np.repeat(rank[place], np.concatenate([t.width for t in tries]))
    sources, counts = (np.concatenate([getattr(t, c) for t in tries]).astype(np.int64) for c in ("sources", "counts"))
    good = leaf >= 0
    most = int(sources.max(initial=0)) + 1
    key, counts = summed(leaf[good] * most + sources[good], counts[good])
    width = np.bincount(key // most, minlength=len(kept))
    return terms.take(pa.array(order)), docs[kept[order]], width, key % most, counts


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)
