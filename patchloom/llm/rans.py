"""A static range asymmetric numeral system over integer symbols, in numpy.

One frequency table is shared by all blocks. A block is coded by up to `LANES` interleaved coders: symbol i belongs to
lane i mod lanes, so a step works on all lanes at once. A coder's state has 64 bits and sheds 32-bit words. Every
`SEGMENT` steps the coder notes a checkpoint, all its states, and begins a new segment of words: a segment can be cut
out of the block and decoded on its own. Each has a checksum of its states and words, and one of its symbols.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SCALE, LANES, SEGMENT = 20, 512, 256
LOW = np.uint64(1 << 31)  # a state stays in [LOW, 2^63)
HEAD = struct.Struct("<4sIII")  # magic, symbols, segments, checksum of what follows up to the first segment
PLACE = struct.Struct("<Q")  # where a segment ends, counted from the first one's begin; one for each segment
PIECE = struct.Struct("<4sIIIII")  # magic, symbols, lanes, words, checksum of states and words, checksum of symbols
MAGIC, PIECE_MAGIC = b"RNS2", b"RNSP"


class BlockError(ValueError):
    """A block is cut short or damaged."""


@dataclass
class FrequencyTable:
    """symbols (ascending) and their shares of 2^SCALE, each at least 1."""

    symbols: np.ndarray
    freqs: np.ndarray

    @classmethod
    def from_counts(cls, symbols, counts) -> FrequencyTable:
        """Shares by largest remainder; the same counts give the same table."""
        symbols, counts = np.asarray(symbols, np.int64), np.asarray(counts, np.float64)
        order = np.argsort(symbols, kind="stable")
        symbols, counts = symbols[order], counts[order]
        if not 0 < len(symbols) <= 1 << (SCALE - 1):
            raise ValueError(f"{len(symbols)} symbols; a table holds 1 to {1 << (SCALE - 1)}")
        spare = (1 << SCALE) - len(symbols)  # each symbol has one already
        exact = counts / counts.sum() * spare
        freqs = np.floor(exact).astype(np.int64)
        short = spare - int(freqs.sum())
        freqs[np.argsort(-(exact - freqs), kind="stable")[:short]] += 1
        return cls(symbols, freqs + 1)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freqs)[:-1]])

    @cached_property
    def index_of(self) -> np.ndarray:
        out = np.full(int(self.symbols[-1]) + 1, -1, np.int64)
        out[self.symbols] = np.arange(len(self.symbols))
        return out

    @cached_property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs)

    @cached_property
    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        return self.freqs.astype(np.uint64), self.starts.astype(np.uint64)

    def __getstate__(self):
        return {"symbols": self.symbols, "freqs": self.freqs}


def encode(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """The block of ids (any integers the table has; none at all is a block too)."""
    ids = np.asarray(ids)
    n = len(ids)
    lanes = min(LANES, max(1, n // 64))
    f, c = table.wide
    index = table.index_of[ids] if n else np.zeros(0, np.int64)
    if n and index.min() < 0:
        raise ValueError("a symbol is not in the table")
    freq, start = f[index], c[index]
    limit = freq << np.uint64(63 - SCALE)
    x = np.full(lanes, LOW, np.uint64)
    shed: list[np.ndarray] = []  # the words of a segment, the last ones first
    pieces: list[bytes] = []
    up, scale = np.uint64(32), np.uint64(SCALE)
    for t in range(-(-n // lanes) - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        s = x[: b - a]
        full = s >= limit[a:b]
        if full.any():
            shed.append(s[full].astype("<u4"))
            s[full] >>= up
        q = s // freq[a:b]
        s += (q << scale) - q * freq[a:b] + start[a:b]  # the quotient moves up, the remainder stays
        if t % SEGMENT == 0:
            own = ids[a : min(n, (t + SEGMENT) * lanes)].astype("<u4").tobytes()
            body = x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(shed))
            pieces.append(PIECE.pack(PIECE_MAGIC, len(own) // 4, lanes, len(body) // 4 - 2 * lanes, zlib.crc32(body), zlib.crc32(own)) + body)
            shed = []
    pieces.reverse()
    places = b"".join(map(PLACE.pack, np.cumsum([len(p) for p in pieces]).tolist()))
    return HEAD.pack(MAGIC, n, len(pieces), zlib.crc32(places)) + places + b"".join(pieces)


def segments(block: bytes) -> list[bytes]:
    """The segments of a block, each for decode_segment()."""
    if len(block) < HEAD.size:
        raise BlockError("no head")
    magic, n, count, crc = HEAD.unpack_from(block)
    begin = HEAD.size + count * PLACE.size
    if magic != MAGIC or len(block) < begin or zlib.crc32(memoryview(block)[HEAD.size : begin]) != crc:
        raise BlockError("not a block, or a damaged head")
    ends = [0, *(PLACE.unpack_from(block, HEAD.size + k * PLACE.size)[0] for k in range(count))]
    if len(block) != begin + ends[-1]:
        raise BlockError("not a whole block")
    pieces = [block[begin + a : begin + b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if sum(PIECE.unpack_from(p)[1] for p in pieces) != n:
        raise BlockError("segments are missing")
    return pieces


def decode_segment(piece: bytes, table: FrequencyTable) -> np.ndarray:
    """The ids of a segment as unsigned 32-bit integers, from its checkpoint; its checksums are tested."""
    if len(piece) < PIECE.size:
        raise BlockError("no segment")
    magic, n, lanes, n_words, crc, crc_symbols = PIECE.unpack_from(piece)
    if magic != PIECE_MAGIC or len(piece) != PIECE.size + 8 * lanes + 4 * n_words or zlib.crc32(memoryview(piece)[PIECE.size :]) != crc:
        raise BlockError("a damaged segment")
    x = np.frombuffer(piece, "<u8", lanes, PIECE.size).astype(np.uint64)
    words = np.frombuffer(piece, "<u4", n_words, PIECE.size + 8 * lanes).astype(np.uint64)
    f, c = table.wide
    slots = table.slots
    mask, scale, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    out = np.empty(n, np.uint32)
    at = 0
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        s = x[: b - a]
        slot = s & mask
        index = slots[slot.astype(np.int64)]
        out[a:b] = index
        s = f[index] * (s >> scale) + slot - c[index]
        low = np.flatnonzero(s < LOW)
        if len(low):
            s[low] = s[low] << up | words[at : at + len(low)]
            at += len(low)
        x[: b - a] = s
    ids = table.symbols.astype(np.uint32)[out]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_symbols:
        raise BlockError("symbols are damaged")
    return ids


def decode(block: bytes, table: FrequencyTable) -> np.ndarray:
    """The ids of a block, segment after segment."""
    found = [decode_segment(p, table) for p in segments(block)]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)
