"""Media columns: MPEG transport streams that hold a payload losslessly.

A stream is a row of 188-byte packets. Every group of `GROUP` access units starts with a program association table
and a program map table (both with their CRC-32) and a random access point. An access unit is one PES packet of up to
`UNIT` payload bytes with a presentation timestamp; its first packet carries a program clock reference, and the random
access flag where the unit starts a group. Reading follows the tables to the elementary stream, checks that the
continuity counter of every PID goes up by one, reassembles the PES packets and keeps timestamps and access points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patchloom.sources.session import prepare

# Fixed values of the transport stream format, and the layout chosen here.
PACKET, SYNC, PAT_PID, PMT_PID, ES_PID, PRIVATE_STREAM, STREAM_TYPE = 188, 0x47, 0, 0x1000, 0x100, 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
UNIT, GROUP, TICKS = 1536, 32, 3600  # payload bytes a unit, units a group, 90 kHz ticks a unit
FRAME = 192
MUXED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, feature string, pts array<long>, access_units array<long>, access_offsets array<long>, continuity_errors long, damaged_units array<long>"


class StreamError(ValueError):
    """The bytes are no transport stream of this kind."""


@lru_cache(1024)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, body: bytes) -> bytes:
    """A section of program or stream number 1, version 0, with its checksum."""
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


PAT = _table_packet(PAT_PID, _section(0, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(2, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _units(block: np.ndarray, first: int) -> np.ndarray:
    """(units, bytes) -> (units, packets, 188); counters are set later."""
    n, size = block.shape
    index = np.arange(first, first + n, dtype=np.int64)
    pts = index * TICKS & ((1 << 33) - 1)
    pes = np.empty((n, 14 + size), np.uint8)
    pes[:, :9] = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (8 + size).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    pes[:, 9] = 0x21 | (pts >> 30 & 7) << 1
    pes[:, 10] = pts >> 22 & 0xFF
    pes[:, 11] = 1 | (pts >> 15 & 0x7F) << 1
    pes[:, 12] = pts >> 7 & 0xFF
    pes[:, 13] = 1 | (pts & 0x7F) << 1
    pes[:, 14:] = block
    room, later = PACKET - 12, PACKET - 4  # the first packet has 8 bytes of adaptation field
    k = 1 + -(-(pes.shape[1] - room) // later)
    out = np.full((n, k, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    out[:, 0, 4] = 7
    out[:, 0, 5] = 0x10 | np.where(index % GROUP == 0, 0x40, 0)
    for j, shift in enumerate((25, 17, 9, 1)):
        out[:, 0, 6 + j] = pts >> shift & 0xFF
    out[:, 0, 10] = (pts & 1) << 7 | 0x7E
    out[:, 0, 11] = 0
    out[:, 0, 12:] = pes[:, :room]
    if k > 2:
        out[:, 1 : k - 1, 4:] = pes[:, room : room + (k - 2) * later].reshape(n, k - 2, later)
    tail = pes[:, room + (k - 2) * later :]
    if stuffing := later - tail.shape[1]:
        out[:, k - 1, 3] = 0x30
        out[:, k - 1, 4] = stuffing - 1
        if stuffing > 1:
            out[:, k - 1, 5] = 0
    out[:, k - 1, PACKET - tail.shape[1] :] = tail
    return out


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of FRAME."""
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload of at least one byte."""
    data = np.frombuffer(payload, np.uint8)
    full = len(data) // UNIT
    parts, firsts = [], []
    if full:
        made = _units(data[: full * UNIT].reshape(full, UNIT), 0)
        firsts.append(np.arange(full) * made.shape[1])
        parts.append(made.reshape(-1, PACKET))
    if rest := len(data) - full * UNIT:
        firsts.append(np.array([sum(map(len, parts))]))
        parts.append(_units(data[-rest:].reshape(1, rest), full).reshape(-1, PACKET))
    packets, first = np.concatenate(parts), np.concatenate(firsts)
    packets[:, 3] |= np.arange(len(packets), dtype=np.int64).astype(np.uint8) & 15
    groups = first[::GROUP]
    count = (np.arange(len(groups)) & 15).astype(np.uint8)
    tables = np.stack([np.repeat(PAT[None], len(groups), 0), np.repeat(PMT[None], len(groups), 0)], 1)
    tables[:, :, 3] |= count[:, None]
    return np.insert(packets, np.repeat(groups, 2), tables.reshape(-1, PACKET), axis=0).tobytes()


def _read_section(packets: np.ndarray, table_id: int) -> bytes:
    """The body of the first section of a table, after its checksum held in every packet that repeats it."""
    if not len(packets):
        raise StreamError(f"no table {table_id}")
    body, rows = b"", packets[:, 4:]
    for row in rows[:1] if (rows == rows[0]).all() else np.unique(rows, axis=0):
        at = 1 + int(row[0])
        length = (int(row[at + 1]) & 15) << 8 | int(row[at + 2])
        section = row[at : at + 3 + length].tobytes()
        if section[0] != table_id or crc32_mpeg(section):
            raise StreamError(f"table {table_id} is damaged")
        body = section[8:-4]
    return body


def _program(body: bytes) -> tuple[int, int]:
    """Number and PID of the first program of an association table; number 0 is the network, no program."""
    for at in range(0, len(body) - 3, 4):
        if number := int.from_bytes(body[at : at + 2], "big"):
            return number, int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    raise StreamError("no program")


def _elementary(body: bytes) -> tuple[int, int]:
    """Type and PID of the stream of a program map table that has private data, else of its first one."""
    at, found = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF), []
    while at + 5 <= len(body):
        found.append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    if not found:
        raise StreamError("a program without streams")
    return next((x for x in found if x[0] == STREAM_TYPE), found[0])


def _in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the packets of one PID those that carry payload, without repeats, and where the counter does not go up by one.

    A packet may be sent twice, one time after the other: the second says nothing. A packet that announces a discontinuity
    may have any counter."""
    rows = rows[rows[:, 3] & 0x10 != 0]
    step = np.diff(rows[:, 3].astype(np.int64) & 15) % 16
    again = np.zeros(len(rows), bool)
    again[1:][step == 0] = (rows[1:][step == 0] == rows[:-1][step == 0]).all(1)
    again[1:] &= ~again[:-1]  # a third time is an error
    rows = rows[~again]
    announced = (rows[:, 3] & 0x20 != 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 != 0)
    gap = np.zeros(len(rows), bool)
    gap[1:] = ((np.diff(rows[:, 3].astype(np.int64) & 15) - 1) % 16 != 0) & ~announced[1:]
    return rows, gap


def demux(media: bytes, strict: bool = True) -> tuple[bytes, dict]:
    """Payload, and what the stream says of itself: pts, access_units, access_offsets, continuity_errors, damaged_units,
    feature.

    The first program counts, and of its streams the first of private data (or the first). A unit is damaged if its
    counter has a gap, or if it is not as long as its header says (0: any length). strict: a unit of a wrong length is a
    StreamError; else damaged units are left out of the payload. A unit without a timestamp has -1.
    """
    if not media or len(media) % PACKET:
        raise StreamError("not a whole number of packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise StreamError("sync byte lost")
    pids = (rows[:, 1].astype(np.int64) & 31) << 8 | rows[:, 2]
    pat, pat_gaps = _in_order(rows[pids == PAT_PID])
    program, pmt_pid = _program(_read_section(pat, 0))
    pmt, pmt_gaps = _in_order(rows[pids == pmt_pid])
    kind, es_pid = _elementary(_read_section(pmt, 2))
    es, gaps = _in_order(rows[pids == es_pid])
    errors = int(pat_gaps.sum() + pmt_gaps.sum() + gaps.sum())
    has_field = es[:, 3] & 0x20 != 0
    start = np.minimum(PACKET, 4 + np.where(has_field, 1 + es[:, 4].astype(np.int64), 0))
    begins = es[:, 1] & 0x40 != 0
    access = has_field & (es[:, 4] > 0) & (es[:, 5] & 0x40 != 0)
    stream = es[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    heads = (ends - (PACKET - start))[begins]
    if not len(heads) or heads[0] != 0:
        raise StreamError("no packet starts the stream")
    length = np.diff(np.append(heads, len(stream)))
    h = stream[np.minimum(heads[:, None] + np.arange(14), len(stream) - 1)].astype(np.int64)
    size = h[:, 4] << 8 | h[:, 5]
    wrong = (h[:, :3] != (0, 0, 1)).any(1) | (length < 9 + h[:, 8]) | (size > 0) & (size + 6 != length)
    if strict and wrong.any():
        raise StreamError("an elementary packet is not whole")
    pts = (h[:, 9] >> 1 & 7) << 30 | h[:, 10] << 22 | h[:, 11] >> 1 << 15 | h[:, 12] << 7 | h[:, 13] >> 1
    pts = np.where((h[:, 7] & 0x80 != 0) & (h[:, 8] >= 5), pts, -1)
    unit = np.cumsum(begins) - 1
    damaged = wrong.copy()
    damaged[unit[gaps & ~begins]] = True
    head = np.where(wrong, length, 9 + h[:, 8])
    body = np.arange(len(stream)) - np.repeat(heads, length) >= np.repeat(head, length)
    if not strict:
        body &= ~np.repeat(damaged, length)
    points = np.flatnonzero(access[begins])
    first = np.flatnonzero((pids == es_pid) & (rows[:, 1] & 0x40 != 0) & (rows[:, 3] & 0x10 != 0))
    if len(first) != len(begins.nonzero()[0]):  # repeats of first packets are there
        new = np.append(True, (rows[first[1:]] != rows[first[:-1]]).any(1))
        first = first[new]
    offsets = first[points] * PACKET
    feature = f"program={program} pid={es_pid} type={kind} units={len(pts)} packets={len(rows)} pts={pts[0]}..{pts[-1]} access={len(points)} last_access={pts[points[-1]] if len(points) else -1} cc_errors={errors}"
    return stream[body].tobytes(), {
        "pts": pts.tolist(), "access_units": points.tolist(), "access_offsets": offsets.tolist(), "continuity_errors": errors,
        "damaged_units": np.flatnonzero(damaged).tolist(), "feature": feature,
    }


#: Bytes of media in one batch handed back to Spark.
BATCH_BYTES = 4 << 20


def _batches(rows: Iterator[dict], size_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += size_of(row)
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, held = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def _mux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows():
        for batch in batches:
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                yield {"doc_id": doc_id, "n_bytes": len(data), "media": mux(pad(data))}

    return _batches(rows(), lambda r: len(r["media"]), schema)


def _demux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long = pa.int64()
    schema = pa.schema([("doc_id", long), ("n_bytes", long), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string()), ("pts", pa.list_(long)), ("access_units", pa.list_(long)), ("access_offsets", pa.list_(long)), ("continuity_errors", long), ("damaged_units", pa.list_(long))])

    def rows():
        for batch in batches:
            for doc_id, n_bytes, media in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
                stored = media.as_buffer().to_pybytes()
                payload, more = demux(stored)
                yield {"doc_id": doc_id, "n_bytes": n_bytes, "media": stored, "payload": payload} | more

    return _batches(rows(), lambda r: 3 * len(r["media"]), schema)


def store(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the padded UTF-8 text of every row of documents (doc_id, text) as a transport stream.

    A null or empty text is one frame of spaces. Null ids and repeated rows stay as they are, an empty table gives no
    row, other columns are not read. A row is worked on alone, so memory follows the longest text.
    """
    prepare(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(_mux_batches, MUXED)


def read_back(stored: DataFrame) -> DataFrame:
    """The columns of READ from (doc_id, n_bytes, media); raises StreamError at a stream that is not whole."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_demux_batches, READ)
