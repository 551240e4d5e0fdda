"""Token-ID / binary output: token ids in blocks coded by a static range asymmetric numeral system.

`write` leaves two Parquet tables in a folder: `table` (symbol, freq: the shared frequency table, from the counts of
all tokens) and `blocks`, a row for each independent block of whole documents in ascending doc_id order (part, block,
start_in_part, n_docs, n_tokens, doc_ids, lengths, data). `read` decodes the blocks in parallel, those of long
documents segment by segment from their checkpoints; it tests every segment's checksums, and gives each document's ids
and its place in the whole sequence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import rans, words
from patchloom.llm.common import written

END_ID = 2
#: Tokens after which a block is closed; a block holds whole documents, so a longer document is a longer block.
BLOCK_TOKENS = 1 << 18
#: Entries of a worker's memory of encoded pieces, and the longest piece it keeps.
ENTRIES, LONGEST = 4_000_000, 64

RAW = "part int, block int, start_in_part long, n_docs int, n_tokens long, doc_ids binary, lengths binary, ids binary"
BLOCKS = "part int, block int, start_in_part long, n_docs int, n_tokens long, doc_ids binary, lengths binary, data binary"
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids binary"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pool:
    """An array that grows."""

    def __init__(self, dtype: np.dtype):
        self.values, self.used = np.zeros(1 << 16, dtype), 0

    def hold(self, values: np.ndarray) -> int:
        """Puts values at the end and says where."""
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), len(values)), self.values.dtype)])
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)


def _same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a and b hold the same values, `sizes` of them, from those places on."""
    if not len(sizes):
        return np.zeros(0, bool)
    ends = np.cumsum(sizes)
    inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    differ = a[np.repeat(at_a, sizes) + inside] != b[np.repeat(at_b, sizes) + inside]
    return np.diff(np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], ends])]) == 0


class Memory:
    """Ids of pieces by the pieces' hashes: sorted tables, a large and a recent one, of about 40 bytes an entry. The
    pieces' bytes are kept too: a hash that two pieces share never gives one the other's ids."""

    def __init__(self, dtype: np.dtype):
        # hashes, places and numbers of ids, places and numbers of bytes
        self.tables = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))] * 2
        self.ids, self.bytes = _Pool(dtype), _Pool(np.dtype(np.uint8))

    def find(self, hashes: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of ids of the pieces that stand at data[begins:begins + sizes]; a place of -1 where a
        piece is not known."""
        place, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, places, counts, at_bytes, n_bytes in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero((known[at] == hashes) & (n_bytes[at] == sizes))
                hit = hit[_same(data, begins[hit], self.bytes.values, at_bytes[at[hit]], sizes[hit])]
                place[hit], count[hit] = places[at[hit]], counts[at[hit]]
        return place, count

    def add(self, hashes: np.ndarray, *columns: np.ndarray) -> None:
        """columns: places and numbers of ids, places and numbers of bytes."""
        merged = [np.concatenate([old, new]) for old, new in zip(self.tables[1], (hashes, *columns), strict=True)]
        if len(merged[0]) > len(self.tables[0][0]) // 4:
            merged = [np.concatenate([old, new]) for old, new in zip(self.tables[0], merged, strict=True)]
            self.tables[0], merged = self._sorted(merged), [x[:0] for x in merged]
        self.tables[1] = self._sorted(merged)

    @staticmethod
    def _sorted(table):
        order = np.argsort(table[0], kind="stable")
        return tuple(x[order] for x in table)

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)


# Bytes of letters and digits, and first bytes of UTF-8 whose characters all are letters (U+00C0 to
# U+027F but two signs, U+0400 to U+047F).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PLAIN = np.zeros(256, bool)
PLAIN[[9 + 1, *range(32, 127), *range(128, 192), *range(0xC3, 0xCA), 0xD0, 0xD1]] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of some texts begin.

    The byte-level pre-tokenizer never joins what stands before a single white-space character to what follows it, nor
    a word to the lone full stop or comma that ends it. So a piece begins at a blank, at a line end, after a line end,
    and at such a mark; the library sees each piece as it stands. A text with white space of other kinds or in a row,
    or with characters that may be no letters, is one piece.
    """
    n = len(data)
    blank, line = data == 32, data == 10
    space = blank | line
    odd = ~PLAIN[data]
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | space[:-1] & space[1:]
    begin = space.copy()
    begin[1:] |= line[:-1]
    ends = np.ones(n, bool)
    ends[:-1] = space[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    mark = ((data == 46) | (data == 44)) & ends
    mark[1:] &= ALNUM[data[:-1]]
    mark[:1] = False
    begin |= mark
    bad = np.add.reduceat(np.append(odd, False), np.minimum(offsets[:-1], n)) > 0
    bad &= np.diff(offsets) > 0
    if bad.any():
        begin &= ~np.repeat(bad, np.diff(offsets))
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Texts to ids with the tokenizers library, through a memory of pieces that holds up to `ENTRIES` of them.

    Pieces are looked up by 64-bit hashes and compared byte by byte. Tokenizers of other kinds than a plain byte-level
    BPE get each text as one piece, and so does any tokenizer a text that holds an added token, such as <|endoftext|>:
    it becomes that token's id, as in the library's plain call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        before, kind = self.tokenizer.pre_tokenizer, lambda x: type(x).__name__
        self.by_piece = kind(before) == "ByteLevel" and not before.add_prefix_space and before.use_regex and self.tokenizer.normalizer is None and kind(self.tokenizer.model) == "BPE"
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.memory = Memory(self.dtype)
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _begins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces begin that the library sees."""
        texts = offsets[:-1][np.diff(offsets) > 0]
        if not self.by_piece:
            return texts
        begins = cuts(data, offsets)
        found = [m.start() for m in self.added.finditer(data.tobytes())] if self.added else []
        if not found:
            return begins
        text_of = np.searchsorted(texts, begins, "right")
        return begins[~np.isin(text_of, np.searchsorted(texts, found, "right")) | np.isin(begins, texts)]

    def encode(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of stretches of texts, each text with end_id after it."""
        for _, _, data, offsets in words.pieces(texts, 1 << 20):
            begins = self._begins(data, offsets)
            sizes = np.diff(np.append(begins, len(data)))
            hashes = words.span_hashes(data, begins)
            unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            memory = self.memory
            room = memory.ids.used
            place, size = memory.find(unique, data, begins[first], sizes[first])
            new = np.flatnonzero(place < 0)
            raw = data.tobytes()
            piece = lambda i: raw[begins[i] : begins[i] + sizes[i]].decode()  # noqa: E731, B023
            for i in new.tolist():
                ids = self.whole(piece(first[i]))
                place[i], size[i] = memory.ids.hold(ids), len(ids)
            places, lengths = place[which], size[which]
            alike = sizes == sizes[first[which]]
            alike[alike] = _same(data, begins[alike], data, begins[first[which[alike]]], sizes[alike])
            for i in np.flatnonzero(~alike).tolist():  # two pieces of one hash
                ids = self.whole(piece(i))
                places[i], lengths[i] = memory.ids.hold(ids), len(ids)
            total = np.concatenate([[0], np.cumsum(lengths)])
            index = np.repeat(places - total[:-1], lengths) + np.arange(total[-1])
            ids = memory.ids.values[index]
            at = total[np.searchsorted(begins, offsets)]
            yield np.insert(ids, at[1:], end_id), np.diff(at) + 1
            if len(memory) + len(new) <= ENTRIES:
                kept = new[sizes[first[new]] <= LONGEST]
                n = sizes[first[kept]]
                ends = np.cumsum(n)
                if len(kept):
                    at_bytes = memory.bytes.hold(data[np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(begins[first[kept]], n)])
                    memory.add(unique[kept], place[kept], size[kept], at_bytes + ends - n, n)
            else:
                memory.ids.used = room


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker keeps its encoder, and so its memory, from task to task."""
    return Encoder(path)


def _tokenize(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, lengths, docs, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, held
            row = [part, block, start, len(docs), held, np.array([-1 << 63 if d is None else d for d in docs], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), b"".join(ids)]
            block, start, held = block + 1, start + held, 0
            ids.clear(), lengths.clear(), docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        for batch in batches:
            doc_ids = iter(batch[0].to_pylist())
            for made, sizes in encoder.encode(batch[1], end_id):
                at = 0
                for size in sizes.tolist():
                    ids.append(made[at : at + size].tobytes())
                    at += size
                    lengths.append(size)
                    docs.append(next(doc_ids))
                    held += size
                    if held >= BLOCK_TOKENS:
                        yield close()
        if docs:
            yield close()

    return run


def _count(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch[0]:
                counts = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(counts) > len(total):
                    total = np.concatenate([total, np.zeros(len(counts) - len(total), np.int64)])
                total[: len(counts)] += counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    return run


def _encode(dtype: np.dtype, table: rans.FrequencyTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = rans.encode(np.frombuffer(batch.column("ids")[i].as_buffer(), dtype), table)
                kept = [batch.column(c).slice(i, 1) for c in ("part", "block", "start_in_part", "n_docs", "n_tokens", "doc_ids", "lengths")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([data], pa.binary())], names=["part", "block", "start_in_part", "n_docs", "n_tokens", "doc_ids", "lengths", "data"])

    return run


def write(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes the ids of every row of documents (doc_id, text), each with end_id after it, to the folder `path`.

    A null or empty text is its end id alone. Rows go by doc_id, ties by text, a null doc_id first; repeated rows are
    written again. An empty table writes an empty `blocks`. Other columns are not read. `parts` is the number of pieces
    of the sequence that are made side by side.
    """
    spark = documents.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    dtype = encoder_of(tokenizer).dtype
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    head = F.substring("text", 1, 32).asc_nulls_first()  # rows of one doc_id, or of none, are dealt by their texts
    dealt = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), head).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    raw = written(dealt.mapInArrow(words.tidy(_tokenize(tokenizer, end_id)), RAW), "token-ids")
    # at most one row a symbol comes to the driver
    counts = raw.select("ids").mapInArrow(words.tidy(_count(dtype)), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    table = rans.FrequencyTable.from_counts([r["symbol"] for r in counts], [r["n"] for r in counts]) if counts else rans.FrequencyTable.from_counts([end_id], [1])
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.freqs, strict=True)], "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    raw.mapInArrow(words.tidy(_encode(dtype, table)), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _documents(row: dict, ids: np.ndarray) -> list[pa.Array]:
    """The columns of READ for the documents of a block."""
    lengths, docs = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
    ends = np.cumsum(lengths)
    offsets = np.concatenate([[0], ends * 4])
    short = offsets[-1] < 1 << 31
    kind, offsets = (pa.binary(), offsets.astype(np.int32)) if short else (pa.large_binary(), offsets)
    blob = (pa.BinaryArray if short else pa.LargeBinaryArray).from_buffers(kind, len(docs), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4").tobytes())])
    return [pa.array(docs, pa.int64(), mask=docs == -1 << 63), pa.array(np.full(len(docs), row["part"]), pa.int32()), pa.array(row["start_in_part"] + ends - lengths), pa.array(lengths), blob.cast(pa.binary())]


def _decode(ids_of):
    """Blocks -> READ; ids_of gives a row's ids."""
    names = ["doc_id", "part", "start_in_part", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays(_documents(row, ids_of(row)), names=names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> their segments, a row each."""
    for batch in batches:
        for part, block, data in zip(*(batch.column(c) for c in ("part", "block", "data")), strict=True):
            for k, piece in enumerate(rans.segments(data.as_py())):
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([block.as_py()], pa.int32()), pa.array([k], pa.int32()), pa.array([piece], pa.binary())], names=["part", "block", "segment", "piece"])


def _decode_segments(table: rans.FrequencyTable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([rans.decode_segment(x.as_py(), table).astype("<u4").tobytes() for x in batch.column("piece")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "block", "segment")), ids], names=["part", "block", "segment", "ids"])

    return run


def read(spark: SparkSession, path: str, long_block: int = 4 * BLOCK_TOKENS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    A block of more than long_block tokens, that of a long document, is cut into its segments, which are decoded side by
    side and put together again; other blocks are decoded whole, a task having many of them."""
    rows = spark.read.schema("symbol long, freq long").parquet(f"{path}/table").orderBy("symbol").collect()
    table = rans.FrequencyTable(np.array([r["symbol"] for r in rows]), np.array([r["freq"] for r in rows]))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row a part
    bases, base = [], 0
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]
    about = ["part", "start_in_part", "doc_ids", "lengths"]
    docs = blocks.where(F.col("n_tokens") <= long_block).select(*about, "data").mapInArrow(words.tidy(_decode(lambda row: rans.decode(row["data"], table))), READ)
    long = blocks.where(F.col("n_tokens") > long_block)
    pieces = long.select("part", "block", "data").mapInArrow(_cut, "part int, block int, segment int, piece binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = pieces.repartition(parts, "part", "block", "segment").mapInArrow(words.tidy(_decode_segments(table)), "part int, block int, segment int, ids binary")
    whole = ids.groupBy("part", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "ids"))), lambda x: x["ids"]).alias("pieces"))
    joined = long.select("block", *about).join(whole, ["part", "block"]).select(*about, "pieces")
    docs = docs.unionByName(joined.mapInArrow(words.tidy(_decode(lambda row: np.frombuffer(b"".join(row["pieces"]), "<u4"))), READ))
    placed = docs.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")  # a row a part
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")
