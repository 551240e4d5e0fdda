"""Vector codes: each vector is cut into parts, each part becomes the index of its nearest codebook entry. The codebooks
come from Lloyd rounds that are maintained by deltas.

Vectors lie as whole numbers in a table dealt by row into buckets, and so do the assignments of the round before. A round
reads the two bucket by bucket (no shuffle), assigns the parts anew and writes the new assignments beside the old ones, in
the same buckets. Parts whose assignment is another one than before take their components out of the old entry's sums
and into the new one's: only these plus and minus contributions, summed in each task, are shuffled, and added to the
running sums, which are a table of one row for each number of a codebook. Sums are whole numbers, so what they
hold after a delta is what a sum over all parts would give, in any order of the parts.

The codebooks (256 entries a part, however many vectors) are all that the driver holds and broadcasts. Each round's
tables are written, so that a lost executor costs a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import Buckets, join_groups, written
from patchloom.llm.words import tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of a task's table of distances at a time.
CELLS = 1 << 21
#: Whole numbers below this are exact as doubles, and so is any sum of theirs below it.
EXACT = 1 << 53


def bound(dims: int) -> int:
    """The largest component for which a squared distance over all dims fits into a long."""
    return int(np.sqrt(2.0**62 / max(dims, 1))) // 2


@dataclass
class Codebooks:
    """entries: (part, entry, component) whole numbers; sums and counts: the running ones of the parts assigned."""

    entries: np.ndarray
    sums: np.ndarray = field(init=False)
    counts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sums = np.zeros_like(self.entries)
        self.counts = np.zeros(self.entries.shape[:2], np.int64)

    def take(self, slots: np.ndarray, values: np.ndarray) -> None:
        """New running sums, by slot: each entry has one for each component and, last, its count."""
        p, e, d = self.entries.shape
        flat = np.zeros(p * e * (d + 1), np.int64)
        flat[slots] = values
        flat = flat.reshape(p, e, d + 1)
        self.sums, self.counts = flat[..., :d], flat[..., d]

    def moved(self) -> Codebooks:
        """Every entry that has parts goes to the floor of their mean; others stay."""
        mean = self.sums // np.maximum(self.counts, 1)[..., None]
        out = Codebooks(np.where(self.counts[..., None] > 0, mean, self.entries))
        out.sums, out.counts = self.sums, self.counts
        return out

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each of some parts of one position (ties to the lower), and the squared distance.

    Exact: by products of doubles where all sums are below 2^53, else of whole numbers."""
    n, d = parts.shape
    codes, errors = np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * max(d, 1) * most * most < EXACT else np.int64
    e = entries.astype(kind)
    norms = (e * e).sum(1)
    step = max(1, CELLS // max(1, len(entries)))
    for a in range(0, n, step):
        x = parts[a : a + step].astype(kind)
        far = norms - 2 * (x @ e.T)
        at = far.argmin(1)
        codes[a : a + step] = at
        errors[a : a + step] = (far[np.arange(len(x)), at] + (x * x).sum(1)).astype(np.int64)
    return codes, errors


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column of lists of one length, as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _assign(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = books.value
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch["q"]).reshape(len(batch), PARTS, entries.shape[2])
            codes, error = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
            for p in range(PARTS):
                codes[:, p], miss = nearest(vectors[:, p], entries[p])
                error += miss
            new = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(batch), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([batch["row"], batch["now"], new.cast(pa.binary()), pa.array(error)], names=["row", "before", "now", "error"])

    return run


def _moves(shape: tuple[int, int, int]):
    """Plus and minus contributions of the parts that moved, summed over the task, by slot."""
    parts, entries, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, d + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch["q"]).reshape(len(batch), parts, d)
            with_one = np.concatenate([vectors, np.ones((*vectors.shape[:2], 1), np.int64)], axis=2)
            known = batch["before"].is_valid().to_numpy(zero_copy_only=False)
            codes = [np.frombuffer(b"".join(batch[c].fill_null(b"\0" * parts).to_pylist()), np.uint8).reshape(-1, parts) for c in ("before", "now")]
            changed = ~known[:, None] | (codes[0] != codes[1])
            for p in range(parts):
                rows = changed[:, p]
                np.add.at(total, p * entries + codes[1][rows, p].astype(np.int64), with_one[rows, p])
                np.subtract.at(total, p * entries + codes[0][rows & known, p].astype(np.int64), with_one[rows & known, p])
        flat = total.ravel()
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(flat[slots])], names=["slot", "value"])

    return run


def whole_numbers(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, label, q (array of floor(1024 * x)) of the rows whose vector is there, with finite components alone.

    Vectors shorter than the longest, or than a multiple of four, count as padded with zeros; components beyond bound()
    count as that bound, which is the largest whose squared distances fit into a long.
    """
    x = F.col(column)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.cast("array<double>").alias("x")).where(F.col("x").isNotNull())
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    longest = rows.agg(F.max(F.size("x"))).head()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    most = F.lit(float(bound(dims)))
    filled = F.concat("x", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))
    return rows.select("vec_id", "label", F.transform(filled, lambda v: F.floor(F.greatest(F.least(v * SCALE, most), -most))).alias("q"))


class Lloyd:
    """The rounds over a table of vectors (vec_id, label, q), each of which costs what has changed."""

    def __init__(self, rows: DataFrame):
        self.spark: SparkSession = rows.sparkSession
        self.tables = Buckets(self.spark)
        numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        self.vectors = self.tables.write(numbered, "vectors", "row", sort=True)
        first = numbered.orderBy(F.col("vec_id").asc_nulls_last(), "q", "row").select("q").limit(ENTRIES).collect()
        d = len(first[0].q) // PARTS if first else 0
        seeds = np.array([r.q for r in first], np.int64).reshape(len(first), PARTS, d)
        self.books = Codebooks(np.ascontiguousarray(seeds.transpose(1, 0, 2)))
        self.sums = self.spark.createDataFrame([], "slot long, value long")
        self.codes: str | None = None

    def assign(self) -> None:
        """Persists the assignments to the codebooks as they are, beside those of the round before."""
        vectors = self.spark.table(self.vectors).select("row", "q")
        if self.codes is None:
            both = vectors.withColumn("now", F.lit(None).cast("binary"))
        else:
            both = vectors.join(self.spark.table(self.codes).select("row", "now").hint("merge"), "row")
        entries = self.spark.sparkContext.broadcast(self.books.entries)
        new = both.mapInArrow(tidy(_assign(entries)), "row long, before binary, now binary, error long")
        old, self.codes = self.codes, self.tables.write(new, "codes", "row", sort=True, dealt=True)
        if old:
            self.tables.drop(old)

    def update(self) -> None:
        """Takes what has changed since the assignment before into the running sums, and moves the entries."""
        codes = self.spark.table(self.codes).select("row", "before", "now").where(F.col("before").isNull() | (F.col("before") != F.col("now")))
        vectors = self.spark.table(self.vectors).select("row", "q")
        moved = vectors.join(codes.hint("merge"), "row").mapInArrow(tidy(_moves(self.books.entries.shape)), "slot long, value long")
        self.sums = written(self.sums.unionByName(moved).groupBy("slot").agg(F.sum("value").alias("value")).where("value <> 0"), "sums")
        held = self.sums.toArrow()
        self.books.take(held.column("slot").to_numpy(), held.column("value").to_numpy())
        self.books = self.books.moved()

    def coded(self) -> DataFrame:
        """vec_id, label, now (the code), error, after the last assignment."""
        vectors = self.spark.table(self.vectors).select("row", "vec_id", "label")
        return vectors.join(self.spark.table(self.codes).select("row", "now", "error").hint("merge"), "row")


def compress(vectors: DataFrame, column: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, one row for each row of vectors (vec_id, label, `column`) whose
    vector has finite components alone.

    Rows are told apart by themselves: equal vec_ids are vectors of their own, and a null vec_id comes after all others
    where the first 256 are taken (ties go by components). With fewer vectors the codebooks have fewer entries. Null
    labels are one label. Vectors of other lengths are padded, see whole_numbers(). An empty table gives no row. Other
    columns are not read.
    """
    lloyd = Lloyd(whole_numbers(vectors, column))
    if lloyd.books.entries.shape[1]:
        for _ in range(rounds):
            lloyd.assign()
            lloyd.update()
        lloyd.assign()
        out = written(lloyd.coded().drop("row"), "coded")
    else:
        out = vectors.sparkSession.createDataFrame([], "vec_id long, label string, now binary, error long")
    lloyd.tables.close()
    by_label = written(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    out = join_groups(out, by_label, "label")
    return out.select("vec_id", F.lower(F.hex("now")).alias("code"), "error", "label_error", F.lit(lloyd.books.sha256()).alias("codebooks_sha256"))
