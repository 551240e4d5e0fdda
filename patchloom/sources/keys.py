"""Tables that are appended to without repeats, beside an index of their keys that is read where it may matter alone.

The index is made of runs. A run is a folder of Parquet files, sorted by the hash of the key, each with at most
FILE_KEYS keys of a range of hashes of its own; its manifest tells the ranges, and each file has a Bloom filter
beside it. A batch of new rows looks up, for each hash, the files in whose range it lies, then their filters, and only the
files that may hold one of its keys are opened. So a call reads about as much however large the table is: a filter for
each of its hashes and run at most. `fanout` runs of one level are merged into one of the next, so that there are few.

An append is done once or not at all: rows are staged, then the run of their keys is written, then the staged files move
into the table. A call that finds staged files finishes the moves if the run is whole, and else removes them. One writer
at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.sources.scratch import remove, tidy_shuffles, written
from patchloom.sources.session import prepare

#: Keys in a file of a run at most, bits of a Bloom filter for each key, hash functions, and hashes in a row of a probe.
FILE_KEYS, BITS, PROBES, CHUNK = 200_000, 20, 14, 8192
RUN = "h long, key string"
_NAME = re.compile(r"l(\d+)-(\d+)-(\d+)$")


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (low + np.uint64(i) * high) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    """The filter of some hashes."""
    words = max(1, -(-BITS * len(hashes) // 64))
    out = np.zeros(words * 64, bool)
    for place in _places(hashes, words * 64):
        out[place] = True
    return np.packbits(out).tobytes()


def may_hold(filter: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: all that it was made of, and few others."""
    bits = np.unpackbits(np.frombuffer(filter, np.uint8)).astype(bool)
    found = np.ones(len(hashes), bool)
    for place in _places(hashes, len(bits)):
        found &= bits[place]
    return found


def _described(rows: pa.Table) -> pa.Table:
    h = rows.column("h").to_numpy()
    return pa.table({"file": rows.column("file").slice(0, 1), "lo": [int(h.min())], "hi": [int(h.max())], "n": [len(h)], "filter": [bloom(h)]})


def _aimed(runs):
    """The files in whose ranges hashes lie, one row for at most CHUNK of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch["h"].to_numpy())
            files, lists = [], []
            for lo, hi, names in runs.value:
                at = np.searchsorted(lo, h, "right") - 1
                inside = (at >= 0) & (h <= hi[np.maximum(at, 0)])
                for f in np.unique(at[inside]).tolist():
                    own = h[inside & (at == f)]
                    for a in range(0, len(own), CHUNK):
                        files.append(names[f])
                        lists.append(own[a : a + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["file", "hashes"])

    return run


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = [f for f, hs, bits in zip(batch["file"].to_pylist(), batch["hashes"], batch["filter"].to_pylist(), strict=True) if may_hold(bits, hs.values.to_numpy()).any()]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string())], names=["file"])


class KeyIndex:
    """The runs of keys in the folder `path`."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, file_keys: int = FILE_KEYS):
        self.spark, self.path, self.fanout, self.file_keys = prepare(spark), path.rstrip("/"), fanout, file_keys
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: What the last lookup read: filters, and files of keys.
        self.filters_read = self.files_read = 0
        found = self._below(self.path)
        whole = {tuple(map(int, m.groups())) for n in found if (m := _NAME.match(n)) and self._whole(n)}
        self.spans = sorted((s for s in whole if not any(t[0] > s[0] and t[1] <= s[1] and s[2] <= t[2] for t in whole)), key=lambda s: s[1])
        for name in found:
            if (m := _NAME.match(name)) and tuple(map(int, m.groups())) not in self.spans:
                remove(spark, f"{self.path}/{name}")

    def _below(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._at(path))) if self.fs.exists(self._at(path)) else []

    def _whole(self, name: str) -> bool:
        return self.fs.exists(self._at(f"{self.path}/{name}/manifest/_SUCCESS"))

    def root(self, span: tuple[int, int, int]) -> str:
        return f"{self.path}/l{span[0]}-{span[1]}-{span[2]}"

    def batches(self) -> int:
        return 1 + max((b for _, _, b in self.spans), default=-1)

    def _write(self, keys: DataFrame, n: int, root: str) -> None:
        """A run of keys (h, key): its sorted files, their filters, and the manifest, which makes it whole."""
        spark, files = self.spark, -(-n // self.file_keys)
        with tidy_shuffles(spark):
            rows = keys.repartitionByRange(max(1, files), "h").sortWithinPartitions("h")
            rows.write.option("compression", "zstd").option("maxRecordsPerFile", self.file_keys).parquet(f"{root}/keys")
            name = F.element_at(F.split(F.input_file_name(), "/"), -1)
            back = spark.read.schema(RUN).parquet(f"{root}/keys").select(name.alias("file"), "h")
            described = back.groupBy("file").applyInArrow(_described, "file string, lo long, hi long, n long, filter binary")
            described.write.partitionBy("file").parquet(f"{root}/filters")
        told = spark.read.schema("file string, lo long, hi long, n long").parquet(f"{root}/filters")
        told.coalesce(1).write.parquet(f"{root}/manifest")

    def add(self, keys: DataFrame, n: int) -> None:
        """Adds a batch of n keys (h, key) as a run, and merges runs where a level is full."""
        k = self.batches()
        self._write(keys, n, self.root((0, k, k)))
        self.spans.append((0, k, k))
        self._merge(0)

    def _merge(self, level: int) -> None:
        full = [s for s in self.spans if s[0] == level]
        if len(full) < self.fanout:
            return
        up = (level + 1, full[0][1], full[-1][2])
        rows = self.spark.read.schema(RUN).parquet(*[f"{self.root(s)}/keys" for s in full])
        self._write(rows, rows.count(), self.root(up))
        self.spans = sorted([*(s for s in self.spans if s[0] != level), up], key=lambda s: s[1])
        for s in full:
            remove(self.spark, self.root(s))
        self._merge(level + 1)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows (with h and key) whose key is in no run. rows are read twice: give written ones."""
        spark, runs, roots = self.spark, [], {}
        for span in self.spans:
            files = sorted(spark.read.schema("file string, lo long, hi long").parquet(f"{self.root(span)}/manifest").collect(), key=lambda r: r.lo)
            runs.append((np.array([r.lo for r in files]), np.array([r.hi for r in files]), [r.file for r in files]))
            roots |= {r.file: self.root(span) for r in files}
        self.filters_read = self.files_read = 0
        aimed = written(rows.select("h").mapInArrow(_aimed(spark.sparkContext.broadcast(runs)), "file string, hashes array<long>"), "aimed")
        near = [r.file for r in aimed.select("file").distinct().collect()]
        if not near:
            return rows
        filters = None
        for root in sorted({roots[f] for f in near}):
            some = spark.read.schema("file string, filter binary").option("basePath", f"{root}/filters").parquet(*[f"{root}/filters/file={f}" for f in near if roots[f] == root])
            filters = some if filters is None else filters.unionByName(some)
        hit = [r.file for r in aimed.join(filters, "file").mapInArrow(_tested, "file string").distinct().collect()]
        self.filters_read, self.files_read = len(near), len(hit)
        if not hit:
            return rows
        known = spark.read.schema(RUN).parquet(*[f"{roots[f]}/keys/{f}" for f in hit])
        return rows.join(known, (rows["h"] == known["h"]) & rows["key"].eqNullSafe(known["key"]), "left_anti")


def append_new(rows: DataFrame, path: str, key: str = "pair_id", index: KeyIndex | None = None) -> int:
    """Appends, as JSON lines, the rows whose key the table at `path` lacks, each key once; says how many. A null key is
    a key like others. Inputs are never changed. The index lies in `<path>.keys`."""
    spark, path = rows.sparkSession, path.rstrip("/")
    index = index or KeyIndex(spark, f"{path}.keys")
    fs, at = index.fs, index._at
    boxed = lambda df: df.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("key"), F.struct(*df.columns).alias("row"))

    def move(staged: str) -> None:
        fs.mkdirs(at(path))
        for name in index._below(staged):
            if name.startswith("part-") and not fs.rename(at(f"{staged}/{name}"), at(f"{path}/{name}")):
                raise OSError(f"cannot move {staged}/{name} to {path}")
        fs.delete(at(staged), True)

    for name in index._below(index.path):
        if name.startswith("staged-"):
            if int(name.removeprefix("staged-")) < index.batches():
                move(f"{index.path}/{name}")
            else:
                fs.delete(at(f"{index.path}/{name}"), True)
    if not index.spans and fs.exists(at(path)):  # a table without an index
        old = written(boxed(spark.read.schema(rows.schema).json(path)).select("h", "key").distinct(), "old-keys")
        index.add(old, old.count())

    fresh = written(boxed(rows).dropDuplicates(["h", "key"]), "fresh")
    left = written(index.unseen(fresh), "unseen")
    n = left.count()
    if n:
        staged = f"{index.path}/staged-{index.batches()}"
        left.select("row.*").write.option("ignoreNullFields", "false").json(staged)
        index.add(left.select("h", "key"), n)
        move(staged)
    return n
