"""Tables that grow by batches and are looked up by key: sorted segments, dealt by key into buckets, merged by levels.

Such a table is a folder of segments. Each batch adds one (for each kind of rows it has): its rows are dealt by key into
as many buckets as all others and sorted there, so a lookup shuffles what is looked up, never what the table holds.
Segments of one level are merged, once there are `fanout` of them, into one of the next level: a row is rewritten about
log(batches) times, and a lookup meets few segments. A batch counts when the segments of all its kinds are whole; what a
lost driver left behind, and what has been merged, is removed when the folder is opened again. One writer at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.sources.scratch import remove, scratch_path, tidy_shuffles
from patchloom.sources.session import prepare

_NAME = re.compile(r"l(\d+)-(\d+)-(\d+)-(\w+)$")


def union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every


class Segments:
    """The segments in the folder `path`. `buckets` holds from the first batch on: choose it for what is to come.

    merged makes one row a key of the rows of several segments of one kind."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], merged: Callable[[DataFrame], DataFrame],
        kinds: tuple[str, ...] = ("rows",), buckets: int | None = None, fanout: int = 4,
    ):
        self.spark, self.path, self.schema, self.keys, self.merged = prepare(spark), path.rstrip("/"), schema, keys, merged
        self.kinds, self.fanout = kinds, fanout
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._open: dict[str, str] = {}
        self.spans: list[tuple[int, int, int]] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._recover()

    def _below(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(path))) if self._fs.exists(self._at(path)) else []

    def _recover(self) -> None:
        """Takes over the folder's number of buckets, and removes what isn't whole or has been merged."""
        for name in self._below(self.path):
            if not name.startswith("buckets-"):
                raise ValueError(f"{self.path} holds something else than segments")
            self.buckets = int(name.removeprefix("buckets-"))
        self.root = f"{self.path}/buckets-{self.buckets}"
        found = self._below(self.root)
        whole = {n for n in found if self._fs.exists(self._at(f"{self.root}/{n}/_SUCCESS"))}
        spans = {tuple(map(int, m.groups()[:3])) for n in whole if (m := _NAME.match(n))}
        spans = {s for s in spans if {self.name(s, kind) for kind in self.kinds} <= whole}
        live = {s for s in spans if not any(t[0] > s[0] and t[1] <= s[1] and s[2] <= t[2] for t in spans)}
        keep = {self.name(s, kind) for s in live for kind in self.kinds}
        for name in found:
            if name not in keep:
                remove(self.spark, f"{self.root}/{name}")
        self.spans = sorted(live, key=lambda s: s[1])

    @staticmethod
    def name(span: tuple[int, int, int], kind: str) -> str:
        return f"l{span[0]}-{span[1]}-{span[2]}-{kind}"

    def batches(self) -> int:
        """The number of batches so far, which is the next one's."""
        return 1 + max((b for _, _, b in self.spans), default=-1)

    def table(self, path: str, schema: str | None = None) -> DataFrame:
        """The bucketed table in a folder, which gets a name in this session's catalog. schema: if it isn't the segments'."""
        if path not in self._open:
            name = f"segment_{uuid.uuid4().hex}"
            keys = ", ".join(self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({schema or self.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self._open[path] = name
        return self.spark.table(self._open[path])

    def write(self, rows: DataFrame, path: str, dealt: bool = False) -> DataFrame:
        """Writes rows as a bucketed table. dealt: they come bucket by bucket already, from such tables."""
        rows, name = rows if dealt else rows.repartition(self.buckets, *self.keys), f"segment_{uuid.uuid4().hex}"
        with tidy_shuffles(self.spark):
            rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).option("compression", "zstd").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return self.table(path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    def dealt(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """rows as a scratch table in the same buckets, and its path, which drop() takes."""
        path = scratch_path(self.spark, "dealt")
        return self.write(rows, path), path

    def drop(self, path: str) -> None:
        if path in self._open:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._open.pop(path)}")
        remove(self.spark, path)

    def next(self, kind: str) -> str:
        """The path of the next batch's segment of a kind. Once all kinds are written, commit() makes them count."""
        k = self.batches()
        return f"{self.root}/{self.name((0, k, k), kind)}"

    def commit(self) -> None:
        k = self.batches()
        self.spans.append((0, k, k))
        self._merge(0)

    def _merge(self, level: int) -> None:
        full = [s for s in self.spans if s[0] == level]
        if len(full) < self.fanout:
            return
        up = (level + 1, full[0][1], full[-1][2])
        for kind in self.kinds:
            parts = [self.table(f"{self.root}/{self.name(s, kind)}") for s in full]
            self.write(self.merged(union(parts)), f"{self.root}/{self.name(up, kind)}")
        self.spans = sorted([*(s for s in self.spans if s[0] != level), up], key=lambda s: s[1])
        for s in full:
            for kind in self.kinds:
                self.drop(f"{self.root}/{self.name(s, kind)}")
        self._merge(level + 1)

    def segments(self, *kinds: str) -> list[DataFrame]:
        """The segments of some kinds, the newest last."""
        return [self.table(f"{self.root}/{self.name(s, kind)}") for s in self.spans for kind in kinds or self.kinds]

    def close(self) -> None:
        """Takes the segments' names out of the catalog; their files stay."""
        for name in self._open.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._open = {}
