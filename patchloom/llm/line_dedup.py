"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run holds (h1, h2, n): two 64-bit hashes of a line's key and the number of documents of its batches that have it,
dealt by hash into buckets and sorted there. A new batch is counted, merge-anti-joins the keys that the runs already
know to be common (their count says nothing new), and adds what is left as a run of level 0. When a level holds
`fanout` runs they are merged into one run of the next level, so a table of n batches is kept in about
fanout * log(n) runs and every key is rewritten log(n) times. Runs are bucketed tables: the anti-join and the merges
shuffle the batch alone, never the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import Buckets, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. lower() does that to ASCII, where it is quicker."""
    ascii_only = F.octet_length(line) == F.length(line)
    low = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.trim(low, F.lit(BLANKS))


def key_hashes(key: Column) -> list[Column]:
    """128 bits, so that two keys of one corpus don't meet by chance."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x9E3779B9), key).alias("h2")]


class LineRuns:
    """The levels of sorted runs. `buckets` is the number of pieces of a run: raise it with the corpus."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.tables = Buckets(spark, buckets)
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def _write(self, counted: DataFrame) -> str:
        return self.tables.write(counted, "line_run", "h1", "h2", sort=True)

    def close(self) -> None:
        """Deletes the runs: what has been read from them must be written by then."""
        self.tables.close()
        self.levels = []

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2), each key once a document of the batch."""
        fresh = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.where(F.col("n") >= self.min_docs).select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._push(0, self._write(fresh))

    def _push(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged([self.spark.table(run) for run in full]))
            for run in full:
                self.tables.drop(run)
            self._push(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """(h1, h2) of the keys found in at least min_docs documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(self.runs()).where(F.col("n") >= self.min_docs).select("h1", "h2")


def dedup_lines(documents: DataFrame, min_docs: int = 10, min_key_chars: int = 1, batches: int = 3, fanout: int = 3) -> DataFrame:
    """doc_id, kept (array of lines), n_lines, n_dropped: one row for each row of documents (doc_id, text).

    Lines end at \\n; a null or empty text is one empty line. Keys of at least min_key_chars code points found in at
    least min_docs documents lose all their lines. Every row is a document: repeated rows count, and rows that share
    a doc_id with other texts are held apart by their text. A null doc_id is a document like others. An empty table
    gives no row. Only the two named columns are read.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    keys = F.array_distinct(F.transform(split_lines(F.col("text")), line_key))
    runs = LineRuns(spark, min_docs, fanout)
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))
    for k in range(batches):
        found = docs.where(batch == k).select(F.explode(keys).alias("key")).where(F.length("key") >= min_key_chars)
        runs.add(found.select(*key_hashes(F.col("key"))))
    common = written(runs.common(), "line-common")
    runs.close()

    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    hashed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_key_chars).select("doc_id", "t", "pos", *key_hashes(F.col("key")))
    # Spark broadcasts `common` only while its files are below spark.sql.autoBroadcastJoinThreshold
    hit = hashed.join(common, ["h1", "h2"], "left_semi")
    drops = hit.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("drop")).select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "drop")
    both = docs.withColumn("t", F.xxhash64("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left")
    both = both.withColumn("lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("lines").cast("long"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.get("lines", i)))
    return both.select("doc_id", kept.alias("kept"), "n_lines", F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))
