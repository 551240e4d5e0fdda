"""Exact dedup against a persistent index of digests (DataFrame functions only).

The index holds one row for each text that it has seen: (digest, top, n), the SHA-256 of the text, the row that stays
and the number of its rows. It lies in a folder as segments, dealt by digest into buckets and sorted there. A batch is
hashed once, counted by digest (partial counts go before the shuffle, so a text that half of the rows share costs one row
a task) and written in the same buckets; then a sort-merge anti-join against the segments gives the texts that are new,
and they are appended as a segment. Texts that the index knows already are appended as sightings, of the same form: they
can move the row that stays and add to the count. Neither join shuffles the index, nor the batch a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import join_groups, scratch_path, written
from patchloom.sources.segments import Segments, union

SCHEMA = "digest BINARY, top STRUCT<doc_id: BIGINT, batch: BIGINT, row: BIGINT>, n BIGINT"


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"))


class DigestIndex(Segments):
    """An index in the folder `path`, taken up where it stands."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 4):
        super().__init__(spark, path, SCHEMA, ["digest"], _merged, ("fresh", "again"), buckets, fanout)

    def add(self, hashed: DataFrame) -> int:
        """Adds a batch of rows (digest, doc_id, row), where row tells the batch's rows apart, and gives its number."""
        k = self.batches()
        top = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.lit(k).cast("long").alias("batch"), F.col("row").cast("long").alias("row"))
        batch, path = self.dealt(hashed.groupBy("digest").agg(F.max(top).alias("top"), F.count("*").alias("n")))
        new = batch
        for known in self.segments("fresh"):  # a text is new in one segment alone
            new = new.join(known.select("digest").hint("merge"), "digest", "left_anti")
        appended = self.write(new, self.next("fresh"), dealt=True)
        again = batch.join(appended.select("digest").hint("merge"), "digest", "left_anti")
        self.write(again, self.next("again"), dealt=True)
        self.drop(path)
        self.commit()
        return k

    def fresh(self, batch: int) -> DataFrame:
        """digest, top, n of the texts that a batch brought, while it has a segment of its own."""
        return self.table(f"{self.root}/{self.name((0, batch, batch), 'fresh')}")

    def groups(self) -> DataFrame:
        """digest, top, n of every text that the index has seen."""
        segments = self.segments()
        return _merged(union(segments)) if segments else self.spark.createDataFrame([], SCHEMA)


def dedup(documents: DataFrame, path: str | None = None, batches: int = 2, buckets: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each row of documents (doc_id, text).

    Texts are equal when their bytes are; a null text is an empty one. Of equal texts the row of the largest doc_id
    stays; a null doc_id is less than any, and of rows of one doc_id one stays (of a group of null ids alone too: then
    keep_id is null). The rows come in `batches` batches to the index in `path`, which is taken up where it stands:
    texts that it knows count with it, and rows of earlier calls then stand behind a later one of a larger id. Without a
    path the index is a scratch one. An empty table gives no row. Only the two named columns are read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    index = DigestIndex(spark, path or scratch_path(spark, "digest-index"), buckets)
    dealt = F.pmod(F.xxhash64("row"), F.lit(batches))
    numbers = [index.add(rows.where(dealt == k)) for k in range(batches)]
    groups = written(index.groups(), "digest-groups")
    index.close()
    batch = F.lit(numbers[0]).cast("long") + dealt
    out = join_groups(rows.withColumn("batch", batch), groups, "digest")
    same = (F.col("top.batch") == F.col("batch")) & (F.col("top.row") == F.col("row"))
    return out.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), "digest")
