"""What the operators of this subpackage share: scratch and bucketed tables, table reads, the rule of words."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.sources.scratch import remove, scope, scratch_path, shared_dir, tidy_shuffles, written  # noqa: F401
from patchloom.sources.session import prepare

#: White space of the word and line rules: U+0020 and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
NON_WS = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a table of hashes that is broadcast: 8 MB, whatever it is made of.
TABLE_BITS = 1 << 26


def bit_table(hashes: DataFrame, column: str, bits: int = TABLE_BITS) -> np.ndarray:
    """A table of `bits` bits, with those of a column of hashes set, as 64-bit words; at most bits / 64 rows come to the
    driver. A hash that is not in the column may share the bit of one that is."""
    place = F.pmod(F.col(column), F.lit(bits))
    word = hashes.select(F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
    table = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def odd_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is null or repeated, so that it doesn't tell rows apart."""
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count() > 0


def word_count(text) -> F.Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"{NON_WS}+")), F.lit(0)).cast("long")


#: Keys that a join may take from a broadcast: those of which each has more than this share of all rows.
HOT_KEYS = 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """rows with the one row of groups that has their key (null is a key like others): an inner join.

    A key of more than 1/most of the rows is looked up in a broadcast, which so has fewer than `most` rows, whatever the
    input; all other rows are joined by a shuffle, where no key weighs more than that share. rows and groups are read
    more than once: give written tables.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows"))
    total = rows.count()
    hot = written(counts.where(F.col("_rows") * most > total).select(F.col(key).alias("_hot")), "hot-keys")
    small = F.broadcast(hot)
    others = [c for c in groups.columns if c != key]
    named = groups.withColumnRenamed(key, "_hot")
    known = named.join(small, named["_hot"].eqNullSafe(small["_hot"]), "left_semi")
    warm = rows.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_hot")))
    cold = rows.join(small, F.col(key).eqNullSafe(F.col("_hot")), "left_anti").join(named, F.col(key).eqNullSafe(F.col("_hot")))
    return warm.select(*rows.columns, *others).unionByName(cold.select(*rows.columns, *others))


class Buckets:
    """Tables dealt by key into files of their own, so that joins on the key shuffle the other side alone.

    Their files lie in the shared folder; their names stand in the session's catalog until drop() or close()."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = prepare(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def write(self, rows: DataFrame, name: str, *keys: str, sort: bool = False, dealt: bool = False) -> str:
        """Writes rows and gives the table's name. dealt: rows come bucket by bucket already, from tables of these keys."""
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        self.paths[table] = scratch_path(self.spark, table)
        writer = (rows if dealt else rows.repartition(self.buckets, *keys)).write.bucketBy(self.buckets, *keys)
        writer = writer.sortBy(*keys) if sort else writer
        with tidy_shuffles(self.spark):
            writer.option("path", self.paths[table]).option("compression", "zstd").saveAsTable(table)
        return table

    def drop(self, table: str, files: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.paths.pop(table)
        if files:
            remove(self.spark, path)

    def close(self, files: bool = True) -> None:
        for table in list(self.paths):
            self.drop(table, files)
