"""Runs that can be taken up again: what is pending, and a stream that appends each key once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patchloom.sources.keys import append_new


def pending(expected: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows whose key is not done."""
    return expected.join(done.select(key), key, "left_anti")


def unexpected(expected: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """Done keys that no row expects: a run of other data. There should be none."""
    return done.select(key).distinct().join(expected.select(key), key, "left_anti")


def stream_results(spark: SparkSession, source: str, schema, transform, target: str, checkpoint: str, key: str = "pair_id", files: int | None = None) -> StreamingQuery:
    """Files that arrive in `source` (JSON lines) go through `transform` and are appended to `target`, each key once,
    also when a batch is tried again. Ends when what is there is worked off. `files`: so many a batch at most.

    Each batch leaves a row in `<target>.progress`, see batch_progress(); a batch that is tried again replaces its row."""

    def put(batch: DataFrame, number: int) -> None:
        began, seen = time.monotonic(), Observation()
        retries = F.coalesce(F.sum("retries"), F.lit(0)) if "retries" in batch.columns else F.lit(0)
        watched = batch.observe(seen, F.count(F.lit(1)).alias("rows"), retries.cast("long").alias("retries"))
        done = append_new(transform(watched), target, key)
        row = (number, seen.get["rows"], done, seen.get["retries"], round(time.monotonic() - began, 3))
        spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").json(f"{target}.progress/batch-{number}")

    rows = spark.readStream.schema(schema)
    rows = rows.option("maxFilesPerTrigger", files).json(source) if files else rows.json(source)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROGRESS = "batch long, rows long, done long, retries long, seconds double"


def batch_progress(spark: SparkSession, target: str) -> DataFrame:
    """batch, rows (that arrived), done (appended), retries, seconds, rate (rows a second), total_done, of each batch of
    stream_results, from the rows that they left: one a batch."""
    rows = spark.read.schema(PROGRESS).json(f"{target}.progress/*")
    rate = F.when(F.col("seconds") > 0, F.round(F.col("rows") / F.col("seconds"), 3))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row a batch
    return rows.withColumn("rate", rate).withColumn("total_done", F.sum("done").over(before))


def progress(expected: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: rows expected and done, and the share."""
    both = expected.select(key).join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("total"), F.count("_d").alias("done")).withColumn("share", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0))
