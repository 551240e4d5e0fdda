"""The session: settings that this library wants, and what Python workers need to find it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings of Arrow batches: Spark's own values, and those that keep a worker small however long its texts are.
BATCHES = (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),)
#: Spark 4.1 takes a union of columnar scans of bucketed tables for dealt by bucket, yet runs its children one after
#: another: an aggregate over it would meet a key in several partitions. Off, such a union is dealt anew.
UNION = "spark.sql.unionOutputPartitioning"
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library where they see the same folder (else ship it with --py-files), bounds
    the batches that they are sent, by bytes, unless the session has bounds of its own, and has unions dealt anew."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH", "")]))
    if spark.conf.get(UNION, "true") != "false":
        spark.conf.set(UNION, "false")
    for key, usual, wanted in BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, wanted)
    return spark
