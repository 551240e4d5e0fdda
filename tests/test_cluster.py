"""Queries on executors that share no memory and no folder with the driver but spark.checkpoint.dir."""

import json
import os
import subprocess
import sys

ROWS = """
import json, sys
from pyspark.sql import SparkSession
from patchloom.plans import queries, registry

conf = {"spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.executor.memory": "600m", "spark.checkpoint.dir": "file://" + sys.argv[3]}
spark = SparkSession.builder.master("local-cluster[2,1,1000]").config(map=conf).getOrCreate()
rows = registry.QUERIES[sys.argv[1]](spark, sys.argv[2]).collect()
print("ROWS", json.dumps(sorted(map(tuple, rows))))
spark.stop()
"""


def test_a_database_is_read_by_other_processes(spark, sf, tmp_path):
    out = subprocess.run([sys.executable, "-c", ROWS, "database_rows", sf, str(tmp_path / "shared")], cwd=tmp_path, capture_output=True, text=True, timeout=300, env=os.environ)
    got = [json.loads(line.split("ROWS ", 1)[1]) for line in out.stdout.splitlines() if "ROWS " in line]
    want = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey in (1, 3)").select("n_nationkey", "n_name").collect()
    assert got and got[0] == sorted(map(list, want)), out.stderr[-2000:]
