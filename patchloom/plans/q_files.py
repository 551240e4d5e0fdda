"""Queries of the readers and writers: files are written from the test tables and read back."""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import tarfile
import tempfile
import uuid
import zipfile

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from patchloom.operators import reports
from patchloom.plans import fixtures as X
from patchloom.plans.registry import query
from patchloom.sources import keys, readers, sinks
from patchloom.sources.scratch import scratch_path, written

TURN = "conv_id long, turn long, role string, text string"


def _turns(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("jsonl_round_trip", "SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text END AS text, FALSE AS missing FROM conversations")
def jsonl_round_trip(spark, d):
    """Null keys are written and read; a strict read of the same lines gives the same; a file that is not there is empty."""
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(_turns(spark, d).withColumn("text", F.when(F.col("turn") % 2 == 0, F.col("text"))), path)
    same = readers.read_jsonl(spark, path, TURN).join(readers.read_jsonl_strict(spark, path, TURN), ["conv_id", "turn", "role"], "left_semi")
    return same.withColumn("missing", F.lit(False)).unionByName(readers.read_jsonl_or_empty(spark, f"{path}-none", TURN).withColumn("missing", F.lit(True)))


@query("catalog_file", f"WITH {X.CATALOG} SELECT id::BIGINT AS id, name, description, CASE WHEN description IS NULL THEN 2 ELSE 3 END AS keys FROM catalog")
def catalog_file(spark, d):
    """A catalog as JSON lines that leave null keys out, read back; and the keys that each line has."""
    path = scratch_path(spark, "catalog")
    sinks.write_jsonl(X.catalog(spark, d), path, keep_nulls=False)
    keys_of = spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.size(F.json_object_keys("value")).alias("keys"))
    return readers.read_catalog(spark, path).join(keys_of, "id")


@query("split_lines", """SELECT CASE n_nationkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split,
  row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_nationkey)::BIGINT AS line, n_nationkey::BIGINT AS id, n_name AS name FROM nation""")  # fmt: skip
def split_lines(spark, d):
    folder, nations = scratch_path(spark, "splits"), X.table(spark, d, "nation")
    for k, split in enumerate(("train", "dev", "test")):
        rows = nations.where(F.col("n_nationkey") % 3 == k).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
        sinks.write_single(rows.orderBy("id"), f"{folder}/{split}.jsonl")
    return readers.read_splits(spark, [f"{folder}/{s}.jsonl" for s in ("train", "dev", "test")], "id long, name string")


@query("numbered_lines", "SELECT o_orderstatus AS split, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS line, o_orderkey::VARCHAR AS value FROM orders")
def numbered_lines(spark, d):
    """A file for each status, read in splits of a few kilobytes and numbered all the same."""
    path, usual = scratch_path(spark, "lines"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    orders = X.table(spark, d, "orders").repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    orders.select("o_orderstatus", F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("o_orderstatus").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = written(readers.numbered_lines(spark, [f"{path}/*/*.txt"]), "numbered")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    return lines.select(F.regexp_extract("path", "o_orderstatus=([^/]+)", 1).alias("split"), "line", "value")


@query("atomic_rewrite", "SELECT r_regionkey, upper(r_name) AS name FROM region")
def atomic_rewrite(spark, d):
    """The second write takes the place of the first."""
    path, rows = scratch_path(spark, "atomic"), X.table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("name"))
    sinks.write_atomic(rows, path)
    sinks.write_atomic(rows.withColumn("name", F.upper("name")), path)
    return spark.read.schema("r_regionkey int, name string").json(path)


@query("appended_once", "SELECT s_suppkey, s_name FROM supplier")
def appended_once(spark, d):
    """Three appends that overlap, the last one whole: every key is there once, with its first row."""
    path, rows = scratch_path(spark, "appended"), X.table(spark, d, "supplier").select("s_suppkey", "s_name")
    for part in (rows.where("s_suppkey % 3 = 0"), rows.where("s_suppkey % 2 = 0").unionByName(rows.where("s_suppkey % 4 = 0")), rows):
        keys.append_new(part, path, "s_suppkey")
    return spark.read.schema(rows.schema).json(path)


@query("tagged_outputs", "SELECT p_partkey, p_size % 3 = 0 AS kept FROM part")
def tagged_outputs(spark, d):
    path = scratch_path(spark, "tagged")
    sinks.write_tagged(X.table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3 == 0).alias("kept")), path, "kept")
    return spark.read.schema("p_partkey long, kept boolean").json(path)


@query("four_outputs", """WITH scored AS (SELECT p_partkey, CASE WHEN p_size > 30 THEN 'high' ELSE 'low' END AS quality_tier, p_size % 4 = 0 AS needs_review FROM part)
SELECT 'scored' AS output, quality_tier, count(*)::BIGINT AS n FROM scored GROUP BY 2 UNION ALL SELECT 'selected', quality_tier, count(*)::BIGINT FROM scored WHERE quality_tier = 'high' GROUP BY 2
UNION ALL SELECT 'review', quality_tier, count(*)::BIGINT FROM scored WHERE needs_review GROUP BY 2 UNION ALL SELECT 'rejected', NULL, count(*)::BIGINT FROM supplier""")  # fmt: skip
def four_outputs(spark, d):
    """The summary; the folders hold the rows that it counts."""
    scored = X.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 30, "high").otherwise("low").alias("quality_tier"), (F.col("p_size") % 4 == 0).alias("needs_review"))
    path = scratch_path(spark, "four")
    summary = sinks.write_four(scored, scored.where("quality_tier = 'high'"), X.table(spark, d, "supplier").select("s_suppkey"), path)
    back = None
    for name in ("scored", "selected", "review"):
        rows = spark.read.schema("quality_tier string").json(f"{path}/{name}").groupBy(F.lit(name).alias("output"), "quality_tier").count()
        back = rows if back is None else back.unionByName(rows)
    none = spark.read.schema("s_suppkey long").json(f"{path}/rejected").agg(F.lit("rejected").alias("output"), F.lit(None).cast("string").alias("quality_tier"), F.count("*").alias("count"))
    back = back.unionByName(none).withColumnRenamed("count", "n")
    return summary.intersect(back)


@query("csv_cells", "SELECT n_nationkey, n_name || ' x' AS name FROM nation")
def csv_cells(spark, d):
    """A CSV with a byte order mark and a TSV, whose tabs and line ends became blanks; both read back."""
    path, rows = scratch_path(spark, "csv"), X.table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\t"), F.lit("x")).alias("name"))
    sinks.write_csv(rows, f"{path}/csv", bom=True)
    sinks.write_tsv(rows, f"{path}/tsv")
    one = spark.read.csv(f"{path}/csv", header=True)
    two = spark.read.csv(f"{path}/tsv", header=True, sep="\t")
    return one.toDF("n_nationkey", "name").intersect(two).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "name")


@query("markdown_report", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def markdown_report(spark, d):
    path = scratch_path(spark, "markdown")
    sinks.markdown_lines(X.table(spark, d, "region").select("r_regionkey", "r_name"), path, ["r_regionkey"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("code_pairs", "SELECT item_id, text AS buggy_code, text AS fixed_code FROM benchmark")
def code_pairs(spark, d):
    """Code files in folders, read with their paths, and joined to pairs that name them."""
    path = scratch_path(spark, "code")
    items = X.table(spark, d, "benchmark")
    items.select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    code = readers.read_code(spark, path, "*.txt").select(F.concat(F.lit("f"), F.regexp_extract("path", r"item_id=(\d+)", 1)).alias("path"), F.regexp_replace("text", r"\n\z", "").alias("text"))
    named = F.concat(F.lit("f"), F.col("item_id"))
    return readers.load_pairs(items.select("item_id", named.alias("buggy_path"), named.alias("fixed_path")), code).select("item_id", "buggy_code", "fixed_code")


def _zip(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def _archive(nations: list[tuple[int, str]]) -> bytes:
    """A tar with a problem for each nation: zips, settings, and for every fifth one a second branch."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for key, name in nations:
            branches = ["main", "old"] if key % 5 == 0 else ["main"]
            for branch in branches:
                at = f"{branch}/problem/P{key}/testcase/case{key}"
                files = {"deep/tb.v": b"module tb;", "standard.txt": f"{name}\r\n".encode()}
                if key % 4 == 1:
                    files["argv.txt"] = b'{"universal": {"timeout": 7, "output_regex": "a+"}}'
                if key % 7 == 2:
                    del files["deep/tb.v"]
                members = {f"{at}/attachment/c.zip": _zip(files), f"{at}/testcase.yaml": b"judge_parameter:\n  universal:\n    timeout: 5\n    simulating_time: '10us'\n    top_module: tb\n", f"{branch}/problem/P{key}/description.md": name.encode()}
                for member, data in members.items():
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _archives(spark, d):
    """Archives with the problems of a region each, as files: Spark writes their bytes as a text of one line."""
    rows = X.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))

    @F.pandas_udf("binary")
    def make(ns: pd.Series) -> pd.Series:
        return pd.Series([_archive([(x["n_nationkey"], x["n_name"]) for x in one]) for one in ns])

    path = scratch_path(spark, "archives")
    rows.select("n_regionkey", make("ns").cast("string").alias("value")).write.partitionBy("n_regionkey").text(path)
    return [f"{path}/*/*.txt"]


@query("archive_cases", """SELECT 'main' AS branch, 'P' || n_nationkey AS directory, 'case' || n_nationkey AS name, n_name || chr(10) AS standard, CASE WHEN n_nationkey % 4 = 1 THEN 'a+' END AS output_regex,
  CASE WHEN n_nationkey % 4 = 1 THEN 7 ELSE 5 END::INT AS timeout, CASE WHEN n_nationkey % 4 = 1 THEN '1000ns' ELSE '10us' END AS simulating_time
FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 2 AND n_nationkey < 20""")  # fmt: skip
def archive_cases(spark, d):
    members = readers.read_tar(spark, _archives(spark, d), r"(\.zip|testcase\.yaml)$")
    wanted = X.table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("P"), F.col("n_nationkey")).alias("directory"))
    return readers.problem_testcases(members, wanted).select("branch", "directory", "name", "standard", "output_regex", "timeout", "simulating_time")


@query("prepared_cases", """SELECT n_nationkey::BIGINT AS problem_id, 'P' || n_nationkey AS name, 'case' || n_nationkey AS "case", 'P' || n_nationkey || '/testcase/case' || n_nationkey || '/attachment' AS directory,
  'standard.txt' AS standard, CASE WHEN n_nationkey % 7 = 2 THEN 'more.v' WHEN n_nationkey = 3 THEN 'deep/tb.v,more.v' ELSE 'deep/tb.v' END AS sources, 5::INT AS timeout, '10us' AS simulating_time, 'tb' AS top_module FROM nation""")  # fmt: skip
def prepared_cases(spark, d):
    """The files of archives and generated ones, laid out, and the manifest of their testcases."""
    names = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("P"), F.col("n_nationkey")).alias("name"))
    key = F.col("id")
    lacking = names.where((key == 3) | (key % 7 == 2)).select(F.concat(F.lit("P"), key, F.lit("/testcase/case"), key, F.lit("/attachment/more.v")).alias("path"))
    made = lacking.unionByName(spark.createDataFrame([("P99/x.v",)], "path string")).withColumn("content", F.encode(F.lit("module more;"), "UTF-8"))
    files = readers.materialise(readers.read_tar(spark, _archives(spark, d)), made, names)
    return readers.manifest(files, names).withColumn("sources", F.array_join("sources", ",")).drop("output_regex")


@query("local_cases", "SELECT n_nationkey::BIGINT AS problem_id, 'root/problem ' || n_nationkey || '/c.zip' AS path FROM nation WHERE n_nationkey IN (SELECT item_id FROM benchmark)")
def local_cases(spark, d):
    cases = X.table(spark, d, "nation").select(F.concat(F.lit("root/problem "), F.col("n_nationkey"), F.lit("/c.zip")).alias("path"))
    return readers.local_cases(cases, X.catalog(spark, d)).select("problem_id", "path")


@query("file_marks", "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS mark, 1::BIGINT AS n FROM region")
def file_marks(spark, d):
    path = scratch_path(spark, "model")
    X.table(spark, d, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.option("lineSep", "\n").text(path)
    marks = readers.fingerprint(spark, path).where(F.col("path").contains("/part-") & F.col("path").endswith(".txt"))
    return marks.groupBy("mark").agg(F.count("*").alias("n"))


@query("reloaded_generations", "SELECT s_suppkey AS pair_id, s_name AS code, 'AC' AS source FROM supplier UNION ALL SELECT s_suppkey, s_name, 'kept' FROM supplier WHERE s_suppkey % 2 = 0")
def reloaded_generations(spark, d):
    """Rows of a generation file that is there, and rows derived from results where it is not."""
    path, rows = scratch_path(spark, "generations"), X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pair_id"), F.col("s_name").alias("code"))
    sinks.write_jsonl(rows.where("pair_id % 2 = 0"), f"{path}/generations")
    sinks.write_jsonl(rows.withColumn("test_result", F.struct(F.lit("AC").alias("status"))), f"{path}/results")
    kind = "pair_id long, code string"
    kept = readers.generations(spark, f"{path}/generations", f"{path}/results", kind).withColumn("source", F.lit("kept"))
    return kept.unionByName(readers.generations(spark, f"{path}/none", f"{path}/results", kind).withColumn("source", F.lit("AC")))


#: Types of columns that a shipped database can have.
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR(32672)"}


def shipped_database(spark, rows, table: str) -> str:
    """The URL of a database with one table that driver and executors can all open.

    An embedded database in memory, or in a folder that one process has open, is no other process's. So it is written
    here, by the driver, row by row (for tables of a few rows alone), closed, and added to the session as an archive,
    which Spark brings to every executor and Derby reads, side by side, from the class path."""
    folder, name, jvm = tempfile.mkdtemp(prefix="patchloom-"), f"d{uuid.uuid4().hex[:12]}", spark.sparkContext._jvm
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{folder}/{name};create=true")
    columns = ", ".join(f'"{c}" {KINDS[kind]}' for c, kind in rows.dtypes)
    connection.createStatement().execute(f"CREATE TABLE {table} ({columns})")
    put = connection.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows.columns))})")
    for row in rows.toLocalIterator():
        for i, value in enumerate(row, 1):
            put.setObject(i, value)
        put.executeUpdate()
    connection.close()
    with contextlib.suppress(Py4JJavaError):  # a shutdown that succeeds is told by an exception
        jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{folder}/{name};shutdown=true")
    spark.sql(f"ADD JAR '{shutil.make_archive(f'{folder}/{name}', 'zip', folder, name)}'")
    return f"jdbc:derby:classpath:{name}"


@query("database_rows", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def database_rows(spark, d):
    """A table of an embedded database, which Spark ships, read by four tasks side by side, with values bound to a column."""
    url = shipped_database(spark, X.table(spark, d, "nation"), "nation")
    return readers.read_database(spark, url, "nation", ["n_nationkey", "n_name"], {"n_regionkey": [1, 3]}, partitionColumn="n_nationkey", lowerBound=0, upperBound=25, numPartitions=4)


@query("changed_pairs", """WITH u AS (SELECT p_partkey, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b FROM part)
SELECT p_partkey AS pair_id, CASE WHEN b THEN 'improved' ELSE 'regressed' END AS change FROM u WHERE a <> b""")  # fmt: skip
def changed_pairs(spark, d):
    run = lambda k: X.table(spark, d, "part").select(F.col("p_partkey").alias("pair_id"), (F.col("p_size") % k == 0).alias("passed"))
    return reports.flips(run(2), run(3))


@query("elapsed", "SELECT event_id, round((epoch_us(ts) - epoch_us(ts - INTERVAL 1500 MILLISECOND)) / 1e6, 1)::DOUBLE AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def elapsed(spark, d):
    rows = X.table(spark, d, "events").withColumn("before", F.expr("ts - INTERVAL 1.5 SECOND"))
    return sinks.as_cells(rows.select("event_id", sinks.elapsed_seconds("before", "ts").alias("seconds"), F.col("ts").alias("at")))
