"""Readers: JSON lines, code files, archives, testcases, databases, model folders."""

from __future__ import annotations

import io
import itertools
import re
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from patchloom.functions.python_text import decode, decode_text, parse_config
from patchloom.sources.scratch import written

MEMBERS = "archive string, member string, content binary"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one fails. The schema is declared: an inferred one would
    lose optional keys that a sample lacks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As read_jsonl, but a blank line fails, in the same pass."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    line = F.when(F.trim("value") == "", F.raise_error(F.lit(f"a blank line in {path}"))).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(line, kind, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As read_jsonl; without the file, no rows."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line (from 1) and value of every line of text files, which are read in splits, by as many tasks.

    Lines end at \\n; a \\r before it is no part of them. Each split tells how many lines it has; the sums of those
    before it in its file, a table of one row a split, give its first line's number. A line's place in its split is its
    distance from the split's first row, as a task reads a split from its beginning."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_row"))
    splits = rows.groupBy("path", "_from").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_from")) - F.col("_n")
    splits = written(splits.withColumn("_before", before), "splits")
    line = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return rows.join(splits, ["path", "_from"]).select("path", line.alias("line"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def read_splits(spark: SparkSession, paths: list[str], schema: StructType | str) -> DataFrame:
    """Rows of several files of JSON lines with split (the file's stem) and line (its number in the file, from 1). Blank
    lines are counted and skipped; files are read in splits, however large they are."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("split")
    lines = numbered_lines(spark, paths).where(F.trim("value") != "")
    return lines.select(stem, "line", F.from_json("value", kind, {"mode": "FAILFAST"}).alias("x")).select("split", "line", "x.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, "id long, name string, description string")


def read_code(spark: SparkSession, folder: str, pattern: str = "*.v") -> DataFrame:
    """path (below the folder), text and encoding of code files, in all folders below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    stem = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    rest = F.substring_index(F.col("path"), f"{stem}/", -1)
    return files.select(rest.alias("path"), decode("content").alias("d")).select("path", "d.text", "d.encoding")


def load_pairs(pairs: DataFrame, code: DataFrame, strict: bool = True) -> DataFrame:
    """pairs (buggy_path, fixed_path) with the texts of both; strict: a path without a file fails the query, else the
    pair is left out."""
    for side in ("buggy", "fixed"):
        text = code.select(F.col("path").alias(f"{side}_path"), F.col("text").alias(f"{side}_code"))
        pairs = pairs.join(text, f"{side}_path", "left" if strict else "inner")
        if strict:
            lost = F.raise_error(F.concat(F.lit("no such file: "), F.col(f"{side}_path")))
            pairs = pairs.withColumn(f"{side}_code", F.coalesce(f"{side}_code", lost))
    return pairs


def read_database(spark: SparkSession, url: str, table: str, columns: list[str], where: dict[str, list] | None = None, **options) -> DataFrame:
    """A table over JDBC, its columns pruned. `where` binds values to columns, whose names it must have (a row needs one
    of the values of each); these filters, and those on the result, are pushed to the database. Give partitionColumn,
    lowerBound, upperBound and numPartitions to read side by side."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    for column, values in (where or {}).items():
        rows = rows.where(F.col(f"`{column}`").isin(list(values)))
    return rows.select(*columns)


def _inside(name: str) -> bool:
    """No absolute name, and none that leaves its folder."""
    path = PurePosixPath(name)
    return not path.is_absolute() and ".." not in path.parts


def tar_members(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """As read_tar, of archives that rows hold: path, content (binaryFile). An archive is as large as its row may be."""
    matches = re.compile(wanted).search if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    names = [m for m in tar if m.isfile() and _inside(m.name) and (matches is None or matches(m.name))]
                    for member in names:
                        yield _member_rows([(path, member.name, tar.extractfile(member).read())])

    return files.select("path", "content").mapInArrow(run, MEMBERS)


class _Stream(io.RawIOBase):
    """Bytes of one archive, pulled piece by piece; skipping what is left of it is reading on."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = piece
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def read_tar(spark: SparkSession, paths: list[str], wanted: str | None = None) -> DataFrame:
    """archive, member, content of the files in tar archives, compressed or not; wanted is a regular expression that
    member names must match, tried before a member is read.

    Spark's text reader streams the archives, so they may lie wherever Spark can read and be of any size: no archive is
    held in a row or in memory, only the members of a batch of about 8 MB. What goes on in order of its bytes has to be
    read in order, so an archive is one task's work; the archives of many paths are dealt over tasks."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))
    # a large file that is not compressed comes in splits, which meet again in order
    whole = raw.repartition("path").sortWithinPartitions("path", "at", "row").select("path", "value")
    matches = re.compile(wanted).search if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((p, v) for batch in batches for p, v in zip(batch["path"].to_pylist(), batch["value"].to_pylist(), strict=True))
        rows, size = [], 0
        for path, own in itertools.groupby(lines, lambda x: x[0]):
            pieces = (v + b"\n" for _, v in own)
            with tarfile.open(fileobj=io.BufferedReader(_Stream(pieces), 1 << 16), mode="r|*") as tar:
                for member in tar:
                    if member.isfile() and _inside(member.name) and (matches is None or matches(member.name)):
                        rows.append((path, member.name, tar.extractfile(member).read()))
                        size += member.size
                        if size > 8 << 20:
                            yield _member_rows(rows)
                            rows, size = [], 0
        yield _member_rows(rows)

    return whole.mapInArrow(run, MEMBERS)


def _member_rows(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    kinds = {"archive": pa.string(), "member": pa.string(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


CASES = "archive string, member string, name string, files map<string,binary>, standard string, output_regex string, timeout int, simulating_time string"


def zip_testcases(members: DataFrame) -> DataFrame:
    """A testcase for each zip among members (archive, member, content): its files by base name, the expected output
    (standard.txt) and settings, from the zip's argv.txt or else from testcase.yaml beside the zip's folder. files and
    standard are null where a zip has no standard.txt or no source."""
    folder = lambda up: F.regexp_replace("member", r"(/[^/]*){%d}$" % up, "")
    zips = members.where(F.lower("member").endswith(".zip")).withColumn("folder", folder(2))
    yaml = members.where(F.element_at(F.split("member", "/"), -1) == "testcase.yaml").select(F.col("archive").alias("a"), folder(1).alias("f"), F.col("content").alias("yaml"))
    both = zips.join(yaml, (F.col("archive") == F.col("a")) & (F.col("folder") == F.col("f")), "left").select("archive", "member", "folder", "content", "yaml")

    def run(frames):
        for frame in frames:
            out = []
            for archive, member, folder, content, yaml in zip(frame.archive, frame.member, frame.folder, frame.content, frame.yaml, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    files = {PurePosixPath(i.filename).name: z.read(i) for i in z.infolist() if not i.is_dir() and _inside(i.filename)}
                named = lambda name: next((v for k, v in files.items() if k.lower() == name), None)  # noqa: E731, B023
                standard, argv = named("standard.txt"), named("argv.txt")
                whole = standard is not None and any(PurePosixPath(k).suffix.lower() in (".v", ".sv") for k in files)
                text = decode_text(standard).replace("\r\n", "\n").replace("\r", "\n") if whole else None
                config = parse_config(decode_text(argv) if argv is not None else None, decode_text(yaml) if yaml is not None else None)
                out.append((archive, member, PurePosixPath(folder).name, files if whole else None, text, config["output_regex"], config["timeout"], config["simulating_time"]))
            yield pd.DataFrame(out, columns=["archive", "member", "name", "files", "standard", "output_regex", "timeout", "simulating_time"])

    return both.mapInPandas(run, CASES)


#: A member of an archive that belongs to a problem's testcases: branch/problem/directory/.../attachment/name.zip.
CASE_MEMBER = r"^([^/]+)/problem/([^/]+)/(?:[^/]+/)+[^/]+/attachment/[^/]+\.zip$"


def problem_testcases(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole testcases of the problems in `wanted` (directory) that one branch alone has: branch, directory, and the
    columns of zip_testcases. What nobody wants is left out before a zip is opened."""
    parts = F.split("member", "/")
    ours = members.withColumn("branch", F.get(parts, F.lit(0))).withColumn("directory", F.get(parts, F.lit(2))).where((F.get(parts, F.lit(1)) == "problem") & (F.size(parts) >= 4))
    ours = ours.join(wanted.select("directory").distinct(), "directory", "left_semi")
    zips = F.lower("member").rlike(CASE_MEMBER)
    single = on_one_branch(ours.where(zips).select("branch", "directory"))
    used = ours.where(zips | F.col("member").endswith("/testcase.yaml")).join(single.select("directory").distinct(), "directory", "left_semi")
    cases = zip_testcases(used.select("archive", "member", "content")).where("files is not null")
    parts = F.split("member", "/")
    return cases.withColumn("branch", F.get(parts, F.lit(0))).withColumn("directory", F.get(parts, F.lit(2)))


# Problems of the branch of 2024, and the end of names that lie on the branch of 2023.
LATE = ("P1_different_number", "P1_eat_meal", "P1_sit_in_rows", "P1_password_check", "P1_inverted_order", "P1_spend_a_day")


def branch_of(name) -> Column:
    return F.when(F.endswith(name, F.lit("_2023")), "2023-main").when(name.isin(*LATE), "2024-main").otherwise("main")


def materialise(members: DataFrame, generated: DataFrame, names: DataFrame) -> DataFrame:
    """name, path, content: the files of the problems in `names` (name), as they are laid out for a judge.

    members: archive, member, content. Of each problem one branch counts (branch_of). generated (path, content; the
    path begins with the problem's name) wins over the archive. Files of zips are laid beside them, but for those that
    stand there already. A member that would leave its folder fails the query."""
    parts = F.split("member", "/")
    rows = members.withColumn("name", F.get(parts, F.lit(2))).where((F.size(parts) >= 4) & (F.get(parts, F.lit(1)) == "problem"))
    rows = rows.join(names.select("name").distinct(), "name", "left_semi").where(F.get(parts, F.lit(0)) == branch_of(F.col("name")))
    plain = rows.select(F.array_join(F.slice(parts, 3, 1 << 30), "/").alias("path"), "content")
    made = generated.select("path", "content").join(names.select(F.col("name").alias("_n")).distinct(), F.substring_index("path", "/", 1) == F.col("_n"), "left_semi")
    zips = made.unionByName(plain.join(made.select("path"), "path", "left_anti")).where(F.col("path").rlike(r"/(attachment|standard)/[^/]+\.zip$"))

    def run(frames):
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    inside = [i for i in z.infolist() if not i.is_dir()]
                    if bad := [i.filename for i in inside if not _inside(i.filename)]:
                        raise ValueError(f"{path} holds {bad[0]}")
                    yield pd.DataFrame([(f"{PurePosixPath(path).parent}/{i.filename}", z.read(i)) for i in inside], columns=["path", "content"])

    unzipped = zips.mapInPandas(run, "path string, content binary").dropDuplicates(["path"])
    return prefer_plain(plain, unzipped, made, ["path"]).select(F.substring_index("path", "/", 1).alias("name"), "path", "content")


def manifest(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """problem_id, name, case, directory, standard, sources and settings of each testcase.yaml in `files` (materialise).

    catalog: id, name. A testcase without standard.txt or without a source fails the query."""
    config = F.regexp_extract("path", r"^([^/]+/testcase/[^/]+)/testcase\.yaml$", 1)
    cases = files.withColumn("folder", config).where("folder <> ''").select("name", "folder", F.col("content").alias("yaml"))
    place = F.regexp_extract("path", r"^([^/]+/testcase/[^/]+)/(attachment|standard)/(.+)$", 1)
    inside = files.select("path", place.alias("folder"), F.regexp_extract("path", r"/testcase/[^/]+/(attachment|standard)/", 1).alias("kind"), F.regexp_extract("path", r"/testcase/[^/]+/(?:attachment|standard)/(.+)$", 1).alias("rest")).where("folder <> ''")
    best = inside.groupBy("folder").agg(F.min("kind").alias("kind"))
    base = F.element_at(F.split("rest", "/"), -1)
    source = F.col("rest").endswith(".v") & ~F.col("rest").contains("__MACOSX") & ~F.startswith(base, F.lit("._"))
    found = inside.join(best, ["folder", "kind"]).groupBy("folder", "kind").agg(F.min(F.when(base == "standard.txt", F.col("rest"))).alias("standard"), F.array_sort(F.collect_list(F.when(source, F.col("rest")))).alias("sources"))
    whole = F.col("standard").isNotNull() & (F.size("sources") > 0)
    out = cases.join(found, "folder", "left").join(catalog.select(F.col("id").alias("problem_id"), "name"), "name")
    out = out.withColumn("standard", F.when(F.coalesce(whole, F.lit(False)), F.col("standard")).otherwise(F.raise_error(F.concat(F.lit("no standard.txt or no source: "), F.col("folder")))))

    @F.pandas_udf("output_regex string, timeout int, simulating_time string, top_module string")
    def settings(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_config(None, decode_text(x)) for x in content], columns=["output_regex", "timeout", "simulating_time", "top_module"])

    out = out.withColumn("c", settings("yaml"))
    return out.select("problem_id", "name", F.element_at(F.split("folder", "/"), -1).alias("case"), F.concat_ws("/", "folder", "kind").alias("directory"), "standard", "sources", "c.output_regex", "c.timeout", "c.simulating_time", "c.top_module")


def on_one_branch(cases: DataFrame, branch: str = "branch", problem: str = "directory") -> DataFrame:
    """cases of problems that are found on one branch alone."""
    single = cases.groupBy(problem).agg(F.count_distinct(branch).alias("_b")).where("_b = 1").select(problem)
    return cases.join(single, problem, "left_semi")


def local_cases(cases: DataFrame, problems: DataFrame) -> DataFrame:
    """Testcases (path, ...) that belong to a problem by the name of the folder they lie in."""
    folder = F.element_at(F.split("path", "/"), -2)
    return cases.withColumn("folder", folder).join(problems.select(F.col("name").alias("folder"), F.col("id").alias("problem_id")), "folder")


def prefer_plain(plain: DataFrame, zipped: DataFrame, generated: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: a generated file wins over a plain one, a plain one over one from a zip."""
    ranked = generated.withColumn("_r", F.lit(0)).unionByName(plain.withColumn("_r", F.lit(1))).unionByName(zipped.withColumn("_r", F.lit(2)))
    rest = [c for c in plain.columns if c not in key]
    return ranked.groupBy(*key).agg(F.min_by(F.struct(*rest), "_r").alias("_x")).select(*key, "_x.*")


def fingerprint(spark: SparkSession, folder: str, weights: str = r"\.(safetensors|bin|pt)$") -> DataFrame:
    """path and mark of the files of a model folder: size and time of weights (not read), SHA-256 of the others."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    heavy = listed.where(F.col("path").rlike(weights)).select("path", F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("mark"))
    return heavy.unionByName(listed.where(~F.col("path").rlike(weights)).select("path", F.sha2("content", 256).alias("mark")))


def generations(spark: SparkSession, path: str, results_path: str, schema: StructType | str) -> DataFrame:
    """Generated rows, or else the results without their test_result, if all rows have one; or else no rows."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if exists(spark, path):
        return read_jsonl(spark, path, kind)
    if not exists(spark, results_path):
        return spark.createDataFrame([], kind)
    judged = read_jsonl(spark, results_path, StructType([*kind.fields, StructField("test_result", StringType())]))
    lacking = judged.where("test_result is null").limit(1).count()
    return spark.createDataFrame([], kind) if lacking else judged.drop("test_result")
