"""Writers: JSON lines, TSV and CSV, several outputs of one pass, reports, appends without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T


def write_jsonl(rows: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """A folder of JSON lines; null keys stay unless told otherwise (a catalog leaves them out)."""
    rows.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_single(rows: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """JSON lines as one file of this very name, in the order of rows: for splits and reports that others read."""
    beside = f"{path}.part-{uuid.uuid4().hex[:8]}"
    write_jsonl(rows.coalesce(1), beside, keep_nulls)
    fs, _ = _fs(rows.sparkSession, path)
    parts = [f.getPath() for f in fs.listStatus(_fs(rows.sparkSession, beside)[1]) if f.getPath().getName().startswith("part-")]
    made = parts[0] if parts else _fs(rows.sparkSession, f"{beside}/empty")[1]
    if not parts:
        fs.createNewFile(made)
    _replace(rows.sparkSession, made, path)
    fs.delete(_fs(rows.sparkSession, beside)[1], True)


def write_tagged(rows: DataFrame, path: str, tag: str) -> None:
    """Several outputs in one pass: a folder for each value of the tag (kept and rejected; scored, selected, review)."""
    rows.write.mode("overwrite").partitionBy(tag).json(path)


def as_cells(rows: DataFrame) -> DataFrame:
    """Text without tabs and line ends, times as ISO text, arrays joined by commas."""
    out = []
    for f in rows.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        cell: Column = T.table_cell(c) if kind == "string" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.array_join(c.cast("array<string>"), ",") if kind.startswith("array") else c
        out.append(cell.alias(f.name))
    return rows.select(*out)


def write_tsv(rows: DataFrame, path: str) -> None:
    as_cells(rows).write.mode("overwrite").option("header", "true").option("quote", "\u0000").csv(path, sep="\t")


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """bom: each file begins with a byte order mark, which stands before its first column's name, as in utf-8-sig."""
    cells = as_cells(rows)
    if bom:
        cells = cells.withColumnRenamed(cells.columns[0], "\ufeff" + cells.columns[0])
    cells.write.mode("overwrite").option("header", "true").csv(path)


def write_four(scored: DataFrame, selected: DataFrame, rejected: DataFrame, path: str) -> DataFrame:
    """The outputs of scoring, which overlap: scored, selected, rejected and review (of the scored), a folder each; gives
    the summary, rows by output and tier."""
    outputs = {"scored": scored, "selected": selected, "rejected": rejected, "review": scored.where("needs_review")}
    summary = None
    for name, rows in outputs.items():
        write_jsonl(rows, f"{path}/{name}")
        tier = F.col("quality_tier") if "quality_tier" in rows.columns else F.lit(None).cast("string")
        n = rows.groupBy(F.lit(name).alias("output"), tier.alias("quality_tier")).agg(F.count("*").alias("n"))
        summary = n if summary is None else summary.unionByName(n)
    return summary


def elapsed_seconds(started, ended) -> Column:
    """Seconds between two times, to one place."""
    micros = lambda t: F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))
    return F.round((micros(ended) - micros(started)) / 1e6, 1)


def _fs(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_atomic(rows: DataFrame, path: str) -> None:
    """JSON lines that readers see whole or not at all: written beside the target, then renamed.

    What stood there is moved aside and deleted when the new one is in its place; a call that finds the target gone
    and an old one beside it (an earlier call was cut off) puts it back first."""
    spark, path = rows.sparkSession, path.rstrip("/")
    beside = f"{path}.part-{uuid.uuid4().hex[:8]}"
    write_jsonl(rows, beside)
    _replace(spark, _fs(spark, beside)[1], path)


def _replace(spark, made, path: str) -> None:
    """Moves what was made to path; what stood there goes when that is done, or comes back."""
    fs, target = _fs(spark, path)
    aside = _fs(spark, f"{path}.old")[1]
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(made, target):
        fs.rename(aside, target)
        raise OSError(f"cannot move {made} to {path}")
    fs.delete(aside, True)


def rewrite(files: DataFrame, new_text: Column) -> DataFrame:
    """path, text, changed: what a rewrite in place would leave; the caller writes it elsewhere, or looks only."""
    return files.withColumn("_new", new_text).select("path", F.col("_new").alias("text"), (~F.col("text").eqNullSafe(F.col("_new"))).alias("changed"))


def markdown_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row, report: the rows as a Markdown table. For summaries, whose rows are few; markdown_lines() has no bound."""
    names = rows.columns
    body = rows.select(F.struct(*[F.col(o) for o in order], _markdown_row(names).alias("_line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return body.select(F.concat(F.lit(_markdown_head(names)), F.array_join(F.transform("xs", lambda x: x["_line"]), "\n")).alias("report"))


def _markdown_row(names: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]), F.lit(" |"))


def _markdown_head(names: list[str]) -> str:
    return f"| {' | '.join(names)} |\n|{' --- |' * len(names)}\n"


def markdown_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """The lines of a Markdown table of any length, in order, as a folder of text files."""
    names = rows.columns
    rows.orderBy(*order).select(_markdown_row(names).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)
