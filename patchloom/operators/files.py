"""Code files and inline rows, cleaned: what changes, and the counts that a clean-up reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.functions.python_text import changed_lines, decode


def normalise_files(files: DataFrame, marks: list[str] = T.HEADER_MARKS) -> DataFrame:
    """path, text, encoding, headers, changed for files (path, content): decoded, normalised, and whether the bytes that
    would be written differ from those there."""
    rows = files.select("path", "content", decode("content").alias("d")).select("path", "content", F.col("d.text").alias("raw"), F.col("d.encoding").alias("encoding"))
    rows = rows.withColumn("text", T.normalise_code(F.col("raw"), marks)).withColumn("headers", T.headers_removed(F.col("raw"), marks))
    return rows.select("path", "text", "encoding", "headers", (F.encode("text", "UTF-8") != F.col("content")).alias("changed"))


def normalise_report(done: DataFrame) -> DataFrame:
    """One row: total, changed, removed_template_headers, converted_from_gb18030, repaired_invalid_utf8."""
    return done.agg(
        F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.coalesce(F.sum("headers"), F.lit(0)).alias("removed_template_headers"),
        F.count_if(F.col("encoding") == "gb18030").alias("converted_from_gb18030"), F.count_if(F.col("encoding") == "utf-8-replaced").alias("repaired_invalid_utf8"),
    )


def comment_report(files: DataFrame) -> DataFrame:
    """One row for files (path, text): total_files, changed_files, removed_comments, of comments that hold Chinese."""
    rows = files.select((T.strip_cjk_comments(F.col("text")) != F.col("text")).alias("changed"), T.count_cjk_comments(F.col("text")).alias("removed"))
    return rows.agg(F.count("*").alias("total_files"), F.count_if("changed").alias("changed_files"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed_comments"))


def inline_rows(pairs: DataFrame) -> DataFrame:
    """pairs with both codes without comments, their lines, the lines that differ, their hashes, and the characters
    removed."""
    rows = pairs.withColumn("_before", F.length("buggy_code") + F.length("fixed_code"))
    for side in ("buggy", "fixed"):
        rows = rows.withColumn(f"{side}_code", T.strip_comments(F.col(f"{side}_code")))
    for side in ("buggy", "fixed"):
        rows = rows.withColumn(f"{side}_line_count", T.line_count(F.col(f"{side}_code"))).withColumn(f"{side}_normalized_sha256", T.code_hash(F.col(f"{side}_code")))
    rows = rows.withColumn("changed_lines", changed_lines("buggy_code", "fixed_code"))
    return rows.withColumn("removed_characters", F.col("_before") - F.length("buggy_code") - F.length("fixed_code")).drop("_before")
