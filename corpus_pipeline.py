"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the docs of the
next one; all but the last return the columns of documents. Columns beyond those are not kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import decontaminate, jaccard_join, language_id, mixing, tokens
from patchloom.llm.common import scope, scratch_path, table, tidy_shuffles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Draws, a fitted network and token blocks have no SQL.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: no text, or no letter in it. lang becomes the predicted one.

    Rows are told apart by doc_id and text, as equal rows get equal predictions.
    """
    net = language_id.train(docs)
    rows = docs.select(*COLUMNS)
    named = language_id.predict_beside(rows, net)
    known = named.where(F.col("lang_pred") != language_id.UNKNOWN)
    return known.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one of the least doc_id, of each group of near duplicates. Rows of null or repeated ids are rows of their
    own: one that is like no other stays, and of a group of null ids alone one stays."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    return mixing.mixed(docs.select(*COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the mix, written in blocks and read back: doc_id, start, n_tokens, ids_crc32, ids."""
    path = scratch_path(spark, "pipeline-tokens")
    tokens.write(docs, path)
    return tokens.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scope(spark), tidy_shuffles(spark):  # what a stage wrote on its way goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
