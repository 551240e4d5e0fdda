"""The steps of curation and evaluation from a command line: python -m patchloom STEP --flag value.

Inputs and outputs are JSON lines wherever Spark reads and writes; run it with spark-submit for a cluster's session.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.python_text import token_counter
from patchloom.operators import chat, files, filters, reports, scoring
from patchloom.sources import readers, sinks
from patchloom.sources.session import prepare

PAIRS = "pair_id string, problem_id long, student_id long, buggy_code string, fixed_code string, verification string, valid_repair boolean"
RESULTS = "pair_id string, problem_id long, status string"
CHATS = "pair_id string, problem_id long, messages array<struct<role: string, content: string>>"
#: Name -> (what it does, what it reads, its flags).
STEPS: dict[str, tuple[Callable, str, list[tuple[str, dict]]]] = {}


def step(name: str, *flags: tuple[str, dict]):
    def put(run):
        STEPS[name] = (run, run.__doc__, list(flags))
        return run

    return put


def _flag(name: str, **more) -> tuple[str, dict]:
    return f"--{name}", more


INPUT, OUTPUT, CATALOG = _flag("input", required=True), _flag("output", required=True), _flag("catalog", required=True)
SEED = _flag("seed", type=int, default=42)


def _tagged(rows: DataFrame, path: str) -> DataFrame:
    """Writes kept and rejected rows in one pass, and gives the reasons' counts."""
    tagged = rows.withColumn("kept", F.col("filter_reason").isNull())
    sinks.write_tagged(tagged, path, "kept")
    return rows.groupBy("filter_reason").agg(F.count("*").alias("n")).orderBy("filter_reason")


@step("filter-length", INPUT, OUTPUT, _flag("threshold", type=float, default=0.5))
def filter_length(spark: SparkSession, a) -> DataFrame:
    """Pairs whose code changes in length by more than a share, and identical ones, are set apart."""
    return _tagged(filters.length_filter(readers.read_jsonl(spark, a.input, PAIRS), a.threshold), a.output)


@step("filter-distance", INPUT, OUTPUT, _flag("threshold", type=float), _flag("iqr-multiplier", type=float, default=1.5))
def filter_distance(spark: SparkSession, a) -> DataFrame:
    """Pairs beyond the fence of edit distances, or beyond a threshold, are set apart."""
    pairs = filters.with_distance(readers.read_jsonl(spark, a.input, PAIRS))
    return _tagged(filters.edit_fence(pairs, a.threshold, a.iqr_multiplier), a.output)


@step("score", INPUT, CATALOG, OUTPUT, _flag("ratio", type=float, default=0.8), _flag("max-distance", type=float, default=0.9), SEED)
def score(spark: SparkSession, a) -> DataFrame:
    """Rejects, scores and samples pairs: folders scored, selected, rejected and review."""
    pairs = filters.with_distance(readers.read_jsonl(spark, a.input, PAIRS))
    judged = filters.hard_reject(pairs, readers.read_catalog(spark, a.catalog), a.max_distance).persist()
    scored = scoring.score(filters.keep(judged)).persist()
    return sinks.write_four(scored, scoring.quality_sample(scored, a.ratio, a.seed), judged.where("filter_reason is not null"), a.output)


@step("split", INPUT, OUTPUT, _flag("train", type=float, default=0.85), _flag("val", type=float, default=0.075), _flag("cap", type=int, default=150), SEED)
def split(spark: SparkSession, a) -> DataFrame:
    """Splits pairs by student, with a cap of rows a problem in each split: a folder for each split."""
    before = scoring.student_split(readers.read_jsonl(spark, a.input, PAIRS), a.seed, a.train, a.val).persist()
    after = None
    for name in ("train", "val", "test"):
        capped = scoring.cap_per_problem(before.where(F.col("split") == name), a.cap, a.seed)
        after = capped if after is None else after.unionByName(capped)
    sinks.write_tagged(after, a.output, "split")
    return scoring.split_counts(before, after)


@step("convert", INPUT, CATALOG, OUTPUT)
def convert(spark: SparkSession, a) -> DataFrame:
    """Pairs become rows of messages; a problem that the catalog lacks fails the step."""
    rows = chat.chat_rows(readers.read_jsonl(spark, a.input, PAIRS), readers.read_catalog(spark, a.catalog))
    sinks.write_jsonl(rows, a.output)
    return readers.read_jsonl(spark, a.output, CHATS).agg(F.count("*").alias("rows"), F.count_distinct("problem_id").alias("problems"))


@step("token-stats", INPUT, OUTPUT, _flag("tokenizer"), _flag("limits", type=int, nargs="+", default=[1024, 2048, 4096, 8192]), _flag("percentile", type=float, default=0.99))
def token_stats(spark: SparkSession, a) -> DataFrame:
    """Lengths of chat rows in tokens (of a tokenizer file, else in words): folders stats, coverage and anomalies."""
    count = token_counter(a.tokenizer) if a.tokenizer else chat.words
    counts = chat.token_counts(readers.read_jsonl(spark, a.input, CHATS), "pair_id", count).persist()
    sinks.write_jsonl(chat.coverage(counts, "full", a.limits), f"{a.output}/coverage")
    sinks.write_jsonl(chat.anomalies(counts, "full", a.limits, a.percentile), f"{a.output}/anomalies")
    stats = chat.token_stats(counts, ["input", "assistant", "full"])
    sinks.write_jsonl(stats, f"{a.output}/stats")
    return stats


@step("evaluate", INPUT, _flag("results", required=True), OUTPUT)
def evaluate(spark: SparkSession, a) -> DataFrame:
    """Repair rates of a run, by problem and over all (which is null until every pair is judged)."""
    rows = readers.read_jsonl(spark, a.input, RESULTS).select("pair_id", "problem_id")
    rollup = reports.repair_rollup(rows, readers.read_jsonl(spark, a.results, RESULTS).select("pair_id", "status")).persist()
    sinks.write_jsonl(rollup, a.output)
    return reports.overall_rate(rollup)


@step("compare", _flag("base", required=True), _flag("tuned", required=True), CATALOG, _flag("train", required=True), OUTPUT)
def compare(spark: SparkSession, a) -> DataFrame:
    """Lift of a tuned run over a base run by problem, the pairs that changed, and the summary."""
    base, tuned = (readers.read_jsonl(spark, x, RESULTS) for x in (a.base, a.tuned))
    names = readers.read_catalog(spark, a.catalog).select(F.col("id").alias("problem_id"), "name")
    train = readers.read_jsonl(spark, a.train, PAIRS).groupBy("problem_id").agg(F.count("*").alias("train"))
    lift = reports.problem_lift(base, tuned, names, train).persist()
    sinks.write_jsonl(lift, f"{a.output}/lift")
    passed = lambda run: run.select("pair_id", (F.col("status") == "AC").alias("passed"))
    sinks.write_jsonl(reports.flips(passed(base), passed(tuned)), f"{a.output}/changed")
    return reports.lift_summary(lift)


@step("normalise", INPUT, _flag("output"), _flag("pattern", default="*.v"))
def normalise(spark: SparkSession, a) -> DataFrame:
    """Code files decoded and normalised, as rows of path and text; without an output only what would change is told."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", a.pattern).load(a.input)
    done = files.normalise_files(found.select("path", "content"))
    if a.output:
        sinks.write_jsonl(done.select("path", "text"), a.output)
    return files.normalise_report(done)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("patchloom", description=__doc__.splitlines()[0])
    below = top.add_subparsers(dest="step", required=True)
    for name, (_, doc, flags) in STEPS.items():
        one = below.add_parser(name, help=doc, description=doc)
        for flag, more in flags:
            one.add_argument(flag, **more)
    return top


def main(argv: list[str] | None = None) -> list[dict]:
    """Runs a step and prints its summary, a row a line."""
    a = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName(f"patchloom {a.step}").getOrCreate())
    rows = [r.asDict(recursive=True) for r in STEPS[a.step][0](spark, a).limit(1000).collect()]
    for row in rows:
        print(row)
    return rows


if __name__ == "__main__":
    sys.exit(0 if main() is not None else 1)
