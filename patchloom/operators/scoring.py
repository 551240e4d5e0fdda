"""Quality of pairs, and samples and splits drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.sources.scratch import written

# Weights of the four signals, tiers with their least score and training weight, correctness by label.
WEIGHTS = {"correctness": 0.41, "purity": 0.29, "diversity": 0.18, "informativeness": 0.12}
TIERS = (("high", 0.75, 1.0), ("medium", 0.50, 0.5), ("low", 0.0, 0.2))
VERIFIED, CHECKED, UNKNOWN = 1.0, 0.8, 0.3


def with_diversity(pairs: DataFrame) -> DataFrame:
    """sqrt(rows of the rarest problem / rows of this one), among the rows given: reject first."""
    counts = pairs.groupBy("problem_id").agg(F.count("*").alias("problem_rows"))
    least = counts.agg(F.min("problem_rows").alias("least_rows"))
    share = counts.crossJoin(F.broadcast(least)).withColumn("diversity", F.sqrt(F.col("least_rows") / F.col("problem_rows")))
    return pairs.join(share, "problem_id")


def score(pairs: DataFrame) -> DataFrame:
    """pairs (with distance) and their signals, score, tier, weight; tiers go by the score before it is rounded."""
    c = F.when((F.col("verification") == "testbench_verified") | F.col("valid_repair"), VERIFIED).when(F.col("verification") == "manual_checked", CHECKED).otherwise(UNKNOWN)
    rows = with_diversity(pairs).withColumn("correctness", c).withColumn("purity", F.greatest(F.lit(0.0), 1 - F.col("distance")))
    rows = rows.withColumn("informativeness", F.least(F.lit(1.0), F.col("distance") / 0.05) * F.col("purity"))
    total = None
    for name, weight in WEIGHTS.items():
        total = F.col(name) * weight if total is None else total + F.col(name) * weight
    rows = rows.withColumn("raw_score", total)
    tier = weight_of = None
    for name, least, weight in TIERS[:-1]:
        hit = F.col("raw_score") >= least
        tier = F.when(hit, name) if tier is None else tier.when(hit, name)
        weight_of = F.when(hit, weight) if weight_of is None else weight_of.when(hit, weight)
    rows = rows.withColumn("quality_tier", tier.otherwise(TIERS[-1][0])).withColumn("training_weight", F.round(weight_of.otherwise(TIERS[-1][2]) * F.col("correctness"), 3))
    rows = rows.withColumn("needs_review", (F.col("correctness") < 1) | (F.col("quality_tier") == "low"))
    return rows.withColumn("quality_score", F.round("raw_score", 6)).withColumns({n: F.round(n, 6) for n in WEIGHTS}).withColumn("normalized_edit_distance", F.round("distance", 6))


def quality_sample(scored: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """The best round-half-even(n * ratio) rows: high tier first, by score; the others by a weighted draw.

    The order is global, so it is taken in two steps that stay distributed: ranks inside ranges of the sort key, and
    the ranges' sizes summed up.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio is in (0, 1]")
    u = T.draw(seed, F.col(key))
    lottery = F.pow(F.greatest(u, F.lit(1e-300)), 1 / F.greatest("quality_score", F.lit(1e-6)))
    rows = scored.withColumn("_low", (F.col("quality_tier") != "high").cast("int")).withColumn("_by", -F.when(F.col("quality_tier") == "high", F.col("quality_score")).otherwise(lottery))
    ranked = global_rank(rows, ["_low", "_by", key], "_rank")
    target = scored.agg(F.bround(F.count("*") * F.lit(ratio)).alias("_target"))
    return ranked.crossJoin(F.broadcast(target)).where("_rank <= _target").drop("_low", "_by", "_rank", "_target")


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their 1-based place in a total order, without gathering them in one task: ranges of the order are
    ranked side by side, and each adds the sizes of those before it (a row a range). The ranges are written, for Spark
    draws their bounds from a sample and would draw others the next time."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(F.broadcast(before), "_range").withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def student_split(pairs: DataFrame, seed: int = 42, train: float = 0.85, val: float = 0.075) -> DataFrame:
    """pairs with split: students, shuffled by a draw, are cut at int(n * train) and int(n * (train + val))."""
    students = pairs.select("student_id").distinct().withColumn("_u", T.draw(seed, F.col("student_id")))
    ranked = global_rank(students, ["_u", "student_id"], "_rank")
    n = students.agg(F.count("*").alias("_n"))
    cut = ranked.crossJoin(F.broadcast(n)).withColumn(
        "split", F.when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(train)), "train").when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(train + val)), "val").otherwise("test")
    )
    return pairs.join(cut.select("student_id", "split"), "student_id")


def cap_per_problem(rows: DataFrame, most: int, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """At most `most` rows of each problem, drawn at random (the sampling is the feature)."""
    order = Window.partitionBy("problem_id").orderBy("_u", key)
    return rows.withColumn("_u", T.draw(seed, F.col(key))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_u", "_n")


def split_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, problems and students of each split, before and after a cap."""

    def count(df, stage):
        return df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("problem_id").alias("problems"), F.count_distinct("student_id").alias("students")).withColumn("stage", F.lit(stage))

    return count(before, "before").unionByName(count(after, "after"))
