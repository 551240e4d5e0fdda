"""Pass rates, runs side by side, roll-ups of audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repair_rollup(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Of each problem total (from inputs), completed and repaired (from results), and repaired / total.

    inputs: pair_id, problem_id; results: pair_id, status."""
    done = inputs.join(results, "pair_id", "left")
    out = done.groupBy("problem_id").agg(F.count("*").alias("total"), F.count("status").alias("completed"), F.count_if(F.col("status") == "AC").alias("repaired"))
    return out.withColumn("repair_rate", F.col("repaired") / F.col("total"))


def overall_rate(rollup: DataFrame) -> DataFrame:
    """One row; repair_rate is null until every row is judged, running_repair_rate goes by what is (0 for none)."""
    out = rollup.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"), F.coalesce(F.sum("repaired"), F.lit(0)).alias("repaired"))
    rate = F.when((F.col("completed") == F.col("total")) & (F.col("total") > 0), F.col("repaired") / F.col("total"))
    running = F.when(F.col("completed") > 0, F.col("repaired") / F.col("completed")).otherwise(0.0)
    return out.withColumn("repair_rate", rate).withColumn("running_repair_rate", running)


def paired(base: DataFrame, tuned: DataFrame, value: str) -> DataFrame:
    """pair_id, problem_id, value, tuned: two runs side by side. A pair that one of them lacks, or that they put to
    different problems, fails the query."""
    b = base.select("pair_id", F.col("problem_id").alias("_p"), F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    t = tuned.select("pair_id", F.col("problem_id").alias("_q"), F.col(value).alias("_t"), F.lit(True).alias("_in_t"))
    refuse = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("pair_id").cast("string"))).cast("boolean")
    both = b.join(t, "pair_id", "full_outer").withColumn(
        "_fine", F.when(F.col("_in_b").isNull() | F.col("_in_t").isNull(), refuse("only one run has")).when(~F.col("_p").eqNullSafe(F.col("_q")), refuse("two problems for")).otherwise(True)
    )
    return both.where("_fine").select("pair_id", F.col("_p").alias("problem_id"), F.col("_b").alias(value), F.col("_t").alias("tuned"))


def problem_lift(base: DataFrame, tuned: DataFrame, names: DataFrame, train_counts: DataFrame) -> DataFrame:
    """Of each problem both pass rates and the lift in points. base, tuned: pair_id, problem_id, status, for the same pairs."""
    both = paired(base, tuned, "status")
    out = both.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "AC").alias("base_ac"), F.count_if(F.col("tuned") == "AC").alias("tuned_ac"))
    out = out.join(names, "problem_id", "left").join(train_counts, "problem_id", "left")
    out = out.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("train", F.coalesce("train", F.lit(0)))
    return out.withColumn("base_rate", F.col("base_ac") / F.col("n")).withColumn("tuned_rate", F.col("tuned_ac") / F.col("n")).withColumn("lift", 100 * (F.col("tuned_ac") - F.col("base_ac")) / F.col("n"))


def lift_summary(lift: DataFrame) -> DataFrame:
    """One row: micro and macro rates, and the problems that rose, stood and fell."""
    return lift.agg(
        (F.sum("base_ac") / F.sum("n")).alias("micro_base"), (F.sum("tuned_ac") / F.sum("n")).alias("micro_tuned"), F.avg("base_rate").alias("macro_base"), F.avg("tuned_rate").alias("macro_tuned"),
        F.count_if(F.col("lift") > 0).alias("up"), F.count_if(F.col("lift") == 0).alias("equal"), F.count_if(F.col("lift") < 0).alias("down"),
    )


def cohort_gain(lift: DataFrame, cap: int) -> DataFrame:
    """Problems with a full training quota against the others, and their share of the gain (null without a gain)."""
    out = lift.groupBy((F.col("train") == cap).alias("rich")).agg(F.count("*").alias("problems"), F.sum("n").alias("n"), F.sum(F.col("tuned_ac") - F.col("base_ac")).alias("gain"))
    total = lift.agg(F.sum(F.col("tuned_ac") - F.col("base_ac")).alias("_all"))
    return out.crossJoin(F.broadcast(total)).withColumn("gain_share", F.when(F.col("_all") != 0, F.col("gain") / F.col("_all"))).drop("_all")


def flips(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """pair_id, change (improved or regressed) of the pairs that changed. base, tuned: pair_id, passed."""
    both = base.select("pair_id", F.col("passed").alias("a")).join(tuned.select("pair_id", F.col("passed").alias("b")), "pair_id")
    return both.where(F.col("a") != F.col("b")).select("pair_id", F.when(F.col("b"), "improved").otherwise("regressed").alias("change"))


def paired_flips(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """One row: ids that improved and regressed, in order, and the change in points. base, tuned: pair_id, passed.

    The lists are the report of one evaluation and hold the ids that changed alone; flips() gives them as rows."""
    both = base.select("pair_id", F.col("passed").alias("a")).join(tuned.select("pair_id", F.col("passed").alias("b")), "pair_id")
    ids = lambda hit: F.array_sort(F.collect_list(F.when(hit, F.col("pair_id"))))
    return both.agg(
        F.count("*").alias("n"), ids(~F.col("a") & F.col("b")).alias("improved"), ids(F.col("a") & ~F.col("b")).alias("regressed"),
        (100.0 * (F.sum(F.col("b").cast("int")) - F.sum(F.col("a").cast("int"))) / F.count("*")).alias("delta_points"),
    )


def audit_pivot(audit: DataFrame, by: str | list[str], categories: list[str]) -> DataFrame:
    """Rows of each category by a column, or by several (split, then problem), and their total."""
    out = audit.groupBy(*([by] if isinstance(by, str) else by)).pivot("category", categories).count().na.fill(0, categories)
    total = None
    for c in categories:
        total = F.col(c) if total is None else total + F.col(c)
    return out.withColumn("total", total)


def audit_rollup(audit: DataFrame, levels: list[str], categories: list[str]) -> DataFrame:
    """The counts of audit_pivot at every level at once: by all levels, by all but the last, ..., overall (nulls)."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in categories]
    return audit.rollup(*levels).agg(*counts, F.count("*").alias("total"))


def issue_histogram(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("issues").alias("issue")).groupBy("issue").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "issue")
