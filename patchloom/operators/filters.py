"""What is rejected, and why; checks of rows and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.functions.python_text import bit_parallel_distance

QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def length_filter(pairs: DataFrame, most: float = 0.5) -> DataFrame:
    """pairs with length_ratio and filter_reason (null: kept). Equality is tested first; the boundary is kept."""
    ratio = T.length_change(F.col("buggy_code"), F.col("fixed_code"))
    reason = F.when(F.col("buggy_code") == F.col("fixed_code"), "identical_code").when(ratio > most, "abnormal_length_change")
    return pairs.withColumn("length_ratio", ratio).withColumn("filter_reason", reason)


#: Steps of the built-in Levenshtein, characters times characters, beyond which the bit-parallel one takes over.
LONG_PAIR = 1 << 24


def with_distance(pairs: DataFrame, long_pair: int = LONG_PAIR) -> DataFrame:
    """pairs with distance: short texts by the built-in, long ones by a bit-parallel function (64 steps at once)."""
    a, b = T.without_line_ends(F.col("buggy_code")), T.without_line_ends(F.col("fixed_code"))
    long = F.length("buggy_code").cast("long") * F.length("fixed_code") > long_pair
    short = F.when(~F.coalesce(long, F.lit(False)), T.edit_distance(F.col("buggy_code"), F.col("fixed_code")))
    steps = bit_parallel_distance(F.when(long, a), F.when(long, b))
    return pairs.withColumn("distance", F.coalesce(short, steps / F.greatest(F.length(a), F.length(b), F.lit(1))))


def distance_stats(pairs: DataFrame, k: float = 1.5) -> DataFrame:
    """One row: count, mean and quantiles of the distances rounded to 6 places, and the fence min(1, p75 + k * (p75 - p25))."""
    d = F.round("distance", 6)
    q = pairs.agg(F.count(d).alias("n"), F.round(F.avg(d), 6).alias("mean"), F.percentile(d, F.array(*map(F.lit, QUANTILES))).alias("q"))
    p = [F.col("q")[i].alias(name) for i, name in enumerate(("min", "p25", "p50", "p75", "p90", "p95", "p99", "max"))]
    fence = F.least(F.lit(1.0), F.col("q")[3] + k * (F.col("q")[3] - F.col("q")[1]))
    return q.select("n", "mean", *p, fence.alias("fence"))


def edit_fence(pairs: DataFrame, threshold: float | None = None, k: float = 1.5) -> DataFrame:
    """pairs with normalized_edit_distance and filter_reason: excessive_edit_distance beyond the fence (or threshold)."""
    limit = F.lit(threshold) if threshold is not None else F.col("fence")
    rows = pairs if threshold is not None else pairs.crossJoin(F.broadcast(distance_stats(pairs, k).select("fence")))  # one row
    d = F.round("distance", 6)
    out = rows.withColumn("filter_reason", F.when(d > limit, "excessive_edit_distance")).withColumn("normalized_edit_distance", d)
    return out.drop("fence")


def hard_reject(pairs: DataFrame, catalog: DataFrame, most: float = 0.9) -> DataFrame:
    """pairs with filter_reason, the first that holds: label, scope, empty, identical, rewrite. The names are fixed values."""
    scope = catalog.select(F.col("id").alias("problem_id"), F.lit(True).alias("in_scope"))
    blank = (T.py_strip(F.col("buggy_code")) == "") | (T.py_strip(F.col("fixed_code")) == "")
    invalid = F.coalesce(~F.col("valid_repair"), F.lit(False)) | F.coalesce(F.col("verification") == "invalid", F.lit(False))
    reason = (
        F.when(invalid, "invalid_fail_to_ac_label").when(F.col("in_scope").isNull(), "out_of_scope_problem").when(blank, "empty_code")
        .when(F.col("buggy_code") == F.col("fixed_code"), "identical_code").when(F.col("distance") > most, "near_total_rewrite")
    )
    return pairs.join(scope, "problem_id", "left").withColumn("filter_reason", reason).drop("in_scope")


def keep(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("filter_reason").isNull())


def denied(rows: DataFrame, ids: list[str]) -> DataFrame:
    """rows on the list, or with a replacement character on either side."""
    return rows.where(F.col("pair_id").isin(ids) | F.col("buggy_code").contains(T.REPLACEMENT) | F.col("fixed_code").contains(T.REPLACEMENT))


def roles_are(messages: Column, *roles: str) -> Column:
    return F.transform(messages, lambda m: m["role"]) == F.array(*map(F.lit, roles))


def key_problems(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, empty keys, and whether the key is unique and never empty."""
    out = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"), F.count_if(F.coalesce(F.col(key).cast("string"), F.lit("")) == "").alias("n_empty"))
    return out.withColumn("ok", (F.col("n") == F.col("n_distinct")) & (F.col("n_empty") == 0))


def keyset_gaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side alone, with the side; no row means that the sides have the same keys."""
    one = a.select(F.col(key)).distinct().withColumn("in_a", F.lit(True))
    two = b.select(F.col(key)).distinct().withColumn("in_b", F.lit(True))
    both = one.join(two, key, "full_outer")
    return both.where("in_a is null or in_b is null").select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))


def run_guard(config_a: DataFrame, config_b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the keys in which two one-row configurations differ (null equals null), and whether none does."""
    a = config_a.select(*[F.col(k).alias(f"a_{k}") for k in keys])
    b = config_b.select(*[F.col(k).alias(f"b_{k}") for k in keys])
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")), F.lit(k)) for k in keys]))
    return a.crossJoin(F.broadcast(b)).select(differ.alias("mismatches"), (F.size(differ) == 0).alias("ok"))


# What two runs must have in common, and the packages whose versions count.
RUN_KEYS = ("test_sha256", "pair_ids", "manifest_sha256", "resources", "script_sha256", "generation", "timeout", "iverilog_version")
PACKAGES = ("torch", "transformers")


def _text_of(kind: str, c: Column) -> Column:
    """A value as one that can be compared: maps, which have no order, as sorted entries."""
    return F.array_sort(F.map_entries(c)) if kind.startswith("map") else c


def run_conditions(base: DataFrame, tuned: DataFrame, keys=RUN_KEYS, packages=PACKAGES) -> DataFrame:
    """One row: what forbids comparing a base run with a tuned one (mismatches, in order), and whether nothing does.

    Both are one-row configurations with `keys`, model, adapter, model_files and versions (maps), mode, complete, and
    result_ids. The keys and the model must be equal, the base run has no adapter and the tuned one has; the files
    below the model's folder and the packages' versions must agree, both runs must be whole runs of a model, and their
    results must be of their pair_ids, in order."""
    side = lambda df, x: df.select(F.struct(*df.columns).alias(x))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    a, b = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    files = lambda x: F.array_sort(F.map_entries(F.map_filter(x("model_files"), lambda k, _: F.startswith(k, F.concat(x("model"), F.lit("/"))))))
    version = lambda x, package: F.try_element_at(x("versions"), F.lit(package))
    whole = lambda x: (x("mode") == "model") & x("complete")
    bad = [
        *[(k, ~_text_of(kinds[k], a(k)).eqNullSafe(_text_of(kinds[k], b(k)))) for k in keys],
        ("adapter", a("adapter").isNotNull() | b("adapter").isNull()),
        ("model", ~a("model").eqNullSafe(b("model"))),
        ("model_files", ~files(a).eqNullSafe(files(b))),
        *[(f"versions.{p}", ~version(a, p).eqNullSafe(version(b, p))) for p in packages],
        *[(f"{name}_incomplete", ~F.coalesce(whole(x), F.lit(False))) for name, x in (("base", a), ("tuned", b))],
        *[(f"{name}_results", ~x("result_ids").eqNullSafe(x("pair_ids"))) for name, x in (("base", a), ("tuned", b))],
    ]
    differ = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in bad]))
    return side(base, "a").crossJoin(F.broadcast(side(tuned, "b"))).select(differ.alias("mismatches"), (F.size(differ) == 0).alias("ok"))  # a row each


def may_reuse(phases: Column, limit) -> Column:
    """Every phase of a cached verdict timed out or took at most the limit; missing phases don't count."""
    return F.forall(F.array_compact(phases), lambda p: p["timeout"] | (p["seconds"] <= limit))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def segment(path: Column, k: int) -> Column:
    """The k-th part of a path, from 1; negative from its end; null beyond."""
    return F.try_element_at(F.split(path, "/"), F.lit(k))


def forbidden(rows: DataFrame, rules: DataFrame, side: str) -> DataFrame:
    """rows of problems with a rule (problem_id, pattern) whose code breaks it, with all it found, distinct and in order."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(side), F.col("pattern"), F.lit(0))))
    return rows.join(rules, "problem_id").withColumn("found", found).where(F.size("found") > 0)


def of_problems(rows: DataFrame, problems: list[int] | DataFrame) -> DataFrame:
    """rows of these problems: ids, or a table with problem_id."""
    if isinstance(problems, list):
        return rows.where(F.col("problem_id").isin(problems))
    return rows.join(problems.select("problem_id").distinct(), "problem_id", "left_semi")


def mapped_by(rows: DataFrame, mapping: DataFrame, method: str) -> DataFrame:
    """rows whose problem was mapped by this method."""
    return of_problems(rows, mapping.where(F.col("method") == method))
