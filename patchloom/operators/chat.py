"""Pairs as chat rows, and what chat rows hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text as T

# The prompt that models are trained on, and the mark after which the code to repair follows.
SYSTEM = (
    "You are an expert Verilog code repair assistant. Fix the given buggy Verilog code according to the problem specification. "
    "Return only the complete corrected Verilog code without explanations."
)
MARK = "Buggy Verilog code:"
IGNORED = -100


def chat_rows(pairs: DataFrame, catalog: DataFrame, system: str = SYSTEM, mark: str = MARK, strict: bool = True) -> DataFrame:
    """pair_id, problem_id and messages: system, user (the specification, the mark, the fenced code), assistant (the code).

    A problem without a description reads None. strict: a pair whose problem the catalog lacks fails the query; else it
    is left out."""
    known = catalog.select(F.col("id").alias("problem_id"), F.coalesce("description", F.lit("None")).alias("description"))
    rows = pairs.join(known, "problem_id", "left" if strict else "inner")
    described = F.coalesce("description", F.raise_error(F.concat(F.lit("no such problem in the catalog: "), F.col("problem_id").cast("string")))) if strict else F.col("description")
    user = F.concat(F.lit("Problem specification:\n"), described, F.lit(f"\n\n{mark}\n```verilog\n"), F.col("buggy_code"), F.lit("\n```"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("pair_id", "problem_id", F.array(message("system", F.lit(system)), message("user", user), message("assistant", F.col("fixed_code"))).alias("messages"))


def codes_of(chats: DataFrame, mark: str = MARK) -> DataFrame:
    """The buggy and the fixed code of chat rows: after the first mark of the user's message (null without one), and the
    answer."""
    user = F.get("messages", F.lit(1))["content"]
    after = F.when(F.contains(user, F.lit(mark)), F.substring(user, F.position(F.lit(mark), user) + len(mark), F.length(user)))
    return chats.withColumn("buggy_code", T.extract_fences(after)).withColumn("fixed_code", T.extract_fences(F.get("messages", F.lit(2))["content"]))


def strict_rows(chats: DataFrame) -> DataFrame:
    """chats as they are; a row whose roles are not system, user, assistant fails the query."""
    fine = F.transform("messages", lambda m: m["role"]) == F.array(*map(F.lit, ("system", "user", "assistant")))
    return chats.withColumn("messages", F.when(fine, F.col("messages")).otherwise(F.raise_error(F.lit("messages of other roles than system, user, assistant"))))


def missing_catalog(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs whose problem the catalog lacks: a strict join has none."""
    return pairs.join(catalog.select(F.col("id").alias("problem_id")), "problem_id", "left_anti")


def words(text: Column) -> Column:
    """Tokens of the stand-in tokenizer: parts between white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def chatml(messages: Column, prompted: bool = False) -> Column:
    """Messages in the ChatML template; prompted: the head of an assistant's turn follows."""
    turn = lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(messages, turn), ""), F.lit("<|im_start|>assistant\n" if prompted else ""))


def token_counts(chats: DataFrame, key: str, count=words, render=chatml, which: str = "last") -> DataFrame:
    """input (what stands before the last assistant's turn, or the first one, as in training), assistant (its text),
    full. count stands for any tokenizer, render for any template. Rows without an assistant are left out."""
    best = F.array_max if which == "last" else F.array_min
    place = best(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)))
    rows = chats.withColumn("_at", place).where(F.col("_at").isNotNull())
    return rows.select(
        key, count(render(F.slice("messages", F.lit(1), F.col("_at")), True)).alias("input"),
        count(F.get("messages", F.col("_at"))["content"]).alias("assistant"), count(render(F.col("messages"))).alias("full"),
    )


def within_length(counts: DataFrame, column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of at most so many tokens, the longer ones)."""
    return counts.where(F.col(column) <= most), counts.where(F.col(column) > most)


def by_length(rows: DataFrame, column: str, *ties: str) -> DataFrame:
    """rows dealt by length into ranges and sorted there, so that batches of neighbours need little padding."""
    return rows.repartitionByRange(column, *ties).sortWithinPartitions(column, *ties)


PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.995)


def token_stats(counts: DataFrame, columns: list[str], percentiles=PERCENTILES) -> DataFrame:
    """Of each column count, min, mean, max and percentiles, to 2 places, in one pass; zeros without rows."""
    names = [f"p{round(1000 * p) / 10:g}".replace(".", "_") for p in percentiles]

    def summary(c: str) -> Column:
        v = F.col(c).cast("double")
        q = F.percentile(v, F.array(*map(F.lit, percentiles)))
        or_zero = lambda x: F.coalesce(x, F.lit(0.0))
        return F.struct(
            F.lit(c).alias("measure"), F.count(v).alias("n"), or_zero(F.min(v)).alias("least"), or_zero(F.round(F.avg(v), 2)).alias("mean"), or_zero(F.max(v)).alias("most"),
            *[or_zero(F.round(q[i], 2)).alias(name) for i, name in enumerate(names)],
        )

    return counts.agg(F.array(*map(summary, columns)).alias("xs")).select(F.inline("xs"))


def coverage(counts: DataFrame, column: str, limits: list[int]) -> DataFrame:
    """Of each limit the rows within it, and their percentage."""
    total = counts.agg(F.count("*").alias("n"), *[F.count_if(F.col(column) <= x).alias(f"c{x}") for x in limits])
    row = F.explode(F.array(*[F.struct(F.lit(x).alias("token_limit"), F.col(f"c{x}").alias("covered"), F.col("n").alias("n")) for x in limits]))
    return total.select(row.alias("x")).select("x.token_limit", "x.covered", F.round(100 * F.col("x.covered") / F.greatest("x.n", F.lit(1)), 2).alias("percent"))


def recommended_limit(counts: DataFrame, column: str, p: float = 0.99, multiple: int = 256) -> DataFrame:
    return counts.agg(F.percentile(column, p).alias("at")).select(F.round("at", 2).alias("at"), (F.ceil(F.col("at") / multiple) * multiple).cast("long").alias("recommended"))


def anomalies(counts: DataFrame, column: str, limits: list[int], p: float = 0.99) -> DataFrame:
    """Rows at or above the percentile, with whether each limit covers them."""
    line = counts.agg(F.percentile(column, p).alias("threshold"))
    hit = counts.crossJoin(F.broadcast(line)).where(F.col(column) >= F.col("threshold"))  # one row
    return hit.withColumn("covered", F.transform(F.array(*map(F.lit, limits)), lambda x: F.col(column) <= x)).drop("threshold")


def mask_labels(prompt_ids: Column, answer_ids: Column, end_id: int) -> tuple[Column, Column]:
    """input_ids and labels: the prompt's labels are ignored, the end follows the answer."""
    answer = F.concat(answer_ids, F.array(F.lit(end_id)))
    return F.concat(prompt_ids, answer), F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt_ids)), answer)


def until_end(ids: Column, end_id: int) -> Column:
    """The ids before the first end; all of them without one."""
    at = F.array_position(ids, end_id)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def warmup_steps(n, batch: int = 32, epochs: int = 2, share: float = 0.03) -> Column:
    return F.greatest(F.lit(1), F.floor(F.ceil(n / batch) * epochs * share)).cast("long")
