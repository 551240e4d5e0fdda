"""Queries of runs: generation in adaptive batches, padded batches, streams of results and their progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.operators import chat, generate
from patchloom.plans import fixtures as X
from patchloom.plans.registry import query
from patchloom.sources import sinks
from patchloom.sources.scratch import scratch_path, written
from patchloom.streaming import resume, verdicts


def _backwards(prompts: list[str]) -> list[str]:
    """A generator whose batches must not be long."""
    if len(prompts) > 1 and sum(map(len, prompts)) > 600:
        raise generate.BatchTooLarge
    return [p[::-1] for p in prompts]


@query("adaptive_generation", """SELECT 'p' || p_partkey AS pair_id, reverse(concat_ws(' ', 'module', p_name, p_type, p_brand)) AS output, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END::INT AS run, TRUE AS fits FROM part""")
def adaptive_generation(spark, d):
    """A run that was cut off after the even ids, and the one that takes it up: each key once, in batches that fit."""
    prompts = X.pairs(spark, d).select("pair_id", F.col("buggy_code").alias("prompt"))
    even = F.substring("pair_id", 2, 20).cast("long") % 2 == 0
    first = written(generate.generate(prompts.where(even), _backwards, largest=16, tasks=3), "generated")
    second = generate.generate(prompts, _backwards, largest=16, tasks=3, done=first.select(F.col("key").alias("pair_id")))
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.select(F.col("key").alias("pair_id"), "output", "run", F.col("batch_size").between(1, 16).alias("fits"))


@query("padded_batches", """WITH ids AS (SELECT conv_id, list(length(text)::INT ORDER BY turn) FILTER (role <> 'assistant') AS p, list(length(text)::INT ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_concat(coalesce(p, []), coalesce(a, []), [2]), ',') AS input_ids, array_to_string(list_concat(list_transform(coalesce(p, []), lambda x: -100), coalesce(a, []), [2]), ',') AS labels,
  TRUE AS within, (len(coalesce(p, [])) + len(coalesce(a, [])) + 1)::INT AS seen FROM ids""")  # fmt: skip
def padded_batches(spark, d):
    """Batches of at most 65,536 cells, taken apart again: what the mask leaves of each row is the row."""
    turns = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("ts"))
    part = lambda own: F.transform(F.filter("ts", lambda t: (t["role"] == "assistant") == own), lambda t: t["n"])
    ids, labels = chat.mask_labels(part(F.lit(False)), part(F.lit(True)), 2)
    budget = 1 << 16
    batches = generate.padded_batches(turns.select("conv_id", ids.alias("input_ids"), labels.alias("labels")), "conv_id", budget, pad_id=-1)
    within = (F.col("rows") * F.col("longest") <= budget) & (F.col("tokens") + F.col("padding") == F.col("rows") * F.col("longest"))
    each = batches.select(within.alias("within"), F.explode(F.arrays_zip("keys", "input_ids", "labels", "attention_mask")).alias("x"))
    seen = F.size(F.filter("x.attention_mask", lambda m: m))
    real = lambda c: F.array_join(F.slice(F.col(f"x.{c}"), F.lit(1), seen), ",")
    return each.select(F.col("x.keys").cast("long").alias("conv_id"), real("input_ids").alias("input_ids"), real("labels").alias("labels"), "within", seen.alias("seen"))


@query("streamed_verdicts", """WITH results AS (
  SELECT c_custkey // 4 AS code_id, c_custkey % 4 + 1 AS idx, CASE WHEN c_nationkey % 5 = 0 THEN 'wrong_answer' WHEN c_nationkey % 7 = 0 THEN 'simulation_timeout' ELSE 'passed' END AS status FROM customer),
numbered AS (SELECT code_id, row_number() OVER (PARTITION BY code_id ORDER BY idx) AS idx, status FROM results),
whole AS (SELECT code_id, count(*) AS total, min(idx) FILTER (status <> 'passed') AS f, arg_min(status, idx) FILTER (status <> 'passed') AS failure_stage FROM numbered GROUP BY 1)
SELECT code_id::BIGINT AS code_id, total::BIGINT AS total, f::BIGINT AS failed_idx, failure_stage, coalesce(f - 1, total)::BIGINT AS passed FROM whole""")  # fmt: skip
def streamed_verdicts(spark, d):
    """Case results of codes that arrive in four files, in no order: each code's verdict, once."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    status = F.when(nation % 5 == 0, "wrong_answer").when(nation % 7 == 0, "simulation_timeout").otherwise("passed")
    rows = X.table(spark, d, "customer").select(F.floor(key / 4).cast("long").alias("code_id"), (key % 4 + 1).alias("n"), status.alias("status"))
    own = F.array_sort(F.collect_list(F.struct("n", "status")))
    cases = rows.groupBy("code_id").agg(own.alias("own")).select("code_id", F.size("own").cast("long").alias("total"), F.posexplode("own").alias("idx", "own"))
    cases = cases.select("code_id", "total", (F.col("idx") + 1).cast("long").alias("idx"), "own.status")
    source, out = scratch_path(spark, "results"), scratch_path(spark, "verdicts")
    cases.repartition(4, F.xxhash64("code_id", "idx")).write.json(source)
    schema = "code_id long, total long, idx long, status string"
    stream = verdicts.first_failures(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(verdicts.OUT).parquet(out)


@query("stream_progress", """SELECT k AS batch, count(*) AS rows, (count(*) FILTER (c_custkey % 3 = k)) AS done, sum(c_nationkey % 2)::BIGINT AS retries, (SELECT count(*) FROM customer WHERE c_custkey % 3 <= k) AS total_done
FROM customer, range(3) t(k) WHERE c_custkey % 3 <= k GROUP BY k""")  # fmt: skip
def stream_progress(spark, d):
    """Three files, each with all rows of those before: what each batch brought, and what was new."""
    source, out = scratch_path(spark, "arriving"), scratch_path(spark, "appended")
    rows = X.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 2).cast("long").alias("retries"))
    for k in range(3):
        sinks.write_single(rows.where(F.col("c_custkey") % 3 <= k), f"{source}/{k}.json")
    resume.stream_results(spark, source, "c_custkey long, retries long", lambda x: x, out, scratch_path(spark, "checkpoint"), "c_custkey", files=1).awaitTermination()
    return resume.batch_progress(spark, out).select("batch", "rows", "done", "retries", "total_done")
