"""Adaptive generation, padded batches, streams of results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.functions.python_text import token_counter
from patchloom.operators import chat, generate, verify
from patchloom.sources.scratch import scratch_path
from patchloom.streaming import verdicts


def test_batches_adapt():
    sizes = []

    def generator(prompts):
        sizes.append(len(prompts))
        if len(prompts) > 3 and "x" in prompts:
            raise generate.BatchTooLarge
        return [p.upper() for p in prompts]

    rows = [(str(i), "x" if i < 9 else "y") for i in range(40)]
    got = [r for batch in generate.adaptive(iter(rows), generator, 8) for r in batch]
    assert [(r["key"], r["output"]) for r in got] == [(k, p.upper()) for k, p in rows]
    # halved until it fits, one more after each success, and up to the largest again
    assert sizes == [8, 4, 2, 3, 4, 2, 3, 4, 5, 6, 7, 8]
    assert [r["retries"] for r in got][:10] == [2, 2, 0, 0, 0, 1, 1, 0, 0, 0] and max(r["batch_size"] for r in got) == 8
    assert list(generate.adaptive(iter([]), generator, 8)) == []

    def never(prompts):
        raise generate.BatchTooLarge

    with pytest.raises(generate.BatchTooLarge):
        list(generate.adaptive(iter(rows), never, 8))
    with pytest.raises(ValueError):
        list(generate.adaptive(iter(rows), lambda p: p[1:], 8))


def test_generation_goes_on_where_it_stopped(spark):
    prompts = spark.createDataFrame([(f"p{i}", "a" * (i % 7) if i % 5 else None) for i in range(50)], "pair_id string, prompt string")
    done = prompts.where("pair_id < 'p3'").select("pair_id")
    out = generate.generate(prompts, lambda ps: [f"<{p}>" for p in ps], largest=4, done=done, tasks=2).collect()
    left = {r.pair_id: r.prompt or "" for r in prompts.collect()}
    left = {k: v for k, v in left.items() if k >= "p3"}
    assert {r.key: r.output for r in out} == {k: f"<{v}>" for k, v in left.items()} and len(out) == len(left)
    assert all(1 <= r.batch_size <= 4 for r in out)


def test_padded_batches(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(1, 9) for _ in range(n)], [rng.choice([-100, 5]) for _ in range(n)]) for i, n in enumerate([0, 0, 1, 100, *(rng.randint(1, 60) for _ in range(200))])]
    df = spark.createDataFrame(rows, "k long, input_ids array<int>, labels array<int>").repartition(3)
    batches = generate.padded_batches(df, "k", 256, 0).collect()
    seen = {}
    for b in batches:
        assert b.rows * b.longest <= 256 and b.tokens + b.padding == b.rows * b.longest == np.array(b.input_ids).size
        for k, ids, labels, mask in zip(b["keys"], b.input_ids, b.labels, b.attention_mask, strict=True):
            n = sum(mask)
            assert mask == [True] * n + [False] * (b.longest - n) and ids[n:] == [0] * (b.longest - n) and labels[n:] == [-100] * (b.longest - n)
            seen[int(k)] = (int(k), ids[:n], labels[:n])
    assert sorted(seen.values()) == sorted(rows) and sum(b.rows for b in batches) == len(rows)
    assert sum(b.padding for b in batches) < 0.25 * sum(b.tokens for b in batches)
    assert max(b.rows for b in generate.padded_batches(df, "k", 256, 0, most=3).collect()) <= 3
    with pytest.raises(Exception, match="cells"):
        generate.padded_batches(df, "k", 99, 0).collect()
    assert generate.padded_batches(df.limit(0), "k", 9, 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_verdicts_of_a_stream_in_any_order(spark, seed):
    rng, rows = random.Random(seed), []
    for code in range(30):
        total = rng.randint(1, 6)
        rows += [(code, i, rng.choice(["passed", "passed", "passed", "bad", "late"]), total) for i in range(1, total + 1)]
    rng.shuffle(rows)
    schema = "code_id long, idx long, status string, total long"
    source, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").json(source)
    stream = verdicts.first_failures(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(verdicts.OUT).parquet(out)
    want = verify.first_failure(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.groupBy("code_id").count().where(F.col("count") > 1).count() == 0


def test_verdicts_of_many_codes_take_few_calls(spark, monkeypatch):
    """Ids of all kinds (below 0, far apart, none), and a call of Python for many codes."""
    rng, rows = random.Random(4), []
    for code in [None, -(2**62), 2**62, *range(-300, 4000)]:
        total = rng.randint(1, 4)
        rows += [(code, i, rng.choice(["passed", "passed", "bad", "late"]), total) for i in range(1, total + 1)]
    rng.shuffle(rows)
    schema = "code_id long, idx long, status string, total long"
    source, out, counted = scratch_path(spark, "in"), scratch_path(spark, "out"), spark.sparkContext.accumulator(0)
    for i in range(2):
        spark.createDataFrame(rows[i::2], schema).coalesce(1).write.mode("append").json(source)
    one = verdicts._verdicts

    def watched(key, frames, state):
        counted.add(1)
        return one(key, frames, state)

    monkeypatch.setattr(verdicts, "_verdicts", watched)
    stream = verdicts.first_failures(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(verdicts.OUT).parquet(out)
    want = verify.first_failure(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert 0 < counted.value < 100  # was one for each code and batch


def test_tokens_of_a_tokenizer_file(spark):
    known = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = str(known.path("byte_bpe_50k.json"))
    texts = ["", None, "module top; endmodule", "Straße 日本 <|im_start|>", "a" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", token_counter(path)(F.col("t")).alias("n")).collect()}
    one = tokenizers.Tokenizer.from_file(path)
    assert got == {i: len(one.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    chats = df.select("i", F.array(F.struct(F.lit("user").alias("role"), F.coalesce("t", F.lit("")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("ok").alias("content"))).alias("messages"))
    counts = {r.i: r for r in chat.token_counts(chats, "i", token_counter(path)).collect()}
    assert counts[2].assistant == len(one.encode("ok", add_special_tokens=False).ids) and counts[2].full > counts[2].input > got[2]
