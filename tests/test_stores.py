"""Stores that grow by batches: segments, verdicts, keys; and the judging of many codes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.operators import verdicts, verify
from patchloom.sources import keys
from patchloom.sources.scratch import scratch_path, written
from patchloom.sources.segments import Segments

CODES = "problem_id long, code_hash string, code string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# segments


def test_segments_merge_and_recover(spark):
    path = scratch_path(spark, "segments")
    last = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    opened = lambda **more: Segments(spark, path, "k BIGINT, v BIGINT", ["k"], last, fanout=2, **more)
    for i in range(7):
        s = opened(buckets=3)
        assert s.batches() == i
        s.write(spark.range(i, i + 4).select(F.col("id").alias("k"), F.lit(i).cast("long").alias("v")), s.next("rows"))
        s.commit()
        s.close()
    s = opened()
    assert s.buckets == 3 and [x[1:] for x in s.spans] == [(0, 3), (4, 5), (6, 6)]
    found = {r.k: r.v for t in s.segments() for r in t.collect()}
    assert found == {k: min(k, 6) for k in range(10)}
    # what was merged and what is not whole goes
    spark.range(3).write.parquet(f"{s.root}/l0-0-0-rows")
    spark.range(3).write.parquet(f"{s.root}/l0-7-7-other")
    assert opened().spans == s.spans and len(opened()._below(s.root)) == 3
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(f"{path}/foreign")
        opened()


# verdicts


def test_codes_of_a_crowded_problem_spread(spark):
    codes = spark.range(400).select(F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id")).cast("long").alias("problem_id"), F.col("id").cast("string").alias("code_hash"), F.col("id").cast("string").alias("code"))
    hot = {r.problem_id: r.pieces for r in verify.crowded(codes, least=16).collect()}
    assert hot == {1000: 13}
    assert verify.crowded(codes, least=1, most=4).collect()[0].pieces == 2  # fewer than `most` groups more, whatever the input
    cases = spark.createDataFrame([(1000, "b", {"f": b"x"}), (1000, "a", None)], "problem_id long, name string, files map<string,binary>")

    def runner(code, case):
        assert case["files"] is None or case["files"] == {"f": b"x"}
        return {"status": "passed"} if int(code) % 4 or case["name"] == "a" else {"status": "bad", "detail": code}

    judged = verify.judge(codes, cases, runner, least=16)
    out = {int(r.code_hash): r for r in judged.collect()}
    assert len(out) == 400
    for i, r in out.items():
        want = ("UNVERIFIED", 0, 0, None) if i % 2 else ("FAIL", 1, 2, "b") if i % 4 == 0 else ("AC", 2, 2, None)
        assert (r.status, r.passed_testcases, r.total_testcases, r.failed_testcase) == want
    sizes = [r.n for r in codes.join(verify.crowded(codes, least=16), "problem_id").groupBy(F.pmod(F.xxhash64("code_hash"), F.col("pieces"))).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 13 and max(sizes) < 40
    with pytest.raises(Exception, match="no testcases"):
        verify.judge(codes, cases, runner, strict=True).collect()
    with pytest.raises(ValueError, match="no testcases"):
        verify.judge_factory(codes, cases, runner)
    assert verify.judge(codes.limit(0), cases, runner).count() == 0


def timed_runner(seconds):
    return lambda code, case: {"status": "passed", "phases": [{"timeout": code == "late", "seconds": seconds[code]}]}


def test_verdicts_are_taken_from_the_store_while_they_hold(spark):
    path, here = scratch_path(spark, "verdicts"), verdicts.conditions(data="a", judge="b")
    assert spark.range(1).select(here == verdicts.conditions(judge="b", data="a")).head()[0]
    cases = spark.createDataFrame([(1, "c")], "problem_id long, name string")
    codes = spark.createDataFrame([(1, "h1", "quick"), (1, "h2", "slow"), (1, "h3", "late"), (1, "h1", "quick")], CODES)
    runner = timed_runner({"quick": 1.0, "slow": 5.0, "late": 30.0})
    store = lambda: verdicts.VerdictStore(spark, path, buckets=2, fanout=3)
    run = lambda limit, name, marks=here: {r.code_hash: r.reused for r in verdicts.judge_again(codes, cases, runner, store(), limit, marks, name).collect()}
    assert run(30, "1") == {"h1": False, "h2": False, "h3": False}
    assert run(30, "2") == {"h1": True, "h2": True, "h3": True}
    assert run(3, "3") == {"h1": True, "h2": False, "h3": True}  # what took longer than the limit is judged again; a time-out stands
    assert run(60, "4") == {"h1": False, "h2": False, "h3": False}  # judged under a shorter limit
    assert run(60, "5", verdicts.conditions(data="c", judge="b")) == {"h1": False, "h2": False, "h3": False}
    assert run(3, "6") == {"h1": True, "h2": False, "h3": True}
    assert len(store().spans) < 6


def test_a_second_run_judges_new_codes_alone_and_the_store_is_not_shuffled(spark, tmp_path):
    path, here = scratch_path(spark, "verdicts"), verdicts.conditions(data="a")
    cases = spark.createDataFrame([(p, "c") for p in range(5)], "problem_id long, name string")
    codes = lambda n: spark.range(n).select((F.col("id") % 5).alias("problem_id"), F.sha2(F.col("id").cast("string"), 256).alias("code_hash"), F.col("id").cast("string").alias("code"))
    seen = str(tmp_path / "seen")

    def runner(code, case):
        with open(seen, "a") as f:
            f.write(code + "\n")
        return {"status": "passed"}

    verdicts.judge_again(codes(60), cases, runner, verdicts.VerdictStore(spark, path), 1, here, "1")
    first = open(seen).read().split()
    assert sorted(map(int, first)) == list(range(60))
    again = verdicts.judge_again(codes(80), cases, runner, verdicts.VerdictStore(spark, path), 1, here, "2")
    assert sorted(map(int, open(seen).read().split()[60:])) == list(range(60, 80))
    assert {(r.reused, r.n) for r in again.groupBy("reused").agg(F.count("*").alias("n")).collect()} == {(True, 60), (False, 20)}
    store = verdicts.VerdictStore(spark, path)
    dealt, _ = store.dealt(codes(80))
    looked = plan(store.lookup(dealt, 1, here))
    assert looked.count("SortMergeJoin") == 2 and "Exchange" not in looked


# keys


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    for n in (0, 1, 5000):
        bits = keys.bloom(h[:n])
        assert keys.may_hold(bits, h[:n]).all()
        assert keys.may_hold(bits, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.001


def read(spark, path):
    return sorted((r.k, r.v) for r in spark.read.schema("k string, v long").json(path).collect())


def test_appends_stay_cheap(spark):
    path = scratch_path(spark, "appended")
    filters, files = [], []
    for i in range(30):
        index = keys.KeyIndex(spark, f"{path}.keys", fanout=3)
        batch = spark.range(i * 100, i * 100 + 100).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
        batch = batch.unionByName(batch.limit(10)).unionByName(spark.createDataFrame([("0", -1)], "k string, v long") if i else batch.limit(0))
        assert keys.append_new(batch, path, "k", index) == 100
        filters.append(index.filters_read)
        files.append(index.files_read)
    assert read(spark, path) == sorted((str(k), k) for k in range(3000))
    # one old key a batch: the file that has it is opened, and hardly any other
    assert sum(files) <= 29 + 6 and max(files) <= 3
    assert max(filters) <= 3 * 2 + 3


def test_appends_to_large_runs_open_the_files_of_their_keys(spark):
    path = scratch_path(spark, "large")
    index = keys.KeyIndex(spark, path, file_keys=100)
    hashed = lambda ids: written(ids.select(F.xxhash64(F.col("id").cast("string")).alias("h"), F.col("id").cast("string").alias("key")), "hashed")
    index.add(hashed(spark.range(5000)), 5000)
    assert sorted(r.key for r in index.unseen(hashed(spark.range(4998, 5003))).collect()) == ["5000", "5001", "5002"]
    assert index.filters_read <= 5 and index.files_read <= 3
    assert index.unseen(hashed(spark.range(5000))).count() == 0 and index.files_read >= 50


def test_appends_that_were_cut_off(spark):
    path = scratch_path(spark, "cut")
    row = lambda k: spark.createDataFrame([(k, 1)], "k string, v long")
    assert keys.append_new(row("a"), path, "k") == 1
    index = keys.KeyIndex(spark, f"{path}.keys")
    # staged, no run: nothing was appended
    row("b").write.json(f"{path}.keys/staged-1")
    assert keys.append_new(row("a"), path, "k") == 0
    assert read(spark, path) == [("a", 1)]
    # staged and indexed, not moved: the next call moves it
    row("b").write.json(f"{path}.keys/staged-1")
    index = keys.KeyIndex(spark, f"{path}.keys")
    index.add(row("b").select(F.xxhash64("k").alias("h"), F.col("k").alias("key")), 1)
    assert keys.append_new(row("b").unionByName(row("c")), path, "k") == 1
    assert read(spark, path) == [("a", 1), ("b", 1), ("c", 1)]


def test_appends_to_a_table_without_an_index_and_odd_keys(spark):
    path = scratch_path(spark, "old")
    spark.createDataFrame([("a", 1), (None, 2)], "k string, v long").write.option("ignoreNullFields", "false").json(path)
    rows = spark.createDataFrame([("a", 3), (None, 4), ("", 5), ("", 5)], "k string, v long").withColumn("h", F.lit("theirs")).withColumn("key", F.lit("theirs"))
    assert keys.append_new(rows, path, "k") == 1
    assert [(r.k, r.v) for r in spark.read.schema("k string, v long").json(path).where("v = 5").collect()] == [("", 5)]
    assert keys.append_new(rows.limit(0), path, "k") == 0
