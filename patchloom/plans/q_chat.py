"""Queries of the conversion, verification and evaluation stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import chat, filters, reports, verdicts, verify
from patchloom.plans import fixtures as X
from patchloom.plans.q_pairs import BLANK
from patchloom.plans.registry import query
from patchloom.sources.scratch import scratch_path
from patchloom.streaming import resume

_USER = f"'Problem specification:' || chr(10) || coalesce(description, 'None') || chr(10) || chr(10) || '{chat.MARK}' || chr(10) || '```verilog' || chr(10) || buggy_code || chr(10) || '```'"


@query("chat_rows", f"""WITH {X.CATALOG}, {X.PAIRS} SELECT pair_id, pairs.problem_id, 'system,user,assistant' AS roles, sha256('{chat.SYSTEM}' || {_USER} || fixed_code) AS digest
FROM pairs JOIN catalog ON catalog.id = pairs.problem_id""")  # fmt: skip
def chat_rows(spark, d):
    rows = chat.strict_rows(chat.chat_rows(X.pairs(spark, d), X.catalog(spark, d), strict=False))
    text = lambda f: F.array_join(F.transform("messages", lambda m: m[f]), "," if f == "role" else "")
    return rows.select("pair_id", "problem_id", text("role").alias("roles"), F.sha2(text("content"), 256).alias("digest"))


@query("chat_codes", f"""WITH {X.CATALOG}, {X.PAIRS} SELECT pair_id, trim(buggy_code, {BLANK}) || chr(10) AS buggy_code, trim(fixed_code, {BLANK}) || chr(10) AS fixed_code
FROM pairs WHERE problem_id IN (SELECT id FROM catalog)""")  # fmt: skip
def chat_codes(spark, d):
    known = filters.of_problems(X.pairs(spark, d), X.catalog(spark, d).select(F.col("id").alias("problem_id")))
    return chat.codes_of(chat.chat_rows(known, X.catalog(spark, d))).select("pair_id", "buggy_code", "fixed_code")


@query("missing_catalog", f"WITH {X.CATALOG}, {X.PAIRS} SELECT pair_id FROM pairs WHERE problem_id NOT IN (SELECT id FROM catalog)")
def missing_catalog(spark, d):
    return chat.missing_catalog(X.pairs(spark, d), X.catalog(spark, d)).select("pair_id")


@query("chat_role_check", f"WITH {X.CHATS} SELECT conv_id, list_transform(messages, lambda m: m.role) = ['system', 'user', 'assistant'] AS as_expected FROM chats")
def chat_role_check(spark, d):
    return X.chats(spark, d).select("conv_id", filters.roles_are(F.col("messages"), "system", "user", "assistant").alias("as_expected"))


_COUNT = r"len(regexp_extract_all(coalesce({0}, ''), '\S+'))"
_RENDER = "array_to_string(list_transform({0}, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')"
COUNTS = f"""{X.CHATS}, last_at AS (SELECT *, list_max(list_transform(list_filter(range(1, len(messages) + 1), lambda i: messages[i].role = 'assistant'), lambda i: i)) AS place FROM chats),
counts AS (SELECT conv_id, {_COUNT.format(_RENDER.format('messages[1:place - 1]') + " || '<|im_start|>assistant' || chr(10)")}::INT AS input, {_COUNT.format('messages[place].content')}::INT AS assistant,
  {_COUNT.format(_RENDER.format('messages'))}::INT AS "full" FROM last_at WHERE place IS NOT NULL)"""
MEASURES = ["input", "assistant", "full"]
LIMITS = [128, 256, 512, 1024]


def _counts(spark, d):
    return chat.token_counts(X.chats(spark, d), "conv_id")


@query("token_counts", f"WITH {COUNTS} SELECT * FROM counts")
def token_counts(spark, d):
    return _counts(spark, d)


@query("first_turn_counts", f"""WITH {COUNTS.replace("list_max", "list_min")}, kept AS (SELECT conv_id, input, assistant FROM counts WHERE "full" <= 512)
SELECT *, TRUE AS kept FROM kept UNION ALL SELECT conv_id, input, assistant, FALSE FROM counts WHERE "full" > 512""")  # fmt: skip
def first_turn_counts(spark, d):
    """Training's view: what stands before the first answer; rows that are too long are set apart; sorted by length."""
    kept, dropped = chat.within_length(chat.token_counts(X.chats(spark, d), "conv_id", which="first"), "full", 512)
    out = chat.by_length(kept, "input", "conv_id").withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))
    return out.select("conv_id", "input", "assistant", "kept")


@query("token_stats", f"""WITH {COUNTS}, long AS (SELECT 'input' AS measure, input::DOUBLE AS v FROM counts UNION ALL SELECT 'assistant', assistant FROM counts UNION ALL SELECT 'full', "full" FROM counts)
SELECT measure, count(*)::BIGINT AS n, min(v) AS least, round(avg(v), 2) AS mean, max(v) AS most, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.9), 2) AS p90,
  round(quantile_cont(v, 0.95), 2) AS p95, round(quantile_cont(v, 0.99), 2) AS p99, round(quantile_cont(v, 0.995), 2) AS p99_5 FROM long GROUP BY 1""")  # fmt: skip
def token_stats(spark, d):
    return chat.token_stats(_counts(spark, d), MEASURES)


@query("coverage", f"""WITH {COUNTS}, limits AS (SELECT unnest([128, 256, 512, 1024]) AS token_limit)
SELECT token_limit::INT AS token_limit, (SELECT count(*) FROM counts WHERE "full" <= token_limit)::BIGINT AS covered,
  round(100 * (SELECT count(*) FROM counts WHERE "full" <= token_limit)::DOUBLE / greatest((SELECT count(*) FROM counts), 1), 2) AS percent FROM limits""")  # fmt: skip
def coverage(spark, d):
    return chat.coverage(_counts(spark, d), "full", LIMITS)


@query("recommended_len", f"""WITH {COUNTS} SELECT round(quantile_cont("full", 0.99), 2) AS at, (ceil(quantile_cont("full", 0.99) / 256) * 256)::BIGINT AS recommended FROM counts""")
def recommended_len(spark, d):
    return chat.recommended_limit(_counts(spark, d), "full")


@query("token_anomalies", f"""WITH {COUNTS} SELECT *, array_to_string(list_transform([128, 256, 512, 1024], lambda x: ("full" <= x)::VARCHAR), ',') AS covered
FROM counts WHERE "full" >= (SELECT quantile_cont("full", 0.99) FROM counts)""")  # fmt: skip
def token_anomalies(spark, d):
    out = chat.anomalies(_counts(spark, d), "full", LIMITS)
    return out.withColumn("covered", F.array_join(F.transform("covered", lambda x: x.cast("string")), ","))


@query("mask_labels", """WITH ids AS (SELECT conv_id, list(length(text)::INT ORDER BY turn) FILTER (role <> 'assistant') AS p, list(length(text)::INT ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_concat(coalesce(p, []), coalesce(a, []), [2]), ',') AS input_ids, array_to_string(list_concat(list_transform(coalesce(p, []), lambda x: -100), coalesce(a, []), [2]), ',') AS labels FROM ids""")  # fmt: skip
def mask_labels(spark, d):
    turns = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("ts"))
    part = lambda own: F.transform(F.filter("ts", lambda t: (t["role"] == "assistant") == own), lambda t: t["n"])
    ids, labels = chat.mask_labels(part(F.lit(False)), part(F.lit(True)), 2)
    return turns.select("conv_id", F.array_join(ids, ",").alias("input_ids"), F.array_join(labels, ",").alias("labels"))


@query("until_end", """WITH ids AS (SELECT user_id, list(event_id % 7 ORDER BY event_id) AS x FROM events GROUP BY 1)
SELECT user_id, array_to_string(CASE WHEN list_position(x, 3) > 0 THEN x[1:list_position(x, 3) - 1] ELSE x END, ',') AS ids FROM ids""")  # fmt: skip
def until_end(spark, d):
    ids = X.table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x % 7).alias("x"))
    return ids.select("user_id", F.array_join(chat.until_end(F.col("x"), 3), ",").alias("ids"))


@query("warmup_steps", "SELECT p_partkey, greatest(1, floor(ceil(p_partkey / 32.0::DOUBLE) * 2 * 0.03::DOUBLE))::BIGINT AS steps FROM part")
def warmup_steps(spark, d):
    return X.table(spark, d, "part").select("p_partkey", chat.warmup_steps(F.col("p_partkey")).alias("steps"))


CATEGORY = """CASE WHEN {0} <> 'AC' AND {1} = 'AC' THEN 'valid_fail_to_ac' WHEN {0} = 'AC' AND {1} = 'AC' THEN 'both_ac'
  WHEN {0} <> 'AC' AND {1} <> 'AC' THEN 'both_fail' ELSE 'buggy_ac_fixed_fail' END"""
JUDGED = """CASE WHEN contains({0}, 'timeout') OR contains({1}, 'timeout') THEN 'timeout_unresolved' WHEN {0} <> 'passed' AND {1} = 'passed' THEN 'valid_fail_to_pass'
  WHEN {0} = 'passed' AND {1} = 'passed' THEN 'both_passed' WHEN {0} = 'passed' THEN 'pass_to_fail' ELSE 'both_failed' END"""
AUDIT = f"""{X.RUNS}, sides AS (
  SELECT r.pair_id, r.problem_id, CASE coalesce(base_status, 'wrong_answer') WHEN 'AC' THEN 'passed' ELSE coalesce(base_status, 'wrong_answer') END AS b,
    CASE coalesce(tuned_status, 'wrong_answer') WHEN 'AC' THEN 'passed' ELSE coalesce(tuned_status, 'wrong_answer') END AS f, p.buggy_code = p.fixed_code AS same,
    count(*) OVER (PARTITION BY p.fixed_code) > 1 AS again FROM runs r JOIN pairs p ON p.pair_id = r.pair_id),
audit AS (
  SELECT *, {JUDGED.format('b', 'f')} AS category, list_filter([CASE WHEN same THEN 'identical_code' END, CASE WHEN again THEN 'duplicate_pair_id' END,
    CASE WHEN contains(b, 'timeout') THEN 'buggy_timeout' END, CASE WHEN contains(f, 'timeout') THEN 'fixed_timeout' END,
    CASE WHEN b = 'passed' THEN 'buggy_passed' END, CASE WHEN f <> 'passed' THEN 'fixed_not_passed' END], lambda x: x IS NOT NULL) AS issues FROM sides)"""
CATEGORIES = ["timeout_unresolved", "valid_fail_to_pass", "both_passed", "pass_to_fail", "both_failed"]


def _audit(spark, d):
    side = lambda c: F.when(F.coalesce(c, F.lit("wrong_answer")) == "AC", "passed").otherwise(F.coalesce(c, F.lit("wrong_answer")))
    rows = X.runs(spark, d).join(X.pairs(spark, d).select("pair_id", "buggy_code", "fixed_code"), "pair_id")
    again = rows.groupBy("fixed_code").agg((F.count("*") > 1).alias("again"))
    rows = rows.join(again, "fixed_code").withColumn("b", side("base_status")).withColumn("f", side("tuned_status"))
    rows = rows.withColumn("issues", verify.issues(F.col("buggy_code") == F.col("fixed_code"), F.col("again"), F.col("b"), F.col("f")))
    return rows.withColumn("category", verify.category(F.col("b"), F.col("f"), by_judge=True))


@query("pair_category", f"""WITH {X.RUNS} SELECT pair_id, {CATEGORY.format("coalesce(base_status, 'FAIL')", "coalesce(tuned_status, 'FAIL')")} AS category FROM runs""")
def pair_category(spark, d):
    known = lambda c: F.coalesce(c, F.lit("FAIL"))
    return X.runs(spark, d).select("pair_id", verify.category(known("base_status"), known("tuned_status")).alias("category"))


@query("audit_rows", f"WITH {AUDIT} SELECT pair_id, category, array_to_string(issues, ',') AS issues, len(issues) > 0 OR category <> 'valid_fail_to_pass' AS anomalous FROM audit")
def audit_rows(spark, d):
    return _audit(spark, d).select("pair_id", "category", F.array_join("issues", ",").alias("issues"), ((F.size("issues") > 0) | (F.col("category") != "valid_fail_to_pass")).alias("anomalous"))


@query("issue_hist", f"WITH {AUDIT} SELECT issue, count(*)::BIGINT AS n FROM (SELECT unnest(issues) AS issue FROM audit) GROUP BY 1")
def issue_hist(spark, d):
    return reports.issue_histogram(_audit(spark, d))


_COLS = ", ".join(f"(count(*) FILTER (category = '{c}'))::BIGINT AS {c}" for c in CATEGORIES)


@query("audit_rollup", f"""WITH {AUDIT}, levels AS (SELECT *, CASE problem_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM audit)
SELECT split, problem_id, {_COLS}, count(*)::BIGINT AS total FROM levels GROUP BY ROLLUP (split, problem_id)""")  # fmt: skip
def audit_rollup(spark, d):
    split = F.when(F.col("problem_id") % 3 == 0, "train").when(F.col("problem_id") % 3 == 1, "dev").otherwise("test")
    return reports.audit_rollup(_audit(spark, d).withColumn("split", split), ["split", "problem_id"], CATEGORIES)


@query("audit_pivot", f"WITH {AUDIT} SELECT problem_id, {_COLS}, count(*)::BIGINT AS total FROM audit GROUP BY 1")
def audit_pivot(spark, d):
    return reports.audit_pivot(_audit(spark, d), "problem_id", CATEGORIES)


_RESULTS = """results AS (SELECT l_orderkey AS code_id, l_linenumber AS idx, CASE WHEN l_quantity < 8 THEN 'wrong_answer' WHEN l_quantity > 48 THEN 'simulation_timeout' ELSE 'passed' END AS status FROM lineitem),
placed AS (SELECT code_id, row_number() OVER (PARTITION BY code_id ORDER BY idx, status) AS idx, status FROM results)"""


@query("first_failure", f"""WITH {_RESULTS}, firsts AS (SELECT code_id, count(*)::BIGINT AS total, min(idx) FILTER (status <> 'passed') AS failed_idx FROM placed GROUP BY 1)
SELECT f.code_id, total, failed_idx::INT AS failed_idx, p.status AS failure_stage, coalesce(failed_idx - 1, total)::BIGINT AS passed
FROM firsts f LEFT JOIN placed p ON p.code_id = f.code_id AND p.idx = f.failed_idx""")  # fmt: skip
def first_failure(spark, d):
    q = F.col("l_quantity")
    results = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("code_id"), F.col("l_linenumber").alias("idx"), F.when(q < 8, "wrong_answer").when(q > 48, "simulation_timeout").otherwise("passed").alias("status"))
    placed = results.withColumn("idx", F.row_number().over(Window.partitionBy("code_id").orderBy("idx", "status")))
    return verify.first_failure(placed)


def _fake_runner(code: str, case: dict) -> dict:
    seconds = (len(code) + 2 * case["k"]) % 7
    phases = [{"timeout": seconds == 6, "seconds": float(seconds)}]
    if (len(code) + case["k"]) % 3:
        return {"status": "passed", "phases": phases}
    return {"status": "wrong_answer", "stage": "wrong_answer", "detail": code, "phases": phases}


def _cases(spark):
    """Of problem p the cases 0 to p % 4 - 1, three at most."""
    every = spark.range(10).select(F.col("id").alias("problem_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return every.where(F.col("k") < F.col("problem_id") % 4).withColumn("name", F.concat(F.lit("case"), F.col("k")))


@query("verdict_memo", f"""WITH {X.PAIRS}, codes AS (
  SELECT DISTINCT problem_id, code FROM (SELECT problem_id, buggy_code AS code FROM pairs UNION ALL SELECT problem_id, fixed_code FROM pairs)),
cases AS (SELECT p AS problem_id, k FROM range(0, 10) t(p), range(0, 3) u(k) WHERE k < p % 4),
verdicts AS (
  SELECT c.problem_id, c.code, count(k) AS total, min(k) FILTER ((length(c.code) + k) % 3 = 0) AS failed FROM codes c LEFT JOIN cases s ON s.problem_id = c.problem_id GROUP BY 1, 2),
named AS (SELECT *, CASE WHEN total = 0 THEN 'UNVERIFIED' WHEN failed IS NULL THEN 'AC' ELSE 'FAIL' END AS status FROM verdicts)
SELECT pair_id, b.status AS buggy, f.status AS fixed, coalesce(f.failed, f.total)::INT AS fixed_passed
FROM pairs p JOIN named b ON b.problem_id = p.problem_id AND b.code = p.buggy_code JOIN named f ON f.problem_id = p.problem_id AND f.code = p.fixed_code""")  # fmt: skip
def verdict_memo(spark, d):
    pairs = X.pairs(spark, d)
    judged = verify.judge(verify.memo_codes(pairs), _cases(spark), _fake_runner)
    return verify.with_verdicts(pairs, judged).select("pair_id", F.col("buggy.status").alias("buggy"), F.col("fixed.status").alias("fixed"), F.col("fixed.passed_testcases").alias("fixed_passed"))


@query("verify_pairs", f"""WITH {X.PAIRS}, cases AS (SELECT p AS problem_id, k FROM range(0, 10) t(p), range(0, 3) u(k) WHERE k < p % 4),
reasons AS (SELECT p AS problem_id, CASE WHEN p % 4 = 0 THEN 'ambiguous_problem_mapping' END AS reason FROM range(0, 10) t(p)),
known AS (SELECT p.*, CASE WHEN r.problem_id IS NULL THEN 'testbench_not_found' ELSE reason END AS reason FROM pairs p LEFT JOIN reasons r ON r.problem_id = p.problem_id),
judged AS (SELECT *, (SELECT min(k) FROM cases c WHERE c.problem_id = known.problem_id AND (length(buggy_code) + k) % 3 = 0) AS b,
  (SELECT min(k) FROM cases c WHERE c.problem_id = known.problem_id AND (length(fixed_code) + k) % 3 = 0) AS f FROM known)
SELECT pair_id, problem_id, CASE WHEN reason IS NULL THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, reason, CASE WHEN reason IS NULL THEN b IS NOT NULL AND f IS NULL END AS valid_repair,
  CASE WHEN reason IS NULL AND f IS NOT NULL THEN 'case' || f END AS failed FROM judged""")  # fmt: skip
def verify_pairs(spark, d):
    selected = spark.range(10).select(F.col("id").alias("problem_id"), F.when(F.col("id") % 4 == 0, "ambiguous_problem_mapping").alias("reason"))
    out = verify.verify_pairs(X.pairs(spark, d), selected, _cases(spark), _fake_runner)
    return out.select("pair_id", "problem_id", "status", "reason", "valid_repair", F.col("fixed.failed_testcase").alias("failed"))


@query("judge_factory", """WITH codes AS (SELECT s_suppkey % 3 AS problem_id, s_name AS code, s_suppkey FROM supplier),
failed AS (SELECT c.*, (SELECT min(k) FROM range(0, 2) t(k) WHERE (length(code) + k) % 3 = 0) AS f FROM codes c)
SELECT s_suppkey::VARCHAR AS code_hash, CASE WHEN f IS NULL THEN 'AC' ELSE 'FAIL' END AS status, coalesce(f, 2)::INT AS passed_testcases FROM failed""")  # fmt: skip
def judge_factory(spark, d):
    rows = X.table(spark, d, "supplier").select((F.col("s_suppkey") % 3).alias("problem_id"), F.col("s_suppkey").cast("string").alias("code_hash"), F.col("s_name").alias("code"))
    cases = spark.range(3).select(F.col("id").alias("problem_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("name", F.concat(F.lit("case"), F.col("k")))
    _, judged = verify.judge_factory(rows, cases, _fake_runner)
    return judged(rows).select("code_hash", "status", "passed_testcases")


@query("stored_verdicts", f"""WITH {X.PAIRS}, cases AS (SELECT p AS problem_id, k FROM range(0, 10) t(p), range(0, 3) u(k) WHERE k < p % 4),
sides AS (SELECT problem_id, buggy_code AS code, 'first' AS run FROM pairs UNION ALL SELECT problem_id, fixed_code, 'second' FROM pairs),
codes AS (SELECT problem_id, code, min(run) AS run FROM sides GROUP BY 1, 2),
judged AS (
  SELECT c.*, (SELECT min(k) FROM cases s WHERE s.problem_id = c.problem_id AND (length(code) + k) % 3 = 0) AS failed,
    (SELECT count(*) FROM cases s WHERE s.problem_id = c.problem_id) AS total FROM codes c),
timed AS (
  SELECT j.*, (SELECT coalesce(bool_and((length(code) + 2 * k) % 7 = 6 OR (length(code) + 2 * k) % 7 <= 3), TRUE)
    FROM cases s WHERE s.problem_id = j.problem_id AND k <= coalesce(failed, 9)) AS quick FROM judged j)
SELECT problem_id, sha256(problem_id || ':' || code) AS mark, CASE WHEN total = 0 THEN 'UNVERIFIED' WHEN failed IS NULL THEN 'AC' ELSE 'FAIL' END AS status,
  coalesce(failed, total)::INT AS passed_testcases, run = 'first' AND quick AS reused, CASE WHEN run = 'first' AND quick THEN 10 ELSE 3 END::DOUBLE AS "limit" FROM timed""")  # fmt: skip
def stored_verdicts(spark, d):
    """A run judges the buggy codes within 10 seconds, the next one all codes within 3: it takes from the first what took
    no longer or timed out, and judges the rest. A run under other conditions lies in the store and does not count."""
    pairs, cases = X.pairs(spark, d), _cases(spark)
    path, now = scratch_path(spark, "verdicts"), verdicts.conditions(data="pairs", judge="fake")
    buggy = verify.memo_codes(pairs.withColumn("fixed_code", F.col("buggy_code")))
    verdicts.judge_again(buggy, cases, _fake_runner, verdicts.VerdictStore(spark, path), 10, now, "run 1")
    verdicts.judge_again(buggy, cases, _other_runner, verdicts.VerdictStore(spark, path), 10, verdicts.conditions(data="others"), "run 2")
    codes = verify.memo_codes(pairs)
    out = verdicts.judge_again(codes, cases, _fake_runner, verdicts.VerdictStore(spark, path), 3, now, "run 3").join(codes, ["problem_id", "code_hash"])
    mark = F.sha2(F.concat_ws(":", "problem_id", "code"), 256).alias("mark")
    return out.select("problem_id", mark, "status", "passed_testcases", "reused", "limit")


def _other_runner(code: str, case: dict) -> dict:
    return {"status": "passed"}


@query("crowded_problem", """WITH codes AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_orderkey % 50 END AS problem_id, o_orderkey::VARCHAR AS code FROM orders),
failed AS (SELECT c.*, (SELECT min(k) FROM range(0, 2) t(k) WHERE (length(code) + k) % 3 = 0) AS f FROM codes c)
SELECT o_orderkey::VARCHAR AS code_hash, problem_id::BIGINT AS problem_id, CASE WHEN f IS NULL THEN 'AC' ELSE 'FAIL' END AS status, coalesce(f, 2)::INT AS passed_testcases,
  CASE WHEN f IS NOT NULL THEN code END AS detail FROM failed""")  # fmt: skip
def crowded_problem(spark, d):
    """A problem that has half of all codes, which several tasks judge; with the detail of each failure."""
    key = F.col("o_orderkey")
    rows = X.table(spark, d, "orders").select(key.cast("string").alias("code_hash"), F.when(key % 2 == 0, 1).otherwise(key % 50).cast("long").alias("problem_id"), key.cast("string").alias("code"))
    cases = spark.range(50).select(F.col("id").alias("problem_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("name", F.concat(F.lit("case"), F.col("k")))
    _, judged = verify.judge_factory(rows, cases, _fake_runner)
    return judged(rows).select("code_hash", "problem_id", "status", "passed_testcases", "detail")


def _run(spark, d, name):
    return X.runs(spark, d).select("pair_id", "problem_id", F.col(f"{name}_status").alias("status"))


_ROLL = "roll AS (SELECT problem_id, count(*)::BIGINT AS total, count(tuned_status)::BIGINT AS completed, (count(*) FILTER (tuned_status = 'AC'))::BIGINT AS repaired FROM runs GROUP BY 1)"


@query("repair_rollup", f"WITH {X.RUNS}, {_ROLL} SELECT *, round(repaired::DOUBLE / total, 6) AS repair_rate FROM roll")
def repair_rollup(spark, d):
    runs = _run(spark, d, "tuned")
    return reports.repair_rollup(runs.select("pair_id", "problem_id"), runs.where("status is not null").select("pair_id", "status")).withColumn("repair_rate", F.round("repair_rate", 6))


@query("repair_overall", f"""WITH {X.RUNS}, {_ROLL}, whole AS (SELECT sum(total)::BIGINT AS total, sum(completed)::BIGINT AS completed, sum(repaired)::BIGINT AS repaired FROM roll)
SELECT *, CASE WHEN completed = total AND total > 0 THEN repaired::DOUBLE / total END AS repair_rate, round(CASE WHEN completed > 0 THEN repaired::DOUBLE / completed ELSE 0 END, 6) AS running_repair_rate FROM whole""")  # fmt: skip
def repair_overall(spark, d):
    runs = _run(spark, d, "tuned")
    out = reports.overall_rate(reports.repair_rollup(runs.select("pair_id", "problem_id"), runs.where("status is not null").select("pair_id", "status")))
    return out.withColumn("running_repair_rate", F.round("running_repair_rate", 6))


_LIFT = f"""{X.CATALOG}, {X.RUNS}, trains AS (SELECT problem_id, least(count(*), 150)::BIGINT AS train FROM pairs WHERE verification IS NOT NULL GROUP BY 1),
counts AS (SELECT problem_id, count(*)::BIGINT AS n, (count(*) FILTER (base_status = 'AC'))::BIGINT AS base_ac, (count(*) FILTER (tuned_status = 'AC'))::BIGINT AS tuned_ac FROM runs GROUP BY 1),
lift AS (
  SELECT c.*, coalesce(name, '') AS name, coalesce(train, 0)::BIGINT AS train, base_ac::DOUBLE / n AS base_rate, tuned_ac::DOUBLE / n AS tuned_rate, 100::DOUBLE * (tuned_ac - base_ac) / n AS lift
  FROM counts c LEFT JOIN catalog ON catalog.id = c.problem_id LEFT JOIN trains t ON t.problem_id = c.problem_id)"""


def _lift(spark, d):
    names = X.catalog(spark, d).select(F.col("id").alias("problem_id"), "name")
    train = X.pairs(spark, d).where("verification is not null").groupBy("problem_id").agg(F.least(F.count("*"), F.lit(150)).alias("train"))
    return reports.problem_lift(_run(spark, d, "base"), _run(spark, d, "tuned"), names, train)


@query("problem_lift", f"WITH {_LIFT} SELECT problem_id, n, base_ac, tuned_ac, name, train, round(base_rate, 6) AS base_rate, round(tuned_rate, 6) AS tuned_rate, round(lift, 6) AS lift, format('{{:+.2f}}', lift) AS points, format('{{:.2f}}%', 100 * base_rate) AS base_percent FROM lift")
def problem_lift(spark, d):
    return _lift(spark, d).withColumn("points", T.signed_points(F.col("lift") / 100)).withColumn("base_percent", T.percent(F.col("base_rate"))).withColumns({c: F.round(c, 6) for c in ("base_rate", "tuned_rate", "lift")})


@query("lift_summary", f"""WITH {_LIFT} SELECT round(sum(base_ac)::DOUBLE / sum(n), 6) AS micro_base, round(sum(tuned_ac)::DOUBLE / sum(n), 6) AS micro_tuned, round(avg(base_rate), 6) AS macro_base, round(avg(tuned_rate), 6) AS macro_tuned,
  (count(*) FILTER (lift > 0))::BIGINT AS up, (count(*) FILTER (lift = 0))::BIGINT AS equal, (count(*) FILTER (lift < 0))::BIGINT AS down FROM lift""")  # fmt: skip
def lift_summary(spark, d):
    out = reports.lift_summary(_lift(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("micro_base", "micro_tuned", "macro_base", "macro_tuned")})


@query("cohort_gain", f"""WITH {_LIFT} SELECT train = 150 AS rich, count(*)::BIGINT AS problems, sum(n)::BIGINT AS n, sum(tuned_ac - base_ac)::BIGINT AS gain,
  round(sum(tuned_ac - base_ac)::DOUBLE / nullif((SELECT sum(tuned_ac - base_ac) FROM lift), 0), 6) AS gain_share FROM lift GROUP BY 1""")  # fmt: skip
def cohort_gain(spark, d):
    return reports.cohort_gain(_lift(spark, d), 150).withColumn("gain_share", F.round("gain_share", 6))


_PASSED = "coalesce({0} = 'AC', FALSE)"


@query("paired_flips", f"""WITH {X.RUNS} SELECT count(*)::BIGINT AS n,
  coalesce(string_agg(pair_id, ',' ORDER BY pair_id) FILTER (NOT {_PASSED.format('base_status')} AND {_PASSED.format('tuned_status')}), '') AS improved,
  coalesce(string_agg(pair_id, ',' ORDER BY pair_id) FILTER ({_PASSED.format('base_status')} AND NOT {_PASSED.format('tuned_status')}), '') AS regressed,
  round(100.0::DOUBLE * (count(*) FILTER (tuned_status = 'AC') - count(*) FILTER (base_status = 'AC')) / count(*), 6) AS delta_points FROM runs""")  # fmt: skip
def paired_flips(spark, d):
    run = lambda n: _run(spark, d, n).select("pair_id", F.coalesce(F.col("status") == "AC", F.lit(False)).alias("passed"))
    out = reports.paired_flips(run("base"), run("tuned"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("improved", "regressed")}).withColumn("delta_points", F.round("delta_points", 6))


@query("run_guard", """WITH a AS (SELECT count(*) AS rows, max(r_name) AS name, NULL::VARCHAR AS adapter, 10 AS timeout FROM region), b AS (SELECT count(*) AS rows, min(r_name) AS name, NULL::VARCHAR AS adapter, 20 AS timeout FROM region)
SELECT array_to_string(list_filter([CASE WHEN a.rows IS DISTINCT FROM b.rows THEN 'rows' END, CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END,
  CASE WHEN a.adapter IS DISTINCT FROM b.adapter THEN 'adapter' END, CASE WHEN a.timeout IS DISTINCT FROM b.timeout THEN 'timeout' END], lambda x: x IS NOT NULL), ',') AS mismatches, FALSE AS ok FROM a, b""")  # fmt: skip
def run_guard(spark, d):
    make = lambda f, t: X.table(spark, d, "region").agg(F.count("*").alias("rows"), f("r_name").alias("name"), F.lit(None).cast("string").alias("adapter"), F.lit(t).alias("timeout"))
    out = filters.run_guard(make(F.max, 10), make(F.min, 20), ["rows", "name", "adapter", "timeout"])
    return out.withColumn("mismatches", F.array_join("mismatches", ","))


@query("run_conditions", """SELECT unnest([1, 2, 3]) AS run, unnest(['', 'resources,timeout,adapter,model_files,versions.torch,tuned_incomplete,tuned_results', 'adapter']) AS mismatches""")
def run_conditions(spark, d):
    """Two runs that may be compared (their maps in another order); one that differs in much; one without an adapter."""
    rows = X.table(spark, d, "region").agg(F.array_sort(F.collect_list("r_name")).alias("pair_ids"))
    pairs = lambda *kv: F.create_map(*map(F.lit, kv))

    def run(adapter=None, timeout=90, files=("/m/a", "1", "/m/b", "2", "/x/c", "3"), torch="2", complete=True, resources=("r", "1", "s", "2"), ids=F.col("pair_ids")):
        fixed = [F.lit("x").alias(k) for k in ("test_sha256", "manifest_sha256", "script_sha256", "iverilog_version")]
        more = {"timeout": F.lit(timeout), "resources": pairs(*resources), "generation": pairs("max_new_tokens", "4096"), "model": F.lit("/m"), "model_files": pairs(*files), "versions": pairs("torch", torch, "other", torch), "mode": F.lit("model"), "adapter": F.lit(adapter).cast("string"), "complete": F.lit(complete), "result_ids": ids}
        return rows.select("pair_ids", *fixed, *[c.alias(k) for k, c in more.items()])

    fine = run("/lora", resources=("s", "2", "r", "1"), files=("/m/b", "2", "/m/a", "1", "/x/c", "4"))
    bad = run(None, 10, files=("/m/a", "9", "/m/b", "2"), torch="1", complete=False, resources=("r", "1"), ids=F.reverse("pair_ids"))
    out = None
    for i, tuned in enumerate((fine, bad, run())):
        one = filters.run_conditions(run(), tuned).select(F.lit(i + 1).alias("run"), F.array_join("mismatches", ",").alias("mismatches"))
        out = one if out is None else out.unionByName(one)
    return out


@query("reuse_guard", """SELECT event_id, (event_type = 'error' OR value <= 50) AND (event_type = 'view' OR user_id % 100 <= 30) AS reusable FROM events""")
def reuse_guard(spark, d):
    phase = lambda t, s: F.struct(t.alias("timeout"), s.cast("double").alias("seconds"))
    kind = F.col("event_type")
    phases = F.array(phase(kind == "error", F.col("value")), F.lit(None).cast("struct<timeout:boolean,seconds:double>"), phase(kind == "view", (F.col("user_id") % 100).cast("double") + 20))
    return X.table(spark, d, "events").select("event_id", filters.may_reuse(phases, F.lit(50.0)).alias("reusable"))


@query("pending_anti", f"WITH {X.RUNS} SELECT pair_id FROM runs WHERE pair_id NOT IN (SELECT pair_id FROM runs WHERE tuned_status IS NOT NULL)")
def pending_anti(spark, d):
    runs = _run(spark, d, "tuned")
    return resume.pending(runs, runs.where("status is not null")).select("pair_id")


@query("run_progress", f"WITH {X.RUNS} SELECT count(*)::BIGINT AS total, count(tuned_status)::BIGINT AS done, round(count(tuned_status)::DOUBLE / count(*), 6) AS share FROM runs")
def run_progress(spark, d):
    runs = _run(spark, d, "tuned")
    return resume.progress(runs, runs.where("status is not null")).withColumn("share", F.round("share", 6))
