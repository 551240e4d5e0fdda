"""Views that stand in for submissions, pairs, runs and the like, made from the driver's tables; each has its CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.sources.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A problem that no catalog has.
OUTSIDE = 1_000_000


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    course = (k % 3).cast("string")
    ext = F.element_at(F.array(F.lit(".v"), F.lit(".SV"), F.lit(".zip"), F.lit("")), (k % 4) + 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("problem_id"), F.col("user_id").alias("student_id"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type").isin("purchase", "click"), 0).otherwise(2).alias("result"),
        F.when(course != "0", course).alias("course_code"), F.col("ts").alias("submitted_at"), F.col("event_id").alias("attachment_id"), ext.alias("ext"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select(F.col("attachment_id").alias("id"), F.concat(F.lit("work"), F.col("attachment_id"), F.col("ext")).alias("filename"))


SUBMISSIONS = """submissions AS (
  SELECT event_id AS id, event_id % 5 AS problem_id, user_id AS student_id,
    CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('purchase', 'click') THEN 0 ELSE 2 END AS result,
    nullif((json_extract_string(props, '$.k')::INT % 3)::VARCHAR, '0') AS course_code, ts AS submitted_at, event_id AS attachment_id,
    ['.v', '.SV', '.zip', ''][json_extract_string(props, '$.k')::INT % 4 + 1] AS ext FROM events),
files AS (SELECT attachment_id AS id, 'work' || attachment_id || ext AS filename FROM submissions)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A problem for each benchmark item: a name and a description; two have none, in one way or another, and one has white space about it."""
    desc = F.when(F.col("item_id") == 3, F.lit(None)).when(F.col("item_id") == 7, F.lit("\t None ")).when(F.col("item_id") == 2, F.concat(F.lit("\t"), "text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("problem "), F.col("item_id")).alias("name"), desc.alias("description"))


def testcases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select((F.col("p_partkey") % 4).alias("problem_id"), F.col("p_partkey").alias("case_id"))


CATALOG = """catalog AS (
  SELECT item_id AS id, 'problem ' || item_id AS name,
    CASE WHEN item_id = 3 THEN NULL WHEN item_id = 7 THEN chr(9) || ' None ' WHEN item_id = 2 THEN chr(9) || text || ' ' ELSE text END AS description FROM benchmark),
testcases AS (SELECT p_partkey % 4 AS problem_id, p_partkey AS case_id FROM part WHERE p_partkey % 3 <> 0)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each part: the code before and after, in seven kinds of change; every label occurs."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(" ", F.lit("module"), "p_name", "p_type", "p_brand").alias("before"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("before").alias("later"))
    rows = parts.join(after, "p_partkey", "left")
    before, which, size = F.col("before"), F.col("p_partkey") % 7, F.col("p_size") % 4
    changed = (
        F.when(which == 0, before).when(which == 1, F.replace(before, F.lit("o"), F.lit("0"))).when(which == 2, F.concat(before, F.lit(";\n")))
        .when(which == 3, F.repeat(F.lit("#"), 60)).when(which == 4, F.replace(before, F.lit(" "), F.lit("  "))).when(which == 5, F.lit(" \n"))
        .otherwise(F.coalesce("later", F.lit("")))
    )
    state = F.when(size == 0, "invalid").when(size == 1, "manual_checked").when(size == 2, "testbench_verified")
    return rows.select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("pair_id"), F.when(F.col("p_partkey") % 11 == 10, OUTSIDE).otherwise(F.col("p_partkey") % 11).alias("problem_id"), (F.col("p_partkey") % 40).alias("student_id"),
        before.alias("buggy_code"), changed.alias("fixed_code"), state.alias("verification"), F.when(F.col("p_partkey") % 29 == 0, False).when(F.col("p_partkey") % 31 == 0, True).alias("valid_repair"),
    )


PAIRS = """parts AS (SELECT p_partkey, p_size, concat_ws(' ', 'module', p_name, p_type, p_brand) AS before FROM part),
pairs AS (
  SELECT 'p' || d.p_partkey AS pair_id, CASE WHEN d.p_partkey % 11 = 10 THEN 1000000 ELSE d.p_partkey % 11 END AS problem_id, d.p_partkey % 40 AS student_id, d.before AS buggy_code,
    CASE d.p_partkey % 7 WHEN 0 THEN d.before WHEN 1 THEN replace(d.before, 'o', '0') WHEN 2 THEN d.before || ';' || chr(10)
      WHEN 3 THEN repeat('#', 60) WHEN 4 THEN replace(d.before, ' ', '  ') WHEN 5 THEN ' ' || chr(10) ELSE coalesce(n.before, '') END AS fixed_code,
    CASE d.p_size % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'manual_checked' WHEN 2 THEN 'testbench_verified' END AS verification,
    CASE WHEN d.p_partkey % 29 = 0 THEN FALSE WHEN d.p_partkey % 31 = 0 THEN TRUE END AS valid_repair
  FROM parts d LEFT JOIN parts n ON n.p_partkey = d.p_partkey + 1),
measured AS (
  SELECT *, levenshtein(translate(buggy_code, chr(13) || chr(10), ''), translate(fixed_code, chr(13) || chr(10), ''))::DOUBLE
    / greatest(length(translate(buggy_code, chr(13) || chr(10), '')), length(translate(fixed_code, chr(13) || chr(10), '')), 1) AS distance FROM pairs)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invented code: document text between comments, strings and template headers (none, one, two, or one that is
    indented and so none); with names that begin with $, doubled and tripled semicolons, and odd white space."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    words = F.translate(F.coalesce("text", F.lit("")), '"/\\\n', "    ")
    note = F.when(k % 2 == 0, F.lit("// 中文说明 ")).otherwise(F.lit("// note "))
    block = F.when(k % 3 == 0, F.lit("/* 注释\n two */")).otherwise(F.lit("/* plain\n two */"))
    rule = "/" * 24 + "\n"
    marks = "// Company: x\n// Create Date: z\n// Module Name: m\n// Additional Comments: none\n"
    header = F.when(k % 20 == 0, F.lit(2 * (rule + marks + rule))).when(k % 10 == 0, F.lit(rule + marks + rule)).when(k % 5 == 0, F.lit(rule + " " + marks + rule)).otherwise(F.lit(""))
    end = F.when(k % 4 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    odd = F.lit("\nmodule $top; a;;;b;\n;c; \t;d module_x module 块z\u3000\n")
    code = F.concat(header, F.lit("\nmodule m"), k.cast("string"), F.lit('; "a // b" '), note, words, end, F.lit("  x = 1;; \\esc//id "), block, F.lit(" y ; \t"), end, words, odd, F.lit(" endmodule\n\n"))
    return docs.select("doc_id", F.concat(F.lit("src/"), k, F.lit(".v")).alias("path"), code.alias("code"))


_RULE = "repeat('/', 24) || chr(10)"
_MARKS = "'// Company: x' || chr(10) || '// Create Date: z' || chr(10) || '// Module Name: m' || chr(10) || '// Additional Comments: none' || chr(10)"
CODE_FILES = rf"""code_files AS (
  SELECT doc_id, 'src/' || doc_id || '.v' AS path,
    CASE WHEN doc_id % 20 = 0 THEN repeat({_RULE} || {_MARKS} || {_RULE}, 2) WHEN doc_id % 10 = 0 THEN {_RULE} || {_MARKS} || {_RULE} WHEN doc_id % 5 = 0 THEN {_RULE} || ' ' || {_MARKS} || {_RULE} ELSE '' END
    || chr(10) || 'module m' || doc_id || '; "a // b" ' || CASE WHEN doc_id % 2 = 0 THEN '// 中文说明 ' ELSE '// note ' END || translate(coalesce(text, ''), '"/\' || chr(10), '    ')
    || CASE WHEN doc_id % 4 = 0 THEN chr(13) || chr(10) ELSE chr(10) END || '  x = 1;; \esc//id '
    || CASE WHEN doc_id % 3 = 0 THEN '/* 注释' || chr(10) || ' two */' ELSE '/* plain' || chr(10) || ' two */' END || ' y ; ' || chr(9)
    || CASE WHEN doc_id % 4 = 0 THEN chr(13) || chr(10) ELSE chr(10) END || translate(coalesce(text, ''), '"/\' || chr(10), '    ')
    || chr(10) || 'module $top; a;;;b;' || chr(10) || ';c; ' || chr(9) || ';d module_x module 块z' || chr(12288) || chr(10) || ' endmodule' || chr(10) || chr(10) AS code
  FROM documents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a base and a tuned run over the pairs; one pair in ten has not been judged."""
    u = lambda name: T.draw(name, F.col("pair_id"))
    verdict = lambda name, rate: F.when(u(f"{name}-done") < 0.1, F.lit(None)).when(u(name) < rate, "AC").when(u(name) < rate + 0.1, "simulation_timeout").otherwise("wrong_answer")
    return pairs(spark, sf_dir).select("pair_id", "problem_id", verdict("base", 0.28).alias("base_status"), verdict("tuned", 0.67).alias("tuned_status"))


DRAW = "(('0x' || sha256('{0}:' || {1})[1:13])::BIGINT / 4503599627370496.0::DOUBLE)"
_verdict = lambda name, rate: f"CASE WHEN {DRAW.format(name + '-done', 'pair_id')} < 0.1 THEN NULL WHEN {DRAW.format(name, 'pair_id')} < {rate} THEN 'AC' WHEN {DRAW.format(name, 'pair_id')} < {rate} + 0.1::DOUBLE THEN 'simulation_timeout' ELSE 'wrong_answer' END"
RUNS = f"{PAIRS}, runs AS (SELECT pair_id, problem_id, {_verdict('base', '0.28::DOUBLE')} AS base_status, {_verdict('tuned', '0.67::DOUBLE')} AS tuned_status FROM pairs)"


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a conversation: messages by turn."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    return turns.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


CHATS = """chats AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id)"""
