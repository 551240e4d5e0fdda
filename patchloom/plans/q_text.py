"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import files
from patchloom.plans import fixtures as X
from patchloom.plans.q_pairs import _raw
from patchloom.plans.registry import query
from patchloom.sources import sinks

# Python's white space, for an engine whose \\s is that of ASCII less one.
W = r"\x{09}-\x{0D}\x{1C}-\x{1F}\x{85}\p{Z}"
TOKENS = rf"""regexp_extract_all(code, '"(?:[^"\\]|\\[\s\S])*"?|\\[^{W}]+[{W}]?|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^"/\\]+|[/\\]', 0)"""
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
GONE = r"CASE WHEN starts_with(t, '//') THEN '' WHEN starts_with(t, '/*') THEN ' ' || regexp_replace(t, '[^\n]', '', 'g') ELSE t END"
TRIM = r"regexp_replace({0}, '[ \t]+(\n|\z)', '\1', 'g')"
STRIP = r"regexp_replace({0}, '[\x09\x0B-\x0D\x1C-\x1F\x{{85}}\p{{Z}}]+(\n|\z)', '\1', 'g')"


def _closed(text: str) -> str:
    return rf"CASE WHEN trim({text}, chr(10)) = '' THEN '' ELSE trim({text}, chr(10)) || chr(10) END"


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, '^[{W}]+|[{W}]+$', '', 'g')"


@query("strip_comments", f"""WITH {X.CODE_FILES}, bare AS (SELECT path, array_to_string(list_transform({TOKENS}, lambda t: {GONE}), '') AS b FROM code_files)
SELECT path, {STRIP.format('b')} AS code FROM bare""")  # fmt: skip
def strip_comments(spark, d):
    return X.code_files(spark, d).select("path", T.strip_comments(F.col("code")).alias("code"))


_CJK = f"""bare AS (SELECT path, code, {TOKENS} AS ts FROM code_files),
joined AS (SELECT path, code, {TRIM.format(f"array_to_string(list_transform(ts, lambda t: CASE WHEN (starts_with(t, '//') OR starts_with(t, '/*')) AND regexp_matches(t, '{CJK}') THEN {GONE} ELSE t END), '')")} AS b,
  len(list_filter(ts, lambda t: (starts_with(t, '//') OR starts_with(t, '/*')) AND regexp_matches(t, '{CJK}')))::INT AS removed FROM bare)"""


@query("strip_cjk_comments", f"WITH {X.CODE_FILES}, {_CJK} SELECT path, {_closed('b')} AS code, removed FROM joined")
def strip_cjk_comments(spark, d):
    return X.code_files(spark, d).select("path", T.strip_cjk_comments(F.col("code")).alias("code"), T.count_cjk_comments(F.col("code")).alias("removed"))


@query("cjk_comment_report", f"""WITH {X.CODE_FILES}, {_CJK}
SELECT count(*)::BIGINT AS total_files, (count(*) FILTER (code <> {_closed('b')}))::BIGINT AS changed_files, sum(removed)::BIGINT AS removed_comments FROM joined""")  # fmt: skip
def cjk_comment_report(spark, d):
    return files.comment_report(X.code_files(spark, d).withColumnRenamed("code", "text"))


_HEAD = r"/{20,}\n" + "".join(rf"{m}[^\n]*\n" for m in T.HEADER_MARKS) + r"/{20,}\n"
_NORMAL = rf"""normal AS (SELECT path, doc_id, code, regexp_replace({TRIM.format("regexp_replace(code, '\r\n?', chr(10), 'g')")}, '^(?:{_HEAD})+', '') AS b FROM code_files)"""


@query("normalise_code", f"WITH {X.CODE_FILES}, {_NORMAL} SELECT path, {_closed('b')} AS code FROM normal")
def normalise_code(spark, d):
    return X.code_files(spark, d).select("path", T.normalise_code(F.col("code"), T.HEADER_MARKS).alias("code"))


@query("normalise_counters", f"""WITH {X.CODE_FILES}, {_NORMAL}
SELECT count(*)::BIGINT AS files, (count(*) FILTER (code <> {_closed('b')}))::BIGINT AS changed FROM normal""")  # fmt: skip
def normalise_counters(spark, d):
    out = sinks.rewrite(X.code_files(spark, d).withColumnRenamed("code", "text"), T.normalise_code(F.col("text"), T.HEADER_MARKS))
    return out.agg(F.count("*").alias("files"), F.count_if("changed").alias("changed"))


@query("normalise_report", f"""WITH {X.CODE_FILES}, {_NORMAL}
SELECT count(*)::BIGINT AS total, (count(*) FILTER (doc_id % 3 <> 0 OR code <> {_closed('b')}))::BIGINT AS changed,
  sum(CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN doc_id % 20 = 0 THEN 2 WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS removed_template_headers,
  (count(*) FILTER (doc_id % 3 = 1))::BIGINT AS converted_from_gb18030, (count(*) FILTER (doc_id % 3 = 2))::BIGINT AS repaired_invalid_utf8 FROM normal""")  # fmt: skip
def normalise_report(spark, d):
    content = F.when(F.col("doc_id") % 3 == 0, F.encode("code", "UTF-8")).otherwise(_raw("doc_id"))
    return files.normalise_report(files.normalise_files(X.code_files(spark, d).select("path", content.alias("content"))))


@query("inline_rows", f"""WITH {X.CODE_FILES}, bare AS (SELECT path, code, array_to_string(list_transform({TOKENS}, lambda t: {GONE}), '') AS b FROM code_files),
cleaned AS (SELECT path, code, {STRIP.format('b')} AS c FROM bare)
SELECT path, len(regexp_split_to_array(regexp_replace(c, '(\r\n|[\n\r])$', ''), '\r\n|[\n\r]'))::INT AS buggy_line_count, 1::INT AS fixed_line_count,
  sha256(regexp_replace(c, '[{W}]+', '', 'g')) AS buggy_normalized_sha256, (length(code) + 6 - length(c) - 1)::INT AS removed_characters FROM cleaned""")  # fmt: skip
def inline_rows(spark, d):
    rows = X.code_files(spark, d).select("path", F.col("code").alias("buggy_code"), F.lit("x //ab").alias("fixed_code"))
    return files.inline_rows(rows).select("path", "buggy_line_count", "fixed_line_count", "buggy_normalized_sha256", "removed_characters")


_ANSWERS = """answers AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Here:' || chr(10) || '```verilog' || chr(10) || chr(10) || text || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || ' more' || chr(10) || '``` end'
    WHEN 1 THEN ' ' || text || chr(12288) WHEN 2 THEN '```SV ' || chr(10) || text || '```' ELSE '```v' || chr(10) || text || '```' END AS answer FROM documents)"""


@query("extract_fences", rf"""WITH {_ANSWERS}, blocks AS (
  SELECT doc_id, answer, regexp_extract_all(answer, '(?is)```(?:verilog|systemverilog|sv)?[{W}]*\n(.*?)```', 1) AS bs FROM answers)
SELECT doc_id, {_stripped("CASE WHEN len(bs) > 0 THEN array_to_string(bs, chr(10) || chr(10)) ELSE answer END")} || chr(10) AS code FROM blocks""")  # fmt: skip
def extract_fences(spark, d):
    text, which = F.col("text"), F.col("doc_id") % 4
    answer = (
        F.when(which == 0, F.concat(F.lit("Here:\n```verilog\n\n"), text, F.lit("\n```\nand\n```\n more\n``` end"))).when(which == 1, F.concat(F.lit(" "), text, F.lit("\u3000")))
        .when(which == 2, F.concat(F.lit("```SV \n"), text, F.lit("```"))).otherwise(F.concat(F.lit("```v\n"), text, F.lit("```")))
    )
    return X.table(spark, d, "documents").select("doc_id", T.extract_fences(answer).alias("code"))


_OUTPUT = "outputs AS (SELECT event_id, 'out = ' || (event_id % 100) || chr(13) || chr(10) || ' noise ' || event_type || '  ' || chr(10) || chr(11) || 'out =  ' || user_id AS o FROM events)"


def _outputs(spark, d):
    o = F.concat(F.lit("out = "), F.col("event_id") % 100, F.lit("\r\n noise "), F.col("event_type"), F.lit("  \n\x0bout =  "), F.col("user_id"))
    return X.table(spark, d, "events").select("event_id", o.alias("o"))


@query("output_match", rf"""WITH {_OUTPUT} SELECT event_id, array_to_string(list_transform(regexp_extract_all(replace(o, chr(13) || chr(10), chr(10)), '(?m)^.?out = +\d+$'), lambda x: {_stripped('x')}), '|') AS hits,
  array_to_string(list_transform(regexp_extract_all(o, '(?m)out = +\d+'), lambda x: trim(regexp_replace(x, '[{W}]+', ' ', 'g'))), '|') AS squeezed FROM outputs""")  # fmt: skip
def output_match(spark, d):
    join = lambda x: F.array_join(x, "|")
    return _outputs(spark, d).select("event_id", join(T.output_matches(F.col("o"), r"^.?out = +\d+$")).alias("hits"), join(T.output_matches(F.col("o"), r"out = +\d+", squeezed=True)).alias("squeezed"))


@query("output_normalise", f"WITH {_OUTPUT} SELECT event_id, array_to_string(list_filter(list_transform(regexp_split_to_array(o, '[\\n\\x0B\\f\\r]'), lambda x: {_stripped('x')}), lambda x: x <> ''), '|') AS lines FROM outputs")
def output_normalise(spark, d):
    return _outputs(spark, d).select("event_id", F.array_join(T.output_lines(F.col("o")), "|").alias("lines"))


@query("compact_text", rf"""SELECT doc_id, CASE WHEN length(t) > 100 THEN t[1:99] || '…' ELSE t END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[{W}]+', ' ', 'g')) AS t FROM documents)""")
def compact_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.compact(F.col("text")).alias("short"))


@query("module_names", rf"""WITH {X.CODE_FILES}, named AS (
  SELECT path, doc_id, list_transform(regexp_extract_all(code, '(?:^|[^\p{{L}}\p{{N}}_])module[{W}]+[A-Za-z_$][\p{{L}}\p{{N}}_$]*'), lambda x: regexp_extract(x, 'module[{W}]+(.*)$', 1)) AS m FROM code_files)
SELECT path, array_to_string(m, ',') AS modules, list_contains(m, 'm' || doc_id) AS expected,
  CASE WHEN doc_id % 2 = 0 THEN 'm' || doc_id END AS expected_module FROM named""")  # fmt: skip
def module_names(spark, d):
    m, own = T.module_names(F.col("code")), F.concat(F.lit("m"), F.col("doc_id"))
    prompt = F.concat(F.lit("Specification\n"), F.when(F.col("doc_id") % 2 == 0, "Module:").otherwise(" Module:"), F.lit("  "), own, F.lit("; rest"))
    return X.code_files(spark, d).select("path", F.array_join(m, ",").alias("modules"), F.array_contains(m, own).alias("expected"), T.expected_module(prompt).alias("expected_module"))


@query("patch_submission", rf"""WITH {X.CODE_FILES}, renamed AS (
  SELECT path, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(code, 'module[ ]\$top', 'module top_') ELSE code END AS c FROM code_files)
SELECT path, regexp_replace(c, ';[ \t]*;', ';', 'g') AS code FROM renamed""")  # fmt: skip
def patch_submission(spark, d):
    code = F.when(F.col("doc_id") % 2 == 0, T.rename_module(F.col("code"), "$top", "top_")).otherwise(T.rename_module(F.col("code"), "$to", "never"))
    return X.code_files(spark, d).select("path", T.patch_submission(code).alias("code"))


@query("time_parse", """SELECT p_partkey, CASE WHEN p_partkey % 7 IN (5, 6) THEN NULL ELSE (p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END)::DOUBLE * CASE p_partkey % 7 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e3 WHEN 3 THEN 1 WHEN 4 THEN 1e-3 END::DOUBLE END AS ns,
  CASE WHEN p_size % 3 = 0 THEN 60 ELSE least(p_size, 60) END::INT AS timeout FROM part""")  # fmt: skip
def time_parse(spark, d):
    units = F.array(*map(F.lit, ("s", "ms", " us", "ns", "ps", "parsec", "ns ")))
    number = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".5").otherwise(""))
    text = F.concat(number, F.element_at(units, (F.col("p_partkey") % 7 + 1).cast("int")))
    return X.table(spark, d, "part").select("p_partkey", T.nanoseconds(text).alias("ns"), T.clamped_timeout(F.when(F.col("p_size") % 3 != 0, F.col("p_size")), 60).alias("timeout"))


@query("json_by_key", """SELECT user_id, count(*)::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1""")
def json_by_key(spark, d):
    k = F.from_json("props", "k long")["k"]
    return X.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
