"""Queries of the filtering and scoring stages: rejection, quality, samples, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import filters, scoring
from patchloom.plans import fixtures as X
from patchloom.plans.registry import query
from patchloom.sources import sinks

BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RATIO = "abs(length(fixed_code) - length(buggy_code))::DOUBLE / greatest(length(buggy_code), length(fixed_code), 1)"
REASON = f"""CASE WHEN coalesce(NOT valid_repair, FALSE) OR coalesce(verification = 'invalid', FALSE) THEN 'invalid_fail_to_ac_label'
  WHEN problem_id NOT IN (SELECT id FROM catalog) THEN 'out_of_scope_problem'
  WHEN trim(buggy_code, {BLANK}) = '' OR trim(fixed_code, {BLANK}) = '' THEN 'empty_code' WHEN buggy_code = fixed_code THEN 'identical_code'
  WHEN distance > 0.9::DOUBLE THEN 'near_total_rewrite' END"""
STATS = """stats AS (SELECT count(*)::BIGINT AS n, round(avg(round(distance, 6)), 6) AS mean,
  quantile_cont(round(distance, 6), [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS q FROM measured),
fence AS (SELECT least(1.0::DOUBLE, q[4] + 1.5::DOUBLE * (q[4] - q[2])) AS fence FROM stats)"""
SCORED = f"""kept AS (SELECT * FROM (SELECT *, {REASON} AS filter_reason FROM measured) WHERE filter_reason IS NULL),
groups AS (SELECT problem_id, count(*) AS n FROM kept GROUP BY 1),
signals AS (
  SELECT k.*, CASE WHEN verification = 'testbench_verified' OR valid_repair THEN 1.0::DOUBLE WHEN verification = 'manual_checked' THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS c,
    greatest(0.0::DOUBLE, 1 - distance) AS p, sqrt((SELECT min(n) FROM groups)::DOUBLE / n) AS dv,
    least(1.0::DOUBLE, distance / 0.05::DOUBLE) * greatest(0.0::DOUBLE, 1 - distance) AS i FROM kept k JOIN groups g ON g.problem_id = k.problem_id),
raw AS (SELECT *, c * 0.41::DOUBLE + p * 0.29::DOUBLE + dv * 0.18::DOUBLE + i * 0.12::DOUBLE AS s FROM signals),
scored AS (
  SELECT *, round(s, 6) AS quality_score, CASE WHEN s >= 0.75::DOUBLE THEN 'high' WHEN s >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS quality_tier,
    round(CASE WHEN s >= 0.75::DOUBLE THEN 1.0::DOUBLE WHEN s >= 0.5::DOUBLE THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END * c, 3) AS training_weight FROM raw)"""
ALL = f"WITH {X.CATALOG}, {X.PAIRS}, {SCORED}"
PARTS = f"""students AS (SELECT student_id, row_number() OVER (ORDER BY {X.DRAW.format('42', 'student_id')}, student_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT student_id FROM pairs)),
split AS (SELECT student_id, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.85::DOUBLE + 0.075::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM students),
assigned AS (SELECT p.*, split FROM pairs p JOIN split s ON s.student_id = p.student_id)"""


def _rejected(spark, d):
    return filters.hard_reject(filters.with_distance(X.pairs(spark, d)), X.catalog(spark, d))


def _scored(spark, d):
    return scoring.score(filters.keep(_rejected(spark, d)))


@query("length_filter", f"""
WITH {X.PAIRS} SELECT pair_id, round({RATIO}, 6) AS length_ratio,
  CASE WHEN buggy_code = fixed_code THEN 'identical_code' WHEN {RATIO} > 0.5::DOUBLE THEN 'abnormal_length_change' END AS filter_reason FROM pairs
""")  # fmt: skip
def length_filter(spark, d):
    return filters.length_filter(X.pairs(spark, d)).select("pair_id", F.round("length_ratio", 6).alias("length_ratio"), "filter_reason")


@query("edit_distance_stats", f"""
WITH {X.PAIRS}, {STATS} SELECT n, mean, round(q[1], 6) AS min, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p90,
  round(q[6], 6) AS p95, round(q[7], 6) AS p99, round(q[8], 6) AS max, round(fence, 6) AS fence FROM stats, fence
""")  # fmt: skip
def edit_distance_stats(spark, d):
    out = filters.distance_stats(filters.with_distance(X.pairs(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n"})


@query("edit_fence", f"""
WITH {X.PAIRS}, {STATS} SELECT pair_id, round(distance, 6) AS normalized_edit_distance,
  CASE WHEN round(distance, 6) > fence THEN 'excessive_edit_distance' END AS filter_reason FROM measured, fence
""")  # fmt: skip
def edit_fence(spark, d):
    return filters.edit_fence(filters.with_distance(X.pairs(spark, d))).select("pair_id", "normalized_edit_distance", "filter_reason")


@query("hard_reject", f"WITH {X.CATALOG}, {X.PAIRS} SELECT coalesce({REASON}, 'kept') AS reason, count(*)::BIGINT AS n FROM measured GROUP BY 1")
def hard_reject(spark, d):
    return _rejected(spark, d).groupBy(F.coalesce("filter_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("dual_sink", f"WITH {X.CATALOG}, {X.PAIRS} SELECT pair_id, {REASON} IS NULL AS kept, {REASON} AS filter_reason FROM measured")
def dual_sink(spark, d):
    return _rejected(spark, d).select("pair_id", F.col("filter_reason").isNull().alias("kept"), "filter_reason")


@query("diversity", f"{ALL} SELECT problem_id, count(*)::BIGINT AS n, round(any_value(dv), 6) AS diversity FROM signals GROUP BY 1")
def diversity(spark, d):
    return scoring.with_diversity(filters.keep(_rejected(spark, d))).groupBy("problem_id").agg(F.count("*").alias("n"), F.round(F.first("diversity"), 6).alias("diversity"))


@query("quality_score", f"""{ALL} SELECT pair_id, round(c, 6) AS correctness, round(p, 6) AS purity, round(dv, 6) AS diversity, round(i, 6) AS informativeness,
  quality_score, quality_tier, training_weight, c < 1 OR quality_tier = 'low' AS needs_review, round(distance, 6) AS normalized_edit_distance FROM scored""")  # fmt: skip
def quality_score(spark, d):
    return _scored(spark, d).select("pair_id", *scoring.WEIGHTS, "quality_score", "quality_tier", "training_weight", "needs_review", "normalized_edit_distance")


@query("tier_hist", f"{ALL} SELECT quality_tier, count(*)::BIGINT AS n, round(avg(s), 6) AS mean_score FROM scored GROUP BY 1")
def tier_hist(spark, d):
    return _scored(spark, d).groupBy("quality_tier").agg(F.count("*").alias("n"), F.round(F.avg("raw_score"), 6).alias("mean_score"))


@query("quality_sample", f"""{ALL} SELECT pair_id, quality_tier, quality_score FROM (
  SELECT *, row_number() OVER (ORDER BY quality_tier <> 'high', CASE WHEN quality_tier = 'high' THEN -quality_score
    ELSE -pow(greatest({X.DRAW.format('42', 'pair_id')}, 1e-300::DOUBLE), 1 / greatest(quality_score, 1e-6::DOUBLE)) END, pair_id) AS r FROM scored)
WHERE r <= (SELECT round_even(count(*) * 0.8::DOUBLE, 0) FROM scored)""")  # fmt: skip
def quality_sample(spark, d):
    return scoring.quality_sample(_scored(spark, d)).select("pair_id", "quality_tier", "quality_score")


@query("review_pool", f"{ALL} SELECT pair_id, quality_tier FROM scored WHERE c < 1 OR quality_tier = 'low'")
def review_pool(spark, d):
    return _scored(spark, d).where("needs_review").select("pair_id", "quality_tier")


@query("student_split", f"WITH {X.PAIRS}, {PARTS} SELECT pair_id, split FROM assigned")
def student_split(spark, d):
    return scoring.student_split(X.pairs(spark, d)).select("pair_id", "split")


_CAPPED = f"capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY {X.DRAW.format('42', 'pair_id')}, pair_id) AS r FROM {{0}}) WHERE r <= 50)"


@query("cap_per_problem", f"WITH {X.PAIRS}, {_CAPPED.format('pairs')} SELECT pair_id, problem_id FROM capped")
def cap_per_problem(spark, d):
    return scoring.cap_per_problem(X.pairs(spark, d), 50).select("pair_id", "problem_id")


@query("split_counts", f"""WITH {X.PAIRS}, {PARTS}, {_CAPPED.format("assigned WHERE split = 'train'")},
after AS (SELECT split, problem_id, student_id FROM capped UNION ALL SELECT split, problem_id, student_id FROM assigned WHERE split <> 'train')
SELECT split, count(*)::BIGINT AS n, count(DISTINCT problem_id)::BIGINT AS problems, count(DISTINCT student_id)::BIGINT AS students, 'before' AS stage FROM assigned GROUP BY 1
UNION ALL SELECT split, count(*)::BIGINT, count(DISTINCT problem_id)::BIGINT, count(DISTINCT student_id)::BIGINT, 'after' FROM after GROUP BY 1""")  # fmt: skip
def split_counts(spark, d):
    before = scoring.student_split(X.pairs(spark, d))
    train = scoring.cap_per_problem(before.where("split = 'train'"), 50)
    return scoring.split_counts(before, train.unionByName(before.where("split <> 'train'")))


@query("deny_or_fffd", f"""WITH {X.PAIRS}, marked AS (
  SELECT pair_id, buggy_code, CASE WHEN problem_id = 3 THEN fixed_code || chr(65533) ELSE fixed_code END AS fixed_code FROM pairs)
SELECT pair_id FROM marked WHERE pair_id IN ('p1', 'p7') OR contains(buggy_code, chr(65533)) OR contains(fixed_code, chr(65533))""")  # fmt: skip
def deny_or_fffd(spark, d):
    marked = F.when(F.col("problem_id") == 3, F.concat("fixed_code", F.lit(T.REPLACEMENT))).otherwise(F.col("fixed_code"))
    return filters.denied(X.pairs(spark, d).withColumn("fixed_code", marked), ["p1", "p7"]).select("pair_id")


@query("content_hash_dupes", rf"""WITH {X.PAIRS}, hashed AS (SELECT sha256(regexp_replace(fixed_code, '\s+', '', 'g')) AS h, problem_id FROM pairs)
SELECT h AS code_hash, count(*)::BIGINT AS n, count(DISTINCT problem_id)::BIGINT AS problems FROM hashed GROUP BY 1 HAVING count(*) > 1""")  # fmt: skip
def content_hash_dupes(spark, d):
    rows = X.pairs(spark, d).withColumn("code_hash", T.code_hash(F.col("fixed_code")))
    return rows.groupBy("code_hash").agg(F.count("*").alias("n"), F.count_distinct("problem_id").alias("problems")).where("n > 1")


@query("keyset_equal", f"""WITH {X.CATALOG}, {X.PAIRS}, a AS (SELECT DISTINCT problem_id AS k FROM pairs), b AS (SELECT DISTINCT id AS k FROM catalog)
SELECT k AS problem_id, 'a' AS only_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT k, 'b' FROM (FROM b EXCEPT FROM a)""")  # fmt: skip
def keyset_equal(spark, d):
    return filters.keyset_gaps(X.pairs(spark, d), X.catalog(spark, d).select(F.col("id").alias("problem_id")), "problem_id")


@query("unique_keys", f"""WITH {X.PAIRS} SELECT count(*)::BIGINT AS n, count(DISTINCT student_id)::BIGINT AS n_distinct,
  (count(*) FILTER (coalesce(student_id::VARCHAR, '') = ''))::BIGINT AS n_empty, count(*) = count(DISTINCT student_id) AS ok FROM pairs""")  # fmt: skip
def unique_keys(spark, d):
    return filters.key_problems(X.pairs(spark, d), "student_id")


@query("forbidden_chars", f"""WITH {X.PAIRS}, found AS (
  SELECT pair_id, array_to_string(list_sort(list_distinct(CASE problem_id WHEN 1 THEN regexp_extract_all(fixed_code, '[xq]') WHEN 4 THEN regexp_extract_all(fixed_code, '[0Z]') ELSE regexp_extract_all(fixed_code, '#{{3}}|a.') END)), '|') AS found
  FROM pairs WHERE problem_id IN (1, 4, 5))
SELECT * FROM found WHERE found <> ''""")  # fmt: skip
def forbidden_chars(spark, d):
    rules = spark.createDataFrame([(1, "[xq]"), (4, "[0Z]"), (5, "#{3}|a.")], "problem_id long, pattern string")
    return filters.forbidden(X.pairs(spark, d), rules, "fixed_code").select("pair_id", F.array_join("found", "|").alias("found"))


@query("changed_lines", """WITH lines AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, (count(*) FILTER (l_linenumber % 3 = 0) + 1)::INT AS changed FROM lines GROUP BY 1""")  # fmt: skip
def changed_lines(spark, d):
    """Every third line is another one, and one is added; blank lines and edges don't count."""
    n = F.array_sort(F.collect_set("l_linenumber"))
    rows = X.table(spark, d, "lineitem").groupBy("l_orderkey").agg(n.alias("n"))
    old = F.array_join(F.transform("n", lambda i: F.concat(F.lit("line "), i)), "\n")
    new = F.array_join(F.transform("n", lambda i: F.concat(F.when(i % 3 == 0, "  other ").otherwise("\tline "), i, F.lit("\n "))), "\n")
    from patchloom.functions.python_text import changed_lines as changed

    return rows.select("l_orderkey", changed(F.concat(F.lit("first\n"), old), F.concat(F.lit("first\nmore\n"), new)).alias("changed"))


@query("name_ratio", "SELECT p_partkey, round(2.0::DOUBLE * length(p_name) / (2 * length(p_name) + p_size), 6) AS ratio FROM part")
def name_ratio(spark, d):
    from patchloom.functions.python_text import sequence_ratio

    longer = F.concat("p_name", F.expr("repeat('#', p_size)"))
    return X.table(spark, d, "part").select("p_partkey", F.round(sequence_ratio("p_name", longer), 6).alias("ratio"))


def _raw(name: str):
    """Bytes of three kinds: UTF-8, GB18030, neither."""
    text, which = F.concat(F.lit("file "), F.col(name)), F.col(name) % 3
    more = F.when(which == 0, F.encode(F.lit("中"), "UTF-8")).when(which == 1, F.unhex(F.lit("D6D0CEC4"))).otherwise(F.unhex(F.lit("FF")))
    return F.concat(F.encode(text, "UTF-8"), more)


@query("utf8_or_gb", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gb18030' ELSE 'utf-8-replaced' END AS encoding,
  'file ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '中' WHEN 1 THEN '中文' ELSE chr(65533) END AS text FROM documents""")  # fmt: skip
def utf8_or_gb(spark, d):
    from patchloom.functions.python_text import decode

    return X.table(spark, d, "documents").select("doc_id", decode(_raw("doc_id")).alias("x")).select("doc_id", "x.encoding", "x.text")


@query("long_distance", """SELECT p_partkey, levenshtein(p_name, p_type || p_brand)::DOUBLE / greatest(length(p_name), length(p_type || p_brand), 1) AS distance FROM part""")
def long_distance(spark, d):
    """The bit-parallel distance, on all pairs."""
    rows = X.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("buggy_code"), F.concat("p_type", "p_brand").alias("fixed_code"))
    return filters.with_distance(rows, long_pair=-1).select("p_partkey", "distance")


@query("method_subset", f"WITH {X.PAIRS} SELECT pair_id FROM pairs WHERE problem_id IN (0, 2, 4, 6, 8)")
def method_subset(spark, d):
    mapping = spark.range(12).select(F.col("id").alias("problem_id"), F.when(F.col("id") % 2 == 0, "exact_name").otherwise("semantic_description").alias("method"))
    return filters.mapped_by(X.pairs(spark, d), mapping, "exact_name").select("pair_id")


@query("table_cells", f"""WITH {X.PAIRS} SELECT pair_id, translate(fixed_code, chr(9) || chr(13) || chr(10), '   ') AS fixed_code, verification FROM pairs""")
def table_cells(spark, d):
    return sinks.as_cells(X.pairs(spark, d).select("pair_id", "fixed_code", "verification"))


@query("verification_counts", f"""WITH {X.PAIRS} SELECT CASE WHEN valid_repair OR verification = 'testbench_verified' THEN 'valid'
  WHEN NOT valid_repair OR verification = 'invalid' THEN 'invalid' ELSE 'unverified' END AS state, count(*)::BIGINT AS n FROM pairs GROUP BY 1""")  # fmt: skip
def verification_counts(spark, d):
    valid, label = F.col("valid_repair"), F.col("verification")
    state = F.when(valid | (label == "testbench_verified"), "valid").when(~valid | (label == "invalid"), "invalid").otherwise("unverified")
    return X.pairs(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("busiest_problems", f"WITH {X.PAIRS} SELECT problem_id, count(*)::BIGINT AS n FROM pairs GROUP BY 1 ORDER BY n DESC, problem_id LIMIT 5")
def busiest_problems(spark, d):
    return X.pairs(spark, d).groupBy("problem_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "problem_id").limit(5)


@query("id_order", f"WITH {X.PAIRS} SELECT pair_id, row_number() OVER (ORDER BY pair_id[2:]::BIGINT)::BIGINT AS place FROM pairs")
def id_order(spark, d):
    return scoring.global_rank(X.pairs(spark, d).select("pair_id", F.substring("pair_id", 2, 20).cast("long").alias("number")), ["number"], "place").select("pair_id", "place")


@query("problem_subset", f"WITH {X.PAIRS} SELECT pair_id, problem_id FROM pairs WHERE problem_id IN (SELECT l_linenumber FROM lineitem)")
def problem_subset(spark, d):
    wanted = X.table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("problem_id"))
    return filters.of_problems(X.pairs(spark, d), wanted).select("pair_id", "problem_id")


@query("signal_stats", f"""{ALL}, long AS (SELECT 'correctness' AS signal, round(c, 6) AS v FROM scored UNION ALL SELECT 'purity', round(p, 6) FROM scored UNION ALL SELECT 'diversity', round(dv, 6) FROM scored UNION ALL SELECT 'informativeness', round(i, 6) FROM scored)
SELECT signal, count(*)::BIGINT AS n, round(min(v), 6) AS least, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM long GROUP BY 1""")  # fmt: skip
def signal_stats(spark, d):
    long = _scored(spark, d).unpivot("pair_id", list(scoring.WEIGHTS), "signal", "v")
    return long.groupBy("signal").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"))
