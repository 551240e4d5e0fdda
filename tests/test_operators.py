"""The behaviours that a user of the reference relies on, and random texts against small independent rules."""

import difflib
import io
import json
import random
import time
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from patchloom.functions import python_text as P
from patchloom.functions import text as T
from patchloom.operators import chat, filters, reports, scoring, verify
from patchloom.plans import q_catalog
from patchloom.sources import keys, readers, scratch, sinks
from patchloom.streaming import resume


def one(spark, f, *values, kinds="string"):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {kinds}" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).head()["x"]


def test_fences_are_joined(spark):
    assert one(spark, T.extract_fences, "```verilog\nmodule a; endmodule\n```\n```verilog\nmodule b; endmodule\n```") == "module a; endmodule\n\n\nmodule b; endmodule\n"
    assert one(spark, T.extract_fences, "a\n```SV  \n\n  one\n```\nb\n```v\ntwo\n```") == "one\n"
    assert one(spark, T.extract_fences, "a\n```v\ntwo\n```\n ") == "a\n```v\ntwo\n```\n"
    assert one(spark, T.extract_fences, " \u3000bare\x1c ") == "bare\n"


def test_output_matches_lines_and_crlf(spark):
    assert one(spark, lambda c: T.output_matches(c, "[01]\\n"), "ISim\r\n1\r\n0\r\n") == ["1", "0"]
    assert one(spark, lambda c: T.output_matches(c, r"^[0-9]\n"), "0\r\n1\r\n2\r\n") == ["0", "1", "2"]
    assert one(spark, lambda c: T.output_matches(c, r"^v=\d$"), "v=1\r\nxv=2\nv=3 \nv=4") == ["v=1", "v=4"]
    assert one(spark, lambda c: T.output_matches(c, r"a.*b$", squeezed=True), "a \t b\na  b") == ["a b", "a b"]
    assert one(spark, T.output_lines, " x\x0by \r\n\n\u2028z") == ["x", "y", "z"]


def test_no_rate_before_all_is_judged(spark):
    inputs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "pair_id string, problem_id long")
    done = spark.createDataFrame([("a", "AC"), ("b", "FAIL")], "pair_id string, status string")
    r = reports.overall_rate(reports.repair_rollup(inputs, done)).head()
    assert (r["total"], r["completed"], r["repair_rate"], r["running_repair_rate"]) == (3, 2, None, 0.5)
    empty = reports.overall_rate(reports.repair_rollup(inputs.limit(0), done)).head()
    assert empty["repair_rate"] is None and empty["running_repair_rate"] == 0


CONFIG = (
    "test_sha256 string, pair_ids array<string>, manifest_sha256 string, resources map<string,string>, script_sha256 string, generation map<string,int>, timeout int, "
    "iverilog_version string, versions map<string,string>, model string, model_files map<string,string>, mode string, adapter string, complete boolean, result_ids array<string>"
)


def test_paired_comparison_and_guard(spark):
    ids = ["a", "b", "c"]
    base = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "pair_id string, passed boolean")
    tuned = spark.createDataFrame([("a", False), ("b", True), ("c", True)], "pair_id string, passed boolean")
    r = reports.paired_flips(base, tuned).head()
    assert (r["improved"], r["regressed"]) == (["b", "c"], ["a"]) and abs(r["delta_points"] - 100 / 3) < 1e-9
    assert sorted(tuple(x) for x in reports.flips(base, tuned).collect()) == [("a", "regressed"), ("b", "improved"), ("c", "improved")]
    run = lambda **more: spark.createDataFrame([tuple({"test_sha256": "test", "pair_ids": ids, "manifest_sha256": "manifest", "resources": {}, "script_sha256": "script", "generation": {"max_new_tokens": 4096}, "timeout": 90, "iverilog_version": "test", "versions": {}, "model": "/base", "model_files": {}, "mode": "model", "adapter": None, "complete": True, "result_ids": ids, **more}.values())], CONFIG)
    check = lambda a, b: filters.run_conditions(a, b).head()["mismatches"]
    assert check(run(), run(adapter="/adapter")) == []
    assert check(run(), run(timeout=10)) == ["timeout", "adapter"]
    assert check(run(adapter="/x"), run(adapter="/adapter", complete=False)) == ["adapter", "tuned_incomplete"]
    assert check(run(model_files={"/base/w": "1", "/x": "1"}), run(adapter="/a", model_files={"/base/w": "2", "/x": "3"}, mode="test")) == ["model_files", "tuned_incomplete"]
    assert check(run(versions={"torch": "1"}), run(adapter="/a", versions={"torch": "2"}, result_ids=["b", "a", "c"])) == ["versions.torch", "tuned_results"]


def test_runs_of_other_pairs_are_refused(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "pair_id string, problem_id long, status string")
    assert reports.paired(make(("a", 1, "AC")), make(("a", 1, "FAIL")), "status").head()["tuned"] == "FAIL"
    for other in (make(("a", 2, "AC")), make(("a", 1, "AC"), ("b", 1, "AC")), make(("b", 1, "AC"))):
        with pytest.raises(Exception, match="two problems for|only one run has"):
            reports.paired(make(("a", 1, "AC")), other, "status").collect()


def test_strict_joins_refuse_what_is_missing(spark):
    pairs = spark.createDataFrame([("p", 1, "a", "b"), ("q", 2, "a", "b")], "pair_id string, problem_id long, buggy_code string, fixed_code string")
    catalog = spark.createDataFrame([(1, None)], "id long, description string")
    with pytest.raises(Exception, match="no such problem in the catalog: 2"):
        chat.chat_rows(pairs, catalog).collect()
    rows = chat.chat_rows(pairs, catalog, strict=False).collect()
    assert [m["content"] for m in rows[0]["messages"]][1:] == ["Problem specification:\nNone\n\nBuggy Verilog code:\n```verilog\na\n```", "b"]
    with pytest.raises(Exception, match="no such file: x"):
        readers.load_pairs(spark.createDataFrame([("x", "x")], "buggy_path string, fixed_path string"), spark.createDataFrame([("y", "t")], "path string, text string")).collect()
    with pytest.raises(Exception, match="messages of other roles"):
        chat.strict_rows(spark.createDataFrame([([Row(role="user", content="x")],)], "messages array<struct<role:string,content:string>>")).collect()


def test_cached_verdicts_and_time(spark):
    df = spark.createDataFrame([([Row(timeout=False, seconds=0.1), Row(timeout=False, seconds=20.0)],), ([Row(timeout=False, seconds=0.1), Row(timeout=False, seconds=0.2)],), ([Row(timeout=True, seconds=99.0), None],)], "p array<struct<timeout:boolean,seconds:double>>")
    assert [r["x"] for r in df.select(filters.may_reuse(F.col("p"), F.lit(10.0)).alias("x")).collect()] == [False, True, True]


def test_hard_filter_and_soft_signals(spark):
    code = {"a": "module a; assign x = 0; endmodule\n", "b": "module a; assign x = 1; endmodule\n", "c": "module b; assign y = 0; endmodule\n", "d": "module b; assign y = 1; endmodule\n"}
    good = "testbench_verified"
    rows = [
        ("common-1", 1, "a", "b", good, None), ("common-2", 1, "a", "b", good, None), ("rare", 2, "c", "d", good, None),
        ("invalid", 3, "a", "b", "invalid", False), ("unverified", 4, "a", "b", None, None), ("out-of-scope", 5, "a", "b", good, None),
        ("empty", 1, "a", None, good, None), ("same", 1, "a", "a", good, None), ("rewrite", 1, "a", "#", good, None),
    ]
    texts = {**code, None: " \u3000\n", "#": "#" * 60}
    pairs = spark.createDataFrame([(i, p, texts[x], texts[y], v, w) for i, p, x, y, v, w in rows], "pair_id string, problem_id long, buggy_code string, fixed_code string, verification string, valid_repair boolean")
    out = filters.hard_reject(filters.with_distance(pairs), spark.range(1, 5), 0.9)
    assert {r["pair_id"]: r["filter_reason"] for r in out.collect() if r["filter_reason"]} == {"invalid": "invalid_fail_to_ac_label", "out-of-scope": "out_of_scope_problem", "empty": "empty_code", "same": "identical_code", "rewrite": "near_total_rewrite"}
    kept = scoring.score(filters.keep(out))
    scored = {r["pair_id"]: r for r in kept.collect()}
    assert scored["rare"]["diversity"] > scored["common-1"]["diversity"]
    assert scored["unverified"]["needs_review"] and scored["unverified"]["training_weight"] < scored["common-1"]["training_weight"]
    assert scoring.quality_sample(kept, 0.5, 42).count() == 2
    with pytest.raises(ValueError):
        scoring.quality_sample(pairs, 0)


def strip_by_hand(code: str) -> str:
    out, i = [], 0
    while i < len(code):
        c = code[i]
        if c == '"':
            j = i + 1
            while j < len(code) and code[j] != '"':
                j += 2 if code[j] == "\\" and j + 1 < len(code) else 1
            out.append(code[i : j + 1])
            i = j + 1
        elif c == "\\" and i + 1 < len(code) and not code[i + 1].isspace():
            j = i + 1
            while j < len(code) and not code[j].isspace():
                j += 1
            out.append(code[i : j + 1])
            i = j + 1
        elif code.startswith("//", i):
            i = code.find("\n", i) if "\n" in code[i:] else len(code)
        elif code.startswith("/*", i):
            j = code.find("*/", i + 2)
            j = len(code) if j < 0 else j + 2
            out.append(" " + "\n" * code[i:j].count("\n"))
            i = j
        else:
            out.append(c)
            i += 1
    return "\n".join(line.rstrip() for line in "".join(out).split("\n"))


def test_random_comments(spark):
    rng = random.Random(3)
    codes = ["".join(rng.choice(['"', "\\", "/", "//", "/*", "*/", "\n", " ", "\r", "\u3000", "\x1c", "a", "b"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    codes += ["", "/* never ends", '"open', "//"]
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", T.strip_comments(F.col("c")).alias("x")).collect()
    assert [r["c"] for r in got if r["x"] != strip_by_hand(r["c"])] == []


def test_random_distances(spark):
    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab\r\né") for _ in range(rng.randint(0, 8)))
    pairs = [(word(), word()) for _ in range(800)]
    bare = lambda s: s.replace("\r", "").replace("\n", "")
    df = spark.createDataFrame(pairs, "buggy_code string, fixed_code string")
    for most in (-1, 20, 1 << 24):  # all by the bit-parallel function, some, none
        for r in filters.with_distance(df, most).collect():
            a, b = bare(r["buggy_code"]), bare(r["fixed_code"])
            assert r["distance"] == lev(a, b) / max(len(a), len(b), 1)


def test_random_grams(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
    pairs = [(word(), word()) for _ in range(500)]
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.containment(T.grams(F.col("a")), T.grams(F.col("b"))).alias("x")).collect():
        a, b = grams(r["a"]), grams(r["b"])
        assert r["x"] == (len(a & b) / min(len(a), len(b)) if a and b else 0)


def test_cjk_comments(spark):
    code = '\n\n a // 中\n"// 中" /* 文\n x */ b // keep\n\n'
    assert one(spark, T.strip_cjk_comments, code) == ' a\n"// 中"  \n b // keep\n'.replace("  \n", "\n")
    assert one(spark, T.count_cjk_comments, code) == 2
    assert one(spark, T.strip_cjk_comments, "//中") == ""


def test_headers_go_again_and_again(spark):
    rule = "/" * 24
    marks = "// Company: x\n// Create Date: y\n// Module Name: z\n// Additional Comments:\n"
    head = f"{rule}\n{marks}{rule}\n"
    f = lambda c: T.normalise_code(c, T.HEADER_MARKS)
    assert one(spark, f, head + head + "x;  \r\ny\n\n") == "x;\ny\n"
    assert one(spark, f, head + "x\r" + head) == "x\n" and one(spark, T.headers_removed, head + "x\r" + head) == 2
    few = f"{rule}\n// Company: x\n{rule}\nz"
    assert one(spark, f, few) == few + "\n" and one(spark, T.headers_removed, few) == 0
    indented = f"{rule}\n {marks}{rule}\nz"
    assert one(spark, f, indented) == indented + "\n"
    assert one(spark, f, "\n" * 12 + head + "x").startswith(rule)
    assert one(spark, f, f"{rule}\n" + "a\n" * 39 + head + "x").startswith(rule)  # the closing separator lies too far
    assert one(spark, f, " \n\t") == ""


def test_decode_and_config(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("中文".encode("gb18030")),), (bytearray(b"a\xff"),), (None,)], "b binary")
    assert [tuple(r["x"]) for r in df.select(P.decode("b").alias("x")).collect()] == [("é", "utf-8"), ("中文", "gb18030"), ("a�", "utf-8-replaced"), (None, None)]
    assert P.decode_text("中文".encode("gb18030")) == "中文" and P.decode_text(b"a\xff") == "a�"
    assert P.parse_config('{"universal": {"timeout": 5}}', "judge_parameter:\n  universal:\n    timeout: 6")["timeout"] == 5
    assert P.parse_config(None, "x: 1\njudge_parameter:\n  # note\n  universal:\n    timeout: 7\n    output_regex: 'a+ #b'\n  other:\n    timeout: 8\n") == {"timeout": 7, "simulating_time": "1000ns", "output_regex": "a+ #b", "top_module": None}
    assert P.parse_config(None, None) == {"timeout": 90, "simulating_time": "1000ns", "output_regex": None, "top_module": None}


def test_matcher_functions(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nx\nc\nd"), ("", ""), (None, "q")], "a string, b string")
    assert [r["x"] for r in df.select(P.changed_lines("a", "b").alias("x")).collect()] == [2, 0, 1]
    got = [r["x"] for r in df.select(P.sequence_ratio("a", "b").alias("x")).collect()]
    assert got[0] == difflib.SequenceMatcher(None, "a\nb\n\nc", "a\nx\nc\nd").ratio() and got[1] == 1.0


def test_small_functions(spark):
    assert one(spark, T.nanoseconds, "10us") == 10000 and one(spark, T.nanoseconds, "1.5us") == 1500 and one(spark, T.nanoseconds, "2 ms") == 2e6
    assert [one(spark, T.nanoseconds, x) for x in ("10 parsec", " 10ns", "10ns\n", "1.2.3ns", "ns", ".ns")] == [None] * 6
    assert one(spark, lambda c: T.compact(c, 5), "a  b\nc d e") == "a b …"
    assert one(spark, T.clean_optional, " None ") is None and [one(spark, T.clean_optional, x) for x in (" x ", "\t", "\u3000NULL\n", "\tnone of it ")] == [" x ", None, None, "\tnone of it "]
    assert one(spark, T.extension, "a.tar.GZ") == ".gz" and one(spark, T.extension, "none") == "<none>"
    assert one(spark, T.patch_submission, "a;;;b;\n;c; \t;d") == "a;;b;\n;c;d"
    assert one(spark, lambda c: T.rename_module(c, "string", "expr"), "module strings; module  string; module string") == "module strings; module expr; module string"
    assert one(spark, T.module_names, "module $top; module a$1(; endmodule  xmodule no; module\n\tb") == ["$top", "a$1", "b"]
    assert one(spark, T.expected_module, "Module x\n Module: no\nModule:  top_1, rest") == "top_1" and one(spark, T.expected_module, "none") is None
    assert one(spark, T.similarity_key, "Ab1!\u4dc0\uf900\u3400") == "ab1\u4dc0\u3400"
    assert one(spark, lambda c: T.percent(c.cast("double")), "0.28357") == "28.36%"
    assert [one(spark, T.line_count, x) for x in ("", "a", "a\n", "\n", "a\r\nb\x0bc", "a\n\n")] == [len(x.splitlines()) for x in ("", "a", "a\n", "\n", "a\r\nb\x0bc", "a\n\n")]
    empty = spark.createDataFrame([], "conv_id long, full int")
    assert tuple(chat.token_stats(empty, ["full"]).head()) == ("full", 0, *[0.0] * 8)


def test_similar_grams_are_found_whatever_their_frequency(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    left, right = [(i, word(rng.randint(0, 12))) for i in range(60)], [(i, word(rng.randint(0, 12))) for i in range(60)]
    grams = lambda s: {s[i : i + 5] for i in range(len(s) - 4)}
    for least in (0.3, 0.8, 1.0):
        want = {(i, j): len(a & b) / min(len(a), len(b)) for i, x in left for j, y in right if (a := grams(x)) and (b := grams(y)) and len(a & b) >= least * min(len(a), len(b))}
        out = verify.gram_scores(spark.createDataFrame(left, "left_id long, key string"), spark.createDataFrame(right, "right_id long, key string"), least)
        assert {(r["left_id"], r["right_id"]): r["score"] for r in out.collect()} == want


def test_best_match_needs_a_margin(spark):
    rows = [(1, "x", "k1", 0.9, 0.9), (1, "y", "k1", 0.9, 0.9), (1, "z", "k2", 0.85, 0.85), (2, "x", "k1", 0.81, 0.81), (2, "z", "k2", 0.8, 0.8), (3, "z", "k2", 0.7, 0.7)]
    out = {r["left_id"]: r for r in verify.best_with_margin(spark.createDataFrame(rows, "left_id long, right_id string, key string, score double, total double")).collect()}
    assert out[1]["accepted"] and out[1]["best_id"] == "y" and not out[2]["accepted"] and not out[3]["accepted"]


def test_best_match_is_that_of_all_rows_and_makes_them_once(spark, sf):
    rng = random.Random(5)
    share = lambda: rng.choice((0.7, 0.8, 0.81, 0.83, 0.9, None))
    rows = [(i, f"r{j}", rng.choice(("k1", "k2", "k3", None)), share(), share()) for i in range(200) for j in range(rng.randint(1, 6))]
    want = {}
    rank = lambda r: tuple((x is not None, x or 0) for x in (r[4], r[3])) + (r[1],)
    for i in range(200):
        own = [r for r in rows if r[0] == i]
        best = max(own, key=rank)
        second = max((r[4] for r in own if None not in (r[2], best[2], r[4]) and r[2] != best[2]), default=0.0)
        want[i] = (best[1], best[3], best[4], second)
    out = verify.best_with_margin(spark.createDataFrame(rows, "left_id long, right_id string, key string, score double, total double"))
    assert {r["left_id"]: (r["best_id"], r["best_score"], r["best_total"], r["second_total"]) for r in out.collect()} == want
    plan = q_catalog.mapping_best_margin(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("sha2(") == 1


def test_judges(spark):
    codes = spark.createDataFrame([(1, "h1", "good"), (1, "h2", "bad"), (2, "h3", "good")], "problem_id long, code_hash string, code string")
    cases = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b")], "problem_id long, name string")
    runner = lambda code, case: {"status": "passed"} if code == "good" or case["name"] != "b" else {"status": "wrong_answer", "stage": "wrong_answer", "detail": "d" * 2000}
    first = {r["code_hash"]: r for r in verify.judge(codes, cases, runner).collect()}
    assert (first["h1"]["status"], first["h1"]["passed_testcases"]) == ("AC", 3)
    assert (first["h2"]["status"], first["h2"]["passed_testcases"], first["h2"]["failed_testcase"], len(first["h2"]["detail"])) == ("FAIL", 1, "b", 1000)
    assert first["h3"]["status"] == "UNVERIFIED"
    every = {r["code_hash"]: r for r in verify.judge(codes, cases, runner, stop_at_first=False).collect()}
    assert every["h2"]["passed_testcases"] == 2


def test_simulator_outcomes():
    run = verify.simulator(["python3", "-m", "py_compile", "{dir}/submission.v"], ["python3", "{dir}/submission.v"])
    case = {"standard": "1\n2\n", "timeout": 20}
    assert run("print(1)\nprint(2)", case)["status"] == "passed"
    assert run("print(3)", case)["status"] == "wrong_answer"
    assert run("def", case)["status"] == "compile_error"
    assert run("while True: pass", case | {"timeout": 2})["status"] == "simulation_timeout"
    assert run("raise SystemExit(3)", case)["status"] == "simulation_error"
    assert run("", {"standard": "", "timeout": 20})["status"] == "wrong_answer"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"pair_id": "x", "n": 1}\n\n{"pair_id": "y z"}\n', encoding="utf-8")
    path = str(tmp_path / "a.jsonl")
    assert readers.read_jsonl(spark, path, "pair_id string, n long").count() == 2
    assert readers.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "pair_id string").count() == 0
    with pytest.raises(Exception, match="a blank line"):
        readers.read_jsonl_strict(spark, path, "pair_id string, n long").collect()
    rows = readers.read_splits(spark, [path], "pair_id string, n long").collect()
    assert sorted((r["split"], r["line"], r["pair_id"]) for r in rows) == [("a", 1, "x"), ("a", 3, "y\u2028z")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "x\ty")], "pair_id string, note string")
    sinks.write_jsonl(rows, str(tmp_path / "nulls"))
    found = [json.loads(line) for f in (tmp_path / "nulls").glob("part-*") for line in f.read_text().splitlines()]
    assert {"pair_id": "a", "note": None} in found
    assert keys.append_new(rows.unionByName(rows), str(tmp_path / "out")) == 2
    assert keys.append_new(rows.unionByName(spark.createDataFrame([("c", None)], rows.schema)), str(tmp_path / "out")) == 1
    assert sorted(r["note"] or "" for r in sinks.as_cells(rows).collect()) == ["", "x y"]
    assert keys.append_new(rows, str(tmp_path / "out")) == 0 and spark.read.json(str(tmp_path / "out")).count() == 3
    for _ in range(2):
        sinks.write_atomic(rows, str(tmp_path / "atomic"))
    (tmp_path / "atomic").rename(tmp_path / "atomic.old")  # a call that was cut off between its two moves
    sinks.write_atomic(rows, str(tmp_path / "atomic"))
    assert not (tmp_path / "atomic.old").exists()
    assert spark.read.json(str(tmp_path / "atomic")).count() == 2
    assert "| a |  |" in sinks.markdown_table(rows, ["pair_id"]).head()["report"]
    sinks.write_tagged(rows, str(tmp_path / "tagged"), "pair_id")
    assert (tmp_path / "tagged" / "pair_id=a").exists()
    sinks.write_tsv(rows, str(tmp_path / "tsv"))
    sinks.write_csv(rows, str(tmp_path / "csv"))


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        for name, text in files.items():
            f.writestr(name.replace("__", "/").replace("_", "."), text)
    return out.getvalue()


def test_archives(spark, tmp_path):
    members = {
        "main/problem/p1/testcase/c1/attachment/a.zip": zipped(deep__tb_v="module tb;", standard_txt="1\r\n", argv_txt='{"universal": {"timeout": 3}}'),
        "main/problem/p1/testcase/c2/attachment/a.zip": zipped(standard_txt="1\n"), "main/problem/p1/testcase/c2/testcase.yaml": b"judge_parameter:\n  universal:\n    timeout: 4\n",
        "../evil.zip": b"x", "main/problem/p1/description.md": b"text",
    }
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.tar.gz"))
    assert {r["member"] for r in readers.tar_members(files).collect()} == set(members) - {"../evil.zip"}
    assert {r["member"] for r in readers.read_tar(spark, [r["path"] for r in files.select("path").collect()], r"\.md$").collect()} == {"main/problem/p1/description.md"}  # streamed
    cases = {r["name"]: r for r in readers.zip_testcases(readers.tar_members(files)).collect()}
    assert set(cases["c1"]["files"]) == {"tb.v", "standard.txt", "argv.txt"} and cases["c1"]["timeout"] == 3 and cases["c1"]["standard"] == "1\n"
    assert cases["c2"]["files"] is None and cases["c2"]["timeout"] == 4
    bad = spark.createDataFrame([("a", "main/problem/p1/testcase/c/attachment/x.zip", bytearray(zipped(**{"..__..__x_v": "m"})))], readers.MEMBERS)
    none = spark.createDataFrame([], "path string, content binary")
    with pytest.raises(Exception, match="holds"):
        readers.materialise(bad, none, spark.createDataFrame([("p1",)], "name string")).collect()


def test_code_folders_and_fingerprints(spark, tmp_path):
    (tmp_path / "m" / "d").mkdir(parents=True)
    (tmp_path / "m" / "a.v").write_text("module a;")
    (tmp_path / "m" / "d" / "b.v").write_bytes("中".encode("gb18030"))
    (tmp_path / "m" / "w.safetensors").write_bytes(b"1")
    code = readers.read_code(spark, str(tmp_path / "m"))
    assert {(r["path"], r["encoding"]) for r in code.collect()} == {("a.v", "utf-8"), ("d/b.v", "gb18030")}
    pairs = spark.createDataFrame([("p", "a.v", "d/b.v")], "pair_id string, buggy_path string, fixed_path string")
    assert readers.load_pairs(pairs, code).head()["fixed_code"] == "中"
    marks = {r["path"].rsplit("/", 1)[1]: r["mark"] for r in readers.fingerprint(spark, str(tmp_path / "m")).collect()}
    assert marks["w.safetensors"].startswith("1:") and len(marks["a.v"]) == 64


def test_priorities_and_branches(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "name string, content string")
    out = readers.prefer_plain(make(("a", "plain"), ("b", "plain")), make(("a", "zip"), ("c", "zip")), make(("b", "made")), ["name"])
    assert {r["name"]: r["content"] for r in out.collect()} == {"a": "plain", "b": "made", "c": "zip"}
    cases = spark.createDataFrame([("main", "p1"), ("old", "p1"), ("main", "p2")], "branch string, directory string")
    assert [r["directory"] for r in readers.on_one_branch(cases).collect()] == ["p2"]


def test_scratch_has_a_scope(spark):
    with scratch.scope(spark):
        rows = scratch.written(spark.range(10), "scoped")
        path = rows.inputFiles()[0].rsplit("/", 1)[0]
        assert rows.count() == 10 and readers.exists(spark, path)
    assert not readers.exists(spark, path)


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"pair_id": "a"}\n{"pair_id": "a"}\n{"pair_id": "b"}\n')
    go = lambda: resume.stream_results(spark, str(tmp_path / "in"), "pair_id string", lambda d: d.withColumn("ok", F.lit(True)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    (tmp_path / "in" / "2.json").write_text('{"pair_id": "b"}\n{"pair_id": "c"}\n')
    go()
    assert sorted(r["pair_id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_empty_inputs(spark):
    kinds = "pair_id string, problem_id long, student_id long, buggy_code string, fixed_code string, verification string, valid_repair boolean"
    none = spark.createDataFrame([], kinds)
    catalog = spark.createDataFrame([], "id long, name string, description string")
    scored = scoring.score(filters.keep(filters.hard_reject(filters.with_distance(none), catalog)))
    assert scoring.quality_sample(scored).count() == 0 and scoring.student_split(none).count() == 0
    assert filters.distance_stats(filters.with_distance(none)).head()["n"] == 0
    assert chat.chat_rows(none, catalog).count() == 0


def test_grams_take_time_that_grows_with_the_text(spark):
    rng = random.Random(3)
    texts = ["", "abcd", "ab\n" * 9, None, *("".join(rng.choice("ab\n😀é中") for _ in range(k)) for k in range(30))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.grams(F.col("t")).alias("g")).collect()
    assert all(r.g == list(dict.fromkeys((r.t or "")[i : i + 5] for i in range(len(r.t or "") - 4))) for r in got) and len(got) == len(texts)
    long = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    began = time.monotonic()
    out = verify.gram_scores(spark.createDataFrame([(1, long[7:300])], "left_id long, key string"), spark.createDataFrame([(2, long), (3, "zzzzzz")], "right_id long, key string"), 0.3).collect()
    assert [tuple(r) for r in out] == [(1, 2, 1.0)] and time.monotonic() - began < 25
