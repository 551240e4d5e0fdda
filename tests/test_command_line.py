"""The command line, on small files."""

import json

import pytest

from patchloom.__main__ import STEPS, main, parser


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read(spark, path):
    return [r.asDict(recursive=True) for r in spark.read.json(path).collect()]


@pytest.fixture
def pairs(tmp_path):
    code = lambda i: f"module m{i}; assign a = {i}; endmodule"
    rows = [{"pair_id": f"p{i}", "problem_id": i % 3, "student_id": i % 8, "buggy_code": code(i), "fixed_code": code(i) if i % 10 == 0 else code(i) + " // ok", "verification": "testbench_verified"} for i in range(40)]
    rows[1]["fixed_code"] = "x"
    return lines(tmp_path / "pairs.jsonl", rows)


@pytest.fixture
def catalog(tmp_path):
    return lines(tmp_path / "catalog.jsonl", [{"id": i, "name": f"n{i}", "description": f"d{i}"} for i in range(3)])


def test_every_step_has_its_flags():
    assert set(STEPS) == {"filter-length", "filter-distance", "score", "split", "convert", "token-stats", "evaluate", "compare", "normalise"}
    a = parser().parse_args(["score", "--input", "a", "--catalog", "b", "--output", "c"])
    assert (a.ratio, a.max_distance, a.seed) == (0.8, 0.9, 42)
    with pytest.raises(SystemExit):
        parser().parse_args(["score"])


def test_curation_steps(spark, tmp_path, pairs, catalog):
    out = lambda name: str(tmp_path / name)
    assert {r["filter_reason"]: r["n"] for r in main(["filter-length", "--input", pairs, "--output", out("length")])} == {None: 35, "identical_code": 4, "abnormal_length_change": 1}
    assert len(read(spark, f"{out('length')}/kept=true")) == 35
    assert sum(r["n"] for r in main(["filter-distance", "--input", pairs, "--output", out("distance"), "--threshold", "0.5"])) == 40
    summary = main(["score", "--input", pairs, "--catalog", catalog, "--output", out("scored"), "--ratio", "0.5"])
    by = {}
    for r in summary:
        by[r["output"]] = by.get(r["output"], 0) + r["n"]
    assert by["scored"] + by["rejected"] == 40 and by["selected"] == round(by["scored"] / 2)
    counts = main(["split", "--input", pairs, "--output", out("split"), "--cap", "5"])
    assert counts and len(read(spark, out("split"))) <= 45
    assert main(["convert", "--input", pairs, "--catalog", catalog, "--output", out("chat")]) == [{"rows": 40, "problems": 3}]
    stats = {r["measure"]: r for r in main(["token-stats", "--input", out("chat"), "--output", out("tokens"), "--limits", "10", "9999"])}
    assert stats["full"]["n"] == 40 and {r["token_limit"]: r["covered"] for r in read(spark, out("tokens/coverage"))} == {10: 0, 9999: 40}


def test_evaluation_steps(spark, tmp_path, pairs, catalog):
    run = lambda name, good: lines(tmp_path / name, [{"pair_id": f"p{i}", "problem_id": i % 3, "status": "AC" if i % good == 0 else "wrong_answer"} for i in range(30)])
    base, tuned = run("base.jsonl", 5), run("tuned.jsonl", 2)
    (whole,) = main(["evaluate", "--input", base, "--results", tuned, "--output", str(tmp_path / "rates")])
    assert (whole["total"], whole["completed"], whole["repaired"], whole["repair_rate"]) == (30, 30, 15, 0.5)
    (summary,) = main(["compare", "--base", base, "--tuned", tuned, "--catalog", catalog, "--train", pairs, "--output", str(tmp_path / "lift")])
    assert summary["micro_base"] == 0.2 and summary["micro_tuned"] == 0.5
    assert {r["change"] for r in read(spark, str(tmp_path / "lift/changed"))} == {"improved", "regressed"}


def test_normalise_step(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "src/deep/a.v").write_bytes(b"module a;  \r\nendmodule\r\n")
    (report,) = main(["normalise", "--input", str(tmp_path / "src")])
    assert report["total"] == 1 and report["changed"] == 1
    main(["normalise", "--input", str(tmp_path / "src"), "--output", str(tmp_path / "out")])
    assert "\r" not in read(spark, str(tmp_path / "out"))[0]["text"]
