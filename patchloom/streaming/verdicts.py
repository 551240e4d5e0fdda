"""Verdicts of a stream of case results: a code's verdict is out as soon as its first failure is certain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "code_id long, total long, failed_idx long, failure_stage string, passed long"
#: Of a group of codes: those that are done, and of each open one its cases so far and its first failure.
STATE = "done array<long>, open array<long>, arrived array<array<long>>, failed array<long>, stage array<string>"
#: Codes whose ids differ in so many of the last bits alone are a group: a call of Python for each code took its time.
BITS = 8


def _verdicts(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get if state.exists else ([], [], [], [], [])
    done = set(old[0])
    codes = {code: [set(arrived), failed, stage] for code, arrived, failed, stage in zip(*old[1:], strict=True)}
    totals: dict[int | None, int] = {}
    for frame in frames:
        ids = [None] * len(frame) if pd.isna(key[0]) else frame.code_id.tolist()
        for code, idx, status, total in zip(ids, frame.idx.tolist(), frame.status.tolist(), frame.total.tolist(), strict=True):
            if code in done:
                continue
            totals[code] = int(total)
            one = codes.setdefault(code, [set(), None, None])
            one[0].add(int(idx))
            if status != "passed" and (one[1] is None or idx < one[1]):
                one[1:] = int(idx), status
    rows = []
    for code, total in totals.items():
        arrived, failed, stage = codes[code]
        # certain: all cases before the failure are there, or all cases are
        first = total + 1 if failed is None else failed
        if total and all(i in arrived for i in range(1, first)):
            rows.append((code, total, failed, stage, first - 1))
            done.add(code)
            del codes[code]
    if rows:
        yield pd.DataFrame(rows, columns=["code_id", "total", "failed_idx", "failure_stage", "passed"]).astype({"code_id": "Int64", "failed_idx": "Int64"})
    each = list(codes.values())
    state.update((list(done), list(codes), [sorted(x[0]) for x in each], [x[1] for x in each], [x[2] for x in each]))


def first_failures(results: DataFrame) -> DataFrame:
    """Of each code of a stream of results (code_id, idx from 1, status, total: cases of the code) one row, as
    verify.first_failure gives it, in whatever order results arrive. It comes out when the first failure is certain, which
    may be long before the last case; later results of the code are ignored.

    The codes of a group, at most 256 with ids side by side, have one state: the numbers of the open codes' cases, and
    which codes are done."""
    grouped = results.withColumn("_group", F.shiftright("code_id", BITS)).groupBy("_group")
    return grouped.applyInPandasWithState(_verdicts, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
