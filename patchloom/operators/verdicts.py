"""A store of verdicts that runs share: what was judged under the same conditions is not judged again.

A verdict is kept by problem and content hash of the code, with what it took (the phases of its cases), the limit of
seconds it was judged under and the conditions of its run (a mark over data, testcases, judge and versions). It holds
for a later run of the same conditions whose limit is not longer, if every phase timed out or took at most the new limit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from patchloom.operators import verify
from patchloom.operators.filters import may_reuse
from patchloom.sources.scratch import written
from patchloom.sources.segments import Segments

KEYS = ["problem_id", "code_hash"]
SCHEMA = f"{verify.VERDICT}, limit double, conditions string, run string"
REST = ["status", "passed_testcases", "total_testcases", "failed_testcase", "failure_stage", "detail", "phases", "limit", "conditions", "run"]
FIELDS = [*KEYS, *REST]


def conditions(**marks: str) -> Column:
    """One mark of the conditions of a run: of data, manifest, testcase files, judge and versions, say."""
    return F.sha2(F.lit("\n".join(f"{k}={marks[k]}" for k in sorted(marks))), 256)


class VerdictStore(Segments):
    """The store in the folder `path`. A key that was judged again has several rows: each under other conditions, or
    under another limit; of one limit and conditions the later one counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = 4):
        def merged(rows: DataFrame) -> DataFrame:
            rest = [c for c in REST if c not in ("conditions", "limit")]
            late = rows.groupBy(*KEYS, "conditions", "limit").agg(F.max_by(F.struct(*rest), "run").alias("v"))
            return late.select(*[f"v.{c}" if c in rest else c for c in FIELDS])

        super().__init__(spark, path, SCHEMA, KEYS, merged, ("verdicts",), buckets, fanout)

    def lookup(self, codes: DataFrame, limit: float, conditions: Column) -> DataFrame:
        """The codes (dealt into the store's buckets) with `known`: the latest verdict that holds now, or null.

        Each segment is joined where it lies: neither it nor the codes are shuffled."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(SCHEMA)}
        out = codes.withColumn("known", F.lit(None).cast(StructType([StructField(c, kinds[c]) for c in REST])))
        holds = (F.col("conditions") == conditions) & (F.col("limit") >= limit) & F.coalesce(may_reuse(F.col("phases"), F.lit(limit)), F.lit(True))
        for segment in reversed(self.segments()):
            # of a key the segment may hold several rows that hold: the one of the shortest limit, then the latest run
            own = segment.where(holds).groupBy(*KEYS).agg(F.max_by(F.struct(*REST), F.struct(-F.col("limit"), "run")).alias("_held")).hint("merge")
            out = out.join(own, KEYS, "left").withColumn("known", F.coalesce("known", "_held")).drop("_held")
        return out


def judge_again(
    codes: DataFrame, cases: DataFrame, runner: Callable[[str, dict], dict], store: VerdictStore, limit: float, conditions: Column, run: str, **more
) -> DataFrame:
    """The verdicts of codes (problem_id, code_hash, code), as verify.judge gives them, with limit, conditions, run and
    reused: those that the store has and that hold are taken from it, all others are judged and added to it.

    `run` names this run, in an order that grows with time. A code that stands several times is judged once; a run that
    is cut off leaves the store as it was."""
    dealt, path = store.dealt(codes.select(*KEYS, "code").dropDuplicates(KEYS))
    looked = written(store.lookup(dealt, limit, conditions), "looked-up")
    store.drop(path)
    new = verify.judge(looked.where("known is null").select(*KEYS, "code"), cases, runner, **more)
    new = new.withColumn("limit", F.lit(float(limit))).withColumn("conditions", conditions).withColumn("run", F.lit(run)).select(*FIELDS)
    fresh = written(store.write(new, store.next("verdicts")), "judged")
    store.commit()
    reused = looked.where("known is not null").select(*KEYS, "known.*").select(*FIELDS)
    return reused.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
