"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document starts with target / source_size copies: the whole part is certain, the rest is a probability.
Two documents with open probabilities meet; words move from one to the other, in a random direction whose odds
keep both expectations, until one probability is 0 or 1. Words moved are words lost elsewhere, so the sum of
probability x size of a source stays what it was until its last open document. The pairs are met along small
groups of documents of like size (one array fold a group), each group hands its one open document to the next
level of a reduction tree, and a source ends with one open document, which goes to the nearer whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm.common import word_count, written
from patchloom.operators.scoring import global_rank

#: Documents that meet in one group, on average.
GROUP = 32


def uniform(*parts) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target. Sources by code point, null last, weigh 1, 2, 3, repeating.

    The level L with sum(min(most * size, weight * L)) = sum(size) is where resharing the excess ends. It rises from the
    level without caps: what lies above its cap is capped, and the level of the others follows, until no more are. Each
    round is one aggregate; the places of the sources are counted in ranges of them, so there may be many.
    """
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("none", F.col("source").isNull())
    t = global_rank(t, ["none", "source"], "place").withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("double")).drop("none", "place")
    t = written(t.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("at", F.col("cap") / F.col("weight")), "mix-sources")
    level, capped = -1.0, -1
    while True:
        free = F.col("at") >= level
        zero = F.lit(0.0)
        got = t.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(~free, F.col("cap"))), zero).alias("caps"),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), zero).alias("weights"), F.count_if(~free).alias("capped"),
        ).head()
        if got["capped"] == capped or not got["weights"] or not got["all"]:
            break
        level, capped = (got["all"] - got["caps"]) / got["weights"], got["capped"]
    return t.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def _meet(state: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the open document of the group meets x."""
    a, none = state["open"], state["open"].isNull()
    a_words, x_words = a["p"] * a["size"], x["p"] * x["size"]
    a_room, x_room = (1 - a["p"]) * a["size"], (1 - x["p"]) * x["size"]
    up, down = F.least(a_room, x_words), F.least(a_words, x_room)  # words that a can gain from x, and lose to x
    gains = uniform(F.lit(seed), a["id"], x["id"], a["n"], x["n"]) * (up + down) < down
    a_closes = F.when(gains, a_room <= x_words).otherwise(a_words <= x_room)
    a_p = F.when(gains, F.when(a_room <= x_words, 1.0).otherwise(a["p"] + up / a["size"])).otherwise(
        F.when(a_words <= x_room, 0.0).otherwise(a["p"] - down / a["size"])
    )
    x_p = F.when(gains, F.when(a_room >= x_words, 0.0).otherwise(x["p"] - up / x["size"])).otherwise(
        F.when(a_words >= x_room, 1.0).otherwise(x["p"] + down / x["size"])
    )
    with_p = lambda d, p: F.struct(d["size"].alias("size"), d["id"].alias("id"), d["n"].alias("n"), p.alias("p"))
    a2, x2 = with_p(a, a_p), with_p(x, x_p)
    return F.struct(
        F.when(none, x).when(a_closes, x2).otherwise(a2).alias("open"),
        F.when(none, state["closed"]).when(a_closes, F.concat(state["closed"], F.array(a2))).otherwise(F.concat(state["closed"], F.array(x2))).alias("closed"),
    )


def _level(rows: DataFrame, level: int, seed: int, group: int) -> DataFrame:
    """rows (source, b, size, id, n, p) in groups of about `group` of like size -> the same rows, p moved; open ones marked."""
    band = F.floor(F.col("b") / F.lit(float(4**level)))
    keyed = rows.withColumn("band", band)
    counts = keyed.groupBy("source", "band").agg(F.ceil(F.count("*") / F.lit(float(group))).alias("groups"))
    # one row a source and band: about 100 a source on the first level
    dealt = keyed.alias("k").join(counts.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.band") == F.col("c.band")))
    dealt = dealt.select("k.source", "k.band", F.pmod(F.xxhash64(F.lit(seed + level), "k.id", "k.n"), F.col("c.groups")).alias("g"), F.struct("k.size", "k.id", "k.n", "k.p").alias("d"))
    arrays = dealt.groupBy("source", "band", "g").agg(F.sort_array(F.collect_list("d"), asc=False).alias("ds"))
    kind = "struct<size:bigint,id:bigint,n:bigint,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("closed"))
    folded = arrays.select("source", F.aggregate("ds", start, lambda s, x: _meet(s, x, seed + level)).alias("s"))
    both = F.concat(F.col("s.closed"), F.array(F.col("s.open")))
    return folded.select("source", F.inline(both)).withColumn("b", F.floor(F.log2(F.col("size") + 1.0) * 8)).withColumn("open", (F.col("p") > 0) & (F.col("p") < 1))


def _numbered(documents: DataFrame, key: Column) -> DataFrame:
    """doc_id, source, size, t, n: t is the hash of what tells rows of one doc_id apart, n a number among equal rows.

    Equal rows are counted before they are shuffled, and numbered where the count lies."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), key.alias("t"))
    many = rows.groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("k"))
    return many.select("doc_id", "source", "size", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("n"))


def mix(documents: DataFrame, seed: int = 0, most: float = 3.0, group: int = GROUP, key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, source, t, n: one row for each row of documents (doc_id, source, text).

    A null text has size 0; a null source is a source of its own; a null doc_id is a document like others. Rows of one
    doc_id are told apart by t, the hash of `key` (their text), and equal rows by a running number n. A document of
    size 0 gets the whole part of its copies; an empty table gives no row. Reruns give the same rows, for draws are
    hashes of the seed and of what names a row.
    """
    rows = written(_numbered(documents, F.xxhash64(F.col("text").cast("string")) if key is None else key), "mix-sizes")
    goal = written(targets(rows, most), "mix-targets")
    rows = rows.withColumn("id", F.xxhash64("doc_id", "source", "t", "size")).alias("d").join(goal.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(F.least(copies, F.lit(most)) + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), copies - F.col("whole")))
    rows = rows.withColumn("p", F.when((F.col("p") < 1e-9) | (F.col("size") == 0) | (F.col("whole") >= most), 0.0).otherwise(F.col("p")))
    rows = written(rows, "mix-rows")

    # in the tree a document is its id, a hash of all that names it but n; two unlike ones meet by chance in 2^-64
    left = rows.where("p > 0").select("source", "size", "id", "n", "p", F.floor(F.log2(F.col("size") + 1.0) * 8).alias("b"))
    closed: list[DataFrame] = []
    most_open = lambda df: df.groupBy("source").count().agg(F.max("count")).head()[0] or 0
    level, still = 0, most_open(left)
    while still > 1:  # a group leaves one open document at most, and from level 4 on all of a source may meet
        folded = written(_level(left, level, seed, group), f"mix-level{level}")
        closed.append(folded.where("not open").select("source", "id", "n", "p"))
        left = folded.where("open").select("source", "size", "id", "n", "p", "b")
        level, still = level + 1, most_open(left)
    last = left.select("source", "id", "n", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("p"))
    drawn = last
    for part in closed:
        drawn = drawn.unionByName(part)
    drawn = drawn.where("p > 0").select("id", "n", F.lit(1).cast("long").alias("more"))
    got = rows.join(drawn, ["id", "n"], "left").withColumn("copies", F.col("whole") + F.coalesce("more", F.lit(0)).cast("long"))
    return got.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source", "t", "n")


def mixed(documents: DataFrame, **more) -> DataFrame:
    """The rows of documents (doc_id, source, text and others), each as often as mix() takes it.

    Rows that differ in any column are told apart; of rows equal in all of them each has its own draw.
    """
    own = "_mix"
    while any(c.startswith(own) for c in documents.columns):
        own += "_"
    ident, theirs, number, times, place, again = (own + x for x in ("t", "u", "n", "times", "place", "again"))
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns])
    copies = mix(documents, key=everything, **more).select(F.col("t").alias(theirs), F.col("n").alias(number), F.col("copies").alias(times))
    copies = written(copies, "mix-copies")
    rows = documents.withColumn(ident, everything)
    same = (F.col(ident) == F.col(theirs)) & (F.col(number) == 0)
    if copies.where(F.col(number) > 0).head(1):
        # only rows that occur again are numbered
        often = copies.where(F.col(number) == 1).select(F.col(theirs).alias(again))
        alone = rows.join(often, F.col(ident) == F.col(again), "left_anti").withColumn(place, F.lit(0).cast("long"))
        equal = rows.join(often, F.col(ident) == F.col(again), "left_semi").withColumn(place, (F.row_number().over(Window.partitionBy(ident).orderBy(ident)) - 1).cast("long"))
        rows, same = alone.unionByName(equal), (F.col(ident) == F.col(theirs)) & (F.col(place) == F.col(number))
    got = rows.join(copies.where(F.col(times) > 0), same)
    return got.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[F.col(f"`{c}`") for c in documents.columns])
