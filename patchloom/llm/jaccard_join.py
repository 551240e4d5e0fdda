"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word shingles, as hashes, in one order of all sets: those that a sample of the documents has often
come last, by a bit table of fixed size, and else they go by hash. (The order changes what is compared, never which
pairs are found.) If two sets are similar
enough, their prefixes of n - ceil(t n) + l shingles share at least l, for every l. A prefix of l = 1 is enough to meet
by, but some shingles are dear there: the documents that meet in them are many. So each document lengthens its prefix by
what its candidates are estimated to cost: by little (SLACK shingles and an eighth) where the sample has seen none of its
prefix often, and by one more for every LONGER shingles that it has. It joins by what is not dear in its prefix, and a pair
must share L shingles before it is verified, where L is what the shorter lengthening demands, less the dear ones that the
pair may share unseen (those of the one that has fewer). A document with more dear shingles than its lengthening has, and
so without such a demand, meets all documents by the first shingle of their prefixes of l = 1 that they have in common.

Links are found in two rounds, so that a large group of near copies is not expanded into its pairs:

1. Of each shared prefix shingle the least document is the pivot; each document is verified against the pivot it
   shares most with, and verified pairs give components.
2. Of each shingle whose documents lie in several components, those outside of its largest component meet all that
   lie in another component than they. So no document meets those it is linked to already, and a shingle's cost is the
   number of its documents outside of its largest component. Meetings are counted by pairs before anything is fetched.

All tables are joined by sorting or as Spark sees fit by the sizes it finds; this code broadcasts the bit table alone
(8 MB), and nothing but that and counts comes to the driver. The prefixes lie in buckets by document, with the texts, so what is looked up
there does not move them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm import graph, words
from patchloom.llm.common import Buckets, bit_table, join_groups, odd_ids, written

#: A shingle is dear if more documents than this lie outside of its largest component.
DEAR = 24
#: Shingles by which every prefix is lengthened, beside an eighth of it, and frequent ones in it that make it longer by one.
SLACK, LONGER = 8, 4
#: One document in SAMPLE is looked at for what is frequent; a shingle that OFTEN of them have comes last.
SAMPLE, OFTEN = 8, 3
STORED = "rid long, text string, n int, slack int, s1 long, s2 long, prefix array<long>"


def _need(n, percent: int):
    """The least number of shingles that a similar set shares with a set of n."""
    return (percent * n + 99) // 100


def _lengthened(n: np.ndarray, often: np.ndarray, place: np.ndarray, text: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the prefix of l = 1 of each text, and by how many more it is lengthened. Of the shingles, text after
    text: whether each is frequent, its place in its text, and its text."""
    core = np.where(n > 0, n - _need(n, percent) + 1, 0)
    costs = np.bincount(text[often & (place < core[text])], minlength=len(n))
    return core, np.minimum(n - core, np.where(n > 0, SLACK + core // 8 + costs // LONGER, 0))


def _core(n: Column, percent: int) -> Column:
    """Shingles of a prefix of l = 1."""
    return n - F.floor((percent * n + 99) / F.lit(100)).cast("int") + 1


def _counted(k: int):
    """The shingles of some texts and how many of them have each; texts of equal sets count once in a stretch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for _, _, flat, sizes in words.flat_sets(batch[0], k):
                ends = np.cumsum(sizes)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(flat), dtype=np.uint64)])
                first = np.zeros(len(sizes), bool)
                first[np.unique(sums[ends] - sums[ends - sizes], return_index=True)[1]] = True
                held.append(flat[np.repeat(first, sizes)])
            h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _stored(k: int, percent: int, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = often.value
        for batch in batches:
            for a, b, flat, sizes in words.flat_sets(batch[1], k):
                last, text = words.in_bits(flat, table), np.repeat(np.arange(b - a), sizes)
                if last.any():
                    order = np.argsort(2 * text + last, kind="stable")
                    flat, last = flat[order], last[order]
                ends = np.cumsum(sizes)
                place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
                core, slack = _lengthened(sizes, last, place, text, percent)
                kept = core + slack
                values = pa.array(flat[place < np.repeat(kept, sizes)].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), values)
                one = words.mix(flat)
                signs = []
                for h in (one, words.mix(one ^ np.uint64(0x5851F42D4C957F2D))):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
                    signs.append(pa.array((sums[ends] - sums[ends - sizes]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), batch[1].slice(a, b - a), pa.array(sizes, pa.int32()), pa.array(slack, pa.int32()), *signs, lists], names=["rid", "text", "n", "slack", "s1", "s2", "prefix"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, flat, sizes in words.flat_sets(batch[1], k):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), lists], names=["rid", "shingles"])

    return run


def _enough_shared(pairs: DataFrame, stored: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that share as many shingles of their lengthened prefixes as the shorter lengthening demands."""
    pairs = written(pairs, f"{name}-met")
    side = lambda c: stored.select(F.col("rid").alias(c), _core(F.col("n"), percent).alias(f"core{c}"), F.col("slack").alias(f"slack{c}"), F.col("prefix").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("more", F.least("slacka", "slackb"))
    first = lambda c: F.slice(f"p{c}", F.lit(1), F.col(f"core{c}") + F.col("more"))
    return both.where(F.size(F.array_intersect(first("a"), first("b"))) > F.col("more")).select("a", "b")


def _verified(pairs: DataFrame, stored: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of rids that are similar, by their whole shingle sets."""
    pairs = written(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = stored.select("rid", "text").join(wanted, "rid", "left_semi").mapInArrow(words.tidy(_sets(k)), "rid long, shingles array<long>")
    sets = written(sets, f"{name}-sets")
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def join(documents: DataFrame, k: int = 5, percent: int = 75, dear: int = DEAR) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of documents (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of k-word shingles; component_id is the
    least doc_id that links lead to. A null, empty or blank text has no shingle and no link; a text of fewer than k
    words has one. A null doc_id stays null in the result, its row links like others and gives no component its name
    (a component of null ids alone is null). Repeated doc_ids are rows of their own. An empty table gives no row.
    Other columns are not read. `dear` sets what is compared, never what is found.
    """
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    if not odd_ids(docs):
        out = _joined(docs.select(F.col("doc_id").alias("rid"), "text"), k, percent, dear)
        return out.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    docs = written(docs.withColumn("rid", F.monotonically_increasing_id()), "rows")
    out = _joined(docs.select("rid", "text"), k, percent, dear).join(docs.select("rid", "doc_id"), "rid")
    names = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return out.join(names, "component").select("doc_id", "n_shingles", "component_id")


def _joined(texts: DataFrame, k: int, percent: int, dear: int = DEAR) -> DataFrame:
    """rid, n_shingles, component (the least rid that links lead to) for every row of texts (rid, text)."""
    spark = texts.sparkSession
    some = texts.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(words.tidy(_counted(k)), "h long, n long")
    often = written(some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).select("h"), "often")
    known = spark.sparkContext.broadcast(bit_table(often, "h"))
    tables = Buckets(spark)
    name = tables.write(texts.mapInArrow(words.tidy(_stored(k, percent, known)), STORED), "prefixes", "rid")
    path, stored = tables.paths[name], spark.table(name)

    # copies: one document of each set goes on
    whole = stored.where("n > 0").select("rid", F.struct("s1", "s2", "n").alias("s"))
    first = written(whole.groupBy("s").agg(F.min("rid").alias("first"), F.count("*").alias("c")).where("c > 1").select("s", "first"), "firsts")
    copies = written(join_groups(whole, first, "s").where("rid <> first").select("rid", "first"), "copies")
    single = stored.select("rid", "n", "slack", "prefix").where("n > 0").join(copies.select("rid"), "rid", "left_anti")
    shared = written(single.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "shared")
    rows = written(single.select("rid", "n", "slack", F.explode("prefix").alias("h")).join(shared, "h"), "matches")

    links = _to_pivots(rows, stored, k, percent)
    known = written(graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "known")
    more = _verified(_between(rows, known, stored, percent, dear), stored, k, percent, "round2")

    edges = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = edges.unionByName(copies.select(F.col("rid").alias("u"), F.col("first").alias("v")))
    found = graph.components(edges)
    tables.close(files=False)
    sizes = spark.read.schema("rid long, n int").parquet(path)
    out = sizes.select("rid", F.col("n").cast("long").alias("n_shingles")).join(found.withColumnRenamed("node", "rid"), "rid", "left")
    return out.withColumn("component", F.coalesce("component", "rid")).select("rid", "n_shingles", "component")


def _long_enough(n, m, percent: int):
    """Sets of these sizes can be similar."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _to_pivots(rows: DataFrame, stored: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of documents and the pivots they share most with."""
    pivots = rows.groupBy("h").agg(F.min(F.struct("rid", "n")).alias("p")).select("h", "p")
    near = rows.select("h", "rid", "n").join(pivots, "h").where((F.col("rid") != F.col("p.rid")) & _long_enough(F.col("n"), F.col("p.n"), percent))
    near = near.groupBy("rid", F.col("p.rid").alias("pivot")).agg(F.count("*").alias("c"))
    best = near.groupBy("rid").agg(F.max_by("pivot", F.struct("c", -F.col("pivot"))).alias("pivot"))
    best = best.select(F.col("rid").alias("a"), F.col("pivot").alias("b"))
    return written(_verified(_enough_shared(best, stored, percent, "round1"), stored, k, percent, "round1"), "links1")


def _between(rows: DataFrame, known: DataFrame, stored: DataFrame, percent: int, dear: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that share as many prefix shingles as similar ones do.

    rows: rid, n, slack, h, for the shingles of lengthened prefixes that several documents have."""
    named = rows.join(known.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    each = named.groupBy("h", "component").agg(F.count("*").alias("c"))
    cost = each.groupBy("h").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all")).where("all > m.c")
    cost = written(cost.select("h", F.col("m.component").alias("major"), (F.col("all") - F.col("m.c")).alias("others")), "costs")
    left = named.join(cost, "h").withColumn("dear", F.col("others") > dear)
    unseen = left.groupBy("rid").agg(F.count_if("dear").cast("int").alias("unseen"))
    left = written(left.drop("others").join(unseen, "rid").withColumn("lost", F.col("unseen") > F.col("slack")), "apart")

    # what is not dear: every meeting of a pair is counted
    light = left.where(~F.col("dear"))
    x, y = (df.select("h", "major", *[F.col(c).alias(f"{c}_{s}") for c in ("rid", "n", "component", "slack", "unseen")]) for s, df in (("x", light.where(F.col("component") != F.col("major"))), ("y", light)))
    # two that both lie outside of the largest component would meet twice
    once = (F.col("component_y") == F.col("major")) | (F.col("rid_x") < F.col("rid_y"))
    pairs = x.join(y.drop("major"), "h").where((F.col("component_x") != F.col("component_y")) & once & _long_enough(F.col("n_x"), F.col("n_y"), percent))
    need = F.greatest(F.least("slack_x", "slack_y") + 1 - F.least("unseen_x", "unseen_y"), F.lit(1))
    pairs = pairs.groupBy(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b"), need.alias("need")).agg(F.count("*").alias("c"))
    found = pairs.where("c >= need").select("a", "b")

    # documents without a demand: every shingle of their prefixes of l = 1, at the first that a pair has in common
    own = written(left.where("lost").select("h").distinct(), "lost-shingles")
    around = written(left.join(own, "h", "left_semi").groupBy("rid").agg(F.first("component").alias("component"), F.first("lost").alias("lost")), "lost-around")
    core = F.slice("prefix", F.lit(1), _core(F.col("n"), percent))
    spots = stored.select("rid", "n", "prefix").join(around, "rid").select("rid", "n", "component", "lost", "prefix", F.posexplode(core).alias("pos", "h"))
    spots = written(spots.withColumn("before", F.get("prefix", F.col("pos") - 1)).drop("prefix").join(own, "h", "left_semi"), "lost-spots")
    x, y = (df.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("rid", "n", "component", "lost", "pos", "before")]) for s, df in (("x", spots.where("lost")), ("y", spots)))
    once = ~F.col("lost_y") | (F.col("rid_x") < F.col("rid_y"))
    # with the same shingle before, an earlier common one speaks for the pair
    first = ~F.coalesce(F.col("before_x") == F.col("before_y"), F.lit(False))
    enough = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= F.ceil((F.col("n_x") + F.col("n_y")) * F.lit(percent) / F.lit(100 + percent))
    met = x.join(y, "h").where((F.col("component_x") != F.col("component_y")) & once & first & enough)
    met = met.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct()
    return found.unionByName(_enough_shared(met, stored, percent, "lost")).distinct()


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component of join(), which names rows one by one: all columns of the row of the least doc_id.

    A null doc_id comes last; among rows of one doc_id the least hash of their columns decides. So a row that is like
    no other stays, whatever its doc_id: null, or one that other rows have too. So do all rows without a word.
    """
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    if not odd_ids(docs):
        reps = _joined(docs.select(F.col("doc_id").alias("rid"), "text"), k, percent).where("rid = component")
        return documents.join(reps.select(F.col("rid").alias("doc_id")), "doc_id", "left_semi").select(*documents.columns)
    whole = documents.select(F.struct(*documents.columns).alias("row"), F.xxhash64(*documents.columns).alias("tie"))
    rows = written(whole.withColumn("rid", F.monotonically_increasing_id()), "rows")
    out = _joined(rows.selectExpr("rid", "cast(row.text as string) text"), k, percent).select("rid", "component")
    keys = rows.selectExpr("rid", "cast(row.doc_id as long) doc_id", "tie")
    reps = out.join(keys, "rid").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "rid"))["rid"].alias("rid"))
    return rows.join(reps.select("rid"), "rid", "left_semi").select("row.*")
