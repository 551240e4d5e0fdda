"""Benchmark decontamination by greedy string tiling.

Runs of `seed` words are the seeds (an item of fewer words is one seed). The seeds of the documents and those of the
benchmark are joined, and pairs that share one are tiled: the longest run of words that the two have in common and no
tile holds yet is found by running Karp-Rabin hashes, compared word by word and marked, again and again, down to the seed
length. The tiles may stand in any order, so a shuffled passage is caught; the share of the item's words under tiles is
its coverage.

Not every seed of an item takes part in the join. Of its seeds, those that most documents have are left out for as long
as all that are left out cover fewer of its words than a leak has to: a document that leaks the item shares one of the others
too. So a phrase of many documents and items brings nobody together unless it is about all of the item.

Before the join each document drops what cannot be a seed of the benchmark, by a bit table of TABLE_BITS bits whatever
the size of the benchmark: a larger one lets more pass, and the join sorts them out. Of a document that keeps any, the
seeds go into the join, each once, and the words under them wait in a table of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import words
from patchloom.llm.common import TABLE_BITS, bit_table, written
from patchloom.sources.session import prepare

ITEMS = "item_id long, words array<long>, size int, seeds array<long>"
HITS = "doc_id long, t long, seeds array<long>, spots array<long>, words array<long>"
FOUND = "doc_id long, t long, item_id long, coverage double, matched_words long, tiles array<struct<doc_at:long,item_at:long,words:long>>"


def _starts(free: np.ndarray, size: int) -> np.ndarray:
    """Where runs of `size` free places begin."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    n = len(free) - size + 1
    return np.flatnonzero(taken[size:] == taken[:n]) if n > 0 else np.zeros(0, np.int64)


def _common(doc: np.ndarray, doc_free: np.ndarray, item: np.ndarray, item_free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes) of the free runs of `size` words in doc that item has too, and those in item."""
    i, j = _starts(doc_free, size), _starts(item_free, size)
    hi, hj = words.run_hashes(doc, i, i + size), words.run_hashes(item, j, j + size)
    in_item, in_doc = np.isin(hi, hj), np.isin(hj, hi)
    return i[in_item], hi[in_item], j[in_doc], hj[in_doc]


def tile(doc: np.ndarray, doc_free: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (doc place, item place, words), none overlapping another, the longest first, the first places first; none
    is shorter than least. Where doc_free is false, doc matches nothing.

    The longest common run is found by halving: if runs of some length are common, so are shorter ones. No list of
    matches is made, so a text of one word again and again takes no more time than another."""
    doc_free, item_free = doc_free.copy(), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= least:
        low, high = least - 1, most  # runs of `low` words are common (or too short), longer ones than `high` are not
        best = None
        while low < high:
            size = (low + high + 1) // 2
            found = _common(doc, doc_free, item, item_free, size)
            if len(found[0]):
                low, best = size, found
            else:
                high = size - 1
        if best is None:
            break
        size, most = low, low
        at = defaultdict(list)
        for place, h in zip(best[2][::-1].tolist(), best[3][::-1].tolist(), strict=True):
            at[h].append(place)  # the first place comes last
        end, before = 0, len(tiles)
        for i, h in zip(best[0].tolist(), best[1].tolist(), strict=True):
            if i < end:
                continue
            places = at[h]
            while places and not item_free[places[-1] : places[-1] + size].all():
                places.pop()
            if places:
                j = places.pop()
                if (doc[i : i + size] != item[j : j + size]).any():
                    continue
                doc_free[i : i + size] = item_free[j : j + size] = False
                tiles.append((i, j, size))
                end = i + size
        if len(tiles) == before:  # equal hashes of unequal runs
            most = size - 1
    return tiles


def _seeds_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return words.mix(words.runs(hashes, size) ^ np.uint64(size))


def _items(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in words.pieces(batch[1]):
                w = words.words_of(data, offsets, words.MARKS)
                for i, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    if y > x:
                        size, own = min(seed, y - x), w.hashes[x:y]
                        lists = [pa.array([v.view(np.int64)]) for v in (own, np.unique(_seeds_of(own, size)))]
                        yield pa.RecordBatch.from_arrays([batch[0].slice(a + i, 1), lists[0], pa.array([size], pa.int32()), lists[1]], names=["item_id", "words", "size", "seeds"])

    return run


def telling(item: np.ndarray, size: int, seeds: np.ndarray, docs: np.ndarray, threshold: float) -> np.ndarray:
    """The seeds of an item, by the numbers of documents that have them, of which a leak has one at least: all but the most
    frequent ones, which together cover less of the item than the threshold."""
    at = _seeds_of(item, size)
    order = np.lexsort((seeds, -docs))
    covered = np.zeros(len(item), bool)
    for k, seed in enumerate(seeds[order].tolist()):
        for place in np.flatnonzero(at == np.uint64(seed)).tolist():
            covered[place : place + size] = True
        if covered.sum() >= threshold * len(item):
            return seeds[order[k:]]
    return seeds[:0]


def _telling(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, size in enumerate(batch["size"].to_pylist()):
                item, seeds, docs = (batch[c][i].values.to_numpy() for c in ("words", "seeds", "docs"))
                kept = telling(item.view(np.uint64), size, seeds.view(np.uint64), docs, threshold).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch["item"][i].as_py(), len(kept)), pa.int64()), pa.array(kept)], names=["item", "seed"])

    return run


def meetings(each: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(doc, item) pairs that share a telling seed. each: doc, seed, once; items: item, words, size, seeds."""
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    found = each.groupBy("seed").agg(F.count("*").alias("docs"))
    own = seeds.join(found, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "docs")).alias("s"))
    own = own.select("item", F.col("s.seed").alias("seeds"), F.col("s.docs").alias("docs")).join(items.select("item", "words", "size"), "item")
    told = own.mapInArrow(words.tidy(_telling(threshold)), "item long, seed long")
    return each.select("doc", "seed").join(written(told, "telling-seeds"), "seed").select("doc", "item").distinct()


def _hits(known, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds = known.value, [pa.list_(pa.int64())] * 3
        for batch in batches:
            rows, lists = [], ([], [], [])
            for a, _, data, offsets in words.pieces(batch[2]):
                w = words.words_of(data, offsets, words.MARKS)
                each = np.diff(w.first)
                left = np.repeat(each, each) - (np.arange(len(w.hashes)) - np.repeat(w.first[:-1], each))  # words from each on
                places, seeds = [], []
                under = np.zeros(len(w.hashes), bool)
                for size in sizes:
                    mine = _seeds_of(w.hashes, size)
                    hit = np.flatnonzero(words.in_bits(mine, table) & (left[: len(mine)] >= size))
                    places.append(hit)
                    seeds.append(mine[hit])
                    for k in range(size):
                        under[hit + k] = True
                place, seed = np.concatenate(places), np.concatenate(seeds)
                text = np.searchsorted(w.first, place, "right") - 1
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(len(each) + 1))
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    kind = np.unique(seed[order[cuts[i] : cuts[i + 1]]])
                    spots = np.flatnonzero(under[w.first[i] : w.first[i + 1]])
                    rows.append(a + i)
                    for held, v in zip(lists, (kind.view(np.int64), spots, w.hashes[w.first[i] + spots].view(np.int64)), strict=True):
                        held.append(v)
            if rows:
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch[0].take(taken), batch[1].take(taken), *[pa.array(v, t) for v, t in zip(lists, kinds, strict=True)]], names=["doc_id", "t", "seeds", "spots", "words"])

    return run


def match(spots: np.ndarray, doc: np.ndarray, item: np.ndarray, size: int, threshold: float) -> tuple[int, list[tuple[int, int, int]]] | None:
    """(words under tiles, tiles) if a document covers an item to the threshold; doc holds the words at `spots`."""
    whole = np.zeros(len(doc), bool)  # spots under seeds of this item: tiles lie there
    at = np.flatnonzero(np.concatenate([spots[size - 1 :] - spots[: len(spots) - size + 1] == size - 1, np.zeros(min(size - 1, len(spots)), bool)]))
    at = at[np.isin(words.run_hashes(doc, at, at + size), words.run_hashes(item, np.arange(len(item) - size + 1), np.arange(size, len(item) + 1)))]
    for k in range(size):
        whole[at + k] = True
    if whole.sum() < threshold * len(item):
        return None
    kept = np.flatnonzero(whole)
    # a word that matches nothing stands between spots that are no neighbours
    breaks = np.flatnonzero(np.diff(spots[kept]) > 1) + 1
    place, free = np.insert(kept, breaks, 0), np.insert(np.ones(len(kept), bool), breaks, False)
    tiles = tile(doc[place], free, item, size)
    covered = sum(n for *_, n in tiles)
    return (covered, [(int(spots[place[i]]), j, n) for i, j, n in tiles]) if covered >= threshold * len(item) else None


def _tiled(threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("tiles", pa.list_(pa.struct([("doc_at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                spots, doc, item = (batch.column(c)[i].values.to_numpy() for c in ("spots", "words", "item"))
                if found := match(spots, doc.view(np.uint64), item.view(np.uint64), batch.column("size")[i].as_py(), threshold):
                    tiles = [{"doc_at": x, "item_at": y, "words": n} for x, y, n in found[1]]
                    rows.append({c: batch.column(c)[i].as_py() for c in ("doc_id", "t", "item_id")} | {"coverage": found[0] / len(item), "matched_words": found[0], "tiles": tiles})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, seed: int = 4, threshold: float = 0.5, filter_bits: int = TABLE_BITS) -> DataFrame:
    """doc_id, t (a hash of the text), item_id, coverage, matched_words, tiles: a row for each document and benchmark
    item of which the document holds at least `threshold` of the words, in tiles of at least `seed` words.

    documents has doc_id and text, benchmark has item_id and text. Null and empty texts match nothing; an item of
    fewer words than a seed must stand whole; null ids stay null; repeated rows give repeated rows; empty tables give
    none. Other columns are not read. filter_bits (a multiple of 64) changes what is joined, never what is found.
    """
    spark = prepare(documents.sparkSession)
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").mapInArrow(words.tidy(_items(seed)), ITEMS)
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most `seed` of them
    if not sizes:
        return spark.createDataFrame([], FOUND)
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    known = spark.sparkContext.broadcast(bit_table(seeds, "seed", filter_bits))
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) t", "cast(text as string) text")
    hits = written(docs.mapInArrow(words.tidy(_hits(known, sizes)), HITS).withColumn("doc", F.monotonically_increasing_id()), "seed-hits")

    pairs = meetings(hits.select("doc", F.explode("seeds").alias("seed")), items, threshold)
    some = pairs.join(items.select("item", "item_id", F.col("words").alias("item_words"), "size"), "item")
    both = some.join(hits.select("doc", "doc_id", "t", "spots", "words"), "doc").select("doc_id", "t", "item_id", "spots", "words", F.col("item_words").alias("item"), "size")
    return both.mapInArrow(words.tidy(_tiled(threshold)), FOUND)


def clean(documents: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """The rows of documents, with all their columns, that hold no benchmark item. Columns of any name may be there."""
    own = "_leak"
    while any(c.startswith(own) for c in documents.columns):
        own += "_"
    bad = leaks(documents, benchmark, **more).select(F.col("doc_id").alias(f"{own}id"), F.col("t").alias(f"{own}t")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{own}t"))
    return documents.join(bad, same, "left_anti")
