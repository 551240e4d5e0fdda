"""Audit of how far the sources of a language diverge, over mergeable radix tries of terms.

Each task counts the terms of its documents into radix tries, one for a language, with counters by source at the leaves, for
about FLUSH bytes of text at a time, so that its memory does not grow with its input. A trie is cut at the bounds of
ranges of prefixes and each piece is a row; a task of the next stage owns a range, merges the pieces that come to it and keeps
the terms of enough documents. So the kept terms lie as a table in UTF-8 order, and a term that all documents have
is a leaf of each task, not a row of each document. The bounds come from a sample of the documents; they say where a term
is merged, never what comes out.

Then one traversal of the kept leaves, with the totals of all groups at hand, sums every pair of sources and holds, for each
group, its best candidates so far. Totals come in blocks of at most BLOCK groups, and each pair of blocks is a
job of its own, so neither a broadcast nor a task's sums grow with the number of sources. Pairs' sums are added by a
group-by; candidates pass a limit for each group in pieces before they meet.

Arithmetic is in whole numbers throughout, in steps that keep below 2^63.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.llm import radix
from patchloom.llm.common import written
from patchloom.llm.words import tidy

#: Bytes of text that a task counts at a time, and leaves that a merging task holds before it adds them up.
FLUSH, HELD = 24 << 20, 3_000_000
#: One document in SAMPLE gives the bounds of ranges; a range has about RANGE leaves; bounds are chosen among BOUNDS terms.
SAMPLE, RANGE, BOUNDS = 64, 250_000, 20_000
#: Groups whose totals are broadcast at a time.
BLOCK = 1024
#: Cells of a table of terms by sources that is summed at once.
CELLS = 1 << 20
#: Pieces that a group's candidates are dealt into before they meet.
PIECES = 16
RANKS, MIN_DOCS = 200, 3
#: Bytes of terms, and A-Z in lower case.
_INSIDE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LEAVES = "lang string, term binary, docs long, sources array<string>, counts array<long>"
ARRAYS = ("labels", "sizes", "shared", "docs", "width", "sources", "counts")
PIECE = f"range int, lang string, names array<string>, {', '.join(f'{a} binary' for a in ARRAYS)}"


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts, one after another, and how many each text has."""
    data, offsets = radix.parts(texts.cast(pa.large_binary()))
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    begins = np.flatnonzero(begin)
    sizes = np.flatnonzero(end) + 1 - begins
    terms = radix.binary(_FOLD[data[inside]], np.concatenate([[0], np.cumsum(sizes)]))
    return terms, np.diff(np.searchsorted(begins, offsets))


def _counted(rows: pa.Table) -> Iterator[tuple[str, list[str], pa.Array, radix.Trie]]:
    """Language, names of sources, terms and trie for each language of some documents (text, lang, source)."""
    terms, each = _tokens(rows.column("text").combine_chunks())
    encoded = terms.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ordered = encoded.dictionary.take(pa.array(order))
    # occurrences of each term in each document
    v = max(1, len(order))
    doc = np.repeat(np.arange(len(each)), each)
    key, n = radix.summed(doc * v + rank[encoded.indices.to_numpy()], np.ones(len(doc), np.int64))
    doc, term = key // v, key % v
    langs, sources = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    names = sources.dictionary.to_pylist()
    lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
    key, n, docs = radix.summed((lang_of[doc] * v + term) * len(names) + source_of[doc], n, np.ones(len(doc), np.int64))
    leaf, docs = radix.summed(key // len(names), docs)
    width = np.diff(np.append(np.searchsorted(key, leaf * len(names)), len(key)))
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        a, b = np.searchsorted(leaf, [i * v, (i + 1) * v])
        first, last = np.searchsorted(key, [i * v * len(names), (i + 1) * v * len(names)])
        own = ordered.take(pa.array(leaf[a:b] - i * v))
        yield lang, names, own, radix.Trie(*[np.zeros(0, np.int64)] * 3, docs[a:b], width[a:b], key[first:last] % len(names), n[first:last])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold FLUSH bytes."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size > FLUSH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pieces(bounds):
    """Pieces of the tries of a task's documents, cut at the bounds (lang, term) of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bounds.value
        for table in _gathered(batches):
            for lang, names, terms, trie in _counted(table):
                if not len(terms):
                    continue
                before = bisect.bisect_left(known, (lang.encode(), b""))
                own = [t for x, t in known if x == lang.encode()]
                cuts = [0, *(bisect.bisect_left(range(len(terms)), t, key=lambda i: terms[i].as_py()) for t in own), len(terms)]  # noqa: B023
                for k, (a, b) in enumerate(itertools.pairwise(cuts)):
                    if a < b:
                        piece = trie.cut(terms, a, b)
                        used, which = np.unique(piece.sources, return_inverse=True)
                        piece.sources = which
                        arrays = [np.ascontiguousarray(getattr(piece, x), np.uint8 if x == "labels" else np.int32).tobytes() for x in ARRAYS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([before + k], pa.int32()), pa.array([lang]), pa.array([[names[i] for i in used]], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in arrays]],
                            names=["range", "lang", "names", *ARRAYS],
                        )

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each language of some documents."""
    for table in _gathered(batches):
        for lang, _, terms, _ in _counted(table):
            for a in range(0, len(terms), 1 << 16):
                some = terms.slice(a, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some.cast(pa.binary())], names=["lang", "term"])


def _merged(min_docs: int):
    """The leaves of a range's pieces, added up; terms of fewer documents go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, known = defaultdict(list), defaultdict(dict)
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [np.frombuffer(row[x], np.uint8 if x == "labels" else np.int32) for x in ARRAYS]
                trie = radix.Trie(*[x if x.dtype == np.uint8 else x.astype(np.int64) for x in arrays])
                own = known[row["lang"]]
                trie.sources = np.array([own.setdefault(s, len(own)) for s in row["names"]], np.int64)[trie.sources]
                tries[row["lang"]].append(trie)
                held += len(trie.docs)
                if held > HELD:
                    tries = defaultdict(list, {lang: [radix.Trie.of(*radix.merged(many))] for lang, many in tries.items()})
                    held = sum(len(many[0].docs) for many in tries.values()) // 2
        for lang in sorted(tries, key=str.encode):
            terms, docs, width, sources, counts = radix.merged(tries.pop(lang), min_docs)
            names = pa.array(list(known[lang]), pa.string())
            first = np.concatenate([[0], np.cumsum(width)])
            for a in range(0, len(terms), 4096):
                b = min(a + 4096, len(terms))
                where, own = pa.array(first[a : b + 1] - first[a], pa.int32()), slice(first[a], first[b])
                lists = [pa.ListArray.from_arrays(where, names.take(pa.array(sources[own]))), pa.ListArray.from_arrays(where, pa.array(counts[own]))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (b - a)), terms.slice(a, b - a).cast(pa.binary()), pa.array(docs[a:b]), *lists], names=["lang", "term", "docs", "sources", "counts"])

    return run


def shares(counts: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / (total + kept)), by three long divisions, exact for totals below 2^53."""
    below = total + kept
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        step = rest * 1000
        out = out * 1000 + step // below
        rest = step % below
    return out + 1


@dataclass
class Totals:
    """A block of groups: their languages, sources, sums over kept terms, and those of their languages."""

    langs: list[str]
    sources: list[str]
    sums: np.ndarray
    lang_sums: np.ndarray
    lang_kept: np.ndarray

    def by_lang(self) -> dict[str, np.ndarray]:
        places = defaultdict(list)
        for i, lang in enumerate(self.langs):
            places[lang].append(i)
        return {lang: np.array(at) for lang, at in places.items()}


def _table(counts: list[dict], places: dict[str, int], width: int) -> np.ndarray:
    out = np.zeros((len(counts), width), np.int64)
    for i, own in enumerate(counts):
        for s, n in own.items():
            if s in places:
                out[i, places[s]] = n
    return out


class _Audit:
    """Sums of pairs (of a group of block a and a source of block b) and candidates of block a over some kept leaves."""

    def __init__(self, a: Totals, b: Totals, ranks: int, candidates: bool):
        self.a, self.b, self.ranks, self.candidates = a, b, ranks, candidates
        self.rows_a, self.rows_b = a.by_lang(), b.by_lang()
        self.pairs: dict[str, np.ndarray] = {}
        #: Of each group a heap whose least is the worst candidate: the least value, of these the last term.
        self.best: dict[int, list[tuple[int, _Last]]] = defaultdict(list)

    def take(self, lang: str, terms: list[bytes], counts: list[dict]) -> None:
        at_a, at_b = self.rows_a.get(lang), self.rows_b.get(lang)
        if at_a is None:
            return
        a, b = self.a, self.b
        names = [a.sources[i] for i in at_a]
        kept = a.lang_kept[at_a[0]]
        own = _table(counts, {s: i for i, s in enumerate(names)}, len(names))
        p = shares(own, a.sums[at_a], kept)
        if at_b is not None:
            others = [b.sources[i] for i in at_b]
            q = p if a is b else shares(_table(counts, {s: i for i, s in enumerate(others)}, len(others)), b.sums[at_b], kept)
            sums = self.pairs.setdefault(lang, np.zeros((len(at_a), len(at_b)), np.int64))
            for i in range(len(at_a)):
                away = p[:, i, None] - q
                sums[i] += (away * away // q).sum(0)
        if self.candidates:
            q = shares(np.array([sum(x.values()) for x in counts], np.int64), a.lang_sums[at_a[0]], kept)[:, None]
            value = (p - q) * (p - q) // q
            good = (own > 0) & (p > q)
            for i, g in enumerate(at_a.tolist()):
                heap = self.best[g]
                least = heap[0][0] if len(heap) == self.ranks else 0
                for t in np.flatnonzero(good[:, i] & (value[:, i] >= least)).tolist():
                    new = (int(value[t, i]), _Last(terms[t]))
                    if len(heap) < self.ranks:
                        heapq.heappush(heap, new)
                    elif heap[0] < new:
                        heapq.heapreplace(heap, new)

    def nothing(self, lang: str) -> None:
        """Every pair of a language has a sum, if it is of no term."""
        at_a, at_b = self.rows_a.get(lang), self.rows_b.get(lang)
        if at_a is not None and at_b is not None:
            self.pairs.setdefault(lang, np.zeros((len(at_a), len(at_b)), np.int64))

    def rows(self) -> Iterator[tuple[str, str, str, bytes, int]]:
        a, b = self.a, self.b
        for lang, sums in self.pairs.items():
            for i, x in enumerate(self.rows_a[lang]):
                for j, y in enumerate(self.rows_b[lang]):
                    if a.sources[x] != b.sources[y]:
                        yield lang, a.sources[x], "pair", b.sources[y].encode(), int(sums[i, j])
        for g, heap in self.best.items():
            for value, term in heap:
                yield a.langs[g], a.sources[g], "term", term.term, value


class _Last:
    """A term that counts as less the later it stands."""

    __slots__ = ("term",)

    def __init__(self, term: bytes):
        self.term = term

    def __lt__(self, other: _Last) -> bool:
        return self.term > other.term


FOUND = "lang string, source string, part string, item binary, value long"


def _audited(block_a, block_b, ranks: int, candidates: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = block_a.value
        audit = _Audit(a, a if block_b is block_a else block_b.value, ranks, candidates)
        widest = max([1, *map(len, audit.rows_a.values()), *map(len, audit.rows_b.values())])
        step = max(1, CELLS // widest)
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("lang", "term", "sources", "counts")]
            at = 0
            while at < len(batch):
                lang, end = columns[0][at], at
                while end < len(batch) and end - at < step and columns[0][end] == lang and columns[1][end] is not None:
                    end += 1
                if end == at:
                    audit.nothing(lang)
                    at += 1
                    continue
                counts = [dict(zip(s, n, strict=True)) for s, n in zip(columns[2][at:end], columns[3][at:end], strict=True)]
                audit.take(lang, columns[1][at:end], counts)
                at = end
        held = []
        for row in audit.rows():
            held.append(row)
            if len(held) == 8192:
                yield _found(held)
                held = []
        yield _found(held)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "source", "part", "item", "value"])


def _bounds(documents: DataFrame) -> list[tuple[bytes, bytes]]:
    """(lang, term) where ranges begin, ascending, by the terms of a sample; fewer than BOUNDS."""
    some = documents.sample(1 / SAMPLE, seed=11).mapInArrow(tidy(_terms), "lang string, term binary").distinct()
    some = written(some.withColumn("hash", F.xxhash64("lang", "term")), "sampled-terms")
    n = some.count()
    ranges = max(documents.sparkSession.sparkContext.defaultParallelism, n * SAMPLE // RANGE)
    few = some.where(F.pmod("hash", F.lit(n // BOUNDS + 1)) == 0).select("lang", "term").collect()
    few = sorted((r.lang.encode(), bytes(r.term)) for r in few)
    return sorted({few[i * len(few) // ranges] for i in range(1, ranges)}) if few else []


def kept_terms(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, docs, sources, counts: the terms found in at least min_docs documents of a language, by ranges in UTF-8
    order, with their occurrences by source. documents: text, lang, source without nulls."""
    bounds = _bounds(documents)
    known = documents.sparkSession.sparkContext.broadcast(bounds)
    pieces = documents.mapInArrow(tidy(_pieces(known)), PIECE)
    return pieces.repartitionById(len(bounds) + 1, F.col("range")).mapInArrow(tidy(_merged(min_docs)), LEAVES)


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) group of documents (text, lang, source) the
    divergence from each other source of its language (part "pair", all ranks), and the `ranks` terms that set it most
    apart from its language (part "term").

    A null text, lang or source counts as an empty one. Every row is a document, repeated ones too. A language of one
    source has no pair, a group without kept terms no term; a language without kept terms has pairs of value 0. Ties go
    by the bytes of the item. An empty table gives no row. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = written(kept_terms(docs, min_docs), "kept-terms")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    known = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = groups.join(known, "lang", "left").na.fill(0, ["n", "kept"])
    whole = Window.partitionBy("lang")
    groups = groups.withColumn("lang_n", F.sum("n").over(whole))
    groups = written(groups.orderBy("lang", "source").withColumn("place", F.monotonically_increasing_id()), "groups")

    blocks = _blocks(groups, block)
    langs = groups.select("lang").distinct().select("lang", *[F.lit(None).cast(t).alias(c) for c, t in (("term", "binary"), ("docs", "long"), ("sources", "array<string>"), ("counts", "array<long>"))])
    leaves = kept.unionByName(langs)
    found = None
    for a, of_a in blocks:
        for b, of_b in blocks:
            if of_a & of_b:
                part = leaves.mapInArrow(tidy(_audited(a, b, ranks, a is b)), FOUND)
                found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    found = written(found.withColumn("item", F.col("item").cast("string")).withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(PIECES))), "found")
    order = [F.col("value").desc(), F.col("item")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(*order)))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    some = ranked(found.where("part = 'term'"), "piece").where(F.col("rank") <= ranks).drop("rank", "piece")
    terms = ranked(some).where(F.col("rank") <= ranks)
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _blocks(groups: DataFrame, block: int) -> list[tuple]:
    """(broadcast totals, their languages) of runs of at most `block` groups, in order of (lang, source)."""
    spark, out, held = groups.sparkSession, [], []

    def close() -> None:
        if held:
            numbers = [np.array([r[c] for r in held], np.int64) for c in ("n", "lang_n", "kept")]
            langs = [r.lang for r in held]
            out.append((spark.sparkContext.broadcast(Totals(langs, [r.source for r in held], *numbers)), set(langs)))
            held.clear()

    for row in groups.orderBy("lang", "source").toLocalIterator():
        held.append(row)
        if len(held) == block:
            close()
    close()
    return out
