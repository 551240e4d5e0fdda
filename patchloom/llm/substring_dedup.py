"""Substring dedup by sliding sentence spans.

From every sentence a span is hashed: the fewest consecutive sentences, at least `span`, that hold at least `passage`
words. Spans are joined globally, and the sentences that a span found in an earlier document covers are removed. (Every
longer run of sentences is a union of such spans, so no other length need be hashed.) Sentences end at . ! or ? before
white space, and at line ends; pieces without a word belong to the sentence before. Words are compared without case
(A-Z) and punctuation. Documents go by doc_id, then text; what a text repeats of itself is not a repeat.

A passage need not hold whole sentences: its first and last ones merge with what stands around it. So windows of
words are hashed beside the spans: of each stretch of windows that fits into a passage the one with the least hash,
which is the same in every copy. A window that several documents hold proves nothing yet; the runs of exactly `passage`
words around it are hashed and joined in a second round, and those found in an earlier document are removed too.
Together: a word goes if, and only if, it lies in a run of `passage` words that an earlier document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import words
from patchloom.llm.common import odd_ids, written

REMOVED = "doc_id long, text string, n_sentences long, n_removed long, n_words_removed long, removed array<struct<begin:long,end:long>>"
HASHED = "h1 long, h2 long, doc_id long, t long, at long"


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[words.Words, np.ndarray]:
    """The words of some texts, and for each word whether a sentence begins with it."""
    w = words.words_of(data, offsets, words.MARKS)
    if not len(w.begins):
        return w, np.zeros(0, bool)
    blank = words.BLANKS[data]
    stop = np.zeros(len(data) + 1, np.int64)
    full = (data == 46) | (data == 33) | (data == 63)
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    np.cumsum((full & after) | (data == 10), out=stop[1:])
    begins = np.ones(len(w.begins), bool)
    begins[1:] = stop[w.begins[1:]] > stop[w.ends[:-1] - 1]
    begins[w.first[:-1][w.first[:-1] < len(begins)]] = True
    return w, begins


def _span_ends(size: np.ndarray, last: np.ndarray, span: int, passage: int) -> np.ndarray:
    """For each sentence the sentence after its span; past last[i], the sentence after its text, there is none (-1)."""
    total = np.concatenate([[0], np.cumsum(size)])
    ends = np.maximum(np.arange(len(size)) + span, np.searchsorted(total, total[:-1] + passage))
    return np.where(ends > last, -1, ends)


def _slide(f: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) of each `width` consecutive values."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = f(values[:-step], values[step:])
        size += step
    return values


def _windows(hashes: np.ndarray, first: np.ndarray, window: int, passage: int) -> np.ndarray:
    """The words with which the chosen windows of some texts begin; first holds each text's first word, and the end.

    Of so many windows in a row that they fit a passage, the one with the least hash is chosen."""
    width = passage - window + 1
    n = len(hashes) - window + 1
    if n < width:
        return np.zeros(0, np.int64)
    begins = np.arange(n)
    whole = words.run_hashes(hashes, begins, begins + window)
    least = _slide(np.minimum, whole, width)
    stretch = np.arange(len(least))
    text = np.searchsorted(first, stretch, "right") - 1
    least[stretch + passage > first[text + 1]] = 0  # parts of two texts
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), width) == whole)


def _other(hashes: np.ndarray) -> np.ndarray:
    """Second, independent hashes: with both, keys of one corpus don't meet by chance."""
    return words.mix(hashes ^ np.uint64(0xD1B54A32D192ED03))


def _rows(batch: pa.RecordBatch, a: int, w: words.Words, h1: np.ndarray, h2: np.ndarray, word: np.ndarray, kind: np.ndarray | int, once: bool) -> pa.RecordBatch:
    """HASHED rows: `word` is where each stands among all words; `at` is four times the place of the first word in its
    text, and the kind. once: a hash that a text has several times makes one row."""
    text = np.searchsorted(w.first, word, "right") - 1
    at = 4 * (word - w.first[text]) + kind
    if once:
        order = np.lexsort((h1, text))
        new = np.ones(len(order), bool)
        new[1:] = (text[order][1:] != text[order][:-1]) | (h1[order][1:] != h1[order][:-1])
        keep = np.sort(order[new])
        h1, h2, text, at = h1[keep], h2[keep], text[keep], at[keep]
    row = pa.array(a + text)
    return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch[0].take(row), batch[1].take(row), pa.array(at)], names=["h1", "h2", "doc_id", "t", "at"])


def _spans(span: int, window: int, passage: int, once: bool):
    """doc_id, t, text -> HASHED, of kind 0 (a window) or 1 (a span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, offsets in words.pieces(batch[2]):
                w, begin = _sentences(data, offsets)
                at = np.flatnonzero(begin)
                if not len(at):
                    continue
                size = np.diff(np.append(at, len(begin)))
                place = np.arange(len(begin)) - np.repeat(at, size)
                value = w.hashes * words.powers(int(place.max()) + 1)[place]
                sentence = words.mix(np.add.reduceat(value, at) + size.astype(np.uint64))
                first = np.searchsorted(at, w.first)  # of each text, and of the text after it
                ends = _span_ends(size, first[np.searchsorted(w.first, at, "right")], span, passage)
                some = np.flatnonzero(ends >= 0)
                begins = _windows(w.hashes, w.first, window, passage)
                h1 = np.concatenate([words.run_hashes(sentence, some, ends[some]), words.run_hashes(w.hashes, begins, begins + window)])
                h2 = np.concatenate([words.run_hashes(_other(sentence), some, ends[some]), words.run_hashes(_other(w.hashes), begins, begins + window)])
                word = np.concatenate([at[some], begins])
                yield _rows(batch, a, w, h1, h2, word, np.arange(len(word)) < len(some), once)

    return run


def _marked(spots: pa.Array, w: words.Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(places among all words, the number each carries) of the spots of texts a to b, a null being none."""
    lists = spots.slice(a, b - a)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    each = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    return np.repeat(w.first[:-1], each) + (flat >> 2), flat


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in some begin:end."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, begins, 1)
    np.add.at(turns, ends, -1)
    return np.cumsum(turns[:-1]) > 0


def _span_cover(w: words.Words, begin: np.ndarray, word: np.ndarray, span: int, passage: int) -> np.ndarray:
    """Which words lie in the spans that begin at these words."""
    at = np.flatnonzero(begin)
    first = np.searchsorted(at, w.first)
    ends = _span_ends(np.diff(np.append(at, len(begin))), first[np.searchsorted(w.first, at, "right")], span, passage)
    return _covered(len(begin), word, np.append(at, len(begin))[ends[np.searchsorted(at, word)]])


def _runs_around(span: int, window: int, passage: int, once: bool, repeats: bool):
    """doc_id, t, text, spots -> HASHED of the runs of `passage` words that hold a window of the spots, but for runs
    that the spans of the spots cover. repeats: only around windows that an earlier document holds, as any run that an
    earlier document holds is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in words.pieces(batch[2]):
                w, begin = _sentences(data, offsets)
                word, spot = _marked(batch[3], w, a, b)
                is_span = spot % 2 == 1
                gone = np.concatenate([[0], np.cumsum(_span_cover(w, begin, word[is_span], span, passage))])
                near = word[spot % 4 == 2 if repeats else ~is_span]
                text = np.searchsorted(w.first, near, "right") - 1
                lo, hi = np.maximum(near + window - passage, w.first[text]), np.minimum(near, w.first[text + 1] - passage) + 1
                begins = np.flatnonzero(_covered(len(begin), lo[lo < hi], hi[lo < hi]))
                begins = begins[gone[begins + passage] - gone[begins] < passage]
                if len(begins):
                    h1, h2 = (words.run_hashes(h, begins, begins + passage) for h in (w.hashes, _other(w.hashes)))
                    yield _rows(batch, a, w, h1, h2, begins, 0, once)

    return run


def _cut(span: int, passage: int):
    """doc_id, text, spans, runs -> REMOVED: without the words of those spans and runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_words_removed", pa.int64()), ("removed", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in words.pieces(batch[1]):
                w, begin = _sentences(data, offsets)
                spans, _ = _marked(batch[2], w, a, b)
                runs, _ = _marked(batch[3], w, a, b)
                gone = _span_cover(w, begin, spans, span, passage) | _covered(len(begin), runs, runs + passage)
                count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
                touched = np.zeros(len(begin), bool)
                at = np.flatnonzero(begin)
                if len(at):
                    touched[at] = np.logical_or.reduceat(gone, at)
                texts, removed = batch[1].slice(a, b - a), [[]] * (b - a)
                lost = count(gone)
                if lost.any():
                    texts, raw = texts.to_pylist(), data.tobytes()
                    for i in np.flatnonzero(lost).tolist():
                        lo, hi, x, y = int(offsets[i]), int(offsets[i + 1]), w.first[i], w.first[i + 1]
                        edges = np.append(w.begins[x:y], hi)
                        edges[0] = lo  # what stands before the first word goes with it
                        turns = edges[np.flatnonzero(np.diff(np.concatenate([[False], gone[x:y], [False]]).astype(np.int8)))].tolist()
                        removed[i] = [{"begin": s - lo, "end": e - lo} for s, e in zip(turns[::2], turns[1::2], strict=True)]
                        bounds = [lo, *turns, hi]
                        texts[i] = b"".join(raw[s:e] for s, e in zip(bounds[::2], bounds[1::2], strict=True)).decode()
                    texts = pa.array(texts, pa.string())
                columns = [batch[0].slice(a, b - a), texts.cast(pa.string()), count(begin), count(touched), lost, removed]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _found_again(counted: DataFrame, hashed: DataFrame, name: str) -> DataFrame:
    """h1, h2, doc_id, t, at, repeat for the rows of hashed whose hash several rows of counted have; repeat: an earlier
    document has it."""
    who = F.struct("doc_id", "t")
    first = counted.groupBy("h1", "h2").agg(F.min(who).alias("first"), F.count("*").alias("n"))
    shared = written(first.where("n > 1").select("h1", "h2", "first"), name)
    return hashed.join(shared, ["h1", "h2"]).withColumn("repeat", ~who.eqNullSafe(F.col("first"))).drop("first")


def _by_document(rows: DataFrame, name: str) -> DataFrame:
    spots = rows.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("at")).alias(name))
    return spots.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), name)


def dedup_spans(documents: DataFrame, span: int = 2, passage: int = 50, window: int = 16) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed, n_words_removed, removed (byte ranges of the UTF-8 text).

    One row for each row of documents (doc_id, text). A null text stays null, one without a word stays as it is. A
    null doc_id comes before all others. Rows equal in doc_id and text are one document: all keep or lose the same.
    Other columns are not read; an empty table gives no row. Hashes are counted before they are shuffled, and no group
    of equal ones is gathered. n_removed counts the sentences that lose words, all or some. window: words of a window,
    fewer than `passage`.
    """
    if not 0 < window <= passage:
        raise ValueError("a window has at least one word and fits into a passage")
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # what tells apart the texts of one doc_id; a hash is dear in every row, so it is left out where ids do that alone
    docs = docs.withColumn("t", F.xxhash64("text") if odd_ids(docs) else F.lit(0).cast("long"))
    own = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))
    texts = docs.select("doc_id", "t", "text")
    counted, hashed = (texts.mapInArrow(words.tidy(_spans(span, window, passage, once)), HASHED) for once in (True, False))
    found = _found_again(counted, hashed, "shared-spans").where("repeat or at % 4 = 0")
    spots = _by_document(found.withColumn("at", F.col("at") + F.when(F.col("repeat"), 2).otherwise(0)), "spots")
    spotted = docs.join(spots, own, "left").withColumn("plain", F.col("spots").isNull()).drop("d", "dt")
    spotted = written(spotted, "spotted", partition_by="plain")
    some = spotted.where("not plain").select("doc_id", "t", "text", "spots")
    counted, hashed = (some.mapInArrow(words.tidy(_runs_around(span, window, passage, x, not x)), HASHED) for x in (True, False))
    runs = _by_document(_found_again(counted, hashed, "shared-runs").where("repeat"), "runs")
    cut = some.join(runs, own, "left").select("doc_id", "text", F.filter("spots", lambda x: x % 2 == 1).alias("spans"), "runs")
    none = F.lit(None).cast("array<long>")
    whole = spotted.where("plain").select("doc_id", "text", none.alias("spans"), none.alias("runs"))
    return whole.unionByName(cut).mapInArrow(words.tidy(_cut(span, passage)), REMOVED)
