"""Language ID by a byte convolutional network in numpy.

Bytes are embedded, filters of several widths slide over fixed windows, the largest answer of each filter feeds a
softmax. The network is trained on the driver on a bounded sample of labelled text (`max_docs` documents, spread over
the languages, of each `windows` pieces of PIECE characters at even distances over the whole text: the bound of what a
long document adds); prediction runs over every window of every whole text and averages the
windows' probabilities, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.words import tidy
from patchloom.sources.session import prepare

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 6
#: Characters of a piece that is learned from.
PIECE = 160
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass
class ByteConvNet:
    languages: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteConvNet:
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            p[f"conv{w}"], p[f"bias{w}"] = draw(w * EMBED, FILTERS), np.zeros(FILTERS, np.float32)
        p["out"], p["out_bias"] = draw(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32)
        return cls(languages, p)

    @cached_property
    def answers_of(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """What one byte, or two in a row, add to the answers of each width's filters, by offset: a filter's answer is a
        sum over its bytes, so embedding and multiplication are done once for each byte and pair of bytes."""
        out = {}
        for w in WIDTHS:
            one = [self.params["emb"] @ self.params[f"conv{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)]
            pairs = [(j, (one[j][:, None] + one[j + 1][None]).reshape(1 << 16, FILTERS)) for j in range(0, w - 1, 2)]
            out[w] = pairs + ([(w - 1, one[w - 1])] if w % 2 else [])
        return out

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, filters): the largest answer of each filter, at least 0."""
        parts = []
        pair = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        for w in WIDTHS:
            steps, answers = WINDOW - w + 1, None
            for j, table in self.answers_of[w]:
                added = table.take((pair if len(table) > 256 else windows)[:, j : j + steps], axis=0, mode="clip")
                answers = added if answers is None else np.add(answers, added, out=answers)
            parts.append(np.maximum(answers.max(1) + self.params[f"bias{w}"], 0))
        return np.concatenate(parts, 1)

    def __getstate__(self):
        return {"languages": self.languages, "params": self.params}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.params["out"] + self.params["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n, grads = self.params, len(windows), {}
        x = p["emb"][windows]
        flat = x.reshape(n, -1)
        pooled, where = [], {}
        for w in WIDTHS:
            steps = WINDOW - w + 1
            views = np.lib.stride_tricks.as_strided(flat, (n, steps, w * EMBED), (flat.strides[0], EMBED * 4, 4))
            answers = (views.reshape(n * steps, w * EMBED) @ p[f"conv{w}"]).reshape(n, steps, FILTERS)
            where[w] = answers.argmax(1)
            pooled.append(np.take_along_axis(answers, where[w][:, None], 1)[:, 0] + p[f"bias{w}"])
        before = np.concatenate(pooled, 1)
        h = np.maximum(before, 0)
        z = h @ p["out"] + p["out_bias"]
        e = np.exp(z - z.max(1, keepdims=True))
        prob = e / e.sum(1, keepdims=True)
        loss = -np.log(prob[np.arange(n), y] + 1e-9).mean()
        dz = prob.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        grads["out"], grads["out_bias"] = h.T @ dz, dz.sum(0)
        dh = (dz @ p["out"].T) * (before > 0)
        dx = np.zeros_like(x)
        for k, w in enumerate(WIDTHS):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"bias{w}"] = d.sum(0)
            at = where[w][:, :, None] + np.arange(w)  # (n, filters, w)
            seen = x[np.arange(n)[:, None, None], at].reshape(n, FILTERS, w * EMBED)
            grads[f"conv{w}"] = np.einsum("nf,nfk->kf", d, seen, optimize=True)
            back = d[:, :, None] * p[f"conv{w}"].T[None]
            np.add.at(dx, (np.arange(n)[:, None, None], at), back.reshape(n, FILTERS, w, EMBED))
        grads["emb"] = np.zeros_like(p["emb"])
        np.add.at(grads["emb"], windows.ravel(), dx.reshape(-1, EMBED))
        return float(loss), grads


def cut(data: bytes | np.ndarray) -> np.ndarray:
    """All windows of a text; they overlap by the widest filter less one, so no place between two is lost."""
    a = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(a) - (WINDOW - step)) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(a)] = a
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (step, 1))


def fit(texts: list[bytes], labels: list[str], steps: int = 900, batch: int = 192, rate: float = 0.004, seed: int = 0) -> ByteConvNet:
    """Adam on windows drawn evenly from the languages, at random offsets and with random ends (short texts occur)."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = ByteConvNet.fresh(languages, rng)
    by = [[t for t, y in zip(texts, labels, strict=True) if y == lang and t] for lang in languages]
    by = [own or [b" "] for own in by]
    if len(languages) < 2:
        return net
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    v = {k: np.zeros_like(a) for k, a in net.params.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)
        x = np.zeros((batch, WINDOW), np.uint8)
        for i, k in enumerate(y):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(max(1, len(t) - WINDOW + 1))
            piece = t[at : at + (WINDOW if rng.random() < 0.7 else rng.integers(6, WINDOW))]
            x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
        _, grads = net.gradients(x, y)
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.params[k] = (net.params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def remainder_of(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def training_sample(documents: DataFrame, max_docs: int, windows: int) -> list[tuple[bytes, str]]:
    """At most about max_docs documents that may be learned from, as many of each language as there are to have, and of
    each `windows` pieces of PIECE characters spread over the whole text. What comes to the driver has this bound."""
    usable = documents.where((remainder_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(max_docs / len(counts) / n)).otherwise(share)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11).cast("double")) / float(1 << 53)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substring("text", F.floor(k * F.greatest(F.lit(0), F.length("text") - PIECE) / max(1, windows - 1)).cast("int") + 1, F.lit(PIECE))))
    rows = usable.where(draw < share).orderBy(draw, "doc_id").limit(2 * max_docs).select("lang", spread.alias("pieces")).collect()
    return [(piece.encode(), r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["pieces"])) for piece in r["pieces"]]


def predictor(net: ByteConvNet):
    """Batches of any columns, then text and letters -> those columns (keep_text: and text), then lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch], keep_text: bool = False) -> Iterator[pa.RecordBatch]:
        languages = pa.array(net.languages, pa.string())
        for batch in batches:
            *others, text, letters = batch.columns
            names = batch.schema.names[: len(others) + keep_text]
            others += [text] * keep_text
            best = np.full(len(text), -1)
            score = np.zeros(len(text))
            rows = np.flatnonzero(letters.to_numpy(zero_copy_only=False))
            some: list[np.ndarray] = []
            owner: list[int] = []

            def settle():
                if not some:
                    return
                windows, of = np.concatenate(some), np.repeat(owner, [len(w) for w in some])
                weight = (windows != 0).sum(1) + 1.0
                total = np.zeros((len(owner), len(net.languages)))
                for a in range(0, len(windows), 64):  # what 64 windows need stays in a core's cache
                    p = net.probabilities(windows[a : a + 64]) * weight[a : a + 64, None]
                    np.add.at(total, np.searchsorted(owner, of[a : a + 64]), p)
                total /= total.sum(1, keepdims=True)
                best[owner], score[owner] = total.argmax(1), total.max(1)
                some.clear()
                owner.clear()

            held_windows = 0
            for i in rows if net.languages else []:
                windows = cut(text[i].as_buffer().to_pybytes())
                some.append(windows)
                owner.append(int(i))
                held_windows += len(windows)
                if held_windows > 16384:
                    settle()
                    held_windows = 0
            settle()
            known = languages.take(pa.array(np.where(best < 0, 0, best))) if net.languages else pa.nulls(len(text), pa.string())
            pred = pa.array([k if b >= 0 else UNKNOWN for k, b in zip(known.to_pylist(), best, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*others, pred, pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def train(documents: DataFrame, max_docs: int = 2000, windows: int = 4, **more) -> ByteConvNet:
    """The network of documents (doc_id, text, lang); without labelled text, one that knows no language."""
    sample = training_sample(documents.select("doc_id", "text", "lang"), max_docs, windows)
    return fit([t for t, _ in sample], [y for _, y in sample], **more) if sample else ByteConvNet([])


def has_letters(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_beside(documents: DataFrame, net: ByteConvNet) -> DataFrame:
    """documents with lang_pred and score beside their columns (columns of these names give way); text comes last of
    the old ones. Else as identify()."""
    prepare(documents.sparkSession)
    rows = documents.drop("lang_pred", "score")
    others = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others, "text").schema)
    run = tidy(predictor(net))
    free = next(name for k in range(len(others) + 2) if (name := f"letters{k}") not in rows.columns)
    return rows.select(*others, "text", has_letters(F.col("text")).alias(free)).mapInArrow(lambda batches: run(batches, True), f"{kinds}, lang_pred string, score double")


def identify(documents: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents (doc_id, text).

    `und` with score 0 where the text is null, empty or without a letter, and everywhere if the network knows no
    language. A null doc_id is not held out. Repeated rows get equal results; an empty table gives no row; whole texts
    are read, of any length; other columns are not.
    """
    prepare(documents.sparkSession)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
        has_letters(F.col("text")).alias("letters"),
    )
    return rows.mapInArrow(tidy(predictor(net)), PREDICTED)
