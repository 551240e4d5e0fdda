"""Generation in batches that adapt to what fits, with an injected generator, and padded batches for training."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators.chat import IGNORED, by_length
from patchloom.streaming.resume import pending

GENERATED = "key string, output string, batch_size int, retries int, seconds double"


class BatchTooLarge(Exception):
    """What a generator raises at a batch that does not fit, as when a device is out of memory."""


def adaptive(rows: Iterator[tuple[str, str]], generator: Callable[[list[str]], list[str]], largest: int) -> Iterator[list[dict]]:
    """Batches of results for (key, prompt) rows, in their order. A batch that is too large is halved and tried again, one
    row that is too large fails; after each success the size grows by one, up to `largest`. At most `largest` rows wait."""
    waiting: deque[tuple[str, str]] = deque()
    size, retries = largest, 0
    more = True
    while more or waiting:
        while more and len(waiting) < size:
            row = next(rows, None)
            more = row is not None
            if more:
                waiting.append(row)
        batch = [waiting[i] for i in range(min(size, len(waiting)))]
        if not batch:
            return
        began = time.monotonic()
        try:
            outputs = generator([prompt for _, prompt in batch])
        except BatchTooLarge:
            if size == 1:
                raise
            size, retries = size // 2, retries + 1
            continue
        if len(outputs) != len(batch):
            raise ValueError(f"{len(outputs)} outputs of {len(batch)} prompts")
        seconds = round(time.monotonic() - began, 3)
        yield [{"key": k, "output": o, "batch_size": len(batch), "retries": retries, "seconds": seconds} for (k, _), o in zip(batch, outputs, strict=True)]
        for _ in batch:
            waiting.popleft()
        size, retries = min(largest, size + 1), 0


def generate(
    prompts: DataFrame, generator: Callable[[list[str]], list[str]], key: str = "pair_id", prompt: str = "prompt", largest: int = 32, done: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """key, output, batch_size, retries (before the batch), seconds (of the batch) for every row of prompts whose key is not
    in `done` (key). Prompts of like length come together, so that a batch needs little padding; `tasks` is the number of
    devices, say, that generate side by side. A task holds one batch at a time."""
    rows = prompts.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt"))
    if done is not None:
        rows = pending(rows, done.select(F.col(key).cast("string").alias("key")), "key")
    rows = rows.withColumn("_n", F.length("prompt"))
    dealt = rows.repartitionByRange(tasks, "_n", "key").sortWithinPartitions("_n", "key") if tasks else by_length(rows, "_n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((k, p) for batch in batches for k, p in zip(batch["key"].to_pylist(), batch["prompt"].to_pylist(), strict=True))
        schema = pa.schema([("key", pa.string()), ("output", pa.string()), ("batch_size", pa.int32()), ("retries", pa.int32()), ("seconds", pa.float64())])
        for results in adaptive(each, generator, largest):
            yield pa.RecordBatch.from_pylist(results, schema)

    return dealt.select("key", "prompt").mapInArrow(run, GENERATED)


BATCHES = "keys array<string>, rows int, longest int, tokens long, padding long, input_ids array<array<int>>, labels array<array<int>>, attention_mask array<array<boolean>>"


def padded_batches(rows: DataFrame, key: str, budget: int, pad_id: int, most: int = 1 << 16) -> DataFrame:
    """Batches of rows (key, input_ids, labels, of one length each) that hold at most `budget` cells when they are padded to
    their longest, and at most `most` rows: keys, rows, longest, tokens, padding (cells), and the padded arrays. Pads are
    pad_id and, in labels, what is ignored; the mask is false where an id is pad_id.

    Rows are dealt by length into ranges and go from the longest to the shortest, each into the open batch if it fits, so that
    neighbours are of like length; a task holds one batch. A row that alone is over the budget fails the query."""
    sized = rows.select(F.col(key).cast("string").alias("key"), "input_ids", "labels").withColumn("_n", F.size("input_ids"))
    dealt = sized.repartitionByRange(F.desc("_n"), F.col("key")).sortWithinPartitions(F.desc("_n"), F.col("key"))

    def closed(open_rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[1]) for r in open_rows])
        n, longest = len(sizes), int(sizes.max(initial=0))
        inside = np.arange(longest) < sizes[:, None]
        cells = [np.full((n, longest), pad, np.int32) for pad in (pad_id, IGNORED)]
        for at, grid in enumerate(cells, 1):
            grid[inside] = np.concatenate([r[at] for r in open_rows]) if longest else np.zeros(0, np.int32)

        def nested(grid: np.ndarray, kind: pa.DataType) -> pa.Array:
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * longest, pa.int32()), pa.array(grid.ravel(), kind))
            return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), each)

        tokens = int(sizes.sum())
        arrays = [pa.array([[r[0] for r in open_rows]], pa.list_(pa.string())), pa.array([n], pa.int32()), pa.array([longest], pa.int32()), pa.array([tokens]), pa.array([n * longest - tokens])]
        arrays += [nested(cells[0], pa.int32()), nested(cells[1], pa.int32()), nested(cells[0] != pad_id, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["keys", "rows", "longest", "tokens", "padding", "input_ids", "labels", "attention_mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for i, k in enumerate(batch["key"].to_pylist()):
                ids, labels = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("input_ids", "labels"))
                if len(ids) > budget or len(ids) != len(labels):
                    raise ValueError(f"row {k} has {len(ids)} ids and {len(labels)} labels; a batch has {budget} cells")
                if held and (len(held[0][1]) * (len(held) + 1) > budget or len(held) == most):
                    yield closed(held)
                    held = []
                held.append((k, ids, labels))
        if held:
            yield closed(held)

    return dealt.select("key", "input_ids", "labels").mapInArrow(run, BATCHES)
