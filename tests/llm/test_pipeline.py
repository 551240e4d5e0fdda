"""The pipeline's stages, one after the other, against what they must keep."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from patchloom.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, docs, sf, path):
    """The rows that each stage keeps, by its name."""
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = docs.collect()
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
    return kept


def check_tokens(mixed, found):
    """The last stage by hand: the mix in order of ids, then texts, encoded by the library."""
    encoder, start = tokens.Encoder(tokens.tokenizer_path()), 0
    order = sorted(mixed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    for want, r in zip(order, sorted(found, key=lambda r: r.start), strict=True):
        made = np.append(encoder.whole(want.text), 2).astype("<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, start, len(made) // 4, zlib.crc32(made)) and bytes(r.ids) == made
        start += r.n_tokens


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(100_000, None, None, None, None), (100_001, "123 ...", "en", "src0", 7)], docs.schema)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    kept = run_stages(spark, docs.unionByName(more), sf, str(tmp_path))
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    assert sorted(ids["language_id"]) == list(range(200))
    one = ids["jaccard_join"]
    assert len(one) == len(set(one)) < 200 and len({r.text for r in kept["jaccard_join"]}) == len(one)
    clean = kept["decontaminate"]
    assert set(ids["decontaminate"]) <= set(one) and not any(b.text in r.text for r in clean for b in bench)
    times = collections.Counter(ids["mixing"])
    assert set(times) <= set(ids["decontaminate"]) and max(times.values()) <= 3
    check_tokens(kept["mixing"], kept["tokens"])


def test_odd_rows_are_lost_for_their_links_alone(spark, sf, tmp_path):
    """Null and repeated ids with unlike texts, repeated rows, a group of null ids alone, a very long text."""
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").limit(12).collect() for w in r.text.split()]
    text = lambda k, n=60: " ".join(words[(k * 97 + i * 7) % len(words)] for i in range(n))
    long = " ".join(words[(i * 31 + i // len(words)) % len(words)] for i in range(40_000))
    rows = [
        (None, text(1), "en", "a", 1), (None, text(2), "en", "a", 1), (None, text(2) + " end", "en", None, 2),  # two of three stay
        (5, text(3), "en", "a", 1), (5, text(4), None, "b", 1), (5, text(5), "en", "b", 1), (5, text(5), "en", "b", 1),  # unlike texts of one id
        (6, text(4) + " more", "en", "b", 1), (7, long, "en", "c", 1), (8, "", "en", "c", 0), (9, None, "en", "c", 0), (10, " 1 2 3 ", "en", "c", 7),
    ]
    kept = run_stages(spark, spark.createDataFrame(rows, DOCS).repartition(3), sf, str(tmp_path))
    assert len(kept["language_id"]) == 9
    texts = collections.Counter((r.doc_id, r.text) for r in kept["jaccard_join"])
    assert sum(texts.values()) == 6 and max(texts.values()) == 1
    assert {(None, text(1)), (5, text(3)), (5, text(4)), (5, text(5)), (7, long)} <= set(texts)
    assert ((None, text(2)) in texts) != ((None, text(2) + " end") in texts)
    assert collections.Counter((r.doc_id, r.text) for r in kept["decontaminate"]) == texts
    assert {(r.doc_id, r.text) for r in kept["mixing"]} <= set(texts)
    check_tokens(kept["mixing"], kept["tokens"])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "a", 0)]])
def test_nothing_to_keep(spark, sf, tmp_path, rows):
    kept = run_stages(spark, spark.createDataFrame(rows, DOCS), sf, str(tmp_path))
    assert {name: len(x) for name, x in kept.items()} == {name: 0 for name, _ in cp.STAGES}


def test_run_is_the_stages(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"] and out.count() > 100
