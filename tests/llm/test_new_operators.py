"""Source divergence, exact dedup and vector codes against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import divergence, exact_dedup, line_dedup, radix, vector_codes
from patchloom.llm.common import join_groups, scratch_path, written

DOCS = "doc_id long, text string, lang string, source string"
LONG = "Wort für wort " * 30_000
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n", "en", "a"), (4, "One two ONE.", "en", "b"), (4, "One two ONE.", "en", "b"), (5, "one two x1y", "en", ""),
    (None, "One two ONE.", "fr", None), (None, None, None, None), (None, "", None, "a"), (6, LONG, "de", "c"), (7, LONG, "de", "d"), (8, LONG, "de", "c"), (9, "12 !", "es", "q"),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = ("digest", "row", "top", "n", "_rows", "_hot", "batch", "term", "item", "rank", "kept", "q", "now")
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("theirs") for c in names}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# what several operators share


def test_join_groups_with_hot_and_null_keys(spark):
    keys = [None] * 40 + ["hot"] * 60 + [f"k{i}" for i in range(50)]
    left = written(spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string"), "left")
    right = written(spark.createDataFrame([(k, str(k) * 2) for k in [*dict.fromkeys(keys), "more"]], "k string, v string"), "right")
    for most in (2, 4, 1024):
        assert rows(join_groups(left, right, "k", most)) == sorted(((i, k, str(k) * 2) for i, k in enumerate(keys)), key=repr)


def test_line_runs_that_were_not_merged(docs):
    want = line_dedup.dedup_lines(docs, batches=1).select("doc_id", "kept", "n_dropped")
    for batches, fanout in ((4, 3), (3, 9)):
        assert rows(line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).select("doc_id", "kept", "n_dropped")) == rows(want)


# 11


def audit_by_hand(documents, min_docs=3, ranks=200):
    docs = [(t or "", x or "", s or "") for t, x, s in documents]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, counts, groups = collections.defaultdict(int), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        groups[lang].add(source)
        for t in set(terms):
            seen[lang, t] += 1
        for t in terms:
            counts[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), n in seen.items() if x == lang and n >= min_docs]
        share = lambda of: {t: 1 + 10**9 * (of(t) + 1) // (sum(map(of, kept)) + len(kept)) for t in kept}
        q = share(lambda t: sum(counts[lang, s, t] for s in sources))  # noqa: B023
        p = {s: share(lambda t: counts[lang, s, t]) for s in sources}  # noqa: B023
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out, key=repr)


def test_audit(spark, docs, odd, monkeypatch):
    for df in (docs, odd):
        assert rows(divergence.audit(df)) == audit_by_hand([(r.text, r.lang, r.source) for r in df.collect()])
    assert divergence.audit(odd.limit(0)).count() == 0
    assert divergence.audit(odd).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_audit_in_blocks_and_ranks(spark):
    rng = random.Random(3)
    words = ["ab", "a", "abc", "é", "éa", "Zoë", "z", "naïve", "日本", "日"]
    some = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice("xyz"), rng.choice("pqrstu")) for i in range(150)]
    df = spark.createDataFrame(some, DOCS).repartition(7)
    want = audit_by_hand([r[1:] for r in some], 3, 2)
    for block in (1, 4, 100):
        assert rows(divergence.audit(df, ranks=2, block=block)) == want


def test_audit_when_texts_are_counted_and_merged_in_many_steps(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["aa", "ab", "b", "ba", "é", "A" * 200 + "x", "A" * 200 + "y"], k=6)) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7]), pa.array(["x"] * len(texts[i : i + 7])), pa.array([str(j % 3) for j in range(i, min(i + 7, 60))])], names=["text", "lang", "source"]) for i in range(0, 60, 7)]
    monkeypatch.setattr(divergence, "FLUSH", 500)
    monkeypatch.setattr(divergence, "HELD", 8)

    class Bounds:
        value = [(b"w", b"z"), (b"x", b"aaaa"), (b"x", b"b"), (b"y", b"")]

    pieces = list(divergence._pieces(Bounds)(iter(batches)))
    assert {r["range"] for out in pieces for r in out.to_pylist()} == {1, 2, 3} and len(pieces) > 8
    found = {}
    for k in (1, 2, 3):
        own = [out for out in pieces if out["range"][0].as_py() == k]
        rows = [r for out in divergence._merged(1)(iter(own)) for r in out.to_pylist()]
        assert [r["term"] for r in rows] == sorted(r["term"] for r in rows)
        found |= {r["term"].decode(): r for r in rows}
    want = {w.lower() if w.isascii() else w for t in texts for w in t.split()}
    assert set(found) == want
    for term, r in found.items():
        split = [[w.lower() for w in t.split()] for t in texts]
        assert r["docs"] == sum(term in ws for ws in split)
        assert dict(zip(r["sources"], r["counts"], strict=True)) == {str(k): n for k in range(3) if (n := sum(ws.count(term) for i, ws in enumerate(split) if i % 3 == k))}


def test_shares_are_exact_beyond_doubles():
    counts, total, kept = np.array([0, 5, 10**15, 2**52], np.int64), np.int64(2**52 + 10**15), np.int64(10**9)
    assert divergence.shares(counts, total, kept).tolist() == [1 + 10**9 * (int(c) + 1) // int(total + kept) for c in counts]
    assert divergence.shares(np.array([7]), np.array([7]), np.int64(1)).tolist() == [1 + 10**9]


def test_radix_tries():
    rng = random.Random(5)

    def made(n):
        docs, counts = collections.Counter(), collections.Counter()
        for _ in range(n):
            term = bytes(rng.choices(b"ab\xc3\xa9", k=rng.choice([1, 2, 6, 70, 200])))
            docs[term] += 1
            counts[term, rng.randrange(3)] += 5
        terms = sorted(docs)
        each = [[(s, counts[t, s]) for s in range(3) if counts[t, s]] for t in terms]
        flat = [x for own in each for x in own]
        trie = radix.Trie.of(pa.array(terms, pa.large_binary()), np.array([docs[t] for t in terms]), np.array([len(x) for x in each]), np.array([s for s, _ in flat]), np.array([n for _, n in flat]))
        assert trie.terms().to_pylist() == terms
        return trie, docs, counts

    (a, da, ca), (b, db, cb) = made(500), made(300)
    for least in (0, 3):
        terms, docs, width, sources, counts = radix.merged([a, b], least)
        want = da + db
        assert dict(zip(terms.to_pylist(), docs.tolist(), strict=True)) == {t: n for t, n in want.items() if n >= least}
        assert terms.to_pylist() == sorted(terms.to_pylist())
        leaf = np.repeat(np.arange(len(terms)), width)
        assert {(terms[i].as_py(), s): n for i, s, n in zip(leaf.tolist(), sources.tolist(), counts.tolist(), strict=True)} == {k: n for k, n in (ca + cb).items() if want[k[0]] >= least}
    assert radix.Trie.of(pa.array([], pa.large_binary()), *[np.zeros(0, np.int64)] * 4).terms().to_pylist() == []
    assert a.cut(a.terms(), 3, 9).terms().to_pylist() == a.terms().to_pylist()[3:9]


# 12


def test_exact_dedup(docs, odd):
    for df in (docs, odd):
        data = [(r.doc_id, r.text or "") for r in df.collect()]
        groups = collections.defaultdict(list)
        for d, t in data:
            groups[t].append(d)
        top = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
        for batches in (1, 2, 5):
            out = exact_dedup.dedup(df, batches=batches).collect()
            got = sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in out), key=repr)
            assert got == sorted(((d, top[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in data), key=repr)
            kept = [r for r in out if r.kept]
            assert len(kept) == len(groups) == len({bytes(r.digest) for r in kept})
            assert all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def test_index_lives_on_and_merges(spark):
    path = scratch_path(spark, "index")
    rng = random.Random(6)
    seen = collections.defaultdict(list)
    for call in range(6):
        new = [(call * 100 + i, rng.choice("abcdefgh") * rng.randint(0, 3)) for i in range(20)]
        before = dict(seen)
        for d, t in new:
            seen[t].append(d)
        out = exact_dedup.dedup(spark.createDataFrame(new, "doc_id long, text string"), path=path, batches=1)
        assert rows(out.select("doc_id", "keep_id", "group_size", "kept")) == sorted(((d, max(seen[t]), len(seen[t]), d == max(seen[t])) for d, t in new), key=repr)
        index = exact_dedup.DigestIndex(spark, path)
        assert index.batches() == call + 1
        if (0, call, call) in index.spans:
            assert index.fresh(call).count() == len(set(t for _, t in new) - set(before))
        index.close()
    assert len(index.spans) < 6


def test_a_batch_that_was_cut_off_does_not_count(spark):
    path = scratch_path(spark, "index")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    exact_dedup.dedup(one, path=path, batches=1)
    index = exact_dedup.DigestIndex(spark, path)
    spark.createDataFrame([(b"x",)], "digest binary").write.parquet(f"{index.root}/l0-1-1-fresh")  # the driver was lost before the second segment
    again = exact_dedup.DigestIndex(spark, path)
    assert again.spans == [(0, 0, 0)] and again.batches() == 1
    assert again.groups().count() == 2


def test_the_index_is_not_shuffled(spark, docs):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"))
    hashed = written(docs.select("doc_id", exact_dedup.digest(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "hashed")
    index.add(hashed)
    index.add(hashed)
    a, b = index.fresh(0), index.fresh(1)
    plan = a.join(b.select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert b.count() == 0


# 13


def codes_by_hand(vectors, rounds=4, entries=256):
    good = [(i, x, v) for i, x, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return []
    dims = -(-max(len(v) for _, _, v in good) // 4) * 4
    data = sorted(((i, x, [math.floor(1024 * c) for c in v] + [0] * (dims - len(v))) for i, x, v in good), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = dims // 4
    parts = [[v[p * width : (p + 1) * width] for p in range(4)] for _, _, v in data]
    books = [[parts[k][p] for k in range(min(entries, len(parts)))] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((far(v[p], c), k) for k, c in enumerate(books[p])) for p in range(4)] for v in parts]

    for _ in range(rounds):
        codes = assigned()
        for p in range(4):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(parts, codes, strict=True) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = assigned()
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in last]
    labels = collections.Counter()
    for (_, x, _), e in zip(data, errors, strict=True):
        labels[x] += e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in c), e, labels[r[1]], sha) for r, c, e in zip(data, last, errors, strict=True)), key=repr)


VECTORS = "vec_id long, label int, embedding array<float>"


def test_vector_codes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    plenty = [(int(i), int(rng.integers(3)), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in rng.permutation(400)]
    odd = [
        (1, None, [0.5, -0.5, 0.001, -0.001]), (1, None, [0.5, -0.5, 0.001, -0.001]), (None, 1, [1.0, 2.0, 3.0, 4.0]), (2, 1, None), (3, 1, [1.0, None, 2.0, 3.0]),
        (4, 1, [float("nan")] * 4), (5, 1, [float("inf"), 1.0, 1.0, 1.0]), (6, 2, [1.5, 2.5]), (7, 2, [1.0, 2.0, 3.0, 4.0, 5.0]), (8, None, []), (1, 4, [0.25, 0.0, 0.0, 0.0]),
    ]
    for data in (plenty, odd, [], [(1, 1, [])], [(1, 1, [1.0, 2.0, 3.0, 4.0])] * 300):
        df = spark.createDataFrame(data, VECTORS).withColumns({c: F.lit("theirs") for c in ("q", "row", "now", "x", "error")}).repartition(5)
        assert rows(vector_codes.compress(df)) == codes_by_hand(data)


def test_only_what_changed_is_shuffled(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    lloyd = vector_codes.Lloyd(written(vector_codes.whole_numbers(vectors, "embedding"), "whole"))
    for _ in range(3):
        lloyd.assign()
        lloyd.update()
        # running sums are what a sum over all parts gives
        codes = lloyd.coded().select("row", "now").join(spark.table(lloyd.vectors), "row").select("now", "q").collect()
        width = lloyd.books.sums.shape[2]
        sums, counts = np.zeros_like(lloyd.books.sums), np.zeros_like(lloyd.books.counts)
        for r in codes:
            for p, k in enumerate(r.now):
                sums[p, k] += r.q[p * width : (p + 1) * width]
                counts[p, k] += 1
        assert (sums == lloyd.books.sums).all() and (counts == lloyd.books.counts).all()
    lloyd.assign()
    plan = spark.table(lloyd.vectors).join(spark.table(lloyd.codes).hint("merge"), "row")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    again = vector_codes.Lloyd(written(vector_codes.whole_numbers(vectors.limit(40), "embedding"), "whole"))
    again.assign()
    again.update()
    again.assign()  # every vector is an entry of its own, so nothing moves
    assert spark.table(again.codes).where("before <> now").count() == 0


def test_nearest_is_exact_for_large_numbers():
    rng = np.random.default_rng(8)
    for most in (10, 1 << 24):
        x, e = (rng.integers(-most, most, (n, 8)) for n in (60, 30))
        codes, errors = vector_codes.nearest(x, e)
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in e] for v in x]
        assert codes.tolist() == [f.index(min(f)) for f in far] and errors.tolist() == [min(f) for f in far]
    same = np.ones((3, 4), np.int64)
    assert vector_codes.nearest(same, np.ones((5, 4), np.int64))[0].tolist() == [0, 0, 0]
