"""The ten operators against brute force, round trips and held-out data, and on odd inputs."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patchloom.llm import chat_format, decontaminate, graph, html_text, jaccard_join, language_id, line_dedup, media_ts, mixing, queries, rans, substring_dedup, tokens, words
from patchloom.llm.common import written

LONG = "word " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\n", "en", "a", 4), (4, "One two three four five six.", "en", "b", 27), (4, "One two three four five six.", "en", "b", 27),
    (5, "one TWO three four five six.", "en", "b", 27), (None, "One two three four five six.", "fr", None, 1), (None, None, None, None, None), (6, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG)),
    (8, "12345 !!! ...", "de", "c", 1), (9, "ein Wort", "de", "c", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    # columns of these names belong to the caller
    return df.withColumns({c: F.lit("theirs") for c in ("h1", "rid", "t", "n", "key", "component", "size", "copies", "lang_pred", "letters", "spots", "part")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def low(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# 1


def lines_by_hand(rows, least):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    split = [(d, (t or "").split("\n")) for d, t in rows]
    seen = collections.Counter(k for _, ls in split for k in {key(x) for x in ls} if k)
    return sorted(((d, len(ls), sum(seen[key(x)] >= least for x in ls), "\n".join(x for x in ls if seen[key(x)] < least)) for d, ls in split), key=repr)


def found_lines(df, **more):
    out = line_dedup.dedup_lines(df, **more).select("doc_id", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("k"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_lines(spark, odd, none, docs):
    assert found_lines(docs) == lines_by_hand([(r.doc_id, r.text) for r in docs.collect()], 10)
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice([" a", "A\t", "b", "É", "é", "", "c" * 40]) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    for batches, fanout in ((1, 2), (5, 2)):
        assert found_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=12, batches=batches, fanout=fanout) == lines_by_hand(rows, 12)
    assert found_lines(odd, min_docs=3) == lines_by_hand([(r[0], r[1]) for r in ODD], 3)
    assert found_lines(none) == []


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2, buckets=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(1, 1), (k + 10, k)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.common().collect()] == [(1, 1)]


# 2


def sentences_by_hand(text):
    """[(words, begin, end)]; pieces without a word go to the sentence before."""
    out, at = [], 0
    for m in re.finditer(r"(?:[.!?](?=[\x20\t\n\x0b\x0c\r]|\Z))|\n|\Z", text):
        piece = text[at : m.end()]
        ws = re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(piece))
        if ws:
            out.append(ws)
        at = m.end()
    return out


def words_by_hand(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(text or ""))


def cut_by_hand(rows, passage):
    """(sentences, sentences that lose words, words lost) by document: all runs of `passage` words, one by one."""
    seen, out, documents = set(), {}, sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for d, text in documents:
        ws = words_by_hand(text)
        runs = [tuple(ws[i : i + passage]) for i in range(len(ws) - passage + 1)]
        gone = {k for i, r in enumerate(runs) if r in seen for k in range(i, i + passage)}
        seen |= set(runs)
        sizes = [len(x) for x in sentences_by_hand(text or "")]
        starts = np.cumsum([0, *sizes])
        out[d, text] = len(sizes), sum(any(k in gone for k in range(x, y)) for x, y in zip(starts[:-1], starts[1:], strict=True)), len(gone)
    return out


def test_spans(spark, docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for passage, more in ((50, {}), (12, {"passage": 12, "window": 5}), (6, {"passage": 6, "window": 6, "span": 1})):
        got = {(r.doc_id, r.before): (r.n_sentences, r.n_removed, r.n_words_removed) for r in substring_dedup.dedup_spans(docs, **more).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").collect()}
        want = cut_by_hand(rows, passage)
        assert sum(x[2] > 0 for x in want.values()) > 10
        assert {k: v for k, v in got.items() if want[k] != v} == {}
    passage = "Alpha beta gamma delta. Epsilon zeta eta theta! Iota kappa lambda mu? "
    two = spark.createDataFrame([(1, "Start here now. " + passage + "End."), (2, "Other words stand. " + passage + "Close it."), (3, "Alone it stays.")], "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.dedup_spans(two, 3, 10, 4).collect()}
    assert (out[1].n_removed, out[2].n_removed, out[3].n_removed) == (0, 3, 0)
    assert out[2].text == "Other words stand. Close it." and [tuple(x) for x in out[2].removed] == [(19, 19 + len(passage))]
    got = substring_dedup.dedup_spans(odd).collect()
    assert len(got) == len(ODD) and sum(r.text is None for r in got) == 2
    assert {r.doc_id: r.n_removed for r in got if r.doc_id in (2, 3, 4, 6)} == {2: 0, 3: 0, 4: 0, 6: 0}
    assert [r.text for r in got if r.doc_id == 7] == [""]
    assert substring_dedup.dedup_spans(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_spans(none, passage=5, window=6)


def test_passages_of_any_sentences(spark, docs):
    rng = random.Random(5)
    new = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    bare, two, one, three = new(50), f"{new(26)}. {new(27)}.", new(60) + ".", f"{new(20)}. {new(25)}. {new(30)}."
    wrapped, itself, short = new(55), new(70) + ". ", new(49)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = [
        f"{new(9)} {bare} {new(9)}", f"{new(4)}. {new(30)} {bare} {new(30)}.",  # inside a sentence
        f"{new(5)}. {two} {new(5)}.", f"{new(7)}. {two} {new(7)}.", f"{new(5)}. {one} {new(5)}.", f"{new(8)}. {one} {new(8)}.",
        f"{new(5)} {three} {new(5)}.", f"{new(8)}. {new(3)} {three} {new(8)}.", f"{new(3)}. {wrapped}.", f"{new(6)}. {wrapped.replace(' ', chr(10))} {new(2)}.",  # other line ends
        f"{new(60)}. {new(60)}", itself + new(3) + ". " + itself, f"{new(9)} {short} {new(9)}", f"{new(4)}. {new(30)} {short} {new(30)}.",  # repeats itself; one word too few
    ]
    rows += [(100_000 + i, t) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[100_000 + i].n_words_removed for i in range(14)] == [0, 50, 0, 53, 0, 60, 0, 75, 0, 55, 0, 0, 0, 0]
    assert two not in out[100_003].text and three not in out[100_007].text
    for d, text in rows:
        raw = (text or "").encode()
        for x in reversed(out[d].removed):
            raw = raw[: x.begin] + raw[x.end :]
        assert raw.decode() == (out[d].text or "")


# 3


def test_numeral_system():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 5000, 300_001):
        ids = (rng.pareto(1.0, n) * 50).astype(np.int64) % 50_000
        table = rans.FrequencyTable.from_counts(*np.unique(np.append(ids, 2), return_counts=True))
        assert table.freqs.sum() == 1 << rans.SCALE and table.freqs.min() >= 1
        block = rans.encode(ids, table)
        assert (rans.decode(block, table) == ids).all()
        if n:
            cut = rans.segments(block)
            assert len(cut) == -(-n // (rans.SEGMENT * min(rans.LANES, max(1, n // 64))))
            assert (np.concatenate([rans.decode_segment(p, table) for p in cut[::-1]][::-1]) == ids).all()
            for bad in (cut[0][:-1], cut[-1][:-3] + bytes([cut[-1][-3] ^ 1]) + cut[-1][-2:], cut[0][:25] + bytes([cut[0][25] ^ 4]) + cut[0][26:]):
                with pytest.raises(rans.BlockError):
                    rans.decode_segment(bad, table)
            for bad in (block[:-1], block[:-3] + bytes([block[-3] ^ 1]) + block[-2:], b"XXXX" + block[4:]):
                with pytest.raises(rans.BlockError):
                    rans.decode(bad, table)
    with pytest.raises(ValueError):
        rans.encode(np.array([1]), rans.FrequencyTable.from_counts([2], [1]))


def test_pieces_make_the_library_s_ids():
    encoder = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(2)
    parts = ["a", "B", " ", "\n", "'s", "'", "1", "é", ".", ",", "  ", "\t", "\r\n", "\xa0", "_", "<|endoftext|>", "世", "×", "ñ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(8000)] + ["", LONG[:5000]]
    for _ in range(2):  # from memory the second time
        got = [x for ids, n in encoder.encode(pa.array(texts), 2) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [x.tolist() for x in got] == [[*encoder.whole(t).tolist(), 2] for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "span_hashes", lambda data, begins: (data[begins] % 3).astype(np.uint64))
    encoder = tokens.Encoder(tokens.tokenizer_path())
    texts = ["one two three, two one.", "four five six five one", "", "one"] * 3
    for _ in range(3):
        got = [x for ids, n in encoder.encode(pa.array(texts), 2) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [x.tolist() for x in got] == [[*encoder.whole(t).tolist(), 2] for t in texts]


def test_added_tokens_get_their_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    encoder = tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "end.", " Next", "<|endof", "text|>", " ", "\n", "word", ",", "é", "  "]
    texts = ["end.<|endoftext|> Next", "", "<|endoftext|>", "a b, c.", "x <|endof", "text|> y", "", *["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(4000)]]
    for _ in range(2):
        got = [x for ids, n in encoder.encode(pa.array(texts), 2) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [x.tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert got[0].tolist() == [437, 13, 50256, 7406, 2]


def check_tokens(spark, df, rows, path, **more):
    tokens.write(df, path)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    got = sorted((tuple(r) for r in tokens.read(spark, path, **more).collect()), key=lambda r: r[1])
    start = 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), got, strict=True):
        ids = [*encoder.whole(text or "").tolist(), 2]
        assert (r[0], r[1], r[2]) == (doc_id, start, len(ids)) and np.frombuffer(r[3], "<u4").tolist() == ids
        start += len(ids)


def test_tokens(spark, docs, odd, none, tmp_path):
    check_tokens(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], str(tmp_path / "a"))
    check_tokens(spark, odd, [(r[0], r[1]) for r in ODD], str(tmp_path / "b"))
    check_tokens(spark, none, [], str(tmp_path / "c"))
    rng = random.Random(1)
    long = [(1, "a b"), (2, " ".join(str(rng.random()) for _ in range(40_000))), (3, None)]  # segment by segment
    check_tokens(spark, spark.createDataFrame(long, "doc_id long, text string"), long, str(tmp_path / "d"), long_block=1000)


# 4


def shingles(text):
    ws = low(text or "").encode().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def components_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_jaccard_join(spark, docs, odd, none):
    same = lambda df: sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=repr)
    assert same(docs) == components_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert same(odd) == components_by_hand([(r[0], r[1]) for r in ODD])
    assert same(none) == []


def test_jaccard_chains_and_groups(spark):
    """Chains whose ends are unlike, near copies of one text, and a passage that many texts share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(80)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = word()
        rows.append((i, " ".join(copy)))
    chain = [word() for _ in range(60)]
    for i in range(60, 80):
        chain[(i * 7) % 60] = word()
        rows.append((i, " ".join(chain)))
    passage = " ".join(base[:25])
    rows += [(i, passage + " " + " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(80, 160)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(r) for r in jaccard_join.join(df).collect()), key=repr) == components_by_hand(rows)


@pytest.mark.parametrize("dear", [0, 3])
def test_dear_shingles_lose_no_link(spark, docs, dear):
    """With next to every shared shingle dear, most documents meet in all of theirs, or few shared ones are seen."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    for i in range(120):  # half of each text is common; every second one has a near copy
        own = common[: rng.randint(0, 60)] + [word() for _ in range(rng.randint(1, 50))]
        rows.append((1000 + 2 * i, " ".join(own)))
        if i % 2:
            own[rng.randrange(len(own))] = word()
            rows.append((1001 + 2 * i, " ".join(own)))
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), dear=dear)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == components_by_hand(rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: top(n) for n in nodes}


def test_one_row_of_each_component(spark, none):
    text = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [
        (3, text("a"), "x"), (5, text("a") + " end", "x"), (5, text("b"), "x"), (5, text("c"), "y"), (5, text("c"), "y"),
        (None, text("d"), "x"), (None, text("e"), None), (None, text("e") + " end", "z"), (None, text("b"), "z"), (9, text("f"), "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string").repartition(3)
    out = jaccard_join.one_of_each(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and set(got) <= set(rows)
    assert sorted(((d, t.split()[0]) for d, t, _ in got), key=repr) == sorted([(3, "a0"), (5, "b0"), (5, "c0"), (9, "f0"), (None, "d0"), (None, "e0")], key=repr)
    plain = df.where("doc_id = 3 or doc_id = 9").unionByName(df.where("doc_id = 9").withColumn("doc_id", F.lit(10).cast("long")))
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(plain).collect()) == [3, 9]
    assert jaccard_join.one_of_each(none).count() == 0


# 5


def test_streams():
    rng = np.random.default_rng(1)
    for n in (0, 1, 192, 193, 1535, 1536, 1537, 3072, 70_000, 600_000):
        payload = media_ts.pad(rng.bytes(n))
        media = media_ts.mux(payload)
        back, told = media_ts.demux(media)
        assert back == payload and told["continuity_errors"] == 0 and len(media) % 188 == 0
        assert told["pts"] == [media_ts.TICKS * k for k in range(-(-len(payload) // media_ts.UNIT))]
        assert told["access_units"] == list(range(0, len(told["pts"]), media_ts.GROUP))
        for at in told["access_offsets"]:
            assert media[at] == 0x47 and media[at + 1] & 0x40 and media[at + 5] & 0x40
    lost = bytearray(media)
    del lost[188 * 5 : 188 * 6]
    with pytest.raises(media_ts.StreamError):
        media_ts.demux(bytes(lost))
    renumbered = bytearray(media)
    renumbered[188 * 5 + 3] ^= 3
    assert media_ts.demux(bytes(renumbered))[1]["continuity_errors"] > 0
    broken = bytearray(media)
    broken[188 + 12] ^= 1
    with pytest.raises(media_ts.StreamError):
        media_ts.demux(bytes(broken))


def test_streams_of_other_makes():
    payload = media_ts.pad(bytes(range(256)) * 30)
    media = media_ts.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    told = media_ts.demux(media)[1]
    assert told["damaged_units"] == [] and len(told["pts"]) == 5
    # a packet may be sent twice, whatever it is, and packets of other PIDs may lie between
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    for k in (0, 1, 2, 3, 9, len(packets) - 1):
        back, more = media_ts.demux(b"".join([*packets[: k + 1], null, packets[k], *packets[k + 1 :]]))
        assert back == payload and more["continuity_errors"] == 0 and more["pts"] == told["pts"] and more["access_units"] == [0]
    assert media_ts.demux(b"".join([*packets[:4], packets[3], packets[3], *packets[4:]]), strict=False)[1]["continuity_errors"] > 0
    # network entry before the program, a stream of another type before ours, descriptors
    pat = media_ts._table_packet(0, media_ts._section(0, b"\x00\x00\xe0\x10" + b"\x00\x07" + (0xE000 | 0x1000).to_bytes(2, "big"))).tobytes()
    streams = b"\x1b\xe2\x00\xf0\x02\x28\x00" + bytes([0x06]) + (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00"
    pmt = media_ts._table_packet(0x1000, media_ts._section(2, b"\xe1\x00\xf0\x02\x09\x00" + streams)).tobytes()
    back, more = media_ts.demux(b"".join([pat, pmt, *packets[2:]]))
    assert back == payload and more["feature"].startswith("program=7 pid=256 type=6")
    # a header with both timestamps: five more bytes, which the length counts
    first = packets[2]
    times = bytes(first[21:26]) + b"\x11\x00\x01\x00\x01"
    long = b"\x00\x00\x01\xbd" + (13 + media_ts.UNIT).to_bytes(2, "big") + b"\x80\xc0\x0a" + times + payload[: media_ts.UNIT]
    cut = [long[i : i + 184] for i in range(0, len(long), 184)]
    made = []
    for i, piece in enumerate(cut):
        head = bytes([0x47, 0x41 if i == 0 else 0x01, 0x00])
        fill = 184 - len(piece)
        made.append(head + bytes([(0x30 if fill else 0x10) | i]) + (bytes([fill - 1]) + (b"\x00" + b"\xff" * (fill - 2) if fill > 1 else b"") if fill else b"") + piece)
    back, more = media_ts.demux(b"".join([pat, pmt, *made]))
    assert back == payload[: media_ts.UNIT] and more["pts"] == [0]
    # a lost packet: the unit is left out and told
    lost = b"".join([*packets[:15], *packets[16:]])
    back, more = media_ts.demux(lost, strict=False)
    assert more["damaged_units"] == [1] and more["continuity_errors"] == 1
    assert back == payload[: media_ts.UNIT] + payload[2 * media_ts.UNIT :]
    for bad in (b"", b"x", pat, pat + pmt):
        with pytest.raises(media_ts.StreamError):
            media_ts.demux(bad)


def test_media_columns(spark, odd, none, sf):
    rows = media_ts.read_back(media_ts.store(odd)).collect()
    want = sorted((media_ts.pad((t or "").encode()) for _, t, *_ in ODD))
    assert sorted(bytes(r.payload) for r in rows) == want and media_ts.store(none).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_media(spark, sf).collect():
        p = media_ts.pad(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_sha256 == hashlib.sha256(media_ts.mux(p)).hexdigest()


# 6


def test_gradients():
    rng = np.random.default_rng(0)
    net = language_id.ByteConvNet.fresh(["a", "b"], rng)
    x, y = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 1])
    _, grads = net.gradients(x, y)
    for name, at in (("out", (3, 1)), ("conv3", (5, 2)), ("bias2", (1,)), ("emb", (int(x[0, 4]), 2))):
        old, step = net.params[name][at], 1e-2
        loss = []
        for sign in (1, -1):
            net.params[name][at] = old + sign * step
            loss.append(net.gradients(x, y)[0])
        net.params[name][at] = old
        assert abs((loss[0] - loss[1]) / (2 * step) - grads[name][at]) < 5e-3


def test_windows_cover_texts():
    for n in (0, 1, 127, 128, 129, 1000):
        data = bytes(range(1, 251)) * 4
        cut = language_id.cut(data[:n])
        assert set(cut.ravel()) - {0} == set(data[:n]) and cut.shape[1] == language_id.WINDOW


def test_languages(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(docs)
    out = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    got = language_id.identify(odd, net).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == dict.fromkeys((1, 2, 3, 8), "und")
    assert language_id.predict_beside(odd, net).where("size = 'theirs' and lang_pred <> 'theirs'").count() == len(ODD)
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(none)).collect()} == {"und"}


# 7


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    model = html_text.TreeModel(rng.normal(size=len(html_text.NAMES)), 0.1, np.log(rng.dirichlet([1, 1], (2, 2))), {"x": -3.0, "y": 1.0})
    nodes, _ = html_text.parse("<body><div class='x y'><p>a</p><p id=y>b. c</p></div><nav><a>x</a></nav></body>")
    n = len(nodes)
    score = html_text.features(nodes, model.odds) @ model.weights + model.bias
    free = html_text.neutral(nodes, model.odds)
    total, mass = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        e = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(model.edge[int(free[v.parent])][y[v.parent]][y[i]] for i, v in enumerate(nodes) if i))
        total += e
        mass += e * np.array(y)
    assert np.allclose(model.marginals(nodes), mass / total)


@pytest.fixture(scope="module")
def model():
    return html_text.trained()


#: Pages of other makes than labelled_pages knows: (page, the main text).
PAGES = [
    (
        "<body><table><tr><td><a href=/>Start</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr><tr><td><h2>The long way home</h2><p>It was late when the last train left the station, and nobody spoke.</p>"
        "<p>We walked along the river. The lamps were lit.</p></td></tr><tr><td>&copy; 1999 by the author. All rights reserved. <a href=mailto:x>Mail</a></td></tr></table></body>",
        "The long way home\nIt was late when the last train left the station, and nobody spoke.\nWe walked along the river. The lamps were lit.",
    ),
    (
        "<body><div id=page><div id=masthead><span>The Daily</span></div><ul id=menu><li><a href=1>World</a><li><a href=2>Sport</a></ul><div id=content><h1>Rain again</h1><div class=byline>By A. Writer</div>"
        "<p>Rain fell on the town for the third day in a row. <a href=x>Officials</a> said that roads were closed.</p><blockquote>We have never seen such water here before.</blockquote><ul><li>Bring a coat with you.</li><li>Stay at home if you can.</li></ul>"
        "<div class='related links'><h3>Read on</h3><a href=3>Storms</a> <a href=4>Floods</a></div></div><div id=sidebar><h3>Popular</h3><ol><li><a href=5>Cats</a><li><a href=6>Dogs</a></ol></div><div id=footer>Imprint</div></div></body>",
        "Rain again\nBy A. Writer\nRain fell on the town for the third day in a row. Officials said that roads were closed.\nWe have never seen such water here before.\nBring a coat with you.\nStay at home if you can.",
    ),
    (
        "<body><header><a href=/>Logo</a><nav><a href=a>A</a><a href=b>B</a></nav></header><main><article><header><h1>On tables</h1></header><p>A table holds numbers that belong together, row by row.</p><table><tr><td>one</td><td>First of all numbers.</td></tr></table>"
        "<pre>x = 1\n  y = 2</pre><p>That is all there is to say about tables today.</p></article><section id=comments><h2>3 comments</h2><article><p>Nice text, thank you for it. I learned a lot.</p></article><article><p>I do not agree with this at all.</p></article></section></main><footer><p>Made by hand.</p></footer></body>",
        "On tables\nA table holds numbers that belong together, row by row.\none\nFirst of all numbers.\nx = 1 y = 2\nThat is all there is to say about tables today.",
    ),
    (
        "<body><div class='cookie-banner'><p>We use cookies to give you the best experience. Do you accept them?</p><button>Accept</button></div><div class=wrapper><div class=story-body><p>The first paragraph tells who did what, and where, and when it was.</p><div class=advert><p>Buy one, get one free. Only today!</p></div>"
        "<p>The second one tells why. It is longer than the first one was.</p><p>Short end.</p></div><form><label>Mail</label><input><p>Subscribe to our letter.</p></form></div></body>",
        "The first paragraph tells who did what, and where, and when it was.\nThe second one tells why. It is longer than the first one was.\nShort end.",
    ),
]


def test_pages_of_other_makes(model):
    """Precision and recall of blocks: on pages written by hand, and on generated ones that were not learned from."""
    found = wanted = right = 0
    for page, text in PAGES:
        got, want = collections.Counter(model.text(page).split("\n")), collections.Counter(text.split("\n"))
        found, wanted, right = found + got.total(), wanted + want.total(), right + (got & want).total()
    assert right >= 0.9 * found and right >= 0.9 * wanted, (found, wanted, right)
    blocks = right = 0
    for page in html_text.labelled_pages(150, seed=99):
        nodes, found = html_text.parse(page)
        y, keep = html_text._labels(nodes), model.marginals(nodes) > 0.5
        blocks += len(found)
        right += sum(bool(y[k]) == bool(keep[k]) for k, _ in found)
    assert right >= 0.95 * blocks, (right, blocks)


def test_names_are_learned():
    """Nothing but the labelled pages says what a name means."""
    sentence = "This is a sentence of the page. "
    pages = [f"<body><div class=zork data-main=1><p>{sentence * 2}</p></div><div class=blah data-main=0><p>{sentence * 2}</p></div></body>" for _ in range(30)]
    assert html_text.trained(pages).text(f"<body><div class=zork><p>Keep it, as it is. {sentence}</p></div><div class=blah><p>Drop it, as it is. {sentence}</p></div></body>") == f"Keep it, as it is. {sentence.strip()}"


THREE = "The first paragraph has a full sentence in it.\nHere is some more text that belongs to the article. It has two.\nThe last paragraph ends the article with a full stop."


def test_elements_without_an_end_lose_no_text(model):
    for tag in ("video src=a.mp4", "select", "audio", "template", "video", "option"):
        assert model.text(f"<article><p>A</p><{tag}><p>B</p><p>C</p></article>") == "A\nB\nC", tag
    assert model.text("<article><p>One.</p><video src=a><p>Two.</p><video src=b><p>no film</p></video><select><option>x</select><template><p>no</p></template><p>Three.</p></article>") == "One.\nTwo.\nThree."
    began = time.perf_counter()
    html_text.parse("<video><p>" * 100_000 + "</video>")
    assert time.perf_counter() - began < 10


def test_names_that_nobody_told(model):
    """A name alone takes no text away, and boxes are told by what they hold and where they lie."""
    three = "".join(f"<p>{x}</p>" for x in THREE.split("\n"))
    talk = "".join(f"<div class=k><b>{who}</b><p>{what}</p></div>" for who, what in (("Anna", "Das sehe ich anders."), ("Bernd", "Ich auch. Aber wer weiss.")))
    for name in ("related", "kommentare", "werbung", "comments ad"):
        assert model.text(f'<article><div class="{name}">{three}</div></article>') == THREE
        assert model.text(f'<body><article>{three}<div class="{name}">{talk}</div></article></body>') == THREE
        assert model.text(f'<body><article>{three}</article><div class="{name}"><p>Kauft jetzt unsere Schuhe. Heute noch!</p></div></body>') == THREE
        assert model.text(f'<body><main>{three}</main><ol class="{name}"><li>Das sehe ich anders.<li>Ich auch.</ol></body>') == THREE
        assert model.text(f'<body><div>{three}</div><div class="{name}"><a href=a>Schuhe</a> <a href=b>Hosen</a></div></body>') == THREE


def test_names_are_learned_from_the_pages_at_hand(model):
    pages = [f"<body><article><p>{THREE} {i}</p><div class=kasten><p>Text of the article.</p></div></article><div class=werbung><p>Kauft jetzt unsere Schuhe.</p></div></body>" for i in range(9)]
    odds = html_text.names_of(pages)
    assert odds["werbung"] < -1 and odds["kasten"] > 1
    assert html_text.names_of(pages[:2]) == {}
    bare = "<body><div><p>%s</p></div><div class=werbung><p>Kauft jetzt unsere Schuhe. Heute noch!</p></div></body>" % THREE.replace("\n", "</p><p>")
    taught = html_text.trained(at_hand=pages)
    assert taught.text(bare) == THREE
    assert taught.text(f"<body><article><div class=werbung><p>{THREE.replace(chr(10), '</p><p>')}</p></div></article></body>") == THREE


def test_text_of_any_element_stays(model):
    one, two, three = "The first paragraph has a full sentence in it.", "Here is some more text that belongs to the article.", "The last paragraph ends the article with a full stop."
    for inner in (f"<noscript><p>{two}</p></noscript>", f"<object><p>{two}</p></object>", f"<p><math>{two}</math></p>", f"<p><button>{two}</button></p>", f"<p><svg viewBox='0 0 1 1'><text>{two}</text></svg></p>",
                  f"<canvas><p>{two}</p></canvas>", f"<xmp>{two}</xmp>", f"<iframe><p>{two}</p></iframe>", f"<svg/><p>{two}</p>", f"<p>{two}<video src=x/></p>", f"<div class='top-story message'>{two}</div>", f"<div data-main=x><p>{two}</p></div>", f"<div data-main=''><p>{two}</p></div>",
                  f"<!--><p>{two}</p>", f"<p title=\"a > b\">{two}</p>", f"<p>{two}</p><script>var x = '<p>no</p>'</SCRIPT ><style>p{{}}</style>"):
        assert model.text(f"<body><nav><a href=x>Home</a></nav><article><p>{one}</p>{inner}<p>{three}</p></article></body>") == f"{one}\n{two}\n{three}", inner


def test_broken_pages_take_linear_time(model):
    size = 1 << 20
    pieces = ["<a ", "<b>", "<p>", "<h1>", "<div>", "<li>", "</script ", "<i><p></i>", "<a b='>", "<a b='>' c=\"", "<!-", "<!--", "<", "</b>", "<td><ul>", "&amp", "<script>", "x. "]
    for piece in pieces:
        page = piece * (size // len(piece) // 4)
        for text in (page, page + "</i>" * 50_000, "<b><div>" + page + "</b>" * 50_000, "<script>" + page):
            began = time.perf_counter()
            html_text.parse(text)
            assert time.perf_counter() - began < 5, piece


def test_sampled_pages(spark):
    df = spark.createDataFrame([("a" * 40,)] * 50 + [(f"page {i}",) for i in range(20)] + [(None,), ("long" * 100,)], "html string")
    some = html_text.sampled(df, 5, 100)
    assert len(some) == len(set(some)) == 5 and html_text.sampled(df.repartition(7), 5, 100) == some
    assert len(html_text.sampled(df, 50, 100)) == 21 and html_text.sampled(df.limit(0)) == []


def test_pages(spark, sf, model):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One <b>bold</b>\n  line&nbsp;&#65;.<br>Next sentence here.<p>Two <script>x='</p>'</script>parts.</article><div class=comments><p>I disagree with all.</p></div><footer>(c)</footer>"
    assert model.text(page) == "T & U\nOne bold line A. Next sentence here.\nTwo parts."
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<" * 50_000), (3, "u", page), (3, "u", page), (4, "u", "<div>" * 3000 + "deep text here." + "<!-- open"), (5, "u", "plain text, no tag")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("theirs"))
    out = html_text.extract(df, model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out) and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert html_text.extract(df.limit(0), model).count() == 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert model.text(r.html) == "\n".join(x for x in want if x)


# 8


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def test_mix(spark, docs, odd, none):
    rng = random.Random(4)
    some = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None])) for i in range(600)] + [(700, "w " * 5, "tiny"), (701, "w", "zero"), (702, "", "empty")]
    for df in (docs, odd, spark.createDataFrame(some, "doc_id long, text string, source string")):
        rows = mixing.mix(df).collect()
        sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            most[r.source] = max(most[r.source], r.size)
            assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        goal = targets_by_hand(sizes)
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) <= 1e-6 * max(1, r.target)
        for s, want in goal.items():
            assert abs(taken[s] - want) <= most[s] / 2 + 1e-6 * want + 1
    again = lambda: sorted((tuple(r) for r in mixing.mix(df).collect()), key=repr)
    assert again() == again()
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(12)
    sizes = {f"s{i:04}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(500)} | {None: 50}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = targets_by_hand(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
    assert {r.target for r in mixing.targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")).collect()} == {0.0}


def test_mix_of_repeated_rows(spark):
    """Rows of one id, or of none, are told apart by their texts; equal rows by a number. Other columns stay with their rows."""
    rows = [(None, f"w{i} " * (1 + i % 9), "a", i) for i in range(60)] + [(7, "same words here", "b", 1)] * 20 + [(7, "other words", "b", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    got = collections.Counter(tuple(r) for r in mixing.mixed(df).collect())
    assert set(got) <= set(rows) and all(n <= 3 * rows.count(r) for r, n in got.items())
    taken = collections.Counter()
    for r, n in got.items():
        taken[r[2]] += n * len(r[1].split())
    for s in "ab":
        goal = next(r for r in out if r.source == s)
        assert abs(taken[s] - goal.target) <= 10


def test_mix_is_fair(spark):
    """Over many seeds a document is taken as often as its share says."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 3 else "b") for i in range(40)], "doc_id long, text string, source string").cache()
    total, runs = collections.Counter(), 4
    for seed in range(runs):
        for r in mixing.mix(df, seed=seed).collect():
            total[r.source] += r.copies - r.target / r.source_size
    assert all(abs(x) / runs < 3 for x in total.values())


def test_mixed_rows(spark, odd):
    want = collections.Counter()
    for r in mixing.mix(odd).collect():
        want[(r.doc_id, r.size)] += r.copies
    rows = mixing.mixed(odd)
    assert rows.columns == odd.columns
    got = collections.Counter((r.doc_id, len((r.text or "").split())) for r in rows.collect())
    assert +got == +want


# 9


def coverage_by_hand(doc, item, least):
    """Greedy tiling by looking at all places."""
    d, t, n = list(doc), list(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(d)):
            for j in range(len(t)):
                k = 0
                while i + k < len(d) and j + k < len(t) and d[i + k] is not None and d[i + k] == t[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return n
        d[i : i + k], t[j : j + k] = [None] * k, [0.5] * k
        n += k


def test_tiles():
    rng = random.Random(6)
    for _ in range(600):
        doc, item = [[rng.randint(1, 4) for _ in range(rng.randint(0, 14))] for _ in range(2)]
        free = np.array([rng.random() < 0.9 for _ in doc], bool)
        tiles = decontaminate.tile(np.array(doc, np.uint64), free, np.array(item, np.uint64), 3)
        assert all(doc[i : i + n] == item[j : j + n] and n >= 3 and free[i : i + n].all() for i, j, n in tiles)
        for axis in (0, 1):
            spots = [p for t in tiles for p in range(t[axis], t[axis] + t[2])]
            assert len(spots) == len(set(spots))
        by_hand = [x if f else None for x, f in zip(doc, free, strict=True)]
        assert sum(n for *_, n in tiles) == coverage_by_hand(by_hand, item, 3)
    same = np.full(100_000, 7, np.uint64)
    began = time.perf_counter()
    assert sum(n for *_, n in decontaminate.tile(same, np.ones(len(same), bool), same[:500], 4)) == 500
    mixed = same.copy()
    mixed[::3] = 100 + np.arange(len(mixed[::3]))
    assert decontaminate.tile(mixed, np.ones(len(same), bool), same[:500], 4) == []
    assert time.perf_counter() - began < 10


def test_leaks(spark, docs, odd, none, sf):
    items = [(1, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn"), (2, "Tiny item"), (3, None), (4, " "), (1, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("t", F.lit("theirs"))
    texts = {
        1: "Before. The quick, brown fox jumps over the lazy dog near a quiet river bank at dawn! After.",
        2: "near a quiet river bank at dawn we saw that the quick brown fox jumps over the lazy dog",  # reordered
        3: "the quick brown bird jumps near a river", 4: "a tiny item of news", 5: "tiny, but no such item", 6: "", 7: "the quick brown fox jumps over a log",
    }
    df = spark.createDataFrame([*texts.items(), (8, None), (None, texts[1])], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect())
    assert got == {(1, 1): 2, (2, 1): 2, (4, 2): 1, (None, 1): 2}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(df, bench).collect()) == ["3", "5", "6", "7", "8"]
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0
    # all pairs, by hand
    real = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ws = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", low(t))
    want = set()
    for r in docs.collect():
        mine = ws(r.text)
        grams = {tuple(mine[i : i + 4]) for i in range(len(mine))}
        for k, t in real:
            item = ws(t)
            if sum(tuple(item[i : i + 4]) in grams for i in range(len(item))) >= 1 and coverage_by_hand(mine, item, min(4, len(item))) >= 0.5 * len(item):
                want.add((r.doc_id, k))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, filter_bits=128).collect()} == want  # nothing is dropped early


def test_leaks_of_long_texts_and_odd_columns(spark):
    """A text of one word again and again, an item of that word, and columns of any name."""
    long = "again " * 100_000
    df = spark.createDataFrame([(1, long, "x", 1), (2, "again and " * 30, "y", 2), (3, None, None, 3)], "doc_id long, text string, bad_id string, bad_t long")
    bench = spark.createDataFrame([(1, "again " * 60, "z"), (2, "and again", None)], "item_id long, text string, doc_id string")
    began = time.perf_counter()
    got = {(r.doc_id, r.item_id): (r.matched_words, r.coverage) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1): (60, 1.0), (2, 2): (2, 1.0)} and time.perf_counter() - began < 30
    assert [(r.doc_id, r.bad_t) for r in decontaminate.clean(df.withColumn("_leakid", F.lit(1)), bench).collect()] == [(3, 3)]


def test_a_phrase_of_all_items_and_documents_brings_nobody_together(spark):
    phrase = "in the year of our lord and of the king"
    item = lambda i: " ".join(f"w{i}x{k}" for k in range(14))
    items = [(i, f"{phrase} {item(i)}") for i in range(60)] + [(60, "in the year of")]
    docs = [(d, f"start {phrase} {'some other words of this document' if d % 10 else item(d // 10)} {d}") for d in range(300)]
    table = spark.createDataFrame(items, "item_id long, text string").mapInArrow(words.tidy(decontaminate._items(4)), decontaminate.ITEMS)
    table = written(table.withColumn("item", F.col("item_id")), "items")
    hashes = lambda data: decontaminate._seeds_of(words.words_of(data, np.array([0, len(data)]), words.MARKS).hashes, 4)
    seeds = [(d, int(h)) for d, text in docs for h in np.unique(hashes(np.frombuffer(text.encode(), np.uint8))).view(np.int64)]
    met = decontaminate.meetings(spark.createDataFrame(seeds, "doc long, seed long"), table, 0.5).collect()
    # the short item, which is all of the phrase, meets all documents; of the others each meets its own
    assert {(r.doc, r.item) for r in met} == {(d, 60) for d in range(300)} | {(10 * i, i) for i in range(30)}
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(r.doc, r.item) for r in met}


# 10


def test_chat_round_trip(spark):
    rng = random.Random(11)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "<\\|end|>", "\\", "<", "|", "[INST]", "[\\/INST]", "</s>", "a", "\n", "é", "<<SYS>>", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "x<|text|>y"]), rng.choice(["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))), None])) for c in range(150) for t in range(rng.randint(1, 4))]
    rows += [(900, 1, "user", "tie b"), (900, 1, "user", "tie a"), (900, 1, "user", "tie a"), (900, None, "user", "first"), (None, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit("theirs"))
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    out = chat_format.format_conversations(df)
    for r in out.collect():
        assert [(p.role, p.text) for p in r.parsed] == want[r.conv_id]
        assert not re.search(r"(<|\[)(/?s>|/?INST\]|/?SYS>)", "".join(p.raw for p in r.parsed))
    for r in chat_format.digests(out).collect():
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = {r.conv_id: r.formatted for r in out.collect()}
    under = collections.defaultdict(list)
    for r in sorted(chat_format.loss_mask(out).collect(), key=lambda r: r.start):
        under[r.conv_id].append(re.sub(r"(<|\[)\\(\\*)(\||/?s>|/?INST\]|/?SYS>)", r"\1\2\3", formatted[r.conv_id][r.start : r.end]))
    assert {c: x for c, turns in want.items() if (x := [t for role, t in turns if role == "assistant"])} == under
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# all


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = c.execute(queries.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(out.fetchall())


def test_words():
    texts = ["One two  three", "", "two\tONE", "é-x", None]
    for k, (_, _, data, offsets) in enumerate(words.pieces(pa.array(texts))):
        w = words.words_of(data, offsets)
        assert k == 0 and w.first.tolist() == [0, 3, 3, 5, 6, 6] and w.hashes[0] == w.hashes[4] and w.hashes[1] == w.hashes[3]
        assert [data[a:b].tobytes() for a, b in zip(w.begins, w.ends, strict=True)][:3] == [b"One", b"two", b"three"]
