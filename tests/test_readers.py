"""Readers of large files: numbered lines of splits, and archives streamed through Spark."""

import io
import random
import tarfile

import pytest

from patchloom.sources import readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_of_many_splits_are_numbered(spark, tmp_path, small_splits):
    rng, want = random.Random(1), []
    for name, end in (("a.jsonl", "\n"), ("b.jsonl", ""), ("c.jsonl", "\r\n"), ("none.jsonl", "")):
        lines = [] if name == "none.jsonl" else ["", *["x" * rng.choice([0, 3, 40, 5000]) + str(i) for i in range(300)], "é\x85\u2028 one line", ""]
        (tmp_path / name).write_bytes(("\r\n" if end == "\r\n" else "\n").join(lines).encode() + end.encode())
        text = (tmp_path / name).read_bytes().decode()
        split = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
        want += [(name, i + 1, line.removesuffix("\r")) for i, line in enumerate(split)]
    df = readers.numbered_lines(spark, [str(tmp_path)])
    assert df.rdd.getNumPartitions() > 1
    got = sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in df.collect())
    assert got == sorted(want)


def test_splits_keep_their_line_numbers(spark, tmp_path, small_splits):
    (tmp_path / "dev.jsonl").write_text("".join(f'{{"n": {i}}}\n' if i % 3 else "\n" for i in range(1000)))
    rows = readers.read_splits(spark, [str(tmp_path / "dev.jsonl")], "n long").collect()
    assert sorted((r.split, r.line, r.n) for r in rows) == [("dev", i + 1, i) for i in range(1000) if i % 3]
    (tmp_path / "bad.jsonl").write_text("{}\n{")
    with pytest.raises(Exception):
        readers.read_splits(spark, [str(tmp_path / "bad.jsonl")], "n long").collect()


@pytest.mark.parametrize("mode", ["w", "w:gz", "w:bz2"])
def test_archives_are_streamed(spark, tmp_path, small_splits, mode):
    rng, want = random.Random(2), {}
    for k in range(3):
        with tarfile.open(tmp_path / f"{k}.{mode.replace('w', 'tar').replace(':', '.')}", mode) as tar:
            for i in range(20):
                data = rng.randbytes(rng.choice([0, 1, 700, 9000])) + b"\n" * rng.randint(0, 3)
                info = tarfile.TarInfo(f"d/{k}-{i}.{'zip' if i % 2 else 'md'}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                want[info.name] = data
            tar.addfile(tarfile.TarInfo("../out.zip"), io.BytesIO())
            folder = tarfile.TarInfo("d/folder")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
    got = {r.member: bytes(r.content) for r in readers.read_tar(spark, [str(tmp_path)]).collect()}
    assert got == want
    some = readers.read_tar(spark, [str(tmp_path)], r"\.zip$").collect()
    assert {r.member: bytes(r.content) for r in some} == {k: v for k, v in want.items() if k.endswith(".zip")}
    assert len({r.archive for r in some}) == 3
