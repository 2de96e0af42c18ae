"""Files read by many tasks, mates put together as they are read, and files as a stream."""

import random
import struct
import zlib

import pytest

from strandflow.sources import fastq


def block(data):
    """A gzip block that states its size."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data, size=700):
    return b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b"")


def text(n, end="\n", seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        seq = "".join(rnd.choice("ACGTN") for _ in range(rnd.randint(0, 60)))
        qual = "".join(rnd.choice("@+I#") for _ in seq)
        rows.append(f"@r{i} x{end}{seq}{end}+{'' if i % 3 else 'r'}{end}{qual}{end}")
    return "".join(rows)


def rows_of(d, cols=("read_id", "name1", "seq1", "strand1", "qual1")):
    return sorted(tuple(r) for r in d.select(*cols).collect())


@pytest.mark.parametrize("end,cut", [("\n", 0), ("\r\n", 0), ("\n", 1)])
def test_spans_equal_one_task(spark, tmp_path, end, cut):
    data = text(300, end)
    data = data[: len(data) - cut].encode()
    for name, raw in (("a.fq", data), ("a.fq.gz", blocks(data))):
        path = tmp_path / name
        path.write_bytes(raw)
        want = rows_of(fastq.read_single(spark, str(path)))
        assert len(want) == 300
        for size in (len(raw) // 7, 997, 5000):
            d = fastq.spans(spark, str(path), size)
            assert d is not None and d.rdd.getNumPartitions() > 1
            assert rows_of(fastq.read_single(spark, str(path), span=size)) == want


def test_irregular_files_go_to_one_task(spark, tmp_path):
    ok = text(100)
    for k, data in enumerate((ok[:3000] + "@x\nACG\n+\nI\n" + ok[3000:], ok + "@cut off\nACGT", ok.replace("\n", "\r"), "\n" + ok)):
        path = tmp_path / f"{k}.fq"
        path.write_text(data, newline="")
        assert fastq.spans(spark, str(path), 1000) is None
        assert rows_of(fastq.read_single(spark, str(path), span=1000)) == rows_of(fastq.read_single(spark, str(path)))


def member(data, level=6, every=0):
    """A gzip member, with a block's end after `every` bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join(c.compress(data[i : i + every]) + c.flush(zlib.Z_BLOCK) for i in range(0, len(data), every)) + c.flush() if every else c.compress(data) + c.flush()


@pytest.mark.parametrize("how", ["one", "blocks", "members", "stored"])
def test_gzip_packed_in_one_go_by_many_tasks(spark, tmp_path, how):
    data = text(4000).encode()
    path = tmp_path / "a.fq.gz"
    halves = len(data) // 2 + 7
    path.write_bytes({"one": lambda: member(data), "blocks": lambda: member(data, every=9000), "members": lambda: member(data[:halves], every=20_000) + member(data[halves:], every=7000), "stored": lambda: member(data, 0)}[how]())
    want = rows_of(fastq.read_single(spark, str(path)))
    assert len(want) == 4000
    d = fastq.spans(spark, str(path), 30_000)
    assert d.rdd.getNumPartitions() > 1 and rows_of(fastq.read_single(spark, str(path), span=30_000)) == want
    cols = ("read_id", "name1", "seq1", "strand1", "qual1", "name2", "seq2", "strand2", "qual2")
    assert rows_of(fastq.read_interleaved(spark, str(path), span=30_000), cols) == rows_of(fastq.read_interleaved(spark, str(path)), cols)
    other = tmp_path / "b.fq"
    other.write_bytes(data)
    assert rows_of(fastq.read_pairs(spark, str(path), str(other), span=30_000), cols) == rows_of(fastq.read_pairs(spark, str(path), str(other)), cols)


def test_every_restart_point_gives_the_rest(tmp_path):
    from strandflow.sources import restart

    data = text(3000, seed=4).encode()
    for k, packed in enumerate((member(data), member(data, every=5000), member(data, 1, 3333) + member(b"") + member(data, 9, 8000) + b"\0" * 9)):
        path, points = str(tmp_path / f"{k}.gz"), str(tmp_path / f"{k}.points")
        with open(path, "wb") as f:
            f.write(packed)
        whole = data * (2 if k == 2 else 1)
        at, begun = 0, {}
        for number, chunk in restart.unpack(path, points, 10_000):
            if number >= 0:
                begun[number] = at
            at += len(chunk)
        assert at == len(whole) and len(begun) > (1 if k == 0 else 5)
        for number, start in begun.items():
            assert b"".join(restart.resumed(path, points, number)) == whole[start:]


def test_a_broken_gzip_file_goes_to_one_task(spark, tmp_path):
    path = tmp_path / "a.fq.gz"
    packed = bytearray(member(text(2000).encode(), every=4000))
    packed[len(packed) // 2] ^= 255
    path.write_bytes(packed)
    assert fastq.spans(spark, str(path), 9000) is None


def test_pairs_by_many_tasks(spark, tmp_path):
    one, two = tmp_path / "1.fq", tmp_path / "2.fq"
    one.write_text(text(200))
    two.write_text(text(180, seed=2))
    cols = ("read_id", "name1", "seq1", "qual1", "name2", "seq2", "qual2")
    want = rows_of(fastq.read_pairs(spark, str(one), str(two)), cols)
    assert len(want) == 180 and rows_of(fastq.read_pairs(spark, str(one), str(two), span=2000), cols) == want
    for d in (fastq.read_pairs(spark, str(one), str(two)), fastq.read_pairs(spark, str(one), str(two), span=2000)):
        assert "Exchange" not in d._jdf.queryExecution().toString()
    assert fastq.read_pairs(spark, str(one), str(two), span=2000).rdd.getNumPartitions() > 3
    assert rows_of(fastq.read_pairs(spark, str(one), str(two), limit=37, span=900), cols) == want[:37]
    packed = tmp_path / "2.fq.gz"
    packed.write_bytes(blocks(two.read_bytes()))
    assert rows_of(fastq.read_pairs(spark, str(one), str(packed), span=1500), cols) == want


@pytest.mark.parametrize("n", [200, 201])
def test_mates_in_one_file_by_many_tasks(spark, tmp_path, n):
    cols = ("read_id", "name1", "seq1", "strand1", "qual1", "name2", "seq2", "strand2", "qual2")
    for name, pack in (("a.fq", bytes), ("a.fq.gz", blocks)):
        path = tmp_path / name
        path.write_bytes(pack(text(n).encode()))
        want = rows_of(fastq.read_interleaved(spark, str(path)), cols)
        d = fastq.read_interleaved(spark, str(path), span=1500)
        assert len(want) == 100 and d.rdd.getNumPartitions() > 3 and rows_of(d, cols) == want
        assert rows_of(fastq.read_interleaved(spark, str(path), limit=7, span=600), cols) == want[:7]


def test_a_limit_opens_only_the_spans_it_needs(spark, tmp_path, monkeypatch):
    from strandflow.sources import spans

    path = tmp_path / "a.fq"
    data = text(400)
    path.write_text(data + "@broken\nACGT\n+\nI\n" * 3)  # where nothing is read, nothing is missed
    seen = []
    real = spans._looked
    monkeypatch.setattr(spans, "_looked", lambda spark, path, starts, *more: seen.extend(starts) or real(spark, path, starts, *more))
    want = rows_of(fastq.read_fastq(spark, str(path), limit=20).withColumnsRenamed({c: f"{c}1" for c in ("name", "seq", "strand", "qual")}))
    assert rows_of(fastq.read_single(spark, str(path), limit=20, span=1000)) == want
    assert max(seen) < len(data) // 3


def test_a_filter_of_one_plan_does_not_change_another(spark, tmp_path):
    path = tmp_path / "a.fq"
    path.write_text(text(300))
    d = fastq.read_single(spark, str(path), span=1000)
    assert [d.where("read_id < 41").count(), d.count(), d.where("read_id < 200").count()] == [41, 300, 200]


def test_bytes_beyond_ascii_and_lines_over_chunks(spark, tmp_path, monkeypatch):
    from strandflow.sources import spans

    path = tmp_path / "a.fq"
    path.write_bytes(b"".join(b"@\xe9%d\nAC\n+\n\xff!\n" % i for i in range(200)))
    want = rows_of(fastq.read_single(spark, str(path)))
    assert want[0][1] == "@é0"
    assert rows_of(fastq.read_single(spark, str(path), span=500)) == want
    monkeypatch.setattr(spans, "CHUNK", 7)
    index = spans.index(spark, str(path), 500)
    got = [r for x in spans.ranges([index], 500, False) for b in x.batches() for r in zip(b.column(1).to_pylist(), *(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
    assert got == want
    for at in range(0, 60, 11):
        a, b = spans.look(str(path), 0, at + 1), spans.look(str(path), at + 1, 10_000)
        assert a.ends + b.ends == 800


def test_memory_of_a_large_packed_span(tmp_path):
    import subprocess
    import sys

    path = tmp_path / "a.fq.gz"
    one = text(20_000, seed=9).encode()
    path.write_bytes(blocks(one, 60_000) * 12)
    code = f"""
import resource, sys
from strandflow.sources import spans
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = spans.look({str(path)!r}, 0, {path.stat().st_size})
n = sum(b.num_rows for b in spans.Range(0, s.ends // 4, [({str(path)!r}, 0, 0, '')], 4).batches())
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == 240_000 and mb < 120


def test_files_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fq").write_text(text(20))
    seen = []

    def run():
        q = fastq.read_stream(spark, str(folder)).writeStream.foreachBatch(lambda b, k: seen.extend((r.name, r.read_id) for r in b.collect()))
        q.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert len(seen) == 20
    (folder / "b.fq.gz").write_bytes(blocks(text(30, seed=3).encode()))
    (folder / "ignored.txt").write_text("x")
    run()
    assert len(seen) == 50 and len(set(seen)) == 50 - 20 + sum(1 for x in seen[20:] if x not in seen[:20]) - 30 + 20
