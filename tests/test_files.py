"""Files in and out, options, reports, runs from the command line and streams."""

import gzip
import io
import json

import pytest

from strandflow import cli
from strandflow.functions import expressions as ex
from strandflow.operators import pipeline as run
from strandflow.plans import report
from strandflow.plans.options import Options
from strandflow.sources import fastq, sinks
from strandflow.streaming import stream

COMP = str.maketrans("ACGT", "TGCA")
SEQ = "ACGTTGCATCGGATCCGTAAGTCACGTTAGCATTCGAGGCTAACGTTACCGATGCATCGA"


def fq(*rows):
    return "".join(f"{n}\n{s}\n+\n{q}\n" for n, s, q in rows)


def test_lines_of_every_kind():
    data = b"a\nb\r\nc\rd\n\ne"
    assert list(fastq.lines(io.BytesIO(data))) == [b"a", b"b", b"c", b"d", b"", b"e"]
    assert list(fastq.lines(io.BytesIO(b"x" * ((1 << 20) - 1) + b"\r\ny"))) == [b"x" * ((1 << 20) - 1), b"y"]


def test_records_skip_and_stop():
    ok = "@a\nAC\n+\nII\n"
    assert len(list(fastq.records(io.BytesIO(("junk\n" + ok + "\n" + ok + "@b\nACG\n+\nII\n" + ok).encode())))) == 2
    assert list(fastq.records(io.BytesIO(b"@a\n\n+\n\n@b\nA\n+\nI"))) == [("@a", "", "+", ""), ("@b", "A", "+", "I")]


def test_read_files(spark, tmp_path):
    rows = [(f"@r{i} 1:N:0:AC+GT", SEQ[i:], "I" * len(SEQ[i:])) for i in range(9)]
    plain, packed, short = tmp_path / "a_R1.fq", tmp_path / "a_R1.fastq.gz", tmp_path / "a_R2.fq"
    plain.write_text(fq(*rows))
    packed.write_bytes(gzip.compress(fq(*rows[:4]).encode()) + gzip.compress(fq(*rows[4:]).encode()))
    short.write_text(fq(*rows[:5]))
    for p in (plain, packed):
        got = fastq.read_fastq(spark, str(p)).orderBy("read_id").collect()
        assert [(r.name, r.seq, r.qual) for r in got] == rows and [r.read_id for r in got] == list(range(9))
    assert fastq.read_pairs(spark, str(plain), str(short)).count() == 5
    assert fastq.read_single(spark, str(plain), limit=3).count() == 3
    both = fastq.read_interleaved(spark, str(plain)).orderBy("read_id").collect()
    assert [(r.name1, r.name2) for r in both] == [(f"@r{2 * i} 1:N:0:AC+GT", f"@r{2 * i + 1} 1:N:0:AC+GT") for i in range(4)]


def test_small_files(tmp_path):
    fa = tmp_path / "a.fa"
    fa.write_text(">b\nACG1T\nAC\n>a\nTTTTTT\n>b\nGGGGGGG\n>c\nACG\n>d\nTTTTTT\n")
    assert fastq.read_fasta(str(fa)) == {"a": "TTTTTT", "b": "GGGGGGG", "c": "ACG", "d": "TTTTTT"}
    assert fastq.read_adapters(str(fa)) == ["TTTTTT", "GGGGGGG"]
    ok, bad = tmp_path / "ok", tmp_path / "bad"
    ok.write_text("ACGT\nTTT\n")
    bad.write_text("ACNT\n")
    assert fastq.read_barcodes(str(ok)) == ["ACGT", "TTT"]
    with pytest.raises(ValueError):
        fastq.read_barcodes(str(bad))
    assert fastq.mate_files(["x_R1.fq", "x_R2.fq", "y_R1.fastq.gz", "Undetermined_R1.fq", "z.fq", "n.txt"]) == [("x_R1.fq", "x_R2.fq"), ("y_R1.fastq.gz", ""), ("z.fq", "")]


@pytest.mark.parametrize("wrong", [
    dict(merge=True), dict(split=1), dict(split=3, split_by_lines=4000), dict(split_by_lines=1001), dict(adapter="ACX"), dict(adapter="ACG"),
    dict(umi=True), dict(umi=True, umi_loc="read1"), dict(umi=True, umi_loc="index2"), dict(cut_front=(4, 31)), dict(qualified_quality=94),
    dict(index_blacklist1=("ACN",)), dict(stdout=True, split=3), dict(compression=0), dict(umi=True, umi_loc="index1", umi_prefix="a b"),
])
def test_options_that_are_wrong(wrong):
    with pytest.raises(ValueError):
        Options(**wrong).validated()


def test_options_that_override():
    assert Options(paired=True, merge=True).validated().correction
    assert not Options(correction=True, unpaired1="x").validated().correction
    assert Options(paired=True, trim_front1=3).of_mate2("trim_front") == 3 and Options(paired=True, trim_front1=3, trim_front2=0).of_mate2("trim_front") == 0
    assert Options(dedup=True, eval_duplication=False).validated().eval_duplication


def test_names(spark):
    name = "@NS500713:64:HFKJJBGXY:1:11101:20469:1097 1:N:0:TATAGCCT+GGTCCCGA"
    d = spark.createDataFrame([(name,), ("@a/1",), ("@ab",), ("@abcdef",)], "n string")
    got = d.select(ex.first_index(d.n), ex.last_index(d.n), ex.fix_mgi(d.n), ex.with_umi(d.n, ex.last_index(d.n), "P")).collect()
    assert tuple(got[0]) == ("TATAGCCT", "GGTCCCGA", name, name.replace(" ", ":P_GGTCCCGA ", 1))
    assert got[1][2] == "@a /1" and tuple(got[2])[:2] == ("", "") and got[3][3] == "@abcdef"


def pair_rows(n=20):
    out = []
    for i in range(n):
        frag = SEQ[i % 7 :] + SEQ[: i % 7]
        one, two = frag + "AGATCGGAAGAGC", frag[::-1].translate(COMP) + "AGATCGGAAGAGC"
        out.append((i, f"@p{i} 1:N:0:AC", one, "I" * len(one), f"@p{i} 2:N:0:AC", two, ("I" if i % 5 else "#") * len(two)))
    return out


COLS = "read_id long, name1 string, seq1 string, qual1 string, name2 string, seq2 string, qual2 string"


def test_routes_of_pairs(spark):
    d = spark.createDataFrame(pair_rows(), COLS)
    for o, want in (
        (Options(paired=True), {"out1": 16, "out2": 16}),
        (Options(paired=True, unpaired1="u", failed_out="f"), {"out1": 16, "out2": 16, "unpaired1": 4, "failed": 4}),
        (Options(paired=True, failed_out="f"), {"out1": 16, "out2": 16, "failed": 8}),
        (Options(paired=True, dedup=True), {"out1": 5, "out2": 5}),
        (Options(paired=True, merge=True, merged_out="m"), {"merged": 20}),
        (Options(paired=True, overlapped_out="o"), {"out1": 16, "out2": 16, "overlapped": 20}),
        (Options(paired=True, length_required=70, failed_out="f"), {"failed": 40}),
        (Options(paired=True, length_required=70, failed_out="f", literal=True), {}),
    ):
        done = run.process(d, o)
        got = {r.target: r["count"] for r in run.routes(done, o.validated()).groupBy("target").count().collect()}
        assert got == want, o
    tags = {r.name.split(" ", 2)[2] for r in run.routes(run.process(d, Options(paired=True, failed_out="f")), Options(paired=True, failed_out="f")).where("target = 'failed'").collect()}
    assert tags == {"paired_read_is_failing", "failed_quality_filter"}


def test_merged_regression_through_the_command_line(spark, tmp_path, capsys):
    inp = tmp_path / "i.fq"
    inp.write_text(fq(("@r1/1", SEQ, "I" * len(SEQ)), ("@r1/2", SEQ[::-1].translate(COMP), "I" * len(SEQ))))
    cli.run_files(spark, cli.parser().parse_args(["--in1", str(inp), "--interleaved_in", "--merge", "--stdout"]))
    assert capsys.readouterr().out.count("\n") == 4


def test_whole_run_with_reports(spark, tmp_path):
    rows = pair_rows()
    one, two, out = tmp_path / "in" / "s_R1.fq.gz", tmp_path / "in" / "s_R2.fq.gz", tmp_path / "out"
    one.parent.mkdir()
    one.write_bytes(gzip.compress(fq(*((r[1], r[2], r[3]) for r in rows)).encode()))
    two.write_bytes(gzip.compress(fq(*((r[4], r[5], r[6]) for r in rows)).encode()))
    cli.run_folder(spark, cli.parser().parse_args(["--in_dir", str(one.parent), "--out_dir", str(out)]))
    r = json.loads((out / "s_R1.fq.gz.json").read_text())
    assert list(r)[:5] == ["summary", "filtering_result", "duplication", "insert_size", "adapter_cutting"]
    assert r["summary"]["before_filtering"]["total_reads"] == 40 and r["filtering_result"]["passed_filter_reads"] == 32
    assert r["adapter_cutting"]["adapter_trimmed_reads"] == 40 and r["insert_size"]["peak"] == len(SEQ)
    assert sum(r["read1_after_filtering"]["kmer_count"].values()) == 16 * (len(SEQ) - 4)
    assert len(r["read1_before_filtering"]["quality_curves"]["mean"]) == len(SEQ) + 13
    assert gzip.open(out / "s_R2.fq.gz", "rt").read().count("\n") == 64 and "<svg" in report.to_html(r)
    with pytest.raises(FileExistsError):
        sinks.write_files(run.routes(run.process(spark.createDataFrame(rows, COLS), Options(paired=True)), Options(paired=True)), {"out1": str(out / "s_R1.fq.gz")}, overwrite=False)


def test_written_tables_keep_the_order(spark, tmp_path):
    o = Options(paired=True)
    routed = run.routes(run.process(spark.createDataFrame(pair_rows(), COLS), o), o)
    sinks.write_table(routed, str(tmp_path / "t"), "gzip")
    parts = sorted((tmp_path / "t" / "target=out1").glob("*.gz"))
    names = [x for x in gzip.decompress(b"".join(p.read_bytes() for p in parts)).decode().split("\n") if x.startswith("@")]
    assert names == [f"@p{i} 1:N:0:AC" for i in range(20) if i % 5]


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    for i in range(3):
        spark.createDataFrame(pair_rows()[i * 7 : i * 7 + 7], COLS).coalesce(1).write.mode("append").parquet(str(src))
    got = []
    q = stream.process_stream(stream.without_duplicates(stream.read_stream(spark, str(src), COLS, 1), ["seq1", "seq2"]), Options(paired=True), str(tmp_path / "c"), lambda d, n: got.extend(d.collect()))
    q.awaitTermination(120)
    assert len({(r.read_id, r.mate) for r in got}) == len(got) and 10 <= len(got) <= 14
