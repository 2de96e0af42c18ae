"""Runs from the command line: split files, strands, tails of two-colour instruments, standard input, guards and pictures."""

import gzip
import io
import json
import random
import sys
from collections import Counter

import pytest

from strandflow import cli
from strandflow.operators import detect
from strandflow.operators.adapters import known_adapters
from strandflow.plans import report
from tests.test_files import COMP, SEQ


def run(spark, *args):
    return cli.run_files(spark, cli.parser().parse_args(list(map(str, args))))


def reads(n, name="@r", tail="", strand="+"):
    return "".join(f"{name}{i} 1:N:0:AC\n{SEQ}{tail}\n{strand}{i if strand != '+' else ''}\n{'I' * len(SEQ + tail)}\n" for i in range(n))


@pytest.mark.parametrize("flag,files,each", [(("--split", 3), 3, [4, 4, 3]), (("--split", 20, "--split_digits", 0), 20, [1] * 11 + [0] * 9), (("--split_by_lines", 1000), 1, [11])])
def test_outputs_are_split(spark, tmp_path, flag, files, each):
    one, two = tmp_path / "a.fq", tmp_path / "b.fq"
    one.write_text(reads(11))
    two.write_text(reads(11).replace(SEQ, SEQ[::-1].translate(COMP)))
    out = tmp_path / "out"
    out.mkdir()
    run(spark, "--in1", one, "--in2", two, "--out1", out / "x.fq", "--out2", out / "y.fq.gz", *flag)
    numbers = [str(i + 1) if flag[-1] == 0 else f"{i + 1:04d}" for i in range(files)]
    assert sorted(p.name for p in out.iterdir()) == sorted([*(f"{n}.x.fq" for n in numbers), *(f"{n}.y.fq.gz" for n in numbers)])
    texts = [(out / f"{n}.x.fq").read_text() for n in numbers]
    assert [t.count("\n") // 4 for t in texts] == each
    assert [x.split()[0] for t in texts for x in t.split("\n") if x.startswith("@")] == [f"@r{i}" for i in range(11)]
    assert [gzip.open(out / f"{n}.y.fq.gz", "rt").read().count("\n") // 4 for n in numbers] == each


def test_strand_lines_are_kept(spark, tmp_path):
    inp, out = tmp_path / "a.fq", tmp_path / "o.fq"
    inp.write_text(reads(3, strand="+s"))
    run(spark, "--in1", inp, "--out1", out)
    assert out.read_text() == inp.read_text()


@pytest.mark.parametrize("flags,cut", [((), True), (("--no-poly_g",), False), (("--poly_g",), True)])
def test_tails_of_two_colour_instruments_can_be_kept(spark, tmp_path, flags, cut):
    inp, out = tmp_path / "a.fq", tmp_path / "o.fq"
    inp.write_text(reads(3, name="@NS500:", tail="G" * 30))
    run(spark, "--in1", inp, "--out1", out, "--no-adapter_trimming", *flags)
    assert all((len(s) < len(SEQ)) == cut for s in out.read_text().split("\n")[1:12:4])


def test_standard_input_is_read_from_the_shared_folder(spark, tmp_path, monkeypatch):
    out = tmp_path / "o.fq"
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(reads(5).encode())))
    run(spark, "--stdin", "--out1", out)
    assert out.read_text().count("\n") == 20


def test_reports_are_guarded_and_drawn(spark, tmp_path):
    inp, js, page = tmp_path / "a.fq", tmp_path / "a.json", tmp_path / "a.html"
    inp.write_text(reads(60) + reads(30, name="@other", tail="AC"))
    out = run(spark, "--in1", inp, "--json", js, "--html", page, "--overrep", "--overrep_sampling", 1, "--no-adapter_trimming")
    text = page.read_text()
    assert "quality histogram" in text and "5-mers" in text and "over-represented sequences" in text
    written = json.loads(js.read_text())
    assert not [k for b in written.values() if isinstance(b, dict) for k in b if k.startswith("_")]
    found = written["read1_before_filtering"]["overrepresented_sequences"]
    assert found and found == written["read1_after_filtering"]["overrepresented_sequences"]
    assert all(n > {10: 500, 20: 200, 40: 100, 100: 50}.get(len(s), 20) for s, n in found.items())
    curves = report.batch_curves({"a": out, "b": {"read1_before_filtering": {"quality_curves": {"mean": [1.0, 2.0]}, "content_curves": {"GC": [0.5]}}}})
    assert {len(v) for v in curves["read1_before_filtering"]["quality_curves: mean"].values()} == {len(SEQ) + 2}
    with pytest.raises(FileExistsError):
        run(spark, "--in1", inp, "--json", js, "--dont_overwrite")


def test_known_adapters():
    known = known_adapters()
    assert len(known) == 234 and all(set(a) <= set("ACGT") for a in known)
    assert known["GATCGGAAGAGCACACGTCTGAACTCCAGTCACTTAGGCATCTCGTATGCCGTCTTCTGCTTG"] == "TruSeq adapter, index 3"


def restated_votes(seqs, adapters):
    out = {}
    for a in adapters:
        hits = wrong = 0
        for s in seqs:
            for p in range(len(s) - 7):
                size = min(len(s) - p, len(a))
                d = sum(x != y for x, y in zip(s[p : p + size], a, strict=False))
                if d <= size // 16:
                    hits, wrong = hits + 1, wrong + d
                    break
        out[a] = (hits, wrong)
    return out


def test_votes_by_restatement(spark):
    rnd = random.Random(4)
    adapters = sorted(known_adapters())[::9]
    seqs = []
    for _ in range(150):
        s = list("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 60))) + rnd.choice(adapters))
        for _ in range(rnd.randint(0, 4)):
            s[rnd.randrange(len(s))] = rnd.choice("ACGTN")
        seqs.append("".join(s)[: rnd.choice((5, 40, 75, 150))])
    d = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    got = {r.adapter: (r.hits, r.mismatches) for r in detect.adapter_votes(d, dict.fromkeys(adapters, "")).collect()}
    assert got == restated_votes(seqs, adapters)


def restated_path(texts, share=0.95, least=50):
    """The rule one level at a time."""
    path = ""
    while True:
        live = [t for t in texts if t.startswith(path) and len(t) > len(path)]
        counts = Counter(t[len(path)] for t in live)
        if len(live) < least:
            return path, True
        base, n = counts.most_common(1)[0]
        if n < share * len(live):
            return path, False
        path += base


def test_tree_paths(spark):
    fixed = ["AAAATTTT", "AAAATTTTGGGG", "AAAATTTTGGGGCCCC", "AAAATTTTGGGGCCAA"] * 100 + ["AAAATTTTGGGACCCC"]
    rnd, texts = random.Random(8), {"fixed": fixed, "few": ["ACGT"] * 49, "just": ["ACGT"] * 50, "empty": [""] * 60}
    for i in range(12):
        base = "".join(rnd.choice("ACGT") for _ in range(70))
        wrong = rnd.choice((0.0, 0.01, 0.05, 0.06))
        texts[f"r{i}"] = ["".join(rnd.choice("ACGT") if rnd.random() < wrong else c for c in base[: rnd.randint(0, 70)]) for _ in range(rnd.choice((50, 52, 120, 400)))]
    d = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "key string, text string").repartition(3)
    want = {k: restated_path(ts) for k, ts in texts.items()}
    assert want["fixed"] == ("AAAATTTTGGGGCC", False) and want["just"] == ("ACGT", True)
    assert detect.dominant_paths(d) == detect.dominant_paths(d, step=3) == want


def test_an_unknown_adapter_is_grown(spark):
    rnd = random.Random(6)
    adapter = "GTCATGACTGGATCCTTAGCATGCAACTGGTACCATTGCA"
    rows = []
    for i in range(10_500):
        frag = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(25, 80)))
        rows.append((i, frag + adapter[: rnd.randint(20, len(adapter))]))
    d = spark.createDataFrame(rows, "read_id long, seq string")
    assert adapter.startswith(detect.find_adapter(d)[:30]) and len(detect.find_adapter(d)) >= 30
    assert detect.find_adapter(d.where("read_id < 9000")) == detect.find_adapter(d, literal=True) == ""  # fragments before it fork
    known = {adapter[:24]: "own"}
    assert detect.find_adapter(d, adapters=known) == adapter[:24]
    want = next(n for n in range(100) if sum(len(s) for _, s in rows[:n]) >= 1000)
    assert detect.first_bases(d, 100, 1000).count() == want and detect.first_bases(d, 5, 10**9).count() == 5
