"""A folder of samples as one run: the figures and files of each are those of a run of its own."""

import gzip
import json
import random

import pytest

from strandflow import cli
from strandflow.operators import detect
from strandflow.plans import report
from tests.test_files import COMP
from tests.test_sinks import many_ranges  # noqa: F401
from tests.test_summary import R1, R2


def text(rnd, n, name, tail):
    one, two = [], []
    frags = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 90))) for _ in range(n)]
    for i in range(n):
        frag = frags[i // 2 * 2] if i % 10 == 1 else frags[i]
        for out, s, t in ((one, frag, R1), (two, frag[::-1].translate(COMP), R2)):
            s = (s + t + tail * 60)[:70]
            out.append(f"@{name}{i} 1:N:0:AC\n{s}\n+\n{''.join(rnd.choice('#?IIII') for _ in s)}\n")
    return "".join(one), "".join(two)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rnd, where = random.Random(11), tmp_path_factory.mktemp("in")
    for k, (n, name, tail) in enumerate(((60, "r", "A"), (90, "NS500:", "G"), (40, "q", "C"))):
        one, two = text(rnd, n, name, tail)
        (where / f"s{k}_R1.fq").write_text(one)
        (where / f"s{k}_R2.fq").write_text(two)
    same = (where / "s0_R1.fq").read_text()
    (where / "lone.fq.gz").write_bytes(gzip.compress(same.encode()))  # the reads of another sample are no duplicates here
    (where / "two.fq").write_text(same + same)
    return where


@pytest.mark.parametrize("more", [(), ("--dedup", "--reads_to_process", "30", "--poly_x")])
def test_each_sample_is_as_in_a_run_of_its_own(spark, folder, tmp_path, more):
    together = tmp_path / "all"
    out = cli.run_folder(spark, cli.parser().parse_args(["--in_dir", str(folder), "--out_dir", str(together), *more]))
    assert sorted(out) == ["lone.fq.gz", "s0_R1.fq", "s1_R1.fq", "s2_R1.fq", "two.fq"]
    for one in sorted(out):
        alone = tmp_path / f"of_{one}"
        alone.mkdir()
        two = one.replace("R1", "R2") if "R1" in one else ""
        args = ["--in1", str(folder / one), "--out1", str(alone / one), "--json", str(alone / f"{one}.json"), *more]
        args += ["--in2", str(folder / two), "--out2", str(alone / two)] if two else []
        want = cli.run_files(spark, cli.parser().parse_args(args))
        assert {k: v for k, v in out[one].items() if k != "command"} == {k: v for k, v in want.items() if k != "command"}
        opened = lambda p: gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes()
        for name in filter(None, (one, two)):
            assert opened(together / name) == opened(alone / name) and opened(alone / name)
        assert json.loads((together / f"{one}.json").read_text())["summary"] == json.loads(report.to_json(want))["summary"]
    assert (together / "overall.html").exists() and not [p for p in together.iterdir() if p.name.startswith(".")]


def test_adapters_of_many_samples_at_once(spark, monkeypatch):
    monkeypatch.setattr(detect, "LEAST_READS", 40)
    rnd, rows = random.Random(3), []
    for sample, adapter in (("a", R1), ("b", R2), ("none", ""), ("few", R1)):
        for i in range(30 if sample == "few" else 200):
            rows.append((sample, i, "".join(rnd.choice("ACGT") for _ in range(rnd.randint(15, 50))) + adapter))
    d = spark.createDataFrame(rows, "sample string, read_id long, seq string").repartition(3)
    found = detect.adapters_by_sample(d)
    assert found["none"] == found["few"] == ""
    for s in ("a", "b"):
        assert found[s] == detect.known_adapter(d.where(f"sample = '{s}'").drop("sample")) != ""


def test_large_files_of_samples_go_by_ranges(spark, folder):
    from strandflow.sources import fastq

    pairs = {f"s{k}": (str(folder / f"s{k}_R1.fq"), str(folder / f"s{k}_R2.fq")) for k in range(3)}
    want = sorted(tuple(r) for r in fastq.read_samples(spark, pairs).collect())
    d = fastq.read_samples(spark, pairs, span=9000)
    assert sorted(tuple(r) for r in d.select(fastq.read_samples(spark, pairs).columns).collect()) == want and len(want) == 190
    lone = {"x": (str(folder / "lone.fq.gz"), ""), "y": (str(folder / "two.fq"), "")}
    d = fastq.read_samples(spark, lone, limit=50, span=4000)
    assert {(r["sample"], r["count"]) for r in d.groupBy("sample").count().collect()} == {("x", 50), ("y", 50)}
