"""Outputs written by tasks: order, commits, lost attempts, failures, parts, and the rules on names."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from strandflow import cli
from strandflow.plans.options import Options
from strandflow.sources import sinks
from tests.test_command_line import reads, run

COLS = "read_id long, mate int, target string, name string, seq string, strand string, qual string"


def routed(spark, n, parts=5):
    rows = [(i, m, "out1" if m == 1 else "out2" if i % 3 else "failed", f"@r{i}é", "ACGT"[: i % 4 + 1], "+", "IIII"[: i % 4 + 1]) for i in range(n) for m in (1, 2)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, COLS).repartition(parts)


def text(n, keep):
    return "".join(f"@r{i}é\n{'ACGT'[: i % 4 + 1]}\n+\n{'IIII'[: i % 4 + 1]}\n" for i in range(n) for m in (1, 2) if keep(i, m)).encode("latin-1")


@pytest.fixture
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("join", [True, False])
def test_files_are_the_reads_in_order(spark, tmp_path, many_ranges, join):
    one, two, both, none = (str(tmp_path / x) for x in ("a.fq", "b.fq.gz", "c.fq", "d.fq.gz"))
    d = routed(spark, 500)
    sinks.write_files(d, {"out1": one, "out2": two, "failed": both, "merged": none}, 4, join=join)
    content = lambda p: b"".join(x.read_bytes() for x in sorted(p.iterdir())) if p.is_dir() else p.read_bytes()
    assert content(tmp_path / "a.fq") == text(500, lambda i, m: m == 1)
    assert gzip.decompress(content(tmp_path / "b.fq.gz")) == text(500, lambda i, m: m == 2 and i % 3)
    assert content(tmp_path / "c.fq") == text(500, lambda i, m: m == 2 and not i % 3)
    if join:
        assert gzip.decompress(content(tmp_path / "d.fq.gz")) == b""
    else:
        assert len(list((tmp_path / "a.fq").iterdir())) > 1
    assert sorted(os.listdir(tmp_path)) == ["a.fq", "b.fq.gz", "c.fq", "d.fq.gz"]


def test_targets_of_one_name_share_its_file(spark, tmp_path):
    p = str(tmp_path / "u.fq")
    sinks.write_files(routed(spark, 40), {"out1": p, "out2": p}, 4)
    assert (tmp_path / "u.fq").read_bytes() == text(40, lambda i, m: m == 1 or i % 3)


def test_a_failed_write_leaves_nothing_and_old_files_as_they_were(spark, tmp_path, many_ranges):
    (tmp_path / "a.fq").write_text("old")
    bad = routed(spark, 300).withColumn("name", F.when(F.col("read_id") == 250, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(bad, {"out1": str(tmp_path / "a.fq"), "out2": str(tmp_path / "b.fq")}, 4)
    assert os.listdir(tmp_path) == ["a.fq"] and (tmp_path / "a.fq").read_text() == "old"
    with pytest.raises(FileExistsError):
        sinks.write_files(routed(spark, 3), {"out1": str(tmp_path / "a.fq")}, 4, overwrite=False)


def test_parts_of_lost_attempts_do_not_count(tmp_path):
    file = str(tmp_path / "a.fq")
    writer = sinks._PartsWriter({"run": "x", "level": "4", "files": f'["{file}"]'})
    folder = tmp_path / ".a.fq.x"
    folder.mkdir()
    for name in ("part-000000-0", "part-000000-7", "part-000001-3"):
        (folder / name).write_text(name)
    told = [sinks._Written(1, [(file, str(folder / "part-000001-3"), 1)]), None, sinks._Written(0, [(file, str(folder / "part-000000-7"), 1)])]
    writer.commit(told)
    assert sorted(os.listdir(folder)) == ["_parts.json", "part-000000-7", "part-000001-3"]
    assert (folder / "_parts.json").read_text() == f'{{"{file}": ["{folder}/part-000000-7", "{folder}/part-000001-3"]}}'
    writer.abort(told)
    assert os.listdir(tmp_path) == []


def test_standard_output_gets_the_bytes(spark, tmp_path, many_ranges):
    import io

    out = io.BytesIO()
    sinks.write_stream(routed(spark, 200), ["out1", "out2"], out)
    assert out.getvalue() == text(200, lambda i, m: m == 1 or i % 3)


@pytest.mark.parametrize(
    "o,in1,in2",
    [
        (dict(), "", ""), (dict(), "", "b"), (dict(interleaved_in=True), "a", "b"), (dict(merge=True, merged_out="m"), "a", ""), (dict(merge=True), "a", "b"),
        (dict(merge=True, merged_out="m", out1="m", out2="o"), "a", "b"), (dict(merge=True, merged_out="m", out1="o", out2="m"), "a", "b"),
        (dict(merge=True, merged_out="m", unpaired1="m"), "a", "b"), (dict(merge=True, merged_out="m", unpaired2="m"), "a", "b"), (dict(out2="o"), "a", ""), (dict(out1="o"), "a", "b"),
        (dict(out2="o"), "a", "b"), (dict(out1="o", out2="o"), "a", "b"), (dict(out1="o", out2="p", unpaired1="o"), "a", "b"), (dict(out1="o", out2="p", unpaired1="p"), "a", "b"),
        (dict(out1="o", out2="p", unpaired2="o"), "a", "b"), (dict(out1="o", out2="p", unpaired2="p"), "a", "b"), (dict(out1="o", failed_out="o"), "a", ""),
        (dict(out1="o", out2="p", failed_out="p"), "a", "b"), (dict(unpaired1="u", failed_out="u"), "a", "b"), (dict(unpaired2="u", failed_out="u"), "a", "b"),
        (dict(merge=True, merged_out="m", failed_out="m"), "a", "b"),
    ],
)
def test_names_that_contradict_each_other(o, in1, in2):
    with pytest.raises(ValueError):
        Options(**o).with_names(in1, in2)


def test_names_that_are_dropped_or_taken():
    o = Options(merge=True, out1="o").with_names("a", "b")
    assert (o.merged_out, o.out1) == ("o", "")
    assert Options(stdout=True, out1="o", out2="o").with_names("a", "b").out1 == ""
    assert Options(merged_out="m").with_names("a").merged_out == ""
    assert Options(unpaired1="u", unpaired2="u", overlapped_out="x").with_names("a").overlapped_out == ""
    o = Options(merge=True, include_unmerged=True, merged_out="m", out1="m", unpaired1="m").with_names("a", "b")
    assert (o.out1, o.unpaired1, o.merged_out) == ("", "", "m")
    assert Options(split=2, out1="o", out2="p", unpaired1="o").with_names("a", "b").unpaired1 == ""
    assert Options(unpaired1="u", unpaired2="u").with_names("a", "b").unpaired2 == "u"


def test_split_pairs_with_one_output_are_refused(spark, tmp_path):
    one = tmp_path / "a.fq"
    one.write_text(reads(8))
    with pytest.raises(ValueError, match="second output"):
        run(spark, "--in1", one, "--in2", one, "--out1", tmp_path / "o.fq", "--split", 2)
    run(spark, "--in1", one, "--in2", one, "--out1", tmp_path / "o.fq", "--out2", tmp_path / "p.fq", "--split", 2, "--no-adapter_trimming")
    assert sum((tmp_path / f"000{k}.{n}.fq").read_text().count("@r") for k in (1, 2) for n in "op") == 16


def test_outputs_as_parts_from_the_command_line(spark, tmp_path):
    one = tmp_path / "a.fq"
    one.write_text(reads(8))
    args = cli.parser().parse_args(["--in1", str(one), "--out1", str(tmp_path / "o.fq.gz"), "--no-join"])
    cli.run_files(spark, args)
    assert b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "o.fq.gz").iterdir())) == one.read_bytes()
