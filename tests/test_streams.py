"""Duplicates of streams over batches and files, numbers of reads, offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from strandflow.operators import pipeline as run
from strandflow.plans import fixture
from strandflow.plans.options import Options
from strandflow.sources import fastq
from strandflow.streaming import stream
from tests.test_files import SEQ, fq


def rows(n, tag):
    return [(f"@{tag}{i}", SEQ[i:] + "ACGT" * 3, "I" * (len(SEQ[i:]) + 12)) for i in range(n)]


def routed_by_stream(spark, folder, tmp_path, o, files_at_once, name="c"):
    got, batches = [], []

    def sink(d, number):
        got.extend(d.collect())
        batches.append(number)

    source = fastq.read_stream(spark, str(folder), files_at_once).toDF("file", "read_id", "name1", "seq1", "strand1", "qual1")
    stream.process_stream(source.drop("file"), o, str(tmp_path / name), sink).awaitTermination(180)
    return got, batches


@pytest.mark.parametrize("at_once", [0, 1])
def test_copies_in_two_files(spark, tmp_path, at_once):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.fq").write_text(fq(*rows(10, name)))
    o = Options(dedup=True, adapter_trimming=False)
    got, batches = routed_by_stream(spark, folder, tmp_path, o, at_once)
    assert sorted(r.seq for r in got) == sorted(s for _, s, _ in rows(10, ""))
    assert len(set(batches)) >= (2 if at_once else 1)
    if at_once:
        assert {r.name[1] for r in got} == {"a"}
    # The same folder without the step: all copies, with numbers of their own.
    both, _ = routed_by_stream(spark, folder, tmp_path, Options(adapter_trimming=False, eval_duplication=False), at_once, "d")
    assert len({r.read_id for r in both}) == len(both) == 20


def test_copies_that_come_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    o = Options(dedup=True, adapter_trimming=False)
    (folder / "a.fq").write_text(fq(*rows(6, "a")))
    first, _ = routed_by_stream(spark, folder, tmp_path, o, 0)
    (folder / "b.fq").write_text(fq(*rows(9, "b")))
    second, _ = routed_by_stream(spark, folder, tmp_path, o, 0)
    assert len(first) == 6 and sorted(r.name for r in second) == ["@b6", "@b7", "@b8"]
    assert not {r.read_id for r in first} & {r.read_id for r in second}


def test_state_is_bounded_by_default(spark, tmp_path):
    source = fastq.read_stream(spark, str(tmp_path)).toDF("file", "read_id", "name1", "seq1", "strand1", "qual1")
    plan = stream.without_duplicates(source, ["seq1"])._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "EventTimeWatermark" in plan
    assert stream.without_duplicates(source, ["seq1"]).columns == source.columns


@pytest.mark.parametrize("given", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_state_is_kept_on_disk(spark, tmp_path, given):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.fq").write_text(fq(*rows(8, name)))
    provider = "spark.sql.streaming.stateStore.providerClass"
    try:
        if given:
            spark.conf.set(provider, given)
        got, _ = routed_by_stream(spark, folder, tmp_path, Options(dedup=True, adapter_trimming=False), 1)
        assert spark.conf.get(provider, None) == given and len(got) == 8
    finally:
        spark.conf.unset(provider)
    kinds = {p.suffix for p in (tmp_path / "c" / "state").rglob("[0-9]*.*")}
    assert (".delta" in kinds) == bool(given) and (".changelog" in kinds) != bool(given)


@pytest.mark.parametrize("o", [Options(), Options(paired=True), Options(paired=True, merge=True, include_unmerged=True, overlapped_out="o", failed_out="f", unpaired1="u")])
def test_a_stream_makes_only_what_it_routes(spark, sf, tmp_path, o):
    d = fixture.pairs(spark, sf).withColumnRenamed("pair_id", "read_id").withColumns({f"strand{m}": F.lit("+") for m in (1, 2)})
    d.write.parquet(str(tmp_path / "in"))
    plans, got = [], []

    def sink(batch, number):
        plans.append(batch._jdf.queryExecution().analyzed().toString())
        got.extend(batch.collect())

    stream.process_stream(stream.read_stream(spark, str(tmp_path / "in"), d.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), o, str(tmp_path / "c"), sink)
    assert plans and not any("adapters1" in p or "corrections" in p or "front1" in p for p in plans)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, run.routes(run.process(d, o), o).collect()), key=repr)


def test_offsets_forget_old_files(tmp_path):
    source = fastq._Stream({"path": str(tmp_path), "maxFilesPerTrigger": "1", "maxFileAge": "100"})
    start, sizes, seen = source.initialOffset(), [], []
    for i in range(30):
        p = tmp_path / f"{i:02d}.fq"
        p.write_text(fq(*rows(1, "x")))
        os.utime(p, (1000 + 40 * i, 1000 + 40 * i))
        end = source.latestOffset()
        seen += [(os.path.basename(x.path), x.number) for x in source.partitions(start, end)]
        source.commit(end)
        start = json.loads(json.dumps(end))
        sizes.append(len(end["files"]))
    assert seen == [(f"{i:02d}.fq", i) for i in range(30)]
    assert max(sizes) <= 5
    assert source.latestOffset()["count"] == 30
    again = fastq._Stream({"path": str(tmp_path), "maxFileAge": "100"})
    assert again.partitions(start, start) == [] and again.latestOffset()["count"] == 30


def test_phred64_is_converted_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.fq").write_text(fq(("@a", SEQ, "h" * len(SEQ))))
    got, _ = routed_by_stream(spark, folder, tmp_path, Options(dedup=True, phred64=True, adapter_trimming=False), 0)
    assert [r.qual for r in got] == ["I" * len(SEQ)]
    assert run.taken(spark.createDataFrame([(0, "h")], "read_id long, qual1 string"), Options(phred64=True)).first().qual1 == "I"
