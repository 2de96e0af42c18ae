"""How the table of reads is derived and written."""

import pyarrow.parquet as pq
import pytest

from strandflow.plans import catalogue, fixture
from strandflow.plans.session import expose


def test_only_keys_are_shuffled(spark, sf):
    plan = fixture.derived(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange RoundRobin", 1)
    assert "md5" in above and "md5" not in below


def test_reads_are_written_packed(spark, sf):
    _, path = fixture.pairs_folder(expose(spark), sf)
    from pathlib import Path

    part = next(Path(path.removeprefix("file://")).glob("*.parquet"))
    assert pq.ParquetFile(part).metadata.row_group(0).column(1).compression == "ZSTD"


def test_a_file_of_reads_has_groups_for_several_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(fixture, "_written", {})
    monkeypatch.setattr(fixture, "ROW_GROUP", 64 << 10)
    _, path = fixture.pairs_folder(expose(spark), sf)
    from pathlib import Path

    assert all(pq.ParquetFile(p).metadata.num_row_groups > 1 for p in Path(path.removeprefix("file://")).glob("*.parquet"))


@pytest.mark.parametrize("name", ["detect_two_color", "detect_seq_len", "detect_kmer10_top"])
def test_detection_writes_no_whole_table(spark, sf, monkeypatch, name):
    monkeypatch.setattr(fixture, "_written", {})
    monkeypatch.setattr(fixture, "ADAPTER_SAMPLE", 1200)
    catalogue.QUERIES[name](spark, sf).collect()
    assert [k[2] for k in fixture._written] == [1200]
    assert fixture.single(spark, sf, 1200).count() == 1200 < fixture.pairs(spark, sf).count()


def test_an_index_is_written_out_once(spark, sf):
    from pyspark.sql import functions as F

    from strandflow.functions import expressions as ex

    d = spark.createDataFrame([("ACGT",), ("ACGTACGA",), ("GGGGGGGG",), ("",), (None,)], "ix string")
    long = F.concat(*(F.upper("ix") for _ in range(20)))
    plan = d.select(ex.index_matches(long, ("ACGTACGT", "AAAAAAAA", "CCGT"), 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("upper(") <= 60
    assert [r[0] for r in d.select(ex.index_matches(F.col("ix"), ("ACGTACGT",), 2)).collect()] == [True, True, False, True, True]
