"""Joins of keys that hold many rows, tables in the shared folder, and duplicates by them."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandflow.operators import dedup
from strandflow.operators.dedup import mark_duplicates
from strandflow.operators.single_steps import placed
from strandflow.plans import session


@pytest.mark.parametrize("broadcast", [1 << 30, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_joins_equal_plain_ones(spark, monkeypatch, broadcast, how):
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(session, "HOT_ROWS", 7)
    rows = [(i, i % 5 if i % 3 else 0) for i in range(300)] + [(1000, None), (1001, 77)]
    d = session.settle(spark.createDataFrame(rows, "id long, key long"))
    groups = session.settle(d.where("key < 5").groupBy("key").agg(F.count("*").alias("size"), F.max("id").alias("most")))
    got = session.salted_join(d, groups, "key", "size", ["id"], how=how)
    want = d.join(groups, "key", how)
    assert sorted(map(tuple, got.select("id", "key", "size", "most").collect()), key=repr) == sorted(map(tuple, want.select("id", "key", "size", "most").collect()), key=repr)
    if not broadcast:
        hot = d.join(groups.where("size > 7"), "key").count()
        assert "__salt" in got._jdf.queryExecution().toString() and hot > 0


def test_few_keys_are_hot_however_many_rows_there_are(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(session, "HOT_ROWS", 1)
    monkeypatch.setattr(session, "HOT_KEYS", 10)
    d = session.settle(spark.range(4000).selectExpr("id", "id % 400 as key"))
    groups = session.settle(d.groupBy("key").agg(F.count("*").alias("size")))
    assert session.salted_join(d, groups, "key", "size", ["id"]).count() == 4000  # 10 rows a key are fewer than 4000 / 10


def test_tables_are_written_to_the_shared_folder_and_removed(spark):
    d = session.settle(spark.range(5).toDF("x"))
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    path = d._settled.removeprefix("file:")
    assert os.path.realpath(path).startswith(os.path.realpath(base)) and d.count() == 5
    session.discard(d, spark.range(2))
    assert not os.path.exists(path)


@pytest.mark.parametrize("broadcast", [1 << 30, 0])
def test_duplicates_of_a_hot_key(spark, monkeypatch, broadcast):
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(session, "HOT_ROWS", 5)
    rows = [(i, "ACGT" if i % 3 else f"{'ACGT' * 3}{'ACGTN'[i % 5]}{i // 30 * 'A'}") for i in range(200)]
    out = {r.read_id: r.is_dup for r in mark_duplicates(spark.createDataFrame(rows, "read_id long, seq string"), ["seq"]).collect()}
    seen: set[str] = set()
    for i, s in rows:
        assert out[i] == (s in seen)
        seen.add(s)


@pytest.mark.parametrize("marks", [64 << 20, 0])
def test_reads_are_not_shuffled_for_many_duplicates(spark, monkeypatch, marks):
    """Only digests, ids and marks are: of keys of two reads, of more, of ids around 0 and far apart, and of samples that number reads alike, one without a name."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dedup, "MARKS_BROADCAST", marks)
    ids = [-130, -65, -64, -1, 0, 1, 62, 63, 64, 1 << 40, (1 << 40) + 63]
    rows = [(s, i, "ACGT"[j % 4] * (1 + j % n), "I") for s, n in (("a", 1), ("b", 3), (None, 2)) for j, i in enumerate(ids)] + [("a", 5, None, "I")]
    d = session.settle(spark.createDataFrame(rows, "sample string, read_id long, seq string, qual string"))
    out = mark_duplicates(d, ["seq"])
    assert out.columns == [*d.columns, "is_dup"]
    firsts: dict = {}
    for s, i, q, _ in sorted(rows, key=lambda r: r[1]):
        firsts.setdefault((s, q), i)
    want = {(s, i): q is not None and i > firsts[s, q] for s, i, q, _ in rows}
    assert {(r.sample, r.read_id): r.is_dup for r in out.collect()} == want and sum(want.values()) > 10
    if marks:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_places_are_numbered_over_ranges(spark):
    d = spark.range(0, 3000, 3).repartition(7).toDF("read_id")
    out, n = placed(d)
    assert n == 1000 and all(r.place == r.read_id // 3 for r in out.collect())
    none, n = placed(d.limit(0))
    assert n == 0 and none.count() == 0


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)
