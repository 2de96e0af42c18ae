"""Bit filters: merging in any order, places and bits alike, and the measured error of the levels."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from strandflow.operators import bit_filter as bf
from strandflow.operators.dedup import duplicate_counts
from strandflow.plans import report
from strandflow.plans.fixture import pairs
from strandflow.plans.options import Options


@pytest.mark.parametrize("size", (64, 1024))
def test_merging_is_a_union(size):
    rnd = np.random.default_rng(3)
    for _ in range(30):
        lots = [rnd.integers(0, size, rnd.integers(0, size)).astype(np.uint32) for _ in range(5)]
        merged = bf.Filter(size)
        for i in rnd.permutation(5):
            f = bf.Filter(size)
            for half in np.array_split(lots[i], 2):
                f.add(half)
            merged.take(f.reads, f.sent())
        want = len(np.unique(np.concatenate(lots)))
        assert merged.reads == sum(map(len, lots))
        sent = merged.sent()
        assert want > bf.FULL * size * 0.99 if sent is None else bf._ones(sent) == want


def test_a_full_filter_stays_given_up():
    full, few = bf.Filter(64), bf.Filter(64)
    full.add(np.arange(200, dtype=np.uint32) % 64)
    few.add(np.arange(3, dtype=np.uint32))
    assert full.sent() is None
    few.take(full.reads, full.sent())
    assert few.sent() is None and few.reads == 203


@pytest.mark.parametrize("level, error", ((1, 0.005), (6, 0.001)))
def test_levels_against_the_exact_share(spark, level, error):
    rnd = random.Random(level)
    rows = []
    for s, n, keys in (("a", 6000, 2500), ("b", 500, 500), ("c", 800, 1)):
        rows += [(s, f"{rnd.randrange(keys):b}".replace("0", "A").replace("1", "C") if keys < n else f"{i:b}".replace("0", "G").replace("1", "T")) for i in range(n)]
    d = spark.createDataFrame(rows, "sample string, seq string")
    for parts in (1, 40):  # 40: two rounds of merging
        got = bf.approximate_rates(d.repartition(parts), ["seq"], level)
        want = {r["sample"]: r.rate for r in duplicate_counts(d, ["seq"]).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < error for s in want)


def test_small_filters_reach_higher_scales(spark, sf):
    d = pairs(spark, sf)
    rows = bf.filters(d.repartition(7), ["seq1", "seq2"], 8).collect()
    again = bf.filters(d.repartition(30), ["seq1", "seq2"], 8).collect()
    r, rate = bf.used(rows, 8)
    assert r.scale > 0 and bf.used(again, 8) == (r, rate)
    exact = duplicate_counts(d, ["seq1", "seq2"]).first().rate
    assert abs(rate - exact) < 0.2  # 256 bits
    assert bf.used([], 8) == (None, 0.0) and bf.used([SimpleNamespace(scale=0, ones=None, reads=9)], 8) == (None, 0.0)
    assert bf.approximate_rates(d.where("pair_id < 0"), ["seq1"], 1) == {}


def test_reports_of_a_level(spark, sf):
    from strandflow.operators import pipeline as run

    d = pairs(spark, sf).withColumnRenamed("pair_id", "read_id")
    exact = duplicate_counts(d, ["seq1", "seq2"]).first().rate
    rates = {}
    for level in (0, 2):
        o = Options(paired=True, dup_calc_accuracy=level).validated()
        done = run.process(d, o)
        rates[level] = report.build(d, done, o)["duplication"]["rate"]
    assert rates[0] == exact and abs(rates[2] - exact) < 0.002
    o = Options(paired=True, dup_calc_accuracy=2, dedup=True).validated()  # what is removed is found exactly
    assert run.process(d, o).where("is_dup").count() == round(exact * d.count())
    with pytest.raises(ValueError):
        Options(dup_calc_accuracy=7).validated()
