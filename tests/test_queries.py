"""Every registered query of the read operators against DuckDB, and none of it needs the text subpackage."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandflow.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


#: Empty over so few reads; compared on larger tables.
FEW_READS = {"overrep_counts", "overrep_places", "overrep_candidates", "detect_adapter"}


def tidy(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    found = con.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(map(tidy, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in cols) for r in got.collect()), key=repr) == want
    assert want or name in FEW_READS, "nothing was compared"


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_matter(spark, sf):
    from strandflow.operators import pipeline as run
    from strandflow.plans.fixture import pairs
    from strandflow.plans.options import Options

    d = pairs(spark, sf).withColumnRenamed("pair_id", "read_id")
    o = Options(paired=True, correction=True, poly_g=True, cut_tail=(4, 20), merge=False, failed_out="f")
    a, b = ([tuple(r) for r in run.routes(run.process(d.repartition(n), o), o).orderBy("read_id", "mate").collect()] for n in (1, 5))
    assert a == b
    done = run.process(d, o)
    assert sum(r.reads for r in run.filter_counts(done, o).collect()) == 2 * d.count()
