"""The audit of sources against a plain restatement in whole numbers."""

import re
import string
from collections import Counter, defaultdict

import pytest

from strandflow.llm import divergence, queries

from .helpers import ROWS, SCHEMA, fixture

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows, min_docs=10, top=10):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        groups = {s: counts[lg, s] for lg, s in counts if lg == lang}
        whole = sum(groups.values(), Counter())

        def parts(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: parts(c) for s, c in groups.items()}, parts(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


MANY = [
    *ROWS,
    *((100 + i, f"Das Wort {'abc'[i % 3]} im Ärger{i % 4} ÄRGER-{i} the_the x{'y' * (i % 5)} z", ("de", "en", None)[i % 3], ("a", "b", "", None, "ü")[i % 5]) for i in range(240)),
    *((400 + i, "one same text one", "en", "hot") for i in range(300)),
    (900, "alone", "xx", "a"), (901, None, "xx", "b"), (902, "?!", "de", "silent"),
]


@pytest.mark.parametrize("how", [{}, {"cells": 7, "dense": 11}, {"min_docs": 1, "top": 3}])
def test_against_a_restatement(spark, how):
    own = {k: v for k, v in how.items() if k in ("min_docs", "top")}
    assert found(divergence.audit(fixture(spark, MANY), **how)) == expected(MANY, **own)


def test_query_and_no_rows(spark, tmp_path):
    fixture(spark, MANY).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.QUERIES["op13_source_divergence"](spark, str(tmp_path))) == expected(MANY)
    assert found(divergence.audit(spark.createDataFrame([], SCHEMA))) == []


def test_words_at_edges_of_texts():
    import pyarrow as pa

    texts = ["ab", "cd", "", " Ef g", "Ünï", "漢字-ß", "x"]
    row, term = divergence.words_of(pa.array(texts))
    assert list(zip(row.tolist(), term.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.translate(LOWER))]


def test_products_beyond_64_bits(spark):
    """A count of 4 * 10**10 times 10**9 does not fit in 64 bits."""
    cells = [("en", s, t, n, 20) for s, t, n in (("a", "x", 4 * 10**10), ("a", "y", 5), ("b", "x", 7), ("b", "y", 3 * 10**10))]
    counted = spark.createDataFrame(cells, "lang string, source string, term string, n long, docs long")
    groups = spark.createDataFrame([("en", "a", 1), ("en", "b", 1)], "lang string, source string, rows long")
    from pyspark.sql import functions as F

    kept = divergence._keep(counted.withColumn("shard", F.lit(0)), 10)
    got = divergence._differences(kept, divergence._totals(groups, kept), 1, 10, 100).where("part = 'pair'").first().value
    n = {s: {t: m for _, o, t, m, _ in cells if o == s} for s in "ab"}
    p = {s: {t: 1 + 10**9 * (m + 2) // (sum(n[s].values()) + 4) for t, m in n[s].items()} for s in n}
    assert got == sum((p["a"][t] - p["b"][t]) ** 2 // (p["a"][t] + p["b"][t]) for t in "xy")
