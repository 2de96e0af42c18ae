import random

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import order_minhash as om
from strandflow.llm.words import Words


def texts_of_one_passage():
    """400 texts that share two thirds of their words, and near copies of every third."""
    rnd = random.Random(11)
    vocab = [f"v{i}" for i in range(50_000)]
    passage, rows = rnd.sample(vocab, 80), []
    for i in range(400):
        own = rnd.sample(vocab, 40)
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            own[rnd.randrange(40)] = "other"
            rows.append((2 * i + 1, " ".join(passage + own)))
    return rows


def test_pairs_of_a_large_bucket_need_no_second_sketch(spark):
    """With one sketch a document no pair shares a second, whatever the size from which on buckets count as large."""
    docs = spark.createDataFrame(texts_of_one_passage(), "doc_id long, text string")
    classes = lambda **how: {r.doc_id: r.class_id for r in om.near_classes(docs, om.Sketching(tables=1, **how)).collect()}
    whole = classes(refine=1 << 40)
    assert sum(c == d - 1 for d, c in whole.items()) > 100
    assert classes(refine=16, block=8) == whole


def test_the_pipelines_stage_drops_copies_from_large_buckets(spark):
    """Of each two near copies with one sketch the second goes, and nothing else: texts of different own words are no copies."""
    rows, how = texts_of_one_passage(), om.Sketching(tables=1, refine=16, block=8)
    marks = [om.labelled(x) for x in om.shingles(Words(pa.array([t for _, t in rows])), how.shingle)]
    sketch = {d: om.sketch(x, how)[0] for (d, _), x in zip(rows, marks, strict=True)}
    gone = {d for d, _ in rows if d % 2 and sketch[d] == sketch[d - 1]}
    kept = om.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
    assert len(gone) > 100 and {r.doc_id for r in kept} == {d for d, _ in rows} - gone


@pytest.mark.parametrize("n", [1, 9, 150])
def test_signatures_of_many_pairs_agree_with_those_of_one(n):
    rnd = np.random.default_rng(n)
    base = rnd.integers(0, 1 << 62, 300, dtype=np.uint64)
    own = [np.where(rnd.random(300) < rnd.random() / 3, rnd.integers(0, 1 << 62, 300, dtype=np.uint64), base)[: rnd.integers(5, 300)] for _ in range(n)]
    sig = np.stack([np.frombuffer(om.signature(om.mix(x)), np.uint8) for x in own])
    t = om.Sketching().similarity
    assert np.array_equal(om.likely_pairs(sig, t), om.likely(sig[:, None], sig[None, :], t))
