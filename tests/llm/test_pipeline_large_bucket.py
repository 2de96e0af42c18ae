import random

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from strandflow.llm import order_minhash as om
from strandflow.llm.words import Words, constants
from strandflow.plans import session

HOW = om.Sketching()


def marks(words):
    return om.labelled(om.shingles(Words(pa.array([" ".join(words)])), HOW.shingle)[0])


def passage(rnd):
    """Four shingles that are the least of any text in the first table's order."""
    stream = [f"p{rnd.randrange(10**9)}" for _ in range(300_000)]
    rank = marks(stream) * constants(HOW.tables, 21)[0]
    return [w for at in rank.argsort()[:4].tolist() for w in stream[at : at + HOW.shingle]]


def pair(rnd, head):
    """A text and a near copy of it that share the first sketch only: words of the others' shingles are changed."""
    text = head + [f"b{rnd.randrange(10**9)}" for _ in range(480)]
    places = om.least(marks(text), constants(HOW.tables, 21), HOW.sample).tolist()
    left, changed = dict(enumerate(map(set, places[1:]), 1)), []
    while left:
        free = [w for w in range(len(head) + 4, len(text) - 4) if all(abs(w - c) >= 5 for c in changed)]
        best = max(free, key=lambda w: sum(not s.isdisjoint(range(w - 4, w + 1)) for s in left.values()))
        changed.append(best)
        left = {t: s for t, s in left.items() if s.isdisjoint(range(best - 4, best + 1))}
    copy = [f"c{w}" if i in changed else w for i, w in enumerate(text)]
    return text, copy


@pytest.mark.parametrize("broadcast", [session.BROADCAST_BYTES, 0])
def test_a_bucket_over_every_limit_loses_no_copy(spark, monkeypatch, broadcast):
    """Over 4,096 texts of one sketch, by the stage itself: of two that share no other sketch the second goes, and nothing else."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    rnd = random.Random(2)
    head = passage(rnd)
    two = pair(rnd, head)
    rows = [head + [f"f{rnd.randrange(10**9)}" for _ in range(30)] for _ in range(4498)]
    rows[3000:3000], rows[4000:4000] = two[:1], two[1:]
    first = [int(om.sketch(marks(r), HOW)[0]) for r in rows]
    a, b = (marks(w) for w in two)
    assert first.count(first[3000]) > HOW.refine and om.aligned(a, b, HOW.similarity)
    assert set(om.sketch(a, HOW).tolist()) & set(om.sketch(b, HOW).tolist()) == {first[3000]}
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert set(range(4500)) - kept == {4000} and len(kept) == 4499
