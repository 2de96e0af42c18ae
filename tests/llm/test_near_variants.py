import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import order_minhash as om
from strandflow.llm.words import Words


def variants(seed, n, length, most):
    """n texts of one base of `length` words, in each of which up to `most` words are others."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(100_000)]
    base, rows = rnd.sample(vocab, length), []
    for k in range(n):
        text = list(base)
        for at in rnd.sample(range(length), rnd.randint(0, most)):
            text[at] = rnd.choice(vocab)
        rows.append((k, " ".join(text)))
    return rows


def classes_by_all_pairs(rows):
    """The least id of each row's class, from all pairs; ids are 0, 1, 2 and so on."""
    seqs, up, t = om.shingles(Words(pa.array([t for _, t in rows])), 5), list(range(len(rows))), Fraction(4, 5)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = find(i), find(j)
            if a != b and 9 * len(np.intersect1d(seqs[i], seqs[j])) >= 4 * (len(seqs[i]) + len(seqs[j])) and om.aligned(seqs[i], seqs[j], t):
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def near(spark, rows, how=om.Sketching()):
    got = {r.doc_id: r.class_id for r in om.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
    return [got[i] for i in range(len(rows))]


def test_pairs_not_compared_in_an_earlier_bucket_are_compared_later(spark):
    rows = variants(1, 300, 64, 6)
    assert near(spark, rows) == classes_by_all_pairs(rows)


def with_neighbours(seed, n, pairs, length):
    """n near copies of one base, and pairs of a member of their class and a text that is near to it only."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(100_000)]
    base, texts = rnd.sample(vocab, length), []

    def edited(text, first, last, times):
        text = list(text)
        for at in rnd.sample(range(first, last), times):
            text[at] = rnd.choice(vocab)
        return text

    for _ in range(n):
        texts.append(edited(base, 0, length // 2, 1))
    for _ in range(pairs):
        texts.append(edited(base, 0, length // 2, length // 50))
        texts.append(edited(texts[-1], length // 2, length, length // 50))
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("how", [om.Sketching(), om.Sketching(block=30)])
def test_members_of_the_leaders_class_are_compared_with_the_rest_of_a_bucket(spark, how):
    rows = with_neighbours(1, 200, 60, 100)
    assert near(spark, rows, how) == classes_by_all_pairs(rows)
