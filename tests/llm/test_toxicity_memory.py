import random
import tracemalloc

import numpy as np
import pyarrow as pa

from strandflow.llm import toxicity
from strandflow.llm.common import SLICE_BYTES

RND = random.Random(4)
VOCAB = ["".join(RND.choices("abcdefghijklmnopqrstuvwxyz", k=RND.randint(2, 9))) for _ in range(90_000)] + ["l" * 40]


def small_model():
    rows = [(" ".join(RND.sample(VOCAB, 30) + ["vile"] * (i % 2)), i % 2) for i in range(40)]
    return toxicity.train(rows, setup=toxicity.Setup(epochs=1))


def test_scoring_a_slice_of_different_words_takes_bounded_memory():
    """A slice of the size that workers get, most of whose words occur a few times: n-grams of all its words at once took over 100 MB."""
    model, texts, size = small_model(), [], 0
    while size < SLICE_BYTES:
        texts.append(" ".join(RND.choices(VOCAB, k=300)))
        size += len(texts[-1])
    column = pa.array(texts)
    model.scores(column[:2])  # makes the model's tables
    tracemalloc.start()
    scores = model.scores(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scores) == len(texts) and peak < 70 << 20


def test_words_are_spelt_alike_whatever_number_is_read_at_once():
    column = pa.array([" ".join(RND.sample(VOCAB, 200) + VOCAB[-1:]), "", "A, 'b' -- " + "é" * 30])
    v, model = toxicity.Vocabulary(column, (3, 6)), small_model()
    for at_once in (1, 7, 1 << 13):
        parts = list(v.spellings(at_once))
        for c in ("size", "core", "word"):
            assert np.array_equal(np.concatenate([getattr(p, c) for p in parts]), getattr(v, c))
        assert np.array_equal(np.concatenate([model.evidence.inputs(p) for p in parts]), model.evidence.inputs(v))
