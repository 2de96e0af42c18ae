import numpy as np
import pyarrow as pa

from strandflow.llm import toxicity


def test_all_bytes_of_long_words_are_read():
    for n in (1, 31, 32, 33, 57, 58, 59, 60, 85, 200):
        text = "".join(chr(97 + i * i % 23) for i in range(n))
        v = toxicity.Vocabulary(pa.array(["x y", text, "", text + " z"]), (3, 6))
        assert np.diff(v.first).tolist() == [2, k := 1 + max(0, -(-(n - 32) // 26)), 0, k + 1]
        seen = v.buckets(np.unique(v.ids[v.first[1] : v.first[2]]))
        for size in range(3, 7):  # n-grams within a word of at most 32 bytes are read as such
            for i in range(n - size + 1):
                inner = toxicity.Vocabulary(pa.array([text[max(0, i - 5) : i + size + 5]]), (size, size))
                at = i - max(0, i - 5) + 1  # behind the mark of the word's beginning
                assert inner.grams[0][0, at] in seen


def test_toxic_terms_in_long_words_are_found():
    rnd = np.random.default_rng(3)
    vocab = [f"{a}{b}" for a in ("lo", "ra", "mi", "ten", "sor") for b in ("ka", "ve", "du", "pil", "nor", "ast")]
    rows = []
    for i in range(500):
        ws = [vocab[k] for k in rnd.integers(0, len(vocab), rnd.integers(5, 100))]
        for _ in range(3 * (i % 4 == 0)):
            ws.insert(int(rnd.integers(0, len(ws))), "grux" + ("ka", "ve", "ix", "om")[int(rnd.integers(0, 4))])
        rows.append((" ".join(ws), int(i % 4 == 0)))
    model = toxicity.train(rows)
    for joint in ("_", "-", "/", " "):
        plain = joint.join(vocab * 4)
        a, b = model.scores(pa.array([plain, joint.join([plain, "gruxom", "gruxix", "gruxka"])]))
        assert a < 0.5 < b, joint
