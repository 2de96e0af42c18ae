import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from strandflow.llm import langid, quality_model, queries, toxicity, training
from tests.llm.helpers import ROWS, fixture

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_gradients_by_differences():
    setup = toxicity.Setup(hidden=3, attention=2, window=5)
    rnd = np.random.default_rng(0)
    net = toxicity.Network(4, setup)
    net.p = {k: v.astype(float) + 0.1 * rnd.standard_normal(v.shape) for k, v in net.p.items()}
    x, n = rnd.standard_normal((5, 3, 4)), np.array([5, 3, 1])
    mask = (np.arange(5)[:, None] < n)[:, :, None].astype(float)
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    _, g = net.gradients(x, mask, y, w)
    for k, v in net.p.items():
        for at in list(np.ndindex(v.shape))[::3]:
            old, d = v[at], 1e-5
            v[at] = old + d
            up = net.gradients(x, mask, y, w)[0]
            v[at] = old - d
            down = net.gradients(x, mask, y, w)[0]
            v[at] = old
            assert abs((up - down) / (2 * d) - g[k][at]) < 1e-6, (k, at)


def test_windows_cover_the_text():
    setup = toxicity.Setup()
    for n in range(0, 200):
        seen = {j for a in toxicity.window_starts(n, setup) for j in range(a, min(n, a + setup.window))}
        assert seen == set(range(n))
        assert all(b - a < setup.window for a, b in zip(toxicity.window_starts(n, setup), list(toxicity.window_starts(n, setup))[1:], strict=False))


@pytest.fixture(scope="module")
def toxic_rows():
    rnd = np.random.default_rng(3)
    vocab = [f"{a}{b}" for a in ("lo", "ra", "mi", "ten", "sor") for b in ("ka", "ve", "du", "pil", "nor", "ast")]
    bad = [f"grux{b}" for b in ("ka", "ve", "du", "pil", "nor", "ast", "ix", "om")]
    rows = []
    for i in range(700):
        ws = [vocab[k] for k in rnd.integers(0, len(vocab), rnd.integers(5, 300))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            ws.insert(int(rnd.integers(0, len(ws))), bad[int(rnd.integers(0, len(bad)))].capitalize() + "!")
        rows.append((" ".join(ws), y))
    return rows


def test_toxic_words_are_found_wherever_they_stand(toxic_rows):
    model = toxicity.train(toxic_rows[:500])
    got = model.scores(pa.array([t for t, _ in toxic_rows[500:]])) >= 0.5
    assert (got == np.array([y == 1 for _, y in toxic_rows[500:]])).mean() > 0.97
    long = "ten raka " * 4000
    a, b = model.scores(pa.array([long, long + "gruxom gruxix gruxka"]))
    assert a < 0.5 < b


def test_scores_do_not_depend_on_the_batch(toxic_rows):
    model = toxicity.train(toxic_rows[:200])
    texts = ["", "x", *(t for t, _ in toxic_rows[:20])]
    whole = model.scores(pa.array(texts))
    alone = np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert np.allclose(whole, alone, atol=1e-5) and np.isfinite(whole).all()


def test_without_both_labels():
    assert toxicity.train([]).scores(pa.array(["a"])).tolist() == [0.0]
    assert toxicity.train([("a", 1)]).scores(pa.array(["a", ""])).tolist() == [1.0, 1.0]
    v = np.zeros((1 << 14, 32), np.float32)
    assert quality_model.train([("a", 0)], v).scores(pa.array(["b"])).tolist() == [0.0]
    assert langid.train([]).predict(pa.array(["a"]))[0] == ["und"]
    assert langid.train([("a b", "xx")]).predict(pa.array(["a", "12 !", ""]))[0] == ["xx", "und", "und"]


def area(labels, scores):
    """The chance that a row of label 1 scores above one of label 0."""
    ones, zeros = (np.array([s for y, s in zip(labels, scores, strict=True) if y == k]) for k in (1, 0))
    return float(np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros)))


@pytest.mark.parametrize("name,column", [("op7_toxicity", "toxic"), ("op9_quality_classifier", "quality")])
def test_held_out_rows(spark, name, column):
    """Both labels are found among rows that nothing was learned from; the larger label alone would have a recall of 0 for the other."""
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, LARGER).collect()}
    folds, part = (5, 0) if column == "toxic" else (3, 1)
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (crc(i) % folds == part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(r[column], rows[r.doc_id]) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    recall = {y: np.mean([r.predicted == y for label, r in held if label == y]) for y in (0, 1)}
    assert min(recall.values()) >= 0.9, recall
    assert area([y for y, _ in held], [r.score for _, r in held]) >= 0.95, area([y for y, _ in held], [r.score for _, r in held])


def test_languages_are_told_apart(spark):
    rows = {r.doc_id: r for r in queries.op8_language_id(spark, SF).collect()}
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (crc(i) % 3 == 1) for i, r in rows.items())
    assert np.mean([a == b for a, b in held]) > 0.98


def test_families_join_the_nearest():
    x = np.eye(4)[[0, 1, 2, 3]] + np.array([[0, 0.5, 0, 0], [0.5, 0, 0, 0], [0, 0, 0, 0.5], [0, 0, 0.5, 0]])
    assert langid.families_of(x, np.array(["a", "b", "c", "d"], object), ["a", "b", "c", "d"]) == [["a", "b"], ["c", "d"]]


def test_awkward_rows(spark):
    docs, labels = fixture(spark), spark.createDataFrame([(i, i % 2, None if i == 4 else (i + 1) % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    for part in (docs, docs.limit(0)):
        n = part.count()
        model = toxicity.fit(part, labels)
        assert toxicity.score_documents(part, model).count() == n
        assert quality_model.score_documents(part, quality_model.fit(part, labels)).count() == n
        out = langid.predict_documents(part, langid.fit(part)).collect()
        assert len(out) == n and all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (1, 2, 3))


def test_word_vectors_add_up_over_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (quality_model.word_vectors(docs.repartition(n)) for n in (1, 7))
    assert np.array_equal(a, b) and a.any()
    setup = quality_model.Setup()
    index = quality_model.index_vectors(setup).astype(int)
    text = ["a b c a", "", "b"]
    bucket = {w: int(quality_model.bucket_of(quality_model.Words(pa.array([w])).hashes(), setup)[0]) for w in "abc"}
    want = np.zeros((1 << setup.bits, setup.size))
    for t in text:
        ws = t.split()
        for i, w in enumerate(ws):
            for j in range(max(0, i - 2), min(len(ws), i + 3)):
                if j != i:
                    want[bucket[w]] += index[bucket[ws[j]]]
    got = quality_model.word_vectors(spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string"))
    assert np.allclose(got, want / (np.linalg.norm(want, axis=1, keepdims=True) + 4))


def test_samples_leave_out_what_is_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    rows, there = training.sample(docs, labels, training.fold(F.col("doc_id"), 5) == 0, 40, 1 << 20)
    ids = [int(t.split()[1]) for t, _ in rows]
    assert len(rows) == 80 and all(crc(i) % 5 for i in ids) and sum(there.values()) == sum(crc(i) % 5 != 0 for i in range(300))
    assert all(i % 2 == y for i, (_, y) in zip(ids, rows, strict=True))
    few, _ = training.sample(docs, labels.withColumn("label", F.lit(1)), F.lit(False), 100, 2000)
    assert 1 <= len(few) < 10
    assert len(ROWS) > 10
