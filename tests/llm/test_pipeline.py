import pyspark.sql.functions as F

import corpus_pipeline as cp
from strandflow.llm import bpe, exact_dedup, order_minhash, phrase_dedup, queries, toxicity
from strandflow.llm.common import settle
from tests.llm.helpers import ROWS, fixture
from tests.llm.test_near_and_phrases import classes_restated, removed_restated


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def test_stages_by_a_restatement(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = [docs]
    for _, stage in cp.STAGES:
        steps.append(settle(stage(spark, steps[-1], sf)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_documents(docs, model).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - bad
    best = {}
    for i, r in rows[1].items():
        best[low(r.text)] = max(i, best.get(low(r.text), i))
    assert set(rows[2]) == set(best.values())
    classes = classes_restated([(i, rows[2][i].text) for i in sorted(rows[2])])
    assert set(rows[3]) == {c for _, c in classes}
    left = list(rows[3].values())
    for r, (_, k, text) in zip(left, removed_restated([r.text for r in left], 35), strict=True):
        now = rows[4][r.doc_id]
        assert now.text == (text if k else r.text) and now.n_chars == len(now.text) and (now.lang, now.source) == (r.lang, r.source)
    packed = steps[-1].collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    enc = bpe.encoder(bpe.tokenizer_file(queries.ENGLISH))
    assert sum(r.length for r in packed) == sum(len(enc.encode(r.text)) // 4 + 1 for r in rows[4].values())
    again = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in cp.run(spark, sf).collect())
    assert again == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_filters_keep_rows_whole(spark):
    docs = fixture(spark).withColumn("__gone_", F.lit(1))
    one = exact_dedup.keep_one(docs).collect()
    assert len(one) == len({low(t) for _, t, *_ in ROWS}) and all(len(r) == len(docs.columns) for r in one)
    assert {r.doc_id for r in one if low(r.text).startswith("same")} >= {5}
    assert order_minhash.keep_one(docs).columns == docs.columns
    out = phrase_dedup.clean(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert {r.doc_id: r.text for r in out.collect()}[1] is None
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0 and phrase_dedup.clean(docs.limit(0)).count() == 0


def test_columns_of_any_name_pass_whole(spark):
    """Values of columns named as operators would name their own, or with a point, are those of the rows that stay."""
    names = ("__id", "__ID0", "__digest", "__text", "__hash", "__row", "__null", "__gone", "__of", "__stays", "__salt", "__copies", "stays", "of", "a.b")
    plain = fixture(spark).drop("digest", "k")
    docs = plain.select("*", *(F.concat_ws(":", F.lit(n), "doc_id", "text").alias(n) for n in names))
    for stage in (exact_dedup.keep_one, order_minhash.keep_one, phrase_dedup.clean):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == stage(plain).count() > 0
        given = {(i, n, ":".join([n, *(str(v) for v in (i, w) if v is not None)])) for i, w, *_ in ROWS for n in names}
        assert {(r.doc_id, n, r[n]) for r in rows for n in names} <= given


def test_toxic_filter_passes_all_columns(spark):
    docs, labels = fixture(spark), spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_stages_take_tables_that_became_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = settle(stage(spark, docs, sf))
        assert docs.count() == 0
        if k < len(cp.STAGES) - 1:
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
