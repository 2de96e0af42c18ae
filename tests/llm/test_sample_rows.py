import pyspark.sql.functions as F
import pytest

from strandflow.llm import langid, quality_model, toxicity, training


@pytest.mark.parametrize("per_class", [50, 200, 1200])
def test_an_id_that_repeats_often_counts_once(spark, per_class):
    rows = [(i, f"text number {i}") for i in range(400)] + [(184, "text number 184")] * 5000 + [(185, "another text")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(186, 0)] * 900 + [(187, 0), (188, None)], "doc_id long, label int")
    got, there = training.sample(docs, labels, F.lit(False), per_class, 1 << 20)
    assert there == {0: 200, 1: 199}  # 187 has two labels
    ids = [t for t, _ in got]
    assert len(ids) == len(set(ids)) == sum(min(n, per_class) for n in there.values())
    assert all(int(t.split()[-1]) % 2 == y for t, y in got if t.startswith("text number"))
    again, _ = training.sample(docs.repartition(3), labels, F.lit(False), per_class, 1 << 20)
    assert sorted(got) == sorted(again)


def test_models_learn_from_tables_with_repeated_rows(spark):
    rows = [(i, f"{'bad words here' if i % 2 else 'good and fine'} {i}", "xx" if i % 2 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[7]] * 3000, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert langid.predict_documents(docs, langid.fit(docs)).where("lang_pred = 'xx'").count() == 3030
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).count() == 3060
    assert quality_model.score_documents(docs, quality_model.fit(docs, labels)).count() == 3060


def test_many_labels_share_the_rows(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 100) as label")
    got, there = training.sample(docs, None, F.lit(False), 3, 1 << 20)
    assert len(there) == 100 and len(got) == 300
