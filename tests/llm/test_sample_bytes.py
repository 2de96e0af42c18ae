import pyspark.sql.functions as F

from strandflow.llm import training


def drawn(spark, lengths, per_class, total):
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "doc_id long, text string").withColumn("turn", F.xxhash64("doc_id"))
    docs = rows.withColumn("label", F.lit(1))
    return [len(t) for t, _ in training.sample(docs, docs.select("doc_id", "label"), F.lit(False), per_class, total)[0]]


def test_long_texts_are_passed_over(spark):
    order = [r.id for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    for place in (0, 3):
        lengths = [10] * 40
        lengths[order[place]] = 100_000
        assert drawn(spark, lengths, 20, 1000) == [10] * 20
    lengths = [10] * 40
    for place in range(4):
        lengths[order[place]] = 400  # of four two fit, and what is left serves the others
    got = drawn(spark, lengths, 40, 1000)
    assert got[:2] == [400, 400] and got[2:] == [10] * 20
    assert drawn(spark, [5000, 4000, 6000], 20, 1000) == [4000]
