from strandflow.llm import order_minhash as om


def text(first, last=60):
    return " ".join(f"w{first + i}" for i in range(last))


ROWS = [
    (1, text(0)), (None, text(0) + " more"),  # near, and one has no id
    (None, text(1000)), (None, text(2000)),  # like nothing else
    (5, text(3000)), (5, text(4000)), (6, text(4000) + " more"),  # an id of two texts, 6 is near to one of them
    (8, text(5000)), (8, text(5000) + " more"),  # an id of two texts that are near
]


def test_rows_go_by_id_and_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    left = {(r.doc_id, r.text) for r in om.keep_one(docs).collect()}
    assert left - {(8, text(5000)), (8, text(5000) + " more")} == {ROWS[i] for i in (0, 2, 3, 4, 5)}
    assert len(left) == 6
    out = om.near_classes(docs).collect()
    assert sorted(r.class_size for r in out if r.doc_id == 5) == [1, 2] and [r.class_size for r in out if r.doc_id == 6] == [2]
    assert sum(r.kept for r in out) == 6 and len(out) == len(ROWS)
