import random

import numpy as np
import pyarrow as pa

from strandflow.llm import phrase_dedup
from strandflow.llm.words import Words


def test_occurrences_come_from_passages_alone():
    rnd = random.Random(2)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"a{i}" for i in range(9)] + passage[3:45] + ["z"]), " ".join(passage[:34]), " ".join([*passage, *passage]), "", " ".join(rnd.choice(passage) for _ in range(400))]
    scan = phrase_dedup.Scan(pa.array(texts), 35, 12)
    found = list(phrase_dedup.occurrences(scan, Words(pa.array([" ".join(passage)])), np.array([20]), 12))
    spans = sorted((int(a), int(b)) for x, y in found for a, b in zip(x, y, strict=True))
    first = scan.words.first
    assert spans == [(9, 51), (int(first[2]), int(first[2]) + 50), (int(first[2]) + 50, int(first[2]) + 100)]


def test_stretches_are_packed_and_read_again():
    scan = phrase_dedup.Scan(pa.array(["  one two\tthree four ", "five", "six séven eight"]), 2, 1)
    text, line = phrase_dedup.texts_of(scan.words, np.array([0, 1, 5]), np.array([2, 4, 8]))
    lines, counts = phrase_dedup.lines_of(phrase_dedup.packed(text, line[[0, 2, 2, 3]]))
    assert lines.to_pylist() == ["one two\n", "two three four\n", "six séven eight\n"] and counts.tolist() == [2, 0, 1]


def test_a_row_that_would_fill_a_shard_is_counted_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    once = " ".join(f"o{i}" for i in range(40))
    rows = [(7, text)] * 3000 + [(8, once), (9, None), (10, once + " " + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = phrase_dedup.remove_repeats(docs, shard_bytes=2000).groupBy("doc_id", "n_words", "n_removed", "text").count().collect()
    assert sorted(tuple(r) for r in out) == [(7, 40, 40, "", 3000), (8, 40, 40, "", 1), (9, 0, 0, "", 1), (10, 80, 80, "", 1)]
    single = docs.where("doc_id < 9")
    out = {(r.doc_id, r.n_removed, r["count"]) for r in phrase_dedup.remove_repeats(single, shard_bytes=2000).groupBy("doc_id", "n_removed").count().collect()}
    assert out == {(7, 40, 3000), (8, 0, 1)}
    kept = phrase_dedup.clean(single.selectExpr("doc_id", "text", "'en' as lang", "length(text) as n_chars"), shard_bytes=2000)
    assert kept.where("doc_id = 7 and text = '' and n_chars = 0 and lang = 'en'").count() == 3000 and kept.count() == 3001
