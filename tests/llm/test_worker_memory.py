import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import functions as F

from strandflow.llm import bpe, packing, phrase_dedup, training
from strandflow.llm.common import table
from strandflow.llm.queries import ENGLISH
from strandflow.llm.words import Words


def test_packing_leaves_no_entries_in_the_caches_of_workers(spark, sf):
    """Workers live on after the stage; half a million pre-tokens kept 75 MB in each."""
    ranks = bpe.tokenizer_file(ENGLISH)
    assert packing.pieces(table(spark, sf, "documents").repartition(4), ranks).count() > 0

    def kept(batches):
        for batch in batches:
            loaded = bpe.encoder.cache_info().currsize
            yield pa.RecordBatch.from_pydict({"loaded": [loaded], "entries": [len(bpe.encoder(ranks)) if loaded else 0]})

    found = spark.range(0, 8, 1, 8).mapInArrow(kept, "loaded long, entries long").collect()
    assert any(r.loaded for r in found) and not any(r.entries for r in found)


def test_samples_start_no_python_workers_for_the_chosen_ids(spark, sf, monkeypatch):
    """Rows of a Python list are read by workers of another kind, beside those of the operators: 84 MB of an executor."""
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **k: (_ for _ in ()).throw(AssertionError("rows from a list")))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows, there = training.sample(docs, training.labels_of(labels, "toxic"), training.fold(F.col("doc_id"), 5) == 0, 20, 1 << 20)
    assert set(there) == {0, 1} and {y for _, y in rows} == {0, 1} and all(isinstance(t, str) for t, _ in rows)


def test_locating_reads_words_without_anchors():
    """The automata say where passages stand, so that a shard's phrases, windows and anchors need not be held while they run."""
    column = pa.array([" ".join(f"w{i % 700}" for i in range(5000))] * 8)
    held = {}
    for anchors in (True, False):
        tracemalloc.start()
        scan = phrase_dedup.Scan(column, 35, 8, anchors)
        held[anchors] = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        spans = [(a.tolist(), b.tolist()) for a, b in phrase_dedup.occurrences(scan, Words(pa.array([" ".join(f"w{i}" for i in range(60))])), np.array([20]), 8)]
        assert len(spans[0][0]) == 64 and (anchors or spans == before)
        before = spans
    assert held[False] < 0.7 * held[True]
