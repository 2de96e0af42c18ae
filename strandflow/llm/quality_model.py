"""Document quality from random-indexing word vectors and a two-layer network, in numpy.

Word vectors: every word falls into one of 2**bits buckets by its hash and has an index vector of a few +1 and
-1 that follows from the hash. A word's vector is the sum of the index vectors of the words up to `reach` places
before and after it, over the whole corpus: each task sums what it reads into one table of buckets, which it
sends in blocks; the blocks are added up by Spark and the table, whose size is fixed, goes to all tasks.

Documents: the vectors, shortened to length 1 at most (rare words to less), are pooled into their mean, spread and
products with their neighbours. A network of one hidden layer and one output is trained by Adam on part of a
bounded sample of labelled rows; on the other part its temperature is set, so that probabilities are calibrated.

Defined cases: null and empty texts have no vectors and pool to zeros, so they have a score too; without training
rows of both labels every score is the share of label 1 (0 without rows). Rows are scored by text alone, each by
itself. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import training
from strandflow.llm.common import batch_of, cut, id_text, map_batches, settle
from strandflow.llm.training import Adam, sigmoid
from strandflow.llm.words import Words, constants, mix

FOLDS, HELD_OUT = 3, 1
_BLOCKS, _WIDTH = 64, 64


@dataclass(frozen=True)
class Setup:
    bits: int = 14
    size: int = 32
    nonzero: int = 2
    reach: int = 2
    hidden: int = 24
    draw: float = 10.0
    per_class: int = 2500
    sample_bytes: int = 12 << 20
    epochs: int = 40
    seed: int = 29


def bucket_of(hashes: np.ndarray, setup: Setup) -> np.ndarray:
    return (hashes >> np.uint64(64 - setup.bits)).astype(np.int64)


def index_vectors(setup: Setup) -> np.ndarray:
    """The index vector of each bucket, of `nonzero` places and signs."""
    n = 1 << setup.bits
    out = np.zeros((n, setup.size), np.int8)
    for c in constants(setup.nonzero, setup.seed):
        h = mix(np.arange(n, dtype=np.uint64) * np.uint64(2) + c)
        out[np.arange(n), (h % np.uint64(setup.size)).astype(int)] = np.where(h >> np.uint64(63), 1, -1)
    return out


def contexts(column: pa.Array, setup: Setup, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The buckets' sums over one column, flat. places, signs: the index vectors' nonzero entries."""
    words = Words(column)
    bucket = bucket_of(words.hashes(), setup)
    row = np.repeat(np.arange(len(column)), words.counts)
    out = np.zeros((1 << setup.bits) * setup.size)
    for d in range(1, setup.reach + 1):
        same = row[d:] == row[:-d]
        a, b = bucket[:-d][same], bucket[d:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(places.shape[1]):
                out += np.bincount(x * setup.size + places[y, k], signs[y, k], minlength=len(out))
    return out


def word_vectors(docs: DataFrame, setup: Setup = Setup()) -> np.ndarray:
    """The table of word vectors (2**bits by size) of all documents."""
    index = index_vectors(setup)
    places = np.argsort(index == 0, axis=1, kind="stable")[:, : setup.nonzero]
    signs = np.take_along_axis(index, places, 1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << setup.bits) * setup.size)
        for batch in batches:
            for part in cut(batch):
                total += contexts(part.column("text"), setup, places, signs)
        blocks = total.reshape(_BLOCKS, -1).astype("<i8")
        yield batch_of(block=pa.array(range(_BLOCKS), pa.int32()), sums=pa.array([b.tobytes() for b in blocks], pa.binary()))

    parts = id_text(docs).select("text").mapInArrow(run, "block int, sums binary")

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((1 << setup.bits) * setup.size // _BLOCKS, np.int64)
        for b in t.column("sums").to_pylist():
            total += np.frombuffer(b, "<i8")
        return pa.table({"block": t.column("block")[:1], "lot": t.column("lot")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    # A tree of sums, as deep as there are tasks, so that no task adds the sums of more than _WIDTH others.
    lots = parts.rdd.getNumPartitions()
    parts = parts.withColumn("lot", F.spark_partition_id())
    while lots > 1:
        lots = -(-lots // _WIDTH)
        lot = F.expr(f"cast(lot div {_WIDTH} as int)")
        parts = parts.withColumn("lot", lot).groupBy("block", "lot").applyInArrow(add, "block int, lot int, sums binary")
    rows = settle(parts).collect()
    table = np.zeros((_BLOCKS, (1 << setup.bits) * setup.size // _BLOCKS))
    for r in rows:
        table[r.block] = np.frombuffer(r.sums, "<i8")
    table = table.reshape(-1, setup.size)
    return (table / (np.linalg.norm(table, axis=1, keepdims=True) + 4.0)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray, setup: Setup) -> np.ndarray:
    """Of each text's word vectors the mean and the spread, drawn to zero where there are few words, the mean's length,
    the mean product and the mean distance of neighbours, and the logarithm of the number of words."""
    words = Words(column)
    v = vectors[bucket_of(words.hashes(), setup)]
    n = words.counts
    out = np.zeros((len(column), 2 * setup.size + 4), np.float32)
    some = n > 0
    if not some.any():
        return out
    at, many = words.first[:-1][some], n[some][:, None]
    sums = lambda x: np.add.reduceat(x, at, axis=0)
    mean, square = sums(v) / many, sums(v * v) / many
    few = many / (many + setup.draw)
    after = np.zeros((len(v), 2), np.float32)
    row = np.repeat(np.arange(len(column)), n)
    same = row[1:] == row[:-1]
    after[1:, 0] = np.where(same, (v[1:] * v[:-1]).sum(axis=1), 0)
    after[1:, 1] = np.where(same, np.abs(v[1:] - v[:-1]).sum(axis=1), 0)
    out[some, : setup.size] = mean * few
    out[some, setup.size : 2 * setup.size] = np.sqrt(np.maximum(square - mean * mean, 0)) * few
    out[some, -4] = np.linalg.norm(mean, axis=1) * few[:, 0]
    out[some, -3:-1] = sums(after) / many * few
    out[some, -1] = np.log1p(n[some])
    return out


@dataclass
class Model:
    setup: Setup
    base: float
    vectors: np.ndarray | None = None
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    net: dict[str, np.ndarray] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.shift) / self.scale @ self.net["a"] + self.net["b"])
        return h @ self.net["c"] + self.net["d"][0]

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), self.base)
        return sigmoid(self.logits(pooled(column, self.vectors, self.setup)) / self.temperature)


def train(rows: list[tuple[str, int]], vectors: np.ndarray, there: dict | None = None, setup: Setup = Setup()) -> Model:
    """there: how many rows of each label the sample stands for; None if it is all of them."""
    y = np.array([int(v == 1) for _, v in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(setup, float(y.mean()) if len(y) else 0.0)
    # A few texts at a time: word vectors of the whole sample would fill the driver.
    x = np.concatenate([pooled(pa.array([t for t, _ in rows[a : a + 64]], pa.string()), vectors, setup) for a in range(0, len(rows), 64)])
    weight = training.weights(y, there)
    rnd = np.random.default_rng(setup.seed)
    order = rnd.permutation(len(y))
    held = np.zeros(len(y), bool)
    for v in (0, 1):  # a fifth of each label sets the temperature
        held[order[y[order] == v][: int((y == v).sum()) // 5]] = True
    fitted = np.flatnonzero(~held)
    model = Model(setup, float(y.mean()), vectors, x[fitted].mean(axis=0), x[fitted].std(axis=0) + 1e-3)
    net = {"a": rnd.standard_normal((x.shape[1], setup.hidden)) / math.sqrt(x.shape[1]), "b": np.zeros(setup.hidden), "c": rnd.standard_normal(setup.hidden) / math.sqrt(setup.hidden), "d": np.zeros(1)}
    model.net = net
    z = (x - model.shift) / model.scale
    opt = Adam(net, 0.01)
    for epoch in range(setup.epochs):
        opt.rate = 0.01 * (1 - epoch / setup.epochs) + 1e-4
        turn = rnd.permutation(fitted)
        for k in range(0, len(turn), 128):
            i = turn[k : k + 128]
            h = np.tanh(z[i] @ net["a"] + net["b"])
            g = weight[i] * (sigmoid(h @ net["c"] + net["d"][0]) - y[i]) / len(i)
            back = np.outer(g, net["c"]) * (1 - h * h)
            opt.step({"a": z[i].T @ back + 1e-4 * net["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * net["c"], "d": np.array([g.sum()])})
    if held.any() and len(set(y[held].tolist())) == 2:
        logit, target, w = model.logits(x[held]), y[held], weight[held]
        loss = lambda t: -float((w * (target * np.log(sigmoid(logit / t) + 1e-12) + (1 - target) * np.log(1 - sigmoid(logit / t) + 1e-12))).sum())
        model.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return model


def fit(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> Model:
    """Word vectors of all documents, and labels.quality learned from the rows that are not held out."""
    held_out = training.fold(F.col("doc_id"), FOLDS) == HELD_OUT
    taken, there = training.sample(docs, training.labels_of(labels, "quality"), held_out, setup.per_class, setup.sample_bytes)
    return train(taken, word_vectors(docs, setup), there, setup)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=batch.column("doc_id"), score=pa.array(model.scores(batch.column("text")), pa.float64()))

    out = map_batches(id_text(docs), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
