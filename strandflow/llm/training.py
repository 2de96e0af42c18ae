"""Bounded samples of labelled rows for the classifiers of this subpackage, and the numpy optimiser they share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.llm.common import discard, id_text, settle

#: Rows of a sample over all labels, where there are so many labels that per_class would give more.
MOST_ROWS = 20_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds; a null doc_id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame | None, held_out: Column, per_class: int, total_bytes: int) -> tuple[list[tuple[str, object]], dict]:
    """(text, label) of at most per_class rows of each label, and at most total_bytes / labels of text for each; and
    how many ids of each label there are. A text that does not fit in what is left of its label's bytes is passed
    over; only where all texts of a label are longer than its bytes the shortest is taken, so that none goes missing.
    Of more than MOST_ROWS / per_class labels each has MOST_ROWS / labels rows at most.

    labels: doc_id and label; if it is None docs has the column label. held_out is over doc_id. Rows are taken in the
    order of a hash of doc_id, so the sample does not depend on how the tables are stored. Null labels, null ids and
    held-out rows are never taken. Rows of one id count once, by the text of the least hash; an id with different
    labels is left out. Only ids, lengths and hashes are shuffled; texts are read for the ids chosen, whose number is bounded.
    """
    own = [] if labels is not None else [F.col("label").alias("label")]
    ids = id_text(docs, *(["label"] if own else [])).where(F.col("doc_id").isNotNull() & ~held_out)
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))).alias("of")
    both = [F.min("label").alias("label"), F.max("label").alias("other")]
    if labels is None:
        rows = ids.groupBy("doc_id").agg(least, *both).where("label = other")
    else:
        known = labels.select("doc_id", "label").where("doc_id is not null").groupBy("doc_id").agg(*both).where("label = other").drop("other")
        rows = ids.groupBy("doc_id").agg(least).join(known, "doc_id")
    rows = settle(rows.select("doc_id", "label", "of.h", "of.n", F.xxhash64("doc_id").alias("turn")))
    found = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("n", "turn", "doc_id", "h")).alias("short")).collect()
    there = {r.label: r.n for r in found}
    if not there:
        return [], there
    most, room = max(1, min(per_class, MOST_ROWS // len(there))), total_bytes // len(there)
    # The first of each label are found in parts of it before they meet, in two steps, so that a task sorts few of a label's rows.
    parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = lambda *c: F.row_number().over(Window.partitionBy("label", *c).orderBy("turn", "doc_id"))
    first = rows.where(F.col("n") <= room)
    for n in (parts, math.isqrt(parts)):
        first = first.withColumn("at", by(F.pmod("turn", F.lit(n)))).where(F.col("at") <= most)
    first = first.withColumn("at", by()).where(F.col("at") <= most).select("doc_id", "label", "h", "n", "turn").collect()
    fitting: dict = {}
    for r in sorted(first, key=lambda r: (r.turn, r.doc_id)):
        fitting.setdefault(r.label, []).append(r)
    chosen: list[tuple[int, int, object]] = []
    for r in sorted(found, key=lambda r: str(r.label)):
        left = room
        for x in fitting.get(r.label, []):
            if x.n <= left:
                left -= x.n
                chosen.append((x.doc_id, x.h, r.label))
        if r.label not in fitting:
            chosen.append((r.short.doc_id, r.short.h, r.label))
    # From an Arrow table: a list of rows goes through Python workers of another kind, which executors keep beside those of the operators.
    wanted = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([i for i, _, _ in chosen], pa.int64()), "h": pa.array([h for _, h, _ in chosen], pa.int64())}))
    own_rows = id_text(docs).withColumn("h", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "h"], "left_semi")
    texts = {r.doc_id: r.text for r in own_rows.groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    discard(rows)
    return [(texts[i], kind) for i, _, kind in chosen], there


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))


class Adam:
    """Adaptive steps over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step_no = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.step_no += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            m = self.mean[k] / (1 - 0.9**self.step_no)
            v = self.square[k] / (1 - 0.999**self.step_no)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def weights(labels: np.ndarray, there: dict | None) -> np.ndarray:
    """What each row of a sample stands for, so that 0 and 1 have the shares they have among all labelled rows; the mean is 1."""
    out = np.ones(len(labels))
    for y in (0, 1):
        if there and (labels == y).any():
            out[labels == y] = there.get(y, 0) / (labels == y).sum()
    return out / out.mean()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights (the last is the constant) of logistic regression with an L2 penalty, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty * len(x) / 10 + 1e-3)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
