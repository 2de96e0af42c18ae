"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

A text is its bytes, letters lower-cased and all else as one blank, cut into n-grams of 1 to 4 bytes that are
counted into 2**bits buckets; counts become square roots of shares, of length 1. Families are found from the
training texts, by joining the languages with the nearest mean profiles. One machine for each pair of families,
and within a family one for each pair of its languages, decide by votes, ties by the sum of margins.

The machines are trained in numpy on at most `per_class` texts of each language and `sample_bytes` of text in
all, by averaged stochastic subgradients.

Defined cases: a text that is null or has no letter is `und`, with score 0; with one language learned, all other
texts are that language; with none, all are `und`. Ties in votes and margins go to the language that sorts first.
Null languages are never learned. Rows are predicted by text alone, each by itself. Columns besides doc_id and
text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import training
from strandflow.llm.common import batch_of, id_text, map_batches, utf8
from strandflow.llm.training import sigmoid

FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_BLANK = np.uint8(0x20)
#: Letters of ASCII and all bytes of longer sequences stay; other bytes are a blank.
_BYTE = np.full(256, _BLANK, np.uint8)
for _b in (*range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTE[_b] = _b


@dataclass(frozen=True)
class Setup:
    bits: int = 12
    grams: tuple[int, ...] = (1, 2, 3, 4)
    per_class: int = 800
    sample_bytes: int = 6 << 20
    epochs: int = 12
    penalty: float = 1e-4
    seed: int = 23


def profiles(column: pa.Array, setup: Setup) -> np.ndarray:
    """A row of 2**bits numbers for each text, of length 1 (0 for a text without letters)."""
    data, offsets = utf8(pc.utf8_lower(column))
    data = _BYTE[data]
    out = np.zeros((len(column), 1 << setup.bits), np.float32)
    # Runs of blanks count as one, and no n-gram reaches into the next text.
    fresh = np.ones(len(data), bool)
    fresh[1:] = (data[1:] != _BLANK) | (data[:-1] != _BLANK)
    kept = np.concatenate([[0], np.cumsum(fresh)])[offsets]
    data = data[fresh].astype(np.uint32)
    h, shift = np.zeros(len(data), np.uint32), np.uint32(32 - setup.bits)
    buckets = []
    for n in range(1, max(setup.grams) + 1):
        h = (h[: len(data) - n + 1] * np.uint32(0x01000193)) + data[n - 1 :] + np.uint32(1)
        if n in setup.grams:
            buckets.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32))
    for i, (a, b) in enumerate(zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)):
        for n, own in zip(setup.grams, buckets, strict=True):
            if b - a >= n:
                out[i] += np.bincount(own[a : b - n + 1], minlength=out.shape[1])
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def machine(x: np.ndarray, y: np.ndarray, setup: Setup) -> np.ndarray:
    """A linear support vector machine (the last weight is the constant); y is 1 or -1. Classes weigh the same."""
    rnd = np.random.default_rng(setup.seed)
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-6), 0.5 / max((y < 0).mean(), 1e-6))
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    mean, mean_bias, steps, counted = np.zeros(x.shape[1]), 0.0, 0, 0
    for epoch in range(setup.epochs):
        order = rnd.permutation(len(y))
        for a in range(0, len(y), 64):
            b = order[a : a + 64]
            steps += 1
            rate = 2.0 / (1 + 0.02 * steps)
            wrong = b[y[b] * (x[b] @ w + bias) < 1]
            w *= 1 - rate * setup.penalty
            if len(wrong):
                push = y[wrong] * weight[wrong] * (rate / len(b))
                w += x[wrong].T @ push.astype(np.float32)
                bias += float(push.sum())
            if epoch >= setup.epochs // 2:
                mean += w
                mean_bias += bias
                counted += 1
    return np.append(mean, mean_bias).astype(np.float32) / max(1, counted)


@dataclass
class Model:
    setup: Setup
    languages: list[str]
    families: list[list[str]] = field(default_factory=list)
    weights: np.ndarray | None = None  # a column for each machine
    pairs: list[tuple[str, int, int, int]] = field(default_factory=list)  # family or language level, its family, first, second

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        letters = np.array(pc.match_substring_regex(column, r"\p{L}").to_pylist(), bool).reshape(n)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        if self.weights is None:
            return [self.languages[0] if x else UNKNOWN for x in letters], letters.astype(float)
        margins = profiles(column, self.setup) @ self.weights[:-1] + self.weights[-1]
        family, sure = self._vote(margins, "family", 0, len(self.families))
        out, score = np.full(n, UNKNOWN, object), np.zeros(n)
        for f, own in enumerate(self.families):
            rows = np.flatnonzero((family == f) & letters)
            within, certain = self._vote(margins[rows], "language", f, len(own))
            out[rows] = np.array(own, object)[within]
            score[rows] = sure[rows] * certain
        return out.tolist(), score

    def _vote(self, margins: np.ndarray, level: str, family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner of the one-versus-one votes, and the least probability that it won each of its pairs with."""
        rows = len(margins)
        votes, total, sure = np.zeros((rows, n)), np.zeros((rows, n)), np.ones((rows, n))
        for c, (kind, f, i, j) in enumerate(self.pairs):
            if kind == level and (level == "family" or f == family):
                m = margins[:, c]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                total[:, i] += m
                total[:, j] -= m
                p = sigmoid(3 * m)
                sure[:, i] = np.minimum(sure[:, i], p)
                sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = np.argmax(votes + sigmoid(total) * 0.5, axis=1)
        return best, sure[np.arange(rows), best]


def families_of(x: np.ndarray, y: np.ndarray, languages: list[str]) -> list[list[str]]:
    """The languages in about as many sets as the root of their number: the two nearest sets become one, by the mean cosine of their languages' mean profiles."""
    means = unit(np.stack([x[y == lang].mean(axis=0) for lang in languages]))
    alike = means @ means.T
    sets = [[i] for i in range(len(languages))]
    while len(sets) > max(1, round(len(languages) ** 0.5)):
        near = {(a, b): float(alike[np.ix_(sets[a], sets[b])].mean()) for a, b in combinations(range(len(sets)), 2)}
        a, b = max(near, key=lambda k: (near[k], -k[0], -k[1]))
        sets[a] = sorted(sets[a] + sets[b])
        del sets[b]
    return sorted([languages[i] for i in s] for s in sets)


def train(rows: list[tuple[str, str]], setup: Setup = Setup()) -> Model:
    languages = sorted({y for _, y in rows})
    model = Model(setup, languages)
    if len(languages) < 2:
        return model
    column = pa.array([t for t, _ in rows], pa.string())
    x, y = profiles(column, setup), np.array([y for _, y in rows], object)
    some = x.any(axis=1)
    x, y = x[some], y[some]
    if set(y) != set(languages):
        return train([r for r, s in zip(rows, some, strict=True) if s], setup)
    model.families = families_of(x, y, languages)
    family = np.array([next(i for i, f in enumerate(model.families) if lang in f) for lang in y])
    columns = []
    for i, j in combinations(range(len(model.families)), 2):
        own = (family == i) | (family == j)
        columns.append(machine(x[own], np.where(family[own] == i, 1.0, -1.0), setup))
        model.pairs.append(("family", 0, i, j))
    for f, langs in enumerate(model.families):
        for i, j in combinations(range(len(langs)), 2):
            own = (y == langs[i]) | (y == langs[j])
            columns.append(machine(x[own], np.where(y[own] == langs[i], 1.0, -1.0), setup))
            model.pairs.append(("language", f, i, j))
    model.weights = np.stack(columns, axis=1)
    return model


def fit(docs: DataFrame, setup: Setup = Setup()) -> Model:
    """Learn documents' lang from the rows that are not held out."""
    held_out = training.fold(F.col("doc_id"), FOLDS) == HELD_OUT
    rows, _ = training.sample(docs.withColumn("label", F.col("lang").cast("string")), None, held_out, setup.per_class, setup.sample_bytes)
    return train(rows, setup)


def predict_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.predict(batch.column("text"))
        return batch_of(doc_id=batch.column("doc_id"), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    return map_batches(id_text(docs), run, "doc_id long, lang_pred string, score double")
