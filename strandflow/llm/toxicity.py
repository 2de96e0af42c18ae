"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

The inputs of a word are a learned vector of the word, the mean of learned vectors of its character n-grams, and
numbers drawn from both: evidence (log-odds against the base rate, by document counts in the training rows) of the
word and of its n-grams, and the shares of capitals and symbols. All windows of `window` words, each starting
`stride` after the one before, are scored, to the end of the text; a document's probability comes from its highest
window scores by logistic regression.

Training: evidence is counted on one half of the sample and used on the other, so that the network sees inputs
as they are in unseen texts; vectors are learned with the network, for the words and n-grams of the most documents,
and left out at random. Windows with the most evidence stand for toxic documents; of clean documents those
with the most evidence and others are counter-examples. The sample holds at most `per_class` rows of each label
and `sample_bytes` of text.

Defined cases: null and empty texts have one window of padding and so a score; without training rows of both
labels every score is the share of label 1 (0 without rows). Rows are scored by text alone, each by itself.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import training
from strandflow.llm.common import batch_of, id_text, map_batches
from strandflow.llm.training import Adam, sigmoid
from strandflow.llm.words import Words, constants, mix

FOLDS = 5
_INPUTS = 8
#: Bytes of a word that are read as one; a longer word is read in parts. And the bits of a bucket.
_BYTES, _BITS = 32, 20
#: Different words that are read at once when a model is trained, and when texts are scored.
_AT_ONCE, _SCORED_AT_ONCE = 1 << 15, 1 << 13
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Setup:
    window: int = 40
    stride: int = 24
    hidden: int = 8
    attention: int = 8
    per_class: int = 1200
    sample_bytes: int = 6 << 20
    epochs: int = 12
    grams: tuple[int, int] = (3, 6)
    prior: float = 8.0
    vocabulary: int = 40_000
    vector: int = 6  # entries of a word's and of an n-gram's vector
    vectors: int = 4096  # words, and n-grams, that have one
    left_out: float = 0.4
    seed: int = 17


@dataclass
class Spelling:
    """Of some different words the bytes read, the lengths without outer punctuation, the words' buckets and, for each
    length of n-grams, the n-grams' buckets, -1 where a word is shorter."""

    size: np.ndarray
    core: np.ndarray
    word: np.ndarray
    grams: list[np.ndarray]


class Vocabulary:
    """The different words of a column, lower-cased and without outer ASCII punctuation, and hashes of their n-grams.

    A word of over _BYTES bytes counts as parts of so many bytes, which overlap by the longest n-gram. ids: for each
    word of the column its place in the vocabulary; first: each row's first word. The n-grams of all words take some
    hundred times the text's bytes, so that spellings() reads them for some words at a time; whole: read all of them.
    """

    def __init__(self, column: pa.Array, grams: tuple[int, int], whole: bool = True):
        words = Words(pc.utf8_lower(column))
        _split(words, grams[1])
        _, at, self.ids = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.first = words.first
        self._starts, self._sizes = words.starts[at], (words.ends - words.starts)[at]
        self.wide, self.lengths = int(min(self._sizes.max(initial=1), _BYTES)), grams
        self._data = words.data if len(words.data) else np.zeros(1, np.uint8)
        if whole:
            parts = list(self.spellings(_AT_ONCE))
            self.size, self.core, self.word = (np.concatenate([getattr(p, c) for p in parts]) for c in ("size", "core", "word"))
            self.grams = [np.concatenate(g) for g in zip(*(p.grams for p in parts), strict=True)]

    def spellings(self, at_once: int) -> Iterator[Spelling]:
        """Those of all words in order, at least one; each word's numbers are the same whatever at_once is."""
        for a in range(0, max(1, len(self._starts)), at_once):
            yield self._read(self._data, self._starts[a : a + at_once], self._sizes[a : a + at_once])

    def _read(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Spelling:
        wide, (low, high) = self.wide, self.lengths
        steps = np.arange(wide)
        raw = np.where(steps < lengths[:, None], data[np.minimum(starts[:, None] + steps, len(data) - 1)], 0)
        letter = _LETTER[raw]
        some = letter.any(axis=1)
        left = np.where(some, letter.argmax(axis=1), 0)
        core = np.where(some, wide - letter[:, ::-1].argmax(axis=1), 0) - left
        body = np.where(steps < core[:, None], np.take_along_axis(raw, np.minimum(left[:, None] + steps, wide - 1), 1), 0)
        marked = np.zeros((len(starts), wide + 2), np.uint64)
        marked[:, 0] = 1
        marked[:, 1:-1] = body
        marked[np.arange(len(starts)), core + 1] = 2
        word = self._bucket((marked * constants(wide + 2, 31)).sum(axis=1, dtype=np.uint64), some)
        grams, h = [], marked
        for n in range(2, high + 1):
            h = h[:, :-1] * _U(0x9FB21C651E98DF25) + marked[:, n - 1 :] if h.shape[1] > 1 else h[:, :0]
            if n >= low:
                fits = np.arange(h.shape[1]) < (core + 3 - n)[:, None]
                grams.append(self._bucket(h + _U(n << 32), fits & some[:, None]))
        return Spelling(np.minimum(lengths, wide), core, word, grams)

    @staticmethod
    def _bucket(h: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.where(valid, (mix(h) >> _U(64 - _BITS)).astype(np.int32), np.int32(-1))

    def buckets(self, some: np.ndarray) -> np.ndarray:
        """The different buckets of n-grams of these words."""
        found = np.unique(np.concatenate([g[some].ravel() for g in self.grams]))
        return found[found >= 0]


def _split(words: Words, overlap: int) -> None:
    """Words of over _BYTES bytes become parts of at most so many bytes, each of which begins in the last `overlap` bytes of the one before."""
    step, length = _BYTES - overlap, words.ends - words.starts
    parts = 1 + np.maximum(0, -(-(length - _BYTES) // step))
    if len(parts) and parts.max() > 1:
        word = np.repeat(np.arange(len(parts)), parts)
        words.starts = words.starts[word] + step * (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts))
        words.ends = np.minimum(words.starts + _BYTES, words.ends[word])
        words.first = np.searchsorted(words.starts, words.offsets)


class Evidence:
    """Log-odds of label 1 of words and of n-grams against the base rate, with a prior of `prior` documents at the base rate."""

    def __init__(self, vocabulary: Vocabulary, rows: np.ndarray, labels: np.ndarray, setup: Setup):
        base = float(np.clip(labels[rows].mean(), 1e-3, 1 - 1e-3))
        word, gram = np.zeros((2, 1 << _BITS), np.int32), np.zeros((2, 1 << _BITS), np.int32)
        for i in rows:
            own, y = np.unique(vocabulary.ids[vocabulary.first[i] : vocabulary.first[i + 1]]), int(labels[i])
            if len(own):
                w = vocabulary.word[own]
                word[y, np.unique(w[w >= 0])] += 1
                gram[y, vocabulary.buckets(own)] += 1
        self.kept = [self._odds(c, base, setup) for c in (word, gram)]

    @staticmethod
    def _odds(counts: np.ndarray, base: float, setup: Setup) -> tuple[np.ndarray, np.ndarray]:
        clean, toxic = counts
        p = (toxic + setup.prior * base) / (toxic + clean + setup.prior)
        odds = np.where(toxic > 1, np.log(p / (1 - p)) - math.log(base / (1 - base)), 0.0)
        found = np.flatnonzero(np.abs(odds) > 0.3)
        found = found[np.argsort(-np.abs(odds[found]), kind="stable")[: setup.vocabulary]]
        return found.astype(np.int32), odds[found].astype(np.float32)

    def tables(self) -> list[np.ndarray]:
        """Dense tables of words and of n-grams; the last entry is for what is not there."""
        if not hasattr(self, "_tables"):
            self._tables = []
            for at, odds in self.kept:
                t = np.zeros((1 << _BITS) + 1, np.float32)
                t[at] = odds
                self._tables.append(t)
        return self._tables

    def __getstate__(self) -> dict:
        return {"kept": self.kept}

    def inputs(self, v: Vocabulary | Spelling) -> np.ndarray:
        """_INPUTS numbers for each word."""
        word, gram = self.tables()
        n = len(v.core)
        top, total, count, strong, edge = (np.zeros(n, np.float32) for _ in range(5))
        for g in v.grams:
            if g.shape[1]:
                odds = gram[g]
                top = np.maximum(top, odds.max(axis=1))
                edge = np.maximum(edge, odds[:, 0])
                total += odds.sum(axis=1)
                count += (g >= 0).sum(axis=1)
                strong += (odds > 1.5).sum(axis=1)
        return np.stack([
            word[v.word], top, edge, total / np.maximum(count, 1), np.minimum(strong, 8) / 4, np.maximum(top - 2, 0),
            1 - v.core / np.maximum(v.size, 1), np.where(v.size < _BYTES, np.minimum(v.core, 24) / 12 - 0.5, 0),  # a part says nothing of length
        ], axis=1).astype(np.float32)


class Vectors:
    """Learned vectors of words and of n-grams, row 0 of each table for all that have none."""

    def __init__(self, vocabulary: Vocabulary, setup: Setup):
        docs = np.zeros((2, 1 << _BITS), np.int32)
        for a, b in zip(vocabulary.first[:-1].tolist(), vocabulary.first[1:].tolist(), strict=True):
            own = np.unique(vocabulary.ids[a:b])
            if len(own):
                w = vocabulary.word[own]
                docs[0, np.unique(w[w >= 0])] += 1
                docs[1, vocabulary.buckets(own)] += 1
        self.kept, self.tables, self.moved = [], [], []
        rnd = np.random.default_rng(setup.seed + 1)
        for counts in docs:
            best = np.argsort(-counts, kind="stable")[: setup.vectors]
            self.kept.append(best[counts[best] > 2].astype(np.int32))
            self.tables.append((0.1 * rnd.standard_normal((len(self.kept[-1]) + 1, setup.vector))).astype(np.float32))
            self.tables[-1][0] = 0
            self.moved.append(np.full(len(self.tables[-1]), 1e-3, np.float32))

    def __getstate__(self) -> dict:
        return {"kept": self.kept, "tables": self.tables}

    def rows(self, v: Vocabulary | Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its row, and the rows of its n-grams that have one, with where each word's begin."""
        if not hasattr(self, "_at"):
            self._at = []
            for kept in self.kept:
                at = np.zeros((1 << _BITS) + 1, np.uint16)  # `vectors` is below 2**16
                at[kept] = np.arange(1, len(kept) + 1)
                self._at.append(at)
        found = np.concatenate([self._at[1][g] for g in v.grams], axis=1)
        some = found > 0
        return self._at[0][v.word].astype(np.int64), found[some].astype(np.int64), np.concatenate([[0], np.cumsum(np.count_nonzero(some, axis=1))])

    def of(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """The two vectors of each word side by side, and what learn() needs."""
        word, gram, first = rows
        which = np.arange(len(word)) if which is None else which
        n = first[which + 1] - first[which]
        begin = np.cumsum(n) - n
        at = gram[np.repeat(first[which] - begin, n) + np.arange(int(n.sum()))]
        of = np.repeat(np.arange(len(which)), n)
        mean = np.zeros((len(which), self.tables[1].shape[1]), np.float32)
        if len(at):
            mean[n > 0] = np.add.reduceat(self.tables[1][at], begin[n > 0], axis=0) / n[n > 0, None]
        return np.hstack([self.tables[0][word[which]], mean]).astype(np.float32), (word[which], at, of, n)

    def learn(self, taken: tuple, grad: np.ndarray, rate: float, decay: float = 1e-3) -> None:
        """A step against the gradient of the vectors of()."""
        word, at, of, n = taken
        e = grad.shape[1] // 2
        parts = ((word, grad[:, :e]), (at, (grad[:, e:] / np.maximum(n, 1)[:, None])[of]))
        for table, moved, (rows, g) in zip(self.tables, self.moved, parts, strict=True):
            total = np.stack([np.bincount(rows, g[:, k], minlength=len(table)) for k in range(e)], axis=1)
            total[0] = 0
            total += decay * table * (total != 0)
            moved += (total**2).mean(axis=1)
            table -= (rate * total / np.sqrt(moved)[:, None]).astype(np.float32)


class Network:
    """Two gated recurrent passes, attention over both, one logit for each window."""

    def __init__(self, inputs: int, setup: Setup):
        rnd, h, a = np.random.default_rng(setup.seed), setup.hidden, setup.attention
        draw = lambda *s: (rnd.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.h = h
        self.p: dict[str, np.ndarray] = {}
        for d in ("f", "b"):
            self.p |= {f"W{d}": draw(inputs, 3 * h), f"U{d}": draw(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, a), "v": draw(a), "o": draw(2 * h), "k": np.zeros(1, np.float32)}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """x: time by windows by 3h, already multiplied by W; returns the states in the order of time."""
        h, u = self.h, self.p[f"U{d}"]
        state = np.zeros((x.shape[1], h), x.dtype)
        out = np.empty((*x.shape[:2], h), x.dtype)
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            gates = np.tanh(0.5 * (x[t, :, : 2 * h] + state @ u[:, : 2 * h]))  # the logistic function, by its half angle
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new))
            state = state + mask[t] * z * (new - state)
            out[t] = state
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, projected: bool = False, cache: dict | None = None) -> np.ndarray:
        """x: time by windows by inputs, or by 6h if projected; mask: time by windows by 1."""
        h = self.h
        px = x if projected else np.concatenate([x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"], axis=2)
        keeps = {d: [] if cache is not None else None for d in "fb"}
        s = np.concatenate([self._pass(d, px[:, :, 3 * h * i : 3 * h * (i + 1)], mask, keeps[d]) for i, d in enumerate("fb")], axis=2)
        hid = np.tanh(s @ self.p["A"])
        e = hid @ self.p["v"] + (mask[:, :, 0] - 1) * 1e4
        e = np.exp(e - e.max(axis=0))
        alpha = (e / e.sum(axis=0))[:, :, None]
        pooled = (alpha * s).sum(axis=0)
        if cache is not None:
            cache |= {"x": x, "mask": mask, "keeps": keeps, "s": s, "hid": hid, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["k"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, inputs: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted cross-entropy and its gradients, by the inputs too if asked for."""
        c: dict = {}
        p, h = self.p, self.h
        prob = sigmoid(self.logits(x, mask, cache=c))
        total = weight.sum()
        loss = -float((weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / total)
        dl = (weight * (prob - y) / total).astype(x.dtype)
        g = {"o": c["pooled"].T @ dl, "k": np.array([dl.sum()], x.dtype)}
        dpool = dl[:, None] * p["o"]
        ds = c["alpha"] * dpool
        dalpha = (c["s"] * dpool).sum(axis=2, keepdims=True)
        de = c["alpha"] * (dalpha - (c["alpha"] * dalpha).sum(axis=0))
        g["v"] = np.einsum("tnk,tna->a", de, c["hid"])
        dhid = de * p["v"] * (1 - c["hid"] ** 2)
        g["A"] = np.einsum("tns,tna->sa", c["s"], dhid)
        ds = ds + dhid @ p["A"].T
        for i, d in enumerate("fb"):
            u, own = p[f"U{d}"], ds[:, :, h * i : h * (i + 1)]
            gu, dx = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * h), x.dtype)
            carry = np.zeros((x.shape[1], h), x.dtype)
            for t, state, z, r, new in reversed(c["keeps"][d]):
                dh = carry + own[t]
                m = mask[t]
                dz = dh * m * (new - state) * z * (1 - z)
                dn = dh * m * z * (1 - new**2)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                carry = dh * (1 - m * z) + drs * r + dz @ u[:, :h].T + dr @ u[:, h : 2 * h].T
                gu[:, :h] += state.T @ dz
                gu[:, h : 2 * h] += state.T @ dr
                gu[:, 2 * h :] += (r * state).T @ dn
                dx[t] = np.concatenate([dz, dr, dn], axis=1)
            g[f"U{d}"], g[f"c{d}"] = gu, dx.sum(axis=(0, 1))
            g[f"W{d}"] = np.einsum("tni,tnk->ik", x, dx)
            if inputs:
                g["inputs"] = g.get("inputs", 0) + dx @ p[f"W{d}"].T
        return loss, g


def window_starts(n: int, setup: Setup) -> range:
    """Where the windows of n words start: the last one reaches the end."""
    return range(0, max(1, n - setup.window + setup.stride), setup.stride)


@dataclass
class Model:
    setup: Setup
    base: float
    evidence: Evidence | None = None
    vectors: Vectors | None = None
    network: Network | None = None
    pool: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text."""
        if self.network is None:
            return np.full(len(column), self.base)
        return self._pooled(self.window_logits(column))

    def window_logits(self, column: pa.Array, at_once: int = 1024) -> list[np.ndarray]:
        s, p = self.setup, self.network.p
        v = Vocabulary(column, s.grams, whole=False)
        x = np.concatenate([np.hstack([self.evidence.inputs(w), self.vectors.of(self.vectors.rows(w))[0]]) for w in v.spellings(_SCORED_AT_ONCE)])
        table = np.concatenate([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]], axis=1)
        table = np.concatenate([table, np.zeros_like(table[:1])] if len(table) else [np.zeros((1, 6 * s.hidden), np.float32)])
        flat = np.append(v.ids, len(table) - 1)
        counts, begin, n = [], [], []
        for a, b in zip(v.first[:-1].tolist(), v.first[1:].tolist(), strict=True):
            starts = np.array(window_starts(b - a, s))
            counts.append(len(starts))
            begin.append(a + starts)
            n.append(np.minimum(s.window, b - a - starts))
        begin, n = np.concatenate(begin), np.concatenate(n)
        out = np.empty(len(begin), np.float32)
        steps = np.arange(s.window)[:, None]
        for a in range(0, len(begin), at_once):
            mask = steps < n[a : a + at_once]
            rows = np.where(mask, flat[np.minimum(begin[a : a + at_once] + steps, len(flat) - 1)], len(table) - 1)
            out[a : a + at_once] = self.network.logits(table[rows], mask[:, :, None].astype(np.float32), projected=True)
        return np.split(out, np.cumsum(counts)[:-1])

    def _pooled(self, logits: list[np.ndarray]) -> np.ndarray:
        x = np.array([pool_inputs(z) for z in logits])
        return sigmoid(np.hstack([x, np.ones((len(x), 1))]) @ self.pool)


def pool_inputs(z: np.ndarray) -> list[float]:
    """Of a document's window logits: the three highest, the expected number of toxic windows, their share, the number of windows."""
    top = np.sort(z)[::-1][:3]
    top = np.concatenate([top, np.full(3 - len(top), -6.0)])
    p = sigmoid(z)
    return [*np.clip(top, -6, 6).tolist(), math.log1p(float(p.sum())), float(p.mean()), math.log1p(len(z))]


def train(rows: list[tuple[str, int]], there: dict | None = None, setup: Setup = Setup()) -> Model:
    """there: how many rows of each label the sample stands for; None if it is all of them."""
    labels = np.array([int(y == 1) for _, y in rows], float)
    if len(set(labels.tolist())) < 2:
        return Model(setup, float(labels.mean()) if len(labels) else 0.0)
    rnd = np.random.default_rng(setup.seed)
    order = np.concatenate([rnd.permutation(np.flatnonzero(labels == y)) for y in (1, 0)])
    labels = labels[order]
    v = Vocabulary(pa.array([rows[i][0] for i in order], pa.string()), setup.grams)
    half = np.arange(len(order)) % 2  # both labels alternate
    inputs: list[np.ndarray] = [np.zeros((0, _INPUTS), np.float32)] * len(order)
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        if len(set(labels[other].tolist())) < 2:
            other = np.arange(len(order))
        of_word = Evidence(v, other, labels, setup).inputs(v)
        for i in np.flatnonzero(half == side):
            inputs[i] = of_word[v.ids[v.first[i] : v.first[i + 1]]]
    chosen: list[tuple[int, int]] = []
    for i, x in enumerate(inputs):
        starts = np.array(window_starts(len(x), setup))
        strength = np.array([np.sort(x[a : a + setup.window, 1])[-3:].sum() if len(x) else 0.0 for a in starts])
        best = np.argsort(-strength, kind="stable")[: 2 if labels[i] else 1]
        more = rnd.choice(len(starts), 0 if labels[i] else min(len(starts), 1), replace=False)
        chosen += [(i, int(starts[k])) for k in {*best.tolist(), *more.tolist()}]
    x, mask, word = windows_of(inputs, [v.ids[a:b] for a, b in zip(v.first[:-1], v.first[1:], strict=True)], chosen, setup)
    y = np.array([labels[i] for i, _ in chosen], np.float32)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    vectors = Vectors(v, setup)
    rows_of = vectors.rows(v)
    net = Network(_INPUTS + 2 * setup.vector, setup)
    opt = Adam(net.p, 0.01)
    for epoch in range(setup.epochs):
        opt.rate = 0.01 * (1 - epoch / setup.epochs) + 0.0005
        turn = rnd.permutation(len(y))
        for a in range(0, len(y), 256):
            b = turn[a : a + 256]
            some, at = np.unique(word[:, b], return_inverse=True)
            own, taken = vectors.of(rows_of, some)
            in_use = (mask[:, b] * (rnd.random(mask[:, b].shape) >= setup.left_out) / (1 - setup.left_out)).astype(np.float32)
            at = at.reshape(word[:, b].shape)
            grads = net.gradients(np.concatenate([x[:, b], own[at] * in_use], axis=2), mask[:, b], y[b], weight[b], True)[1]
            back = (grads.pop("inputs")[:, :, _INPUTS:] * in_use).reshape(-1, own.shape[1])
            vectors.learn(taken, np.stack([np.bincount(at.ravel(), back[:, k], minlength=len(some)) for k in range(own.shape[1])], axis=1), 5 * opt.rate)
            opt.step(grads)
    model = Model(setup, float(labels.mean()), Evidence(v, np.arange(len(order)), labels, setup), vectors, net)
    pooled, own = [], vectors.of(rows_of)[0]
    for i, x in enumerate(inputs):
        x = np.hstack([x, own[v.ids[v.first[i] : v.first[i + 1]]]])
        xs, ms, _ = windows_of([x], [np.zeros(len(x), int)], [(0, a) for a in window_starts(len(x), setup)], setup)
        pooled.append(pool_inputs(net.logits(xs, ms)))
    model.pool = training.logistic(np.array(pooled), labels, training.weights(labels, there))
    return model


def windows_of(inputs: list[np.ndarray], words: list[np.ndarray], chosen: list[tuple[int, int]], setup: Setup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, mask and words of the chosen windows (text, start), by time and window."""
    x = np.zeros((setup.window, len(chosen), inputs[0].shape[1]), np.float32)
    mask = np.zeros((setup.window, len(chosen), 1), np.float32)
    word = np.zeros((setup.window, len(chosen)), np.int64)
    for j, (i, a) in enumerate(chosen):
        part = inputs[i][a : a + setup.window]
        x[: len(part), j], mask[: len(part), j], word[: len(part), j] = part, 1, words[i][a : a + setup.window]
    return x, mask, word


def fit(docs: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> Model:
    """Learn labels.toxic from the rows that are not held out."""
    held_out = training.fold(F.col("doc_id"), FOLDS) == 0
    return train(*training.sample(docs, training.labels_of(labels, "toxic"), held_out, setup.per_class, setup.sample_bytes), setup)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=batch.column("doc_id"), score=pa.array(model.scores(batch.column("text")), pa.float64()))

    out = map_batches(id_text(docs), run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below one half, with all their columns."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index("text")).fill_null("")
        return batch.filter(pa.array(model.scores(text) < 0.5))

    return map_batches(docs, run, docs.schema)
