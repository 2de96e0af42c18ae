import random
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import order_minhash as om
from strandflow.llm import phrase_dedup, queries
from strandflow.llm.words import Words, sliding_argmin
from tests.llm.helpers import ROWS, fixture, words


def test_words_and_hashes():
    texts = ["", "a bb\tccc", " x ", "y", "\n", "é漢 \x0b z" + "w" * 100, "w" * 100]
    w = Words(pa.array(texts))
    assert w.texts() == [" ".join(words(t)).encode() for t in texts]
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    h, flat = w.hashes(), [x for t in texts for x in words(t)]
    assert len(set(h.tolist())) == len(set(flat))
    again = Words(pa.array(["w" * 100, "bb", "y"])).hashes()
    assert again[0] == h[-1] and again[1] == h[1]


def test_sliding_argmin():
    v = np.array([random.Random(3).randrange(5) for _ in range(60)])
    for width in (1, 2, 5, 24):
        assert sliding_argmin(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(60 - width + 1)]


def removed_restated(texts, window):
    ws = [words(t) for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for w in ws:
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize("window,phrase,shard,hot", [(35, 12, 8 << 20, 64), (35, 12, 3000, 64), (35, 12, 3000, 2), (7, 3, 2000, 64), (7, 3, 2000, 1), (4, 4, 1500, 64), (4, 4, 1500, 0)])
def test_repeats_by_brute_force(spark, window, phrase, shard, hot):
    rnd = random.Random(window)
    vocab = [f"w{i}é" for i in range(40)] if window < 10 else [f"word{i}" for i in range(4000)]
    passages = [" ".join(rnd.choice(vocab) for _ in range(n)) for n in (34, 35, 36, 60, 90)]
    rows = [(1, None), (2, ""), (3, "short text"), (4, "orre " * 200), (5, passages[3] + " x " + passages[3])]
    for i in range(6, 60):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice((3, 30, 80)))) for _ in range(3)]
        if i % 2:
            parts.insert(rnd.randrange(4), rnd.choice(passages))
        rows.append((i, "  ".join(parts)))
    rows.append((60, rows[-1][1]))
    rows.append((60, rows[-1][1]))
    got = phrase_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int"), window, phrase, shard, hot).collect()
    want = [(i, *x) for (i, _), x in zip(rows, removed_restated([t for _, t in rows], window), strict=True)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == sorted(want)
    for r in got:
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed


def test_repeats_of_a_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, k, sha256(t.encode()).hexdigest()) for (i, _), (n, k, t) in zip(rows, removed_restated([t for _, t in rows], 35), strict=True)]
    assert sorted(tuple(r) for r in queries.op10_substring_dedup(spark, sf).collect()) == sorted(want)


def test_awkward_rows_and_empty_tables(spark):
    none = fixture(spark).limit(0)
    assert phrase_dedup.remove_repeats(none).count() == 0 and om.near_classes(none).count() == 0
    assert phrase_dedup.remove_repeats(fixture(spark)).count() == len(ROWS)
    out = om.near_classes(fixture(spark)).collect()
    assert len(out) == len(ROWS)
    of = {r.doc_id: r for r in out}
    assert of[1].class_id == of[2].class_id == of[3].class_id == 1 and of[8].class_id == 7 and of[9].class_size == 1
    assert sorted(r.kept for r in out if r.doc_id == 5) == [False, True]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_by_brute_force():
    rnd, t = random.Random(4), Fraction(4, 5)
    hits = 0
    for _ in range(3000):
        a = [rnd.randrange(rnd.choice((2, 5, 1000))) for _ in range(rnd.choice((0, 1, 4, 5, 12, 40)))]
        b = list(a)
        for _ in range(rnd.choice((0, 1, 2, 6))):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.choice((0, 1, 2))] = [rnd.randrange(1000)] * rnd.choice((0, 1, 2))
        m = lcs(a, b)
        want = m >= t * (len(a) + len(b) - m)
        hits += want
        assert om.aligned(np.array(a, np.int64), np.array(b, np.int64), t) == want, (a, b)
    assert 500 < hits < 2900


def links_restated(texts, t=Fraction(4, 5)):
    """All linked pairs, by full comparison of all shingle sequences."""
    ids, seqs = {}, []
    for x in texts:
        w = words(x)
        s = [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]
        seqs.append([ids.setdefault(y, len(ids)) for y in s])
    out, where = set(), defaultdict(set)
    for i, s in enumerate(seqs):
        for y in s:
            where[y].add(i)
    for i, s in enumerate(seqs):
        for j in {j for y in s for j in where[y] if j < i}:
            n = len(s) + len(seqs[j])
            if sum((Counter(s) & Counter(seqs[j])).values()) * (1 + t) >= t * n and (m := lcs(s, seqs[j])) >= t * (n - m):
                out.add((j, i))
        if not s:
            out |= {(j, i) for j in range(i) if not seqs[j]}
    return out


def classes_restated(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted(links_restated([t for _, t in rows])):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_near_classes_of_a_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_order_minhash(spark, sf).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_restated(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


@pytest.mark.parametrize("how", [om.Sketching(), om.Sketching(block=3), om.Sketching(block=3, refine=4)])
def test_near_classes_of_chains_templates_and_short_texts(spark, how):
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    rows, k = [], 0

    def add(ws):
        nonlocal k
        k += 1
        rows.append((k, " ".join(ws)))

    for n in (1, 3, 5, 6, 8, 9, 12, 18, 24, 27, 30, 60, 150):  # edits of all kinds near the limit
        base = [rnd.choice(vocab) for _ in range(n)]
        add(base)
        for e in (0, 1, 1, 2, 3, 5, 8):
            b = list(base)
            for _ in range(e):
                b[rnd.randrange(len(b))] = rnd.choice(vocab)
            add(b if rnd.random() < 0.7 else [*b, rnd.choice(vocab)])
    chain = [rnd.choice(vocab) for _ in range(100)]
    for _ in range(25):  # each near the one before, the ends far apart
        chain = list(chain)
        chain[rnd.randrange(100)] = rnd.choice(vocab)
        add(chain)
    common = [rnd.choice(vocab) for _ in range(80)]
    for _ in range(60):  # a shared passage, but not near
        add([*common, *(rnd.choice(vocab) for _ in range(rnd.choice((25, 35))))])
    rnd.shuffle(rows)
    got = om.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == classes_restated(sorted(rows))
