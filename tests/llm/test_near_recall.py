import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from strandflow.llm import order_minhash as om
from strandflow.llm.words import Words

T = Fraction(4, 5)


def exact_classes(rows):
    """The least id of each row's class; candidates by the rarest shingles, of which two linked texts must share one."""
    seqs = [s.tolist() for s in om.shingles(Words(pa.array([t or "" for _, t in rows])), 5)]
    sets = [Counter(s) for s in seqs]
    often = Counter(x for s in sets for x in s)
    by, seen, up = defaultdict(list), set(), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        marked = [(x, k) for x in s for k in range(s[x])]
        marked.sort(key=lambda e: (often[e[0]], e))
        for e in marked[: len(marked) - -(-4 * len(marked) // 5) + 1]:
            for j in by[e]:
                seen.add((j, i))
            by[e].append(i)
    for j, i in sorted(seen):
        a, b = find(i), find(j)
        if a != b and 9 * sum((sets[i] & sets[j]).values()) >= 4 * (len(seqs[i]) + len(seqs[j])) and om.aligned(np.array(seqs[i]), np.array(seqs[j]), T):
            up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    empty = [i for i, s in enumerate(seqs) if not s]
    out = {d: least[find(i)] for i, (d, _) in enumerate(rows)}
    return out | {rows[i][0]: min((rows[j][0] for j in empty), default=None) for i in empty}


def test_no_link_of_a_table_is_lost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in om.near_classes(docs).collect()}
    assert got == exact_classes(rows)


@pytest.mark.parametrize("refine", [1 << 40, 40])
def test_a_passage_that_many_texts_hold_joins_none_of_them(spark, refine):
    """Buckets of texts of which two fifths are one passage, and pairs of near copies among them, split or not."""
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(50_000)]
    passage, rows = rnd.sample(vocab, 60), []
    for i in range(400):
        own = rnd.sample(vocab, 40)
        rows.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            own[rnd.randrange(40)] = "other"
            rows.append((2 * i + 1, " ".join(passage + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in om.near_classes(docs, om.Sketching(refine=refine)).collect()}
    assert got == exact_classes(rows)


def test_each_pair_is_compared_once_and_splitting_compares_fewer():
    """Of all buckets a pair is eligible in the first it shares; of buckets split by a second sketch in the first two."""
    rnd, how = np.random.default_rng(3), om.Sketching(tables=6, small_tables=4)
    keys = rnd.integers(0, 3, (40, 6)) + 10 * np.arange(6)
    sig = om.signature(om.mix(np.arange(500, dtype=np.uint64)))

    def square(members, at):
        n = len(members)
        cols = {"x": [0] * n, "y": [0] * n, "block": [0] * n, "r": members, "n": [100] * n, "keys": [keys[m].tolist() for m in members], "sig": [sig] * n, "at": [at] * n}
        return [(members[i], members[j]) for i, j in zip(*np.nonzero(om.eligible(pa.table(cols), how)), strict=True)]

    whole, split = Counter(), Counter()
    for t in range(6):
        for k in range(3):
            own = [m for m in range(40) if keys[m, t] == k + 10 * t]
            whole.update(square(own, [t]))
            for u in range(t + 1, 6):
                for k2 in range(3):
                    split.update(square([m for m in own if keys[m, u] == k2 + 10 * u], [t, u]))
    shared = {(a, b): int((keys[a] == keys[b]).sum()) for a, b in combinations(range(40), 2)}
    assert set(whole) == {p for p, n in shared.items() if n > 0} and set(whole.values()) == {1}
    assert set(split) == {p for p, n in shared.items() if n > 1} and set(split.values()) == {1}


def test_signatures_keep_what_is_linked():
    rnd = np.random.default_rng(5)
    kept = {0.8: 0, 0.5: 0}
    for share, n in ((0.8, 400), (0.5, 400)):
        for _ in range(n):
            size = int(rnd.integers(20, 600))
            common = rnd.integers(0, 1 << 62, int(2 * size * share / (1 + share)), dtype=np.uint64)
            a, b = (np.concatenate([common, rnd.integers(0, 1 << 62, size - len(common), dtype=np.uint64)]) for _ in range(2))
            x, y = (np.frombuffer(om.signature(om.mix(s)), np.uint8) for s in (a, b))
            kept[share] += bool(om.likely(x, y, T))
    assert kept[0.8] == 400 and kept[0.5] < 200
