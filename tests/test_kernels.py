"""Fixed vectors and scalar restatements of the kernels."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandflow.operators import kernels as k
from strandflow.plans.options import Options


def reads(*rows):
    return k.reads(pa.array([s for s, _ in rows]), pa.array([q for _, q in rows]))


def text(m, n):
    return k.texts(m, n).to_pylist()


def test_reverse_complement():
    r = reads(("AAAATTTTCCCCGGGG", "I" * 16), ("acgtRN", "ABCDEF"), ("", "")).complemented()
    assert text(r.seq, r.length) == ["CCCCGGGGAAAATTTT", "NNACGT", ""] and text(r.qual, r.length)[1] == "FEDCBA"


def test_overlap_and_late_mismatches():
    r1 = "CAGCGCCTACGGGCCCCTTTTTCTGCGCGACCGCGTGGCTGTGGGCGCGGATGCCTTTGAGCGCGGTGACTTCTCACTGCGTATCGAGC"
    r2 = "ACCTCCAGCGGCTCGATACGCAGTGAGAAGTCACCGCGCTCAAAGGCATCCGCGCCCACAGCCACGCGGTCGCGCAGAAAAAGGGGTCC"
    a, b = reads((r1, r1)), reads((r2, r2))
    ov = k.overlap(a, b, 2, 30, 0.2)
    assert (ov.found[0], ov.offset[0], ov.length[0], ov.diff[0]) == (True, 10, 79, 1)
    late = reads(("A" * 50 + "G" * 30,) * 2).complemented()
    ov = k.overlap(reads(("A" * 50 + "C" * 30,) * 2), late, 0, 30, 0.0)
    assert (ov.found[0], ov.offset[0], ov.length[0], ov.diff[0]) == (True, 0, 80, 30)


def test_quality_cut():
    r = reads(("TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTT", "/////CCCCCCCCCCCC////CCCCCCCCCCCCCC////E"))
    out, lost, _ = k.cut(r, 0, 1, k.Cut(front=(4, 20), tail=(4, 20)))
    assert not lost[0] and text(out.seq, out.length) == ["CCCCCCCCCCCCCCCCCCCCCCCCCCCC"] and text(out.qual, out.length) == ["CCCCCCCCCCC////CCCCCCCCCCCCC"]


def test_adapters():
    r = reads(("TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCCCGGGG",) * 2)
    assert k.adapter_at(r, b"TTTTCCACGGGGATACTACTG")[0] == len("TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAA")
    r = reads(("TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCCCGGGGAAATTTCCCGGGAAATTTCCCGGGATCGATCGATCGATCGAATTCC",) * 2)
    for a in (b"GCTAGCTAGCTAGCTA", b"AAATTTCCCGGGAAATTTCCCGGG", b"ATCGATCGATCGATCG", b"AATTCCGGAATTCCGG"):
        r = r.resized(np.minimum(k.adapter_at(r, a), r.length))
    assert text(r.seq, r.length) == ["TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCCCGGGG"]
    gapped = reads(("ACGTTGCATCGGATCCGTAAGTC" + "AGATCGGAAGAGTCACACGTCTGAACTCC",) * 2)
    assert k.adapter_at(gapped, b"AGATCGGAAGAGCACACGTCTGAACTCC")[0] == 23
    assert k.adapter_at(gapped, b"AGATCGGAAGAGCACACGTCTGAACTCC", gaps=False)[0] == gapped.length[0]


def test_correction():
    e = lambda at, n=56: "".join("/" if i == at else "E" for i in range(n))
    a = reads(("TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCACGGGG", e(50)))
    b = reads(("AAAAAAAAAACCCCGGGGAAAATTTTAAAATTGGGGGGGGGGTGGGGGGGGGGGGG", e(42)))
    x, y, n1, n2, pairs = k.correct(a, b, k.overlap(a, b, 5, 30, 0.2))
    assert text(x.seq, x.length) == ["TTTTAACCCCCCCCCCCCCCCCCCCCCCCCCCCCAATTTTAAAATTTTCCCCGGGG"]
    assert text(y.seq, y.length) == ["AAAAAAAAAACCCCGGGGAAAATTTTAAAATTGGGGGGGGGGGGGGGGGGGGGGGG"]
    assert text(x.qual, x.length) == text(y.qual, y.length) == ["E" * 56] and (n1[0], n2[0], len(pairs)) == (1, 1, 2)


def test_homopolymers():
    n, base = k.poly_x(reads(("ATTTTAAAAAAAAAATAAAAAAAAAAAAACAAAAAAAAAAAAAAAAAAAAAAAAAT",) * 2), 10)
    assert n[0] == 5 and base[0] == 0


def scalar_cut(s, q, front, tail, how):
    """The rules one read and one base at a time."""
    n = len(s)
    lost = (None, 0)
    q = [ord(c) - 33 for c in q]
    if n - front - tail < 0 and (front or tail):
        return lost
    start, left = front, n - front - tail
    if how.front:
        w, m = how.front
        if n - start - tail - w <= 0:
            return lost
        i = start
        while i + w < n - tail and sum(q[i : i + w]) < w * m:
            i += 1
        i = i + w - 1 if i > 0 else i
        while i < n and s[i] == "N":
            i += 1
        start, left = i, n - i - tail
    if how.right:
        w, m = how.right
        if n - start - tail - w <= 0:
            return lost
        i = start
        while i + w < n - tail and sum(q[i : i + w]) >= w * m:
            i += 1
        if i + w < n - tail:
            while i < n - 1 and q[i] >= m:
                i += 1
            left = i - start
    elif how.tail:
        w, m = how.tail
        if n - start - tail - w <= 0:
            return lost
        t = n - tail - 1
        while t - w >= start and sum(q[t - w + 1 : t + 1]) < w * m:
            t -= 1
        t = t - w + 1 if t < n - 1 else t
        while t >= 0 and s[t] == "N":
            t -= 1
        left = t - start + 1
    if how != k.Cut() and (left <= 0 or start >= n - 1):
        return lost
    return s[start : start + max(left, 0)], start


def scalar_poly_g(s, least):
    wrong, first, i = 0, len(s) - 1, 0
    while i < len(s):
        if s[len(s) - 1 - i] != "G":
            wrong += 1
        else:
            first = len(s) - 1 - i
        if wrong > 5 or (wrong > (i + 1) // 8 and i >= least - 1):
            break
        i += 1
    return first if i >= least and s else len(s)


def scalar_code(s, q, o):
    if not s:
        return 16
    low, total = sum(ord(c) - 33 < o.qualified_quality for c in q), sum(ord(c) - 33 for c in q)
    if o.quality_filter:
        if low > o.unqualified_percent * len(s) / 100.0 or (o.average_quality and total // len(s) < o.average_quality):
            return 20
        if s.count("N") > o.n_base_limit:
            return 12
    if o.length_filter:
        if len(s) < o.length_required:
            return 16
        if o.length_limit and len(s) > o.length_limit:
            return 17
    if o.complexity_filter and (len(s) <= 1 or sum(a != b for a, b in zip(s, s[1:], strict=False)) / (len(s) - 1) < o.complexity_percent / 100.0):
        return 24
    return 0


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(9)
    out = [("", ""), ("A", "I"), ("N", "#"), ("GG", "II"), ("ACGT", "IIII"), ("G" * 40, "I" * 40), ("N" * 30, "#" * 30)]
    for _ in range(1500):
        n = rnd.choice((3, 5, 8, 20, 60, 110))
        s = "".join(rnd.choice("ACGTGN" if rnd.random() < 0.5 else "ACGT") for _ in range(n))
        s += rnd.choice(("", "", "G" * rnd.randint(1, 25), "A" * rnd.randint(5, 20) + "C" + "A" * rnd.randint(0, 12)))
        level = rnd.choice((12, 20, 30))
        out.append((s, "".join(chr(33 + max(2, min(40, int(rnd.gauss(level, 9))))) for _ in s)))
    return out


@pytest.mark.parametrize("how", [k.Cut(), k.Cut(front=(4, 20)), k.Cut(tail=(4, 20)), k.Cut(right=(4, 20)), k.Cut((3, 15), (5, 25)), k.Cut(front=(1, 28), right=(6, 22)), k.Cut((2, 30), (2, 30), (2, 30))])
@pytest.mark.parametrize("front,tail", [(0, 0), (2, 1), (10, 0), (0, 30)])
def test_cuts_by_restatement(many, how, front, tail):
    out, lost, begin = k.cut(reads(*many), front, tail, how)
    got = [(None, 0) if gone else (s, f) for s, gone, f in zip(text(out.seq, out.length), lost.tolist(), begin.tolist(), strict=True)]
    want = [scalar_cut(s, q, front, tail, how) for s, q in many]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got if g[0]] == [w[1] for w in want if w[0]]


@pytest.mark.parametrize("least", [1, 5, 10, 20])
def test_poly_g_by_restatement(many, least):
    assert k.poly_g(reads(*many), least).tolist() == [scalar_poly_g(s, least) for s, _ in many]


@pytest.mark.parametrize("o", [Options(), Options(average_quality=25, length_limit=60), Options(complexity_filter=True, quality_filter=False), Options(n_base_limit=0, unqualified_percent=10, length_filter=False)])
def test_results_by_restatement(many, o):
    assert k.classify(reads(*many), o).tolist() == [scalar_code(s, q, o) for s, q in many]


def test_overlap_by_restatement():
    rnd = random.Random(2)
    comp = str.maketrans("ACGTN", "TGCAN")
    pairs = []
    for _ in range(300):
        frag = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 130)))
        one, two = (frag + "AGATCGGAAGAGC" * 5)[: rnd.choice((40, 60, 70))], (frag[::-1].translate(comp) + "AGATCGGAAGAGC" * 5)[: rnd.choice((40, 60))]
        for _ in range(rnd.choice((0, 0, 1, 4))):
            i = rnd.randrange(len(one))
            one = one[:i] + rnd.choice("ACGTN") + one[i + 1 :]
        pairs.append((one, two))
    ov = k.overlap(*(k.reads(a, a) for a in (pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]))))
    for i, (a, two) in enumerate(pairs):
        b, want = two[::-1].translate(comp), (False, 0, 0, 0)
        tries = [(o, min(len(a) - o, len(b)), a[o:], b) for o in range(max(0, len(a) - 30))]
        tries += [(-o, min(len(a), len(b) - o), a, b[o:]) for o in range(max(0, len(b) - 30))]
        for o, n, x, y in tries:
            most = min(5, int(n * 0.2))
            if sum(p != q for p, q in zip(x[: min(n, 50)], y[: min(n, 50)], strict=True)) <= most:
                want = (True, o, n, sum(p != q for p, q in zip(x[:n], y[:n], strict=True)))
                break
        assert (bool(ov.found[i]), int(ov.offset[i]), int(ov.length[i]), int(ov.diff[i])) == want
