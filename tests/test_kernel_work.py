"""What the gapped comparisons look at, and that they find what a scalar restatement finds."""

import numpy as np
import pyarrow as pa
import pytest

from strandflow.operators import kernels as k

R1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"


@pytest.fixture
def compared(monkeypatch):
    """The rows that were given to one_insertion."""
    rows, plain = [], k.one_insertion
    monkeypatch.setattr(k, "one_insertion", lambda x, *rest: rows.append(len(x)) or plain(x, *rest))
    return rows


def some_reads(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s = "".join(rng.choice(list("ACGT"), rng.integers(0, 101)))
        a = R1 if i % 3 == 0 else R1[:9] + "C" + R1[9:] if i % 3 == 1 else R1[:12] + R1[13:]
        out.append((s + a[: int(rng.integers(0, 36))])[:100] if i % 4 else s)
    return out


def wrong(x, y):
    return sum(a != b for a, b in zip(x, y, strict=True))


def first_place(s, adapter, least=4):
    """Where the adapter is, place by place and base by base."""
    for i in range(-4, len(s) - least):
        size = min(len(s) - i, len(adapter))
        if wrong(s[max(i, 0) : i + size], adapter[max(-i, 0) : size]) <= size // 8:
            return i
    for more in (True, False):
        for i in range(0, len(s) - least - more):
            size = min(len(s) - i - 1, len(adapter)) if more else min(len(s) - i, len(adapter) - 1)
            x, y = (s[i:], adapter) if more else (adapter, s[i:])
            if any(wrong(x[:j], y[:j]) + wrong(x[j + 1 : size + 1], y[j:size]) <= size // 8 - 1 for j in range(1, size)):
                return i
    return len(s)


def test_adapter_places_are_those_of_scalar_comparisons(compared):
    seqs = some_reads(400)
    col = pa.array(seqs)
    assert k.adapter_at(k.reads(col, col), R1.encode()).tolist() == [first_place(s, R1) for s in seqs]
    assert not compared, "gaps were tried place by place"


def test_chunks_do_not_matter(monkeypatch):
    col = pa.array(some_reads(300))
    r = k.reads(col, col)
    want = k.adapter_at(r, R1.encode()).tolist(), k.overlap(r, r, gaps=True)
    monkeypatch.setattr(k, "_ROWS", 7)
    assert k.adapter_at(r, R1.encode()).tolist() == want[0]
    assert k.overlap(r, r, gaps=True).offset.tolist() == want[1].offset.tolist()


def test_few_overlaps_are_compared_with_gaps(compared):
    rng = np.random.default_rng(4)
    mates = [pa.array(["".join(x) for x in rng.choice(list("ACGT"), (300, 100))]) for _ in range(2)]
    assert not k.overlap(*(k.reads(m, m) for m in mates), gaps=True).found.any()
    assert sum(compared) < 300, "more than the pairs themselves"


def test_statistics_of_mixed_reads(monkeypatch):
    from strandflow.operators import stats

    seqs, quals = ["ACGTN", "", "ac", "GGGGGGG"], ["I5?!#", "", "II", "?5I?5I!"]
    weighted = []
    plain = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: weighted.append(weights is not None) or plain(x, weights, minlength))
    at, sums = stats.cycle_sums(k.reads(pa.array(seqs), pa.array(quals)))
    want = {}
    for s, q in zip(seqs, quals, strict=True):
        for i, (b, x) in enumerate(zip(s, q, strict=True)):
            own = want.setdefault(i * 256 + ord(b), [0, 0, 0, 0])
            for j, v in enumerate((1, x >= "5", x >= "?", ord(x) - 33)):
                own[j] += v
    assert {a: list(v) for a, v in zip(at.tolist(), np.array(sums).T.tolist(), strict=True)} == want
    assert not any(weighted), "each sum was a pass of its own over all bases"
