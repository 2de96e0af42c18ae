"""Sequence kernels in numpy over batches of reads.

A batch is a matrix of bytes, a row for each read, padded with 0, and the reads' lengths. Every kernel works on
all rows at once and loops over positions or offsets only, dropping rows that are decided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(b"ACGTacgt", b"TGCATGCA", strict=True):
    _COMPLEMENT[_a] = _b
_COMPLEMENT[0] = 0
#: The order in which homopolymer bases are tried.
POLY_BASES = b"ATCG"
#: One mismatch for so many bases, and at most so many, in homopolymer tails.
_ONE_IN, _MOST = 8, 5
#: An odd number and its inverse modulo 2**64, for hashes of runs.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bases of an overlap in which mismatches are bounded.
_PROTECTED = 50
#: Reads that are compared at a time, so that what each step touches stays in a core's cache.
_ROWS = 2048


@dataclass
class Reads:
    seq: np.ndarray
    qual: np.ndarray
    length: np.ndarray

    @property
    def steps(self) -> np.ndarray:
        return np.arange(self.seq.shape[1])

    def resized(self, length: np.ndarray) -> Reads:
        """Cut at the end; a longer or negative length leaves a read as it is."""
        length = np.where((length > self.length) | (length < 0), self.length, length)
        gone = self.steps >= length[:, None]
        return Reads(np.where(gone, 0, self.seq), np.where(gone, 0, self.qual), length)

    def dropped(self, front: np.ndarray) -> Reads:
        """Without the first bases."""
        if not front.any():
            return self
        at = self.steps + front[:, None]
        inside = at < self.length[:, None]
        at = np.minimum(at, max(self.seq.shape[1] - 1, 0))
        pick = lambda m: np.where(inside, np.take_along_axis(m, at, 1), 0)
        return Reads(pick(self.seq), pick(self.qual), self.length - front)

    def complemented(self) -> Reads:
        """Reverse complement; whatever is not A, C, G or T becomes N."""
        inside = self.steps < self.length[:, None]

        def pick(m: np.ndarray) -> np.ndarray:
            out = np.zeros_like(m)
            out[inside] = m[:, ::-1][inside[:, ::-1]]
            return out

        return Reads(_COMPLEMENT[pick(self.seq)], pick(self.qual), self.length)

    def rows(self, some: np.ndarray) -> Reads:
        return Reads(self.seq[some], self.qual[some], self.length[some])


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("") if column.null_count else column
    width_of = 8 if pa.types.is_large_string(column.type) else 4
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros((len(column), width or 1), np.uint8), np.zeros(len(column), np.int64)
    offsets = np.frombuffer(off, f"<i{width_of}", len(column) + 1, column.offset * width_of).astype(np.int64)
    length = np.diff(offsets)
    wide = max(int(length.max(initial=0)), width or 1, 1)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    out = np.zeros((len(column), wide), np.uint8)
    out[np.arange(wide) < length[:, None]] = values[offsets[0] : offsets[-1]]
    return out, length


def reads(seq: pa.Array, qual: pa.Array) -> Reads:
    s, n = matrix(seq)
    q, _ = matrix(qual, s.shape[1])
    return Reads(s, q[:, : s.shape[1]], n)


def texts(m: np.ndarray, length: np.ndarray) -> pa.Array:
    inside = np.arange(m.shape[1]) < length[:, None]
    data = np.ascontiguousarray(m[inside])
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def run_hashes(m: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` bases, by sums over prefixes modulo 2**64; the same for matrices of any width."""
    wide = m.shape[1]
    up = np.cumprod(np.full(wide + 1, _FACTOR))
    down = np.cumprod(np.full(wide + 1, _INVERSE))
    total = np.concatenate([np.zeros((len(m), 1), np.uint64), np.cumsum(m.astype(np.uint64) * up[:-1], axis=1)], axis=1)
    return (total[:, size:] - total[:, :-size]) * down[: wide - size + 1]


def poly_g(r: Reads, least: int) -> np.ndarray:
    """The lengths after G tails are cut: at the leftmost G seen before the mismatches become too many."""
    back = np.take_along_axis(r.seq, np.maximum(r.length[:, None] - 1 - r.steps, 0), 1)
    inside = r.steps < r.length[:, None]
    other = np.cumsum((back != ord("G")) & inside, axis=1)
    bad = ((other > _MOST) | ((other > (r.steps + 1) // _ONE_IN) & (r.steps >= least - 1))) & inside
    stop = np.where(bad.any(axis=1), bad.argmax(axis=1), r.length)
    g = (back == ord("G")) & inside & (r.steps <= stop[:, None])
    last = np.where(g.any(axis=1), r.seq.shape[1] - 1 - g[:, ::-1].argmax(axis=1), 0)
    return np.where((stop >= least) & (r.length > 0), r.length - 1 - last, r.length)


def poly_x(r: Reads, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths after homopolymer tails of any base are cut, and the base's place in POLY_BASES (-1: none)."""
    n, wide = r.seq.shape
    back = np.take_along_axis(r.seq, np.maximum(r.length[:, None] - 1 - r.steps, 0), 1)
    inside = r.steps < r.length[:, None]
    counts = np.stack([np.cumsum(((back == b) | (back == ord("N"))) & inside, axis=1) for b in POLY_BASES])
    allowed = np.minimum(_MOST, (r.steps + 1) // _ONE_IN)
    fits = (r.steps + 1 - counts <= allowed).any(axis=0)
    bad = ~fits & ((r.steps >= _ONE_IN) | (r.steps + 1 >= least - 1)) & inside
    pos = np.where(bad.any(axis=1), bad.argmax(axis=1), r.length)
    seen = np.clip(pos, 0, np.maximum(r.length - 1, 0))
    final = counts[:, np.arange(n), seen]
    base = final.argmax(axis=0)
    # Back to the outermost base of the tail; a place before the read counts as a mismatch.
    own = (back == np.frombuffer(POLY_BASES, np.uint8)[base][:, None]) & inside & (r.steps <= pos[:, None])
    edge = np.where(own.any(axis=1), wide - 1 - own[:, ::-1].argmax(axis=1), -1)
    hit = (pos + 1 >= least) & (r.length > 0)
    return np.where(hit, r.length - edge - 1, r.length), np.where(hit, base, -1)


def window_sums(q: np.ndarray, width: int) -> np.ndarray:
    """The sum of each `width` values from a place on; places without so many get those there are."""
    c = np.concatenate([np.zeros((len(q), 1), np.int64), np.cumsum(q, axis=1, dtype=np.int64)], axis=1)
    return c[:, np.minimum(np.arange(q.shape[1]) + width, q.shape[1])] - c[:, :-1]


@dataclass(frozen=True)
class Cut:
    front: tuple[int, int] | None = None  # window, mean quality
    tail: tuple[int, int] | None = None
    right: tuple[int, int] | None = None


def cut(r: Reads, front: int, tail: int, how: Cut) -> tuple[Reads, np.ndarray, np.ndarray]:
    """Reads after trimming and sliding-window quality cuts, which reads are lost (too short to cut), and what went in front."""
    n, steps, length = len(r.length), r.steps, r.length
    lost, start = np.zeros(n, bool), np.full(n, front)
    left = length - front - tail
    if front or tail:
        lost |= left < 0
    base_n = r.seq == ord("N")
    if how.front:
        w, q = how.front
        lost |= length - start - tail - w <= 0
        good = (window_sums(r.qual, w) >= w * (33 + q)) & (steps >= start[:, None]) & (steps + w < (length - tail)[:, None])
        s = np.where(good.any(axis=1), good.argmax(axis=1), np.maximum(length - tail - w, start))
        s = np.where(s > 0, s + w - 1, s)
        known = ~base_n & (steps >= s[:, None]) & (steps < length[:, None])
        start = np.where(known.any(axis=1), known.argmax(axis=1), np.maximum(length, s))
        left = length - start - tail
    if how.right:
        w, q = how.right
        lost |= length - start - tail - w <= 0
        low = (window_sums(r.qual, w) < w * (33 + q)) & (steps >= start[:, None]) & (steps + w < (length - tail)[:, None])
        found, s = low.any(axis=1), low.argmax(axis=1)
        stop = ((r.qual < 33 + q) | (steps >= (length - 1)[:, None])) & (steps >= s[:, None])
        left = np.where(found, np.where(stop.any(axis=1), stop.argmax(axis=1), length - 1) - start, left)
    elif how.tail:
        w, q = how.tail
        lost |= length - start - tail - w <= 0
        sums = window_sums(r.qual, w)
        first = steps  # of a window that ends at first + w - 1
        good = (sums >= w * (33 + q)) & (first + w - 1 <= (length - tail - 1)[:, None]) & (first - 1 >= start[:, None])
        t = np.where(good.any(axis=1), r.seq.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + w - 1, np.minimum(length - tail - 1, start + w - 1))
        t = np.where(t < length - 1, t - w + 1, t)
        known = ~base_n & (steps <= t[:, None]) & (steps < length[:, None])
        t = np.where(known.any(axis=1), r.seq.shape[1] - 1 - known[:, ::-1].argmax(axis=1), -1)
        left = t - start + 1
    if how != Cut():
        lost |= (left <= 0) | (start >= length - 1)
    start, left = np.where(lost, 0, np.minimum(start, length)), np.where(lost, length, np.maximum(left, 0))
    return r.dropped(start).resized(left), lost, start


@dataclass
class Overlap:
    found: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    diff: np.ndarray
    gap: np.ndarray


def no_overlap(n: int) -> Overlap:
    return Overlap(np.zeros(n, bool), *(np.zeros(n, np.int64) for _ in range(3)), np.zeros(n, bool))


def overlap(r1: Reads, r2: Reads, limit: int = 5, least: int = 30, percent: float = 0.2, gaps: bool = False) -> Overlap:
    """The first offset at which the first mate and the second's reverse complement agree: forward offsets, then backward, then with one gap."""
    parts = [_overlap(r1.rows(p), r2.rows(p), limit, least, percent, gaps) for p in (slice(i, i + _ROWS) for i in range(0, len(r1.length), _ROWS))]
    if len(parts) < 2:
        return parts[0] if parts else no_overlap(0)
    return Overlap(*(np.concatenate(x) for x in zip(*((p.found, p.offset, p.length, p.diff, p.gap) for p in parts), strict=True)))


def _overlap(r1: Reads, r2: Reads, limit: int, least: int, percent: float, gaps: bool) -> Overlap:
    n = len(r1.length)
    out = no_overlap(n)
    a, b = r1, r2.complemented()
    wide = max(a.seq.shape[1], b.seq.shape[1])
    s1, s2 = (np.pad(m, ((0, 0), (0, 2 * wide - m.shape[1]))) for m in (a.seq, b.seq))
    near = min(_PROTECTED, wide)
    ends = max(int(a.length.max(initial=0)) - least, 0), max(int(b.length.max(initial=0)) - least, 0)
    offsets = [*((o, True) for o in range(ends[0])), *((-o, False) for o in range(ends[1]))]
    for gap in (False, True)[: 1 + gaps]:
        rows = np.flatnonzero(~out.found)
        t1, t2 = (np.ascontiguousarray(m[rows].T) for m in (s1, s2))  # a column for each pair
        n1, n2 = a.length[rows], b.length[rows]
        for o, forward in offsets:
            if 4 * np.count_nonzero(~out.found[rows]) < 3 * len(rows):
                keep = np.flatnonzero(~out.found[rows])
                rows, n1, n2 = rows[keep], n1[keep], n2[keep]
                t1, t2 = t1[:, keep], t2[:, keep]
            if not len(rows):
                break
            live = ~out.found[rows] & ((o < n1 - least) if forward else (-o < n2 - least))
            ol = np.minimum(n1 - o, n2) if forward else np.minimum(n1, n2 + o)
            if gap:
                # What the first bases of all offsets told already leaves only overlaps of hardly more bases than those.
                live &= ol - 2 < near
            if not live.any():
                continue
            most = np.minimum(limit, (ol * percent).astype(np.int64))
            at1, at2 = max(o, 0), max(-o, 0)
            wrong = t1[at1 : at1 + near] != t2[at2 : at2 + near]
            # With a gap all but the last two bases must agree as they stand (one_insertion).
            inside = ol - 2 if gap else ol
            if int(inside[live].min()) < near:
                wrong &= np.arange(near)[:, None] < inside
            head = np.add.reduce(wrong.view(np.uint8), axis=0, dtype=np.uint8)
            at = np.flatnonzero(live & (head <= most))
            if not len(at):
                continue
            own, ol, most = rows[at], ol[at], most[at]
            x, y = s1[own, at1 : at1 + wide], s2[own, at2 : at2 + wide]
            if gap:
                d = one_insertion(x, y, ol - 1, most)
                d = np.where(d < 0, one_insertion(y, x, ol - 1, most), d)
                ok = (d >= 0) & (d <= most)
                _note(out, own[ok], o, ol[ok], d[ok], True)
            else:
                _note(out, own, o, ol, ((x != y) & (np.arange(wide) < ol[:, None])).sum(axis=1), False)
    return out


def _note(out: Overlap, rows: np.ndarray, offset: int, length: np.ndarray, diff: np.ndarray, gap: bool) -> None:
    out.found[rows], out.offset[rows], out.length[rows], out.diff[rows], out.gap[rows] = True, offset, length, diff, gap


def one_insertion(longer: np.ndarray, plain: np.ndarray, length: np.ndarray, limit: np.ndarray, first: bool = False) -> np.ndarray:
    """The least mismatches with one base of `longer` left out, -1 where those before some base pass the limit.

    first: it is enough if a place for the base fits before the mismatches pass the limit.
    """
    wide = longer.shape[1]
    steps = np.arange(wide)
    inside = steps < length[:, None]
    left = np.cumsum((longer != plain) & inside, axis=1)
    shifted = np.concatenate([longer[:, 1:], np.zeros_like(longer[:, :1])], axis=1)
    wrong = (shifted != plain) & inside
    right = wrong[:, ::-1].cumsum(axis=1)[:, ::-1]
    last = wrong[np.arange(len(length)), np.clip(length - 1, 0, wide - 1)]
    before = np.concatenate([np.zeros_like(left[:, :1]), left[:, :-1]], axis=1)
    use = inside & (steps >= 1)
    over = np.logical_or.accumulate((before + last[:, None] > limit[:, None]) & use, axis=1)
    best = np.where(use & ~(over & first), before + right, 1 << 30).min(axis=1, initial=1 << 30)
    return np.where((over.any(axis=1) & (not first)) | (best >= 1 << 30), -1, best)


def correct(r1: Reads, r2: Reads, ov: Overlap, good: int = 30, bad: int = 14) -> tuple[Reads, Reads, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Mismatches in overlaps take the base of the mate of good quality where the other's is bad. Also: bases changed in each mate, and (from, to)."""
    s1, q1, s2, q2 = r1.seq.copy(), r1.qual.copy(), r2.seq.copy(), r2.qual.copy()
    n = len(r1.length)
    changed, pairs = np.zeros((2, n), np.int64), []
    rows = np.flatnonzero(ov.found & (ov.diff > 0) & ~ov.gap)
    start1, start2 = np.maximum(0, ov.offset), r2.length - np.maximum(0, -ov.offset) - 1
    for i in range(int(ov.length[rows].max(initial=0))):
        at = rows[ov.length[rows] > i]
        p1, p2 = start1[at] + i, start2[at] - i
        x, y = s1[at, p1], _COMPLEMENT[s2[at, p2]]
        first = (x != y) & (q1[at, p1] >= 33 + good) & (q2[at, p2] <= 33 + bad)
        second = (x != y) & (q2[at, p2] >= 33 + good) & (q1[at, p1] <= 33 + bad) & ~first
        k, a, b = at[first], p1[first], p2[first]
        pairs += zip(s2[k, b].tolist(), _COMPLEMENT[s1[k, a]].tolist(), strict=True)
        s2[k, b], q2[k, b] = _COMPLEMENT[s1[k, a]], q1[k, a]
        changed[1, k] += 1
        k, a, b = at[second], p1[second], p2[second]
        pairs += zip(s1[k, a].tolist(), _COMPLEMENT[s2[k, b]].tolist(), strict=True)
        s1[k, a], q1[k, a] = _COMPLEMENT[s2[k, b]], q2[k, b]
        changed[0, k] += 1
    return Reads(s1, q1, r1.length), Reads(s2, q2, r2.length), changed[0], changed[1], pairs


def adapter_at(r: Reads, adapter: bytes, least: int = 4, literal: bool = False, gaps: bool = True) -> np.ndarray:
    """Where the adapter begins in each read (negative: before it), or the read's length where it does not occur.

    First without gaps, then with one base more in the read, then with one less. literal: the gapped comparisons
    look at the read's start whatever the place, as the tool that this follows does.
    """
    out = r.length.copy()
    if len(adapter) < least:
        return out
    for start in range(0, len(out), _ROWS):
        length = r.length[start : start + _ROWS]
        wide = int(length.max(initial=0)) + len(adapter)
        s = np.zeros((wide, len(length)), np.uint8)  # a column for each read
        s[: r.seq.shape[1]] = r.seq[start : start + _ROWS, :wide].T
        # Beyond a read nothing counts as a mismatch.
        inside = np.arange(wide, dtype=np.int32)[:, None] < length.astype(np.int32)
        wrong = {c: ((s != c) & inside).view(np.uint8) for c in set(adapter)}
        left = np.arange(len(length))
        for kind in ("plain", "more", "less") if gaps else ("plain",):
            if kind == "plain" or not literal:
                at, hit = _adapter_places(wrong, length[left], adapter, least, kind)
            else:
                at, hit = _literal_places(r.seq[start + left], length[left], adapter, least, kind)
            out[start + left[hit]] = at[hit]
            if hit.all():
                break
            if hit.any():
                left = left[~hit]
                wrong = {c: w[:, ~hit] for c, w in wrong.items()}
    return out


def _adapter_places(wrong: dict[int, np.ndarray], length: np.ndarray, adapter: bytes, least: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The first place of the adapter in each read, and whether there is one.

    wrong: for each base of the adapter where a read (a column) has another one. All places are compared at once, base after base
    of the adapter. `gapped` has the least mismatches of a comparison in which the base left out has been passed, which must
    not be the first and not come behind the last base compared.
    """
    alen, at = len(adapter), length.copy()
    begin = (-4 if alen >= 16 else -3 if alen >= 12 else -2 if alen >= 8 else 0) if kind == "plain" else 0
    shorter, size = {"plain": (0, alen), "more": (1, alen), "less": (0, alen - 1)}[kind]
    top = int(length.max(initial=0)) - least - shorter
    if top <= begin:
        return at, np.zeros(len(length), bool)
    length = length.astype(np.int32)
    total = np.zeros((top - begin, len(length)), np.uint16 if alen > 255 else np.uint8)
    if kind == "plain":
        for j, c in enumerate(adapter):
            first = max(begin + j, 0)  # before the read nothing counts
            total[first - j - begin :] += wrong[c][first : max(top + j, first)]
    else:
        so_far, most = wrong[adapter[0]][:top].astype(total.dtype), np.iinfo(total.dtype).max
        closed = np.negative((np.arange(top + size, dtype=np.int32)[:, None] >= length - shorter).astype(total.dtype))
        gapped, spare = total, np.empty_like(total)
        gapped += most // 2
        for j in range(1, size):
            np.minimum(gapped, np.bitwise_or(so_far, closed[j : j + top], out=spare), out=gapped)
            gapped += wrong[adapter[j]][j + 1 : j + 1 + top] if kind == "more" else wrong[adapter[j + 1]][j : j + top]
            so_far += wrong[adapter[j]][j : j + top]
    rest = length - np.arange(begin, top, dtype=np.int32)[:, None] - shorter
    ok = (rest > least) & (total <= (np.minimum(rest, size) >> 3) - (kind != "plain"))
    hit = np.logical_or.reduce(ok, axis=0)
    at[hit] = ok[:, hit].argmax(axis=0) + begin
    return at, hit


def _literal_places(s: np.ndarray, length: np.ndarray, adapter: bytes, least: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The first place for which the read's start fits the adapter with a gap, and whether there is one; only the bases compared depend on the place."""
    alen, n = len(adapter), len(length)
    out, found = length.copy(), np.zeros(n, bool)
    part = np.pad(s, ((0, 0), (0, alen + 2)))[:, : alen + 1]
    whole = np.broadcast_to(np.append(np.frombuffer(adapter, np.uint8), 0), (n, alen + 1)).astype(np.uint8)
    for pos in range(0, int(length.max(initial=0)) - least - (kind == "more")):
        live = np.flatnonzero(~found & (pos < length - least - (kind == "more")))
        if not len(live):
            continue
        size = np.minimum(length[live] - pos - 1, alen) if kind == "more" else np.minimum(length[live] - pos, alen - 1)
        d = one_insertion(*((part[live], whole[live]) if kind == "more" else (whole[live], part[live])), size, size // 8 - 1, True)
        hit = live[(d >= 0) & (d <= size // 8 - 1)]
        out[hit], found[hit] = pos, True
    return out, found


def adapters_least(n: int) -> int:
    """Bases that must match when n adapters are tried one after the other."""
    return 4 + (n > 16) + (n > 256)


def classify(r: Reads, o) -> np.ndarray:
    """The first rule each read breaks, as a code of RESULTS (0: none). o: Options."""
    n, steps = r.length, r.steps
    inside = steps < n[:, None]
    code = np.zeros(len(n), np.int64)
    if o.length_filter:
        code = np.where((o.length_limit > 0) & (n > o.length_limit), 17, code)
        code = np.where(n < o.length_required, 16, code)
    if o.quality_filter:
        low = ((r.qual < 33 + o.qualified_quality) & inside).sum(axis=1)
        many_n = (r.seq == ord("N")).sum(axis=1)
        quality = low > o.unqualified_percent * n / 100.0
        mean = (r.qual.astype(np.int64) - 33 * inside).sum(axis=1) // np.maximum(n, 1)
        quality = quality | ((o.average_quality > 0) & (mean < o.average_quality))
        code = np.where(many_n > o.n_base_limit, 12, code)
        code = np.where(quality, 20, code)
    if o.complexity_filter:
        change = ((r.seq[:, 1:] != r.seq[:, :-1]) & inside[:, 1:]).sum(axis=1)
        code = np.where((code == 0) & ((n <= 1) | (change / np.maximum(n - 1, 1) < o.complexity_percent / 100.0)), 24, code)
    return np.where(n == 0, 16, code)
