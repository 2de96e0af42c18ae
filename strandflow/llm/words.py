"""Words `[^\\x20\\x09-\\x0D]+` of whole Arrow batches and 64-bit hashes of them, by numpy over the UTF-8 bytes.

White space here is ASCII only, so no byte of a longer UTF-8 sequence is taken for it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from strandflow.llm.common import utf8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
#: Words over so many bytes are hashed by themselves.
_LONG = 48
#: Bytes that gather() copies at a time.
_AT_ONCE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache
def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers that depend on the seed only."""
    base = (seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64
    steps = np.array([(base + i * 0x9E3779B97F4A7C15) % 2**64 for i in range(1, n + 1)], np.uint64)
    return mix(steps) | _U(1)


def gather(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of these places, a blank behind each, and where each begins; some bytes at a time, as the places of bytes take eight times their room."""
    size = length + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(to[-1]), np.uint8)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(to, to[i] + _AT_ONCE, "right")) - 1)
        place = np.repeat(starts[i:j] - to[i:j] + to[i], size[i:j])
        place += np.arange(len(place))
        out[to[i] : to[j]] = data[np.minimum(place, len(data) - 1, out=place)]
        i = j
    out[to[1:] - 1] = 0x20
    return out, to


class Words:
    """starts, ends: byte places of the words of all rows; first: the index of each row's first word, and the total."""

    def __init__(self, column):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        word = ~_SPACE[self.data]
        begin, close = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        close[:-1] &= ~word[1:]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = word[inner]
        close[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        length = self.ends - self.starts
        h = length.astype(np.uint64)
        order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
        from_long = int(np.count_nonzero(length > _LONG))
        short = order[from_long:]
        at, left = self.starts[short], length[short]
        letters = constants(256, 7)
        acc = left.astype(np.uint64)
        for j in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -j, "left"))  # words with more than j bytes come first
            part = acc[:m]
            part *= _U(0x9FB21C651E98DF25)
            part += letters[self.data[at[:m] + j]]
            part ^= part >> _U(29)
        h[short] = acc
        for i in order[:from_long]:
            h[i] = long_hash(self.data[self.starts[i] : self.ends[i]].tobytes())
        return mix(h)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Every row's words joined by one space: the bytes of all rows and the rows' offsets."""
        return self.keep(np.ones(len(self.starts), bool))

    def keep(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As joined(), with the words of mask only."""
        starts, length = self.starts[mask], (self.ends - self.starts)[mask]
        row_of = np.repeat(np.arange(len(self.first) - 1), self.counts)[mask]
        out, to = gather(self.data, starts, length)
        at = to[np.searchsorted(row_of, np.arange(len(self.first)))]
        return out, at  # each row with words ends in one space, which texts() leaves out

    def texts(self, mask: np.ndarray | None = None) -> list[bytes]:
        data, at = self.joined() if mask is None else self.keep(mask)
        return [data[a : b - 1].tobytes() if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


def long_hash(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def window_hashes(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of `size` entries of h (as many as fit), by joining runs of doubling length."""
    a, b = constants(2, seed)
    power, width, have, done = h, 1, None, 0
    left = size
    while left:
        if left & 1:
            if have is None:
                have = power
            else:
                n = min(len(have), len(power) - done)
                have = mix(have[: max(n, 0)] * a + power[done : done + max(n, 0)] * b)
            done += width
        left >>= 1
        if left:
            n = max(len(power) - width, 0)
            power = mix(power[:n] * a + power[width : width + n] * b + _U(width))
            width *= 2
    return have[: max(len(h) - size + 1, 0)]


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` entries the place of its least, the leftmost of equals."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        x, y = best[:m], best[step:]
        best = np.where(v[x] <= v[y], x, y)
        have += step
    return best[:n]
