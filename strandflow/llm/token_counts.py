"""Token counts that follow edits.

For each document a segment tree is kept over its pre-tokens. A leaf holds the lengths and token counts of some
`LEAF` pre-tokens, each node the sums of its two children (tokens, characters, pre-tokens), the root the document's.
Trees are a binary column beside the text, so they are stored and edited again: `build_trees` makes them,
`apply_edits` takes and returns them.

Edits touch only what they must: pre-tokens are split and encoded again from a boundary `_LOOK` characters before an
edit (text before it cannot see the edit) to the first boundary behind it that the old split has too; from there on
both splits read the same characters. The new pre-tokens replace the old ones in their leaves, whose sums go up to
the root. Only where leaves overflow are they dealt out anew, without encoding.

Edits are (start, stop, replacement) in characters of the text before them, in order and not overlapping. Of a row whose edits
are not so (a null edit, a null, negative or reversed place, one behind the text's end or before the edit before) none is applied: its
text, tree and counts stay, n_edits is 0 and `error` says why. In other rows `error` is null; a null replacement is empty.

Defined cases: a null text counts as empty (no tokens, no edits); an insertion has start = stop; repeated rows
are counted each by itself; columns besides doc_id, text (and edits, tree) are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm import bpe
from strandflow.llm.common import batch_of, id_text, map_batches

LEAF = 64
#: A contraction looks two characters ahead, the white-space rule one.
_LOOK = 3
TOKENS, CHARS, PIECES = 0, 1, 2

Edit = tuple[int, int, str]


class CountTree:
    """leaves: lengths and token counts of runs of pre-tokens; sums: the tree, node i over 2i and 2i + 1, the root at 1."""

    def __init__(self, text: str, enc: bpe.Encoder, stored: bytes | None = None):
        self.enc, self.text = enc, text
        if stored is None:
            found = bpe.pieces(text)
            self.encoded = len(found)
            self._plant(*self._measure(found))
        else:
            self.encoded = 0
            self._plant(*_unpacked(stored))

    def _measure(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = len(found)
        return np.fromiter(map(len, found), np.int64, n), np.fromiter(map(len, map(self.enc.__getitem__, found)), np.int64, n) // 4

    def _plant(self, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Deal pre-tokens out over leaves and sum up."""
        at = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[a : a + LEAF], tokens[a : a + LEAF]) for a in at]
        self.width = 1 << (len(at) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 3), np.int64)
        if len(lengths):
            own = self.sums[self.width : self.width + len(at)]
            own[:, TOKENS], own[:, CHARS] = np.add.reduceat(tokens, at), np.add.reduceat(lengths, at)
            own[:, PIECES] = np.diff([*at, len(lengths)])
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    def _put(self, leaf: int, lengths: np.ndarray, tokens: np.ndarray) -> None:
        self.leaves[leaf] = lengths, tokens
        i = self.width + leaf
        more = np.array([tokens.sum(), lengths.sum(), len(lengths)]) - self.sums[i]
        while i:
            self.sums[i] += more
            i //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1, TOKENS])

    @property
    def pieces(self) -> int:
        return int(self.sums[1, PIECES])

    def pack(self) -> bytes:
        """The tree as bytes: the pre-tokens' lengths and counts; sums follow from them."""
        return b"".join(_packed(np.concatenate([x[i] for x in self.leaves])) for i in (0, 1))

    def _leaf(self, at: int, unit: int) -> tuple[int, np.ndarray]:
        """The leaf in which the unit numbered `at` lies (the last one that has any if it is beyond the end), and the sums before it."""
        i, before = 1, np.zeros(3, np.int64)
        while i < self.width:
            i *= 2
            if at - before[unit] >= self.sums[i, unit] and self.sums[i + 1, PIECES]:
                before = before + self.sums[i]
                i += 1
        return i - self.width, before

    def _boundary(self, at: int) -> tuple[int, int]:
        """How many pre-tokens end at `at` or before, and where the last of them ends."""
        leaf, before = self._leaf(at, CHARS)
        ends = before[CHARS] + np.cumsum(self.leaves[leaf][0])
        n = int(np.searchsorted(ends, at, "right"))
        return int(before[PIECES]) + n, int(ends[n - 1] if n else before[CHARS])

    def edit(self, edits: list[Edit]) -> int:
        """Apply edits to the text; leaves and sums follow. Returns the number of pre-tokens encoded again."""
        text, shifts, at = [], [], 0
        for start, stop, put in edits:
            if start < at or stop < start or stop > len(self.text):
                raise ValueError("edits must lie in order within the text and not overlap")
            text += [self.text[at:start], put]
            at = stop
            shifts.append((shifts[-1] if shifts else 0) + len(put) - (stop - start))
        new, splices, k = "".join([*text, self.text[at:]]), [], 0
        while k < len(edits):
            first, begin = self._boundary(edits[k][0] - _LOOK)
            fresh, p, last = [], begin + (shifts[k - 1] if k else 0), self.pieces
            for piece in self._from(new, p):
                fresh.append(piece)
                p += len(piece)
                while k + 1 < len(edits) and edits[k + 1][0] - _LOOK < p - shifts[k]:
                    k += 1  # the next edit is reached before the splits agree
                q = p - shifts[k]
                if q >= edits[k][1]:
                    index, end = self._boundary(q)
                    if end == q:
                        last = index
                        break
            else:
                k = len(edits)  # the text ends before the splits agree
            splices.append((first, last, *self._measure(fresh)))
            k += 1
        for splice in reversed(splices):
            self._splice(*splice)
        again = sum(len(s[2]) for s in splices)
        self.encoded += again
        self.text = new
        return again

    def _splice(self, first: int, last: int, lengths: np.ndarray, tokens: np.ndarray) -> None:
        """Put other pre-tokens in the place of those from first to last."""
        a, before = self._leaf(first, PIECES)
        b, until = self._leaf(max(last - 1, first), PIECES)
        head, tail = first - int(before[PIECES]), last - int(until[PIECES])
        both = [np.concatenate([self.leaves[a][i][:head], x, self.leaves[b][i][tail:]]) for i, x in enumerate((lengths, tokens))]
        n, share = b - a + 1, -(-len(both[0]) // (b - a + 1))
        for j in range(n):
            self._put(a + j, *(x[j * share : (j + 1) * share] for x in both))
        if share > 4 * LEAF:
            self._plant(*(np.concatenate([x[i] for x in self.leaves]) for i in (0, 1)))

    @staticmethod
    def _from(text: str, at: int):
        """Pre-tokens from a boundary on, in growing windows so that a short region costs little."""
        size = 256
        while at < len(text):
            window = text[at : at + size]
            found = bpe.pieces(window)
            if at + size < len(text):
                keep, n = 0, 0
                for p in found:
                    if n + len(p) > len(window) - _LOOK - 1:
                        break
                    n += len(p)
                    keep += 1
                found = found[:keep]
                if not found:
                    size *= 2
                    continue
            for p in found:
                yield p
                at += len(p)
            size *= 2


_EMAIL = re.compile(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"\+?\d[\d().-]{6,}\d")


def redactions(text: str) -> list[Edit]:
    """E-mail addresses and long numbers, each with its placeholder: the edits of the registered query."""
    found = [(m.start(), m.end(), "<email>") for m in _EMAIL.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end(), "<number>") for m in _NUMBER.finditer(text)]
    out: list[Edit] = []
    for e in sorted(found):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """The width in bytes, how many there are, and the numbers in as few bytes each as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << (8 * w))
    return np.array([width, len(numbers)], "<u4").tobytes() + numbers.astype(f"<u{width}").tobytes()


def _unpacked(stored: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(2):
        width, n = np.frombuffer(stored, "<u4", 2, at).tolist()
        out.append(np.frombuffer(stored, f"<u{width}", n, at + 8).astype(np.int64))
        at += 8 + width * n
    return out


def fault(edits: list[tuple[int | None, int | None, str]], length: int) -> str | None:
    """Why edits cannot be applied to a text of so many characters; None if they can."""
    at = 0
    for k, (start, stop, _) in enumerate(edits):
        if start is None or stop is None:
            return f"edit {k} has no place"
        if start < 0 or stop < start:
            return f"edit {k} ends before it starts or starts before the text"
        if stop > length:
            return f"edit {k} ends behind the text"
        if start < at:
            return f"edit {k} starts before the end of the one before"
        at = stop
    return None


def build_trees(docs: DataFrame, ranks: str, *more: str) -> DataFrame:
    """doc_id, text, tree and n_tokens of every row, and the columns `more` of docs."""
    d = id_text(docs, *more)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = bpe.encoder(ranks)
        trees = [CountTree(t, enc) for t in batch.column("text").to_pylist()]
        own = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", *more)}
        return batch_of(**own, tree=pa.array([t.pack() for t in trees], pa.binary()), n_tokens=pa.array([t.total for t in trees], pa.int64()))

    kinds = dict(d.dtypes)
    return map_batches(d, run, "doc_id long, text string, " + "".join(f"{c} {kinds[c]}, " for c in more) + "tree binary, n_tokens long")


def apply_edits(trees: DataFrame, ranks: str, edits_of: Callable[[str], list[Edit]] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_pieces, n_reencoded, the edited text, its tree and error, of rows with text and tree.

    Edits come from the column edits array<struct<start: int, stop: int, put: string>> (null: none), or from edits_of(text).
    """
    own = edits_of is None
    d = trees.select("doc_id", "text", "tree", *(["edits"] if own else []))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = bpe.encoder(ranks), []
        given = batch.column("edits").to_pylist() if own else None
        for i, (text, stored) in enumerate(zip(batch.column("text").to_pylist(), batch.column("tree").to_pylist(), strict=True)):
            edits = [(e["start"], e["stop"], e["put"] or "") if e else (None, None, "") for e in given[i] or []] if own else edits_of(text)
            error = fault(edits, len(text))
            edits = [] if error else edits
            tree = CountTree(text, enc, stored)
            before, pieces = tree.total, tree.pieces
            again = tree.edit(edits)
            rows.append((before, len(edits), tree.total, pieces, again, tree.text, tree.pack() if edits else stored, error))
        cols = list(zip(*rows, strict=True))
        numbers = {n: pa.array(c, pa.int64()) for n, c in zip(("n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_reencoded"), cols, strict=False)}
        return batch_of(doc_id=batch.column("doc_id"), **numbers, text=pa.array(cols[5], pa.string()), tree=pa.array(cols[6], pa.binary()), error=pa.array(cols[7], pa.string()))

    return map_batches(d, run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_pieces long, n_reencoded long, text string, tree binary, error string")


def count_after_edits(docs: DataFrame, ranks: str, edits_of: Callable[[str], list[Edit]] | None = redactions) -> DataFrame:
    """What apply_edits returns for trees built from docs; if edits_of is None docs has the column edits."""
    more = ("edits",) if edits_of is None else ()
    return apply_edits(build_trees(docs, ranks, *more), ranks, edits_of)
