"""The share of duplicates without moving keys: bit filters of fixed size that tasks make and that merge as a tree.

A key's hash sets one bit of a filter of 2**bits. Filter j takes only keys whose hash begins with j zero bits, a 2**-j
part of them, with all their reads, so that whatever the number of reads some filter is neither empty nor full. From
the bits that are set follows how many different keys there were (linear counting), and from that and the
number of reads the share of duplicates. A filter that is nearly full in a task is given up there, and so in
whatever it is merged with.

Level n of the option `dup_calc_accuracy` has filters of 2**(19 + n) bits: 128 KB to 4 MB each, of which a task keeps those that
are not full. The standard error of the rate is about 2**-(bits / 2), so 0.1 % at level 1 and 0.02 % at level 6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from strandflow.functions.expressions import duplicate_key

LEVELS = {level: 19 + level for level in range(1, 7)}
#: Filters, and bits set of all from which on one is given up in a task, and from which on one is not counted from.
SCALES, FULL, USED = 40, 0.99, 0.86
#: Bytes of filters that a task holds before it sends them, and filters that are merged at a time.
HELD, FAN = 64 << 20, 16
_SCHEMA = "sample string, scale int, part int, reads long, bits binary"


def key_hash(seqs: list[str]) -> Column:
    """60 bits of the digest of a read's sequences."""
    return F.conv(F.substring(F.sha2(duplicate_key(*(F.col(s) for s in seqs)), 256), 1, 15), 16, 10).cast("long")


def filters(df: DataFrame, seqs: list[str], bits: int) -> DataFrame:
    """sample, scale, reads and ones (bits set; null: given up as nearly full) of each filter that keys fell into."""
    size = 1 << bits
    of = F.col("sample") if "sample" in df.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            names = b.column(0).fill_null("").dictionary_encode()
            which = names.indices.to_numpy()
            hashes = b.column(1).to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = hashes[which == i]
                zeros = SCALES - np.frexp((own >> (60 - SCALES)).astype(np.float64))[1]  # frexp: binary digits
                for scale in range(int(zeros.max()) + 1):
                    held.setdefault((name, scale), Filter(size)).add((own[zeros >= scale] & (size - 1)).astype(np.uint32))
            if sum(f.held() for f in held.values()) > HELD:
                yield from rows(part, held)
                held = {}
        yield from rows(part, held)

    def rows(part: int, held: dict) -> Iterator[pa.RecordBatch]:
        for (name, scale), f in held.items():
            yield pa.RecordBatch.from_pydict(_row(name, scale, part, f))

    def merge(t: pa.Table) -> pa.Table:
        f = Filter(size)
        for reads, sent in zip(t.column("reads").to_pylist(), t.column("bits").to_pylist(), strict=True):
            f.take(reads, sent)
        return pa.table(_row(t.column("sample")[0].as_py(), t.column("scale")[0].as_py(), t.column("part")[0].as_py() // FAN, f))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ones = [None if x is None else _ones(x) for x in b.column("bits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sample"), b.column("scale"), b.column("reads"), pa.array(ones, pa.int64())], names=["sample", "scale", "reads", "ones"])

    d = df.select(of.alias("sample"), key_hash(seqs).alias("h")).where(F.col("h").isNotNull())
    parts = d.rdd.getNumPartitions()
    d = d.mapInArrow(run, _SCHEMA)
    while True:  # rows of one part after the other, FAN at a time
        d = d.groupBy("sample", "scale", F.expr(f"part div {FAN}").alias("of")).applyInArrow(merge, _SCHEMA)
        if parts <= FAN:
            return d.mapInArrow(counted, "sample string, scale int, reads long, ones long")
        parts = -(-parts // FAN)


class Filter:
    """Reads, and the bits that their keys set: as their places while they are few, then as bits, then given up as nearly full."""

    def __init__(self, size: int):
        self.size, self.reads, self.full = size, 0, False
        self.places: list[np.ndarray] = []
        self.bits: np.ndarray | None = None

    def held(self) -> int:
        return sum(p.nbytes for p in self.places) + (0 if self.bits is None else self.bits.nbytes)

    def add(self, places: np.ndarray) -> None:
        self.reads += len(places)
        self._set(places)

    def _set(self, places: np.ndarray) -> None:
        if self.full:
            return
        self.places.append(places)
        if self.bits is None and 4 * sum(map(len, self.places)) * 8 > self.size:
            self.bits = np.zeros(-(-self.size // 8), np.uint8)
        if self.bits is not None:
            p = np.unique(np.concatenate(self.places))
            np.bitwise_or.at(self.bits, p >> 3, (128 >> (p & 7)).astype(np.uint8))
            self.places = []
            self._look()

    def _look(self) -> None:
        if self.reads > 2 * self.size and np.bitwise_count(self.bits).sum() > FULL * self.size:
            self.full, self.bits = True, None

    def take(self, reads: int, sent: bytes | None) -> None:
        """What another filter has sent."""
        self.reads += reads
        if sent is None:
            self.full, self.bits, self.places = True, None, []
        elif sent[:1] == b"p":
            self._set(np.frombuffer(sent, "<u4", offset=1))
        elif not self.full:
            if self.bits is None:
                self.bits = np.zeros(-(-self.size // 8), np.uint8)
            self.bits |= np.frombuffer(sent, np.uint8, offset=1)
            self._look()

    def sent(self) -> bytes | None:
        if self.full:
            return None
        if self.bits is not None:
            if self.places:
                self._set(np.zeros(0, np.uint32))
            return None if self.full else b"b" + self.bits.tobytes()
        return b"p" + np.unique(np.concatenate([np.zeros(0, np.uint32), *self.places])).astype("<u4").tobytes()


def _ones(sent: bytes) -> int:
    return len(sent) // 4 if sent[:1] == b"p" else int(np.bitwise_count(np.frombuffer(sent, np.uint8, offset=1)).sum())


def _row(sample: str, scale: int, part: int, f: Filter) -> dict[str, pa.Array]:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return {c.split()[0]: pa.array([v], k) for c, v, k in zip(_SCHEMA.split(", "), (sample, scale, part, f.reads, f.sent()), kinds, strict=True)}


def used(rows: list, bits: int) -> tuple[Row | None, float]:
    """Of one sample's filters the fullest that is not too full, and the share of duplicates that it tells."""
    for r in sorted(rows, key=lambda r: r.scale):
        if r.ones is not None and r.ones <= USED * (1 << bits):
            keys = -(1 << bits) * math.log1p(-r.ones / (1 << bits))
            return r, min(max(1 - keys / r.reads, 0.0), 1.0)
    return None, 0.0


def approximate_rates(df: DataFrame, seqs: list[str], level: int) -> dict[str, float]:
    """The share of duplicates of each sample ('' without a column `sample`), nearly. A sample without reads is not there.

    Where all filters are too full, as when few keys are nearly all reads, the highest are those of some keys only or of none; then it is 0.
    """
    of: dict[str, list] = {}
    for r in filters(df, seqs, LEVELS[level]).collect():  # at most SCALES + 1 rows of numbers for a sample
        of.setdefault(r["sample"], []).append(r)
    return {s: used(rows, LEVELS[level])[1] for s, rows in of.items()}
