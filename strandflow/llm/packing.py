"""Packing documents into sequences of at most `capacity` tokens by bounded-space online best-fit.

A document's ids end in the end token. Only a longer document is cut, into pieces of `capacity` tokens of which
the first may be shorter. Pieces are dealt over tasks in turn, whatever their ids, and each task packs what it gets in
the order of a hash, through a reordering buffer: of every `BLOCK` pieces the longest come first (which leaves 0.2 %
more sequences than the tokens fill, against 0.8 % without). It has at most `open_bins` open bins, in stacks by free
space, and a bitset of the free spaces that occur: a piece goes into the fullest bin it fits, found by the lowest set
bit at or above its length; if it fits none a bin is opened, for which, when all are open, the fullest is closed first.

Only ids' lengths and checksums are shuffled. The number of tasks follows the amount of that, so that few bins
stay open at the end for the pieces there are.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each by itself; an empty
table gives no sequences; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm import bpe
from strandflow.llm.common import batch_of, id_text, map_batches

CAPACITY, END_ID, OPEN_BINS = 1024, 2, 2048
#: Pieces that are put in order of length before they arrive.
BLOCK = 1024


class BestFit:
    """Bounded-space online best-fit; place() returns a bin's number and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest: the least free space
            number, free = self.made, self.capacity
            self.made += 1
        if free > length:
            self.stacks[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        self.open -= 1
        if not stack:
            self.bits &= ~(1 << free)
        return number


def pieces(docs: DataFrame, ranks: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = bpe.encoder(ranks).encode
        row, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encode(text) + tail
            n = len(ids) // 4
            stops = range(n % capacity or capacity, n + 1, capacity)
            at = 0
            for k, stop in enumerate(stops):
                part = ids[4 * at : 4 * stop]
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(stop - at)
                crc.append(zlib.crc32(part))
                if with_ids:
                    kept.append(part)
                at = stop
        out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32())}
        out |= {n: pa.array(c, pa.int64()) for n, c in (("start", start), ("length", length), ("ids_crc32", crc))}
        return batch_of(**out, **({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    # Workers outlive the stage: entries left in the cache would stay beside whatever runs in them next.
    return map_batches(id_text(docs), run, schema, lambda: bpe.encoder(ranks).clear())


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset."""
    names = cut.columns
    dealt = cut.hint("rebalance").withColumn("turn", F.xxhash64("doc_id", "ids_crc32")).sortWithinPartitions("turn", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for block in blocks(batches, BLOCK):
            length = block.column("length").to_numpy()
            ids, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for i in np.argsort(-length, kind="stable").tolist():
                number, offsets[i] = bins.place(int(length[i]))
                ids[i] = base + number
            yield batch_of(**{c: block.column(c) for c in names}, sequence_id=pa.array(ids), offset=pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows`, the last of fewer."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            yield _joined([*held, b.slice(0, rows - n)])
            b, held, n = b.slice(rows - n), [], 0
        held.append(b)
        n += b.num_rows
    if n:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    return t.to_batches()[0] if t.num_rows else parts[0]


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids (little-endian unsigned 32-bit) from packed pieces that have their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"))
