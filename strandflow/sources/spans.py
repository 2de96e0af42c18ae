"""Large FASTQ files by many tasks: an index of places, and ranges of records that tasks read.

A first pass reads the file in spans of bytes, a task each. It counts line ends, notes how many there are before each chunk (`marks`), and
looks whether the records that begin in the span are whole, for any place in a record that its first line may have. From the
counts of all spans follows which place it was; a file with a broken or odd record is left to one task. If only the first records are
wanted, spans are looked at in waves, each twice as many as before, until there are enough.

A range of records is read from the last mark before it. So tasks read the same range of two files side by side, or of one file with
both mates, and nothing is shuffled. Lines become Arrow columns by their offsets, without a Python string for each.

Plain files and gzip files of blocks that state their sizes can be read so. A gzip file packed in one go is looked at by one task, which
writes restart points (module `restart`); the marks are these points, and ranges are read by many tasks as well.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandflow.plans.session import shared_dir
from strandflow.sources import restart
from strandflow.sources.places import file_system

#: Bytes of a chunk, unpacked, before which line ends are counted.
CHUNK = 1 << 20
#: The first bytes of a gzip block that states its size.
_BLOCK = b"\x1f\x8b\x08\x04"
RECORD = ("name", "seq", "strand", "qual")


def block_size(head: bytes) -> int:
    """The bytes of the gzip block with this head; 0 if it does not state them."""
    if len(head) < 18 or not head.startswith(_BLOCK) or head[10:16] != b"\x06\x00BC\x02\x00":
        return 0
    return int.from_bytes(head[16:18], "little") + 1


def _first_block(f, start: int, size: int) -> int | None:
    """The place of the first block from `start` on: a head behind which another follows, or the file's end."""
    f.seek(start)
    data = f.read(1 << 17)
    at = data.find(_BLOCK)
    while at >= 0:
        length = block_size(data[at : at + 18])
        if length and (start + at + length == size or block_size(data[at + length : at + length + 18])):
            return start + at
        at = data.find(_BLOCK, at + 1)
    return None


def chunks(path: str, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """What the file has from `start` on, in unpacked chunks with the places they begin at; no chunk has something of both sides of `stop`."""
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        stop = size if stop is None else stop
        if not path.endswith(".gz"):
            at = start
            f.seek(at)
            while data := f.read(min(CHUNK, stop - at) if at < stop else CHUNK):
                yield at, data
                at += len(data)
            return
        at = _first_block(f, start, size)
        while at is not None and at < size:
            begin, parts, n, edge = at, [], 0, stop if at < stop else size
            f.seek(at)
            packed = f.read(CHUNK)  # more than blocks of a chunk take, mostly
            while at < edge and n < CHUNK:
                if at + (1 << 16) + 18 > begin + len(packed) < size:
                    break
                length = block_size(packed[at - begin : at - begin + 18])
                if not length:
                    raise ValueError(f"no gzip block at {at}")
                parts.append(zlib.decompress(packed[at - begin : at - begin + length], wbits=31))
                n += len(parts[-1])
                at += length
            if n:
                yield begin, b"".join(parts)


@dataclass
class Look:
    """What the first pass saw of a span: line ends, bytes, whether the last byte ends a line, marks, and for each place of the first line whether records are whole."""

    ends: int
    size: int
    ended: bool
    marks: list[tuple[int, int]]
    whole: list[bool]


def look(path: str, start: int, stop: int) -> Look:
    """The first pass over a span of bytes."""
    return _look(chunks(path, start, stop), stop)


def _look(found: Iterator[tuple[int, bytes]], stop: int) -> Look:
    """The same of chunks with their places, of which those at `stop` and behind belong to the next span; a place of -1 is no mark."""
    sizes, firsts = [], []  # of the lines, the first may have begun before the span
    marks, ends, size, own_lines, behind = [], 0, 0, 1, 0
    held, first, last = 0, -1, -1  # of the line that has not ended yet: bytes, first and last byte
    odd = ended = False
    for place, data in found:
        if 0 <= place < stop:
            marks.append((place, ends))
        a = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(a == 0x0A)
        returns = np.flatnonzero(a == 0x0D)
        # A carriage return counts only before a line end; alone it would be one in a file that is read in one go.
        odd |= bool((a[returns[returns + 1 < len(a)] + 1] != 0x0A).any()) or (last == 0x0D and a[0] != 0x0A)
        if len(at):
            begin = np.concatenate([[0], at[:-1] + 1])
            n, head = (at - begin).astype(np.int64), np.where(at > begin, a[np.minimum(begin, len(a) - 1)], -1).astype(np.int16)
            tail = np.where(at > begin, a[at - 1], -1)
            if held:
                head[0], n[0], tail[0] = first, n[0] + held, tail[0] if n[0] else last
            n -= (tail == 0x0D) & (n > 0)
            sizes.append(n)
            firsts.append(head)
            held, first = 0, -1
        rest = len(a) - (int(at[-1]) + 1 if len(at) else 0)
        if rest:
            first = first if held else int(a[len(a) - rest])
            held += rest
        last = int(a[-1])
        if place < stop:
            ends, size, ended = ends + len(at), size + len(a), last == 0x0A
            own_lines = 1 + ends - ended
        else:
            behind += len(at)
            if behind >= 8:
                break
    else:
        if held:
            sizes.append(np.array([held - (last == 0x0D)]))
            firsts.append(np.array([first], np.int16))
    n, head = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, firsts))
    return Look(ends, size, ended, marks, [not odd and _whole(n, head, own_lines, at_line, phase) for at_line in (False, True) for phase in range(4)])


def _whole(n: np.ndarray, head: np.ndarray, own: int, at_line: bool, phase: int) -> bool:
    """Whether each record that begins in the span is whole, if the first line that begins in it is number `phase` of its record."""
    start = (not at_line) + (4 - phase) % 4
    records = max(0, -(-(own - start) // 4))
    n, head = n[start : start + 4 * records], head[start : start + 4 * records]
    if len(n) < 4 * records - 1:
        return False
    if len(n) < 4 * records:  # an empty last line
        n, head = np.append(n, 0), np.append(head, -1)
    return bool((head[::4] == ord("@")).all() and (head[2::4] == ord("+")).all() and (n[1::4] == n[3::4]).all())


@dataclass
class Index:
    """Marks (place, line ends before it) of a file and its number of lines; or of its beginning, where no more was wanted."""

    path: str
    marks: list[tuple[int, int]]
    lines: int
    size: int
    points: str = ""  # the file of restart points that the marks are numbers of

    def before(self, line: int) -> tuple[int, int]:
        """A place to read from and the line ends to pass over until the line begins."""
        at = int(np.searchsorted([n for _, n in self.marks], line)) - 1 if line else 0
        place, ends = self.marks[max(at, 0)]
        return place, line - ends


def index(spark: SparkSession, path: str, span: int, lines: int = 0) -> Index | None:
    """The index of a file, or of so many lines of it at least; None if it is small, packed in one go or irregular."""
    system, inner = file_system(path)
    size = system.get_file_info(inner).size
    if not size or size <= span:
        return None
    with system.open_input_file(inner) as f:
        if path.endswith(".gz") and not block_size(f.read(18)):
            return None if lines else _restarts(spark, path, span, size)
    starts = list(range(0, size, span))
    marks, ends, ended, done, wave = [], 0, True, 0, 1 if lines else len(starts)
    while done < len(starts) and (not lines or ends < lines):
        for r in _looked(spark, path, starts[done : done + wave], span, size):
            line = ends if ended else ends + 1  # the number of the first line that begins in the span
            if r.size and not r.whole[4 * ended + line % 4]:
                return None
            marks += [(place, ends + n) for place, n in r.marks]
            ends, ended = ends + r.ends, r.ended if r.size else ended
        done, wave = done + wave, 2 * wave
    return Index(path, marks, ends + (not ended), size)


def _restarts(spark: SparkSession, path: str, span: int, size: int) -> Index | None:
    """The index of a file packed in one go, by one task that unpacks it; its points are some of the span's length apart."""
    if not restart.available():
        return None
    points = shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _ in range(b.num_rows):
                # Points under a name of this attempt's own.
                from pyspark import TaskContext

                own = f"{points}/points-{TaskContext.get().taskAttemptId()}"
                try:
                    s = _look(restart.unpack(path, own, span), 1 << 62)
                except zlib.error:  # what one task reads up to the error, as it does with any broken file
                    s = Look(0, 0, True, [], [False] * 8)
                cols = [pa.array([own]), pa.array([json.dumps([s.ends, s.size, s.ended, s.marks, s.whole])])]
                yield pa.RecordBatch.from_arrays(cols, names=["points", "look"])

    row = spark.range(0, 1, 1, 1).mapInArrow(run, "points string, look string").first()
    s = Look(*json.loads(row.look))
    if not s.size or not s.whole[4]:  # a line begins with the file, the first of its record
        return None
    return Index(path, s.marks, s.ends + (not s.ended), size, row.points)


def _looked(spark: SparkSession, path: str, starts: list[int], span: int, size: int) -> list[Look]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in b.column(0).to_pylist():
                s = look(path, start, min(start + span, size))
                cols = [pa.array([start]), pa.array([json.dumps([s.ends, s.size, s.ended, s.marks, s.whole])])]
                yield pa.RecordBatch.from_arrays(cols, names=["start", "look"])

    parts = spark.createDataFrame([(s,) for s in starts], "start long").repartition(len(starts), "start")
    rows = sorted(parts.mapInArrow(run, "start long, look string").collect())  # places only, one for each chunk
    return [Look(*json.loads(r.look)) for r in rows]


def lines_from(path: str, place: int, skip: int, count: int, width: int, points: str = "") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes with the begins and ends of lines, some of `count` lines at a time, always a multiple of `width`; lines behind the file's end are empty."""
    carry, left = b"", count
    for data in restart.resumed(path, points, place) if points else (x for _, x in chunks(path, place)):
        if skip:
            at = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
            if len(at) < skip:
                skip -= len(at)
                continue
            data, skip = data[int(at[skip - 1]) + 1 :], 0
        data = carry + data
        a = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(a == 0x0A)
        n = min(len(at) // width * width, left)
        if n:
            yield _lines(a, at[:n])
            left -= n
            data = data[int(at[n - 1]) + 1 :]
        if not left:
            return
        carry = data
    if left and carry:
        data = carry + b"\n" * (left - carry.count(b"\n"))
        a = np.frombuffer(data, np.uint8)
        yield _lines(a, np.flatnonzero(a == 0x0A)[:left])


def _lines(a: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin = np.concatenate([[0], ends[:-1] + 1])
    return a, begin, ends - ((ends > begin) & (a[np.maximum(ends - 1, 0)] == 0x0D))


def columns(a: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> list[pa.Array]:
    """Each width-th line as a column; bytes are read as Latin-1."""
    out = []
    for c in range(width):
        b, n = begin[c::width], (end - begin)[c::width]
        at = np.concatenate([[0], np.cumsum(n)])
        data = a[np.repeat(b - at[:-1], n) + np.arange(at[-1])]
        if (data >= 0x80).any():
            out.append(pa.array([a[x : x + y].tobytes().decode("latin-1") for x, y in zip(b.tolist(), n.tolist(), strict=True)], pa.string()))
        else:
            out.append(pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)))
    return out


@dataclass
class Range(InputPartition):
    """Records first to stop (not included) of one file or of two side by side: file, place, line ends to pass over, restart points."""

    first: int
    stop: int
    files: list[tuple[str, int, int, str]]
    width: int

    def batches(self) -> Iterator[pa.RecordBatch]:
        parts = [self._columns(*f) for f in self.files]
        held: list[list[pa.Array]] = [[] for _ in parts]
        at = self.first
        while at < self.stop:
            for i, p in enumerate(parts):
                held[i] = held[i] if held[i] and len(held[i][0]) else next(p)
            n = min(len(h[0]) for h in held)
            cols = [c.slice(0, n) for h in held for c in h]
            held = [[c.slice(n) for c in h] for h in held]
            ids = pa.array(np.arange(at, at + n))
            mates = len(cols) // 4
            names = ["file", "read_id", *(f"{c}{m}" if mates > 1 else c for m in range(1, mates + 1) for c in RECORD)]
            yield pa.RecordBatch.from_arrays([pa.array([self.files[0][0]] * n, pa.string()), ids, *cols], names=names)
            at += n

    def _columns(self, path: str, place: int, skip: int, points: str) -> Iterator[list[pa.Array]]:
        for a, begin, end in lines_from(path, place, skip, (self.stop - self.first) * self.width, self.width, points):
            yield columns(a, begin, end, self.width)


def ranges(indexes: list[Index], span: int, mates_in_one: bool, limit: int = 0) -> list[Range]:
    """The records that all files have, in ranges of about `span` bytes of the largest file."""
    width = 8 if mates_in_one else 4
    # A record of which only the quality line, empty at the file's end, is missing counts.
    records = min(i.lines // width if mates_in_one else -(-i.lines // width) for i in indexes)
    n = min(records, limit) if limit else records
    tasks = max(1, -(-max(i.size for i in indexes) // span))
    step = max(1, -(-records // tasks))
    return [Range(a, min(a + step, n), [(i.path, *i.before(a * width), i.points) for i in indexes], width) for a in range(0, n, step)]


def whole_files(paths: tuple[str, ...], mates_in_one: bool) -> Range | None:
    """All records of files that one task reads, if they are regular: it looks at them first, which takes less time than reading them line by line."""
    found = []
    for path in paths:
        # Point 0 of a gzip file is its beginning, for which no file of points is read.
        points = "-" if path.endswith(".gz") else ""
        try:
            s = _look(((-1, d) for d in restart.resumed(path, points, 0)) if points else chunks(path, 0), 1 << 62)
        except zlib.error:
            return None
        if not s.whole[4]:
            return None
        found.append(Index(path, [(0, 0)], s.ends + (not s.ended and s.size > 0), s.size, points))
    return next(iter(ranges(found, 1 << 62, mates_in_one)), Range(0, 0, [], 4))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.ranges = [Range(a, b, [tuple(f) for f in files], width) for a, b, files, width in json.loads(options["ranges"])]

    def partitions(self):
        return self.ranges or [Range(0, 0, [], 4)]

    def read(self, partition):
        return partition.batches()


class RangesSource(DataSource):
    """Options: ranges (as JSON), mates (1 or 2)."""

    @classmethod
    def name(cls):
        return "fastq_ranges"

    def schema(self):
        mates = int(self.options["mates"])
        return "file string, read_id long, " + ", ".join(f"{c}{m if mates > 1 else ''} string" for m in range(1, mates + 1) for c in RECORD)

    def reader(self, schema):
        return _Reader(self.options)


def read_ranges(spark: SparkSession, found: list[Range], mates: int) -> DataFrame:
    """The records of all ranges, a task for each.

    Bounds of read_id are not pushed into the source: in Spark 4.1 a filter that one plan pushes stays in the reader
    for other plans of the same DataFrame, which then lack rows. Readers take a limit instead.
    """
    spark.dataSource.register(RangesSource)
    plan = json.dumps([(r.first, r.stop, r.files, r.width) for r in found])
    return spark.read.format("fastq_ranges").option("ranges", plan).option("mates", str(mates)).load()
