"""FASTQ and FASTA as DataFrames.

The source `fastq` has one task for each file or pair of files, gzip (of one or many members) or plain, on any file
system that pyarrow opens; mates are put together as they are read. Records are numbered in file order; a malformed
record ends its file, as if it ended there. Large files are read by many tasks (module `spans`). As a stream the source takes the files of a folder as they arrive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandflow.sources.places import file_system
from strandflow.sources.spans import RECORD as _RECORD
from strandflow.sources.spans import index, ranges, read_ranges, whole_files

SCHEMA = "file string, read_id long, " + ", ".join(f"{c} string" for c in _RECORD)
PAIRS = "file string, read_id long, " + ", ".join(f"{c}{m} string" for m in (1, 2) for c in _RECORD)
_ROWS = 10_000
_KEEP = re.compile(r"[^A-Za-z*-]")
#: Bytes of a file that a task reads, where a file is read by many.
SPAN_BYTES = 64 << 20


def lines(stream) -> Iterator[bytes]:
    r"""Lines that end in \n, \r or \r\n, the last with or without an end."""
    rest, skip = b"", False
    while block := stream.read(1 << 20):
        if skip and block[:1] == b"\n":
            block = block[1:]
        skip = block[-1:] == b"\r"
        parts = re.split(rb"\r\n|\n|\r", rest + block)
        rest = parts.pop()
        yield from parts
    if rest:
        yield rest


def records(stream) -> Iterator[tuple[str, str, str, str]]:
    """name, sequence, strand and quality; what comes before a name is skipped, a broken record ends the stream."""
    it = lines(stream)
    for name in it:
        if not name.startswith(b"@"):
            continue
        seq, strand, qual = next(it, None), next(it, None), next(it, None)
        if seq is None or strand is None or not strand.startswith(b"+") or len(qual or b"") != len(seq):
            return
        yield tuple(x.decode("latin-1") for x in (name, seq, strand, qual or b""))  # type: ignore[misc]


def open_input(path: str):
    system, inner = file_system(path)
    return system.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]
    limit: int
    mates: str


def _rows(part: _Files) -> Iterator[tuple]:
    """file, read_id and the record or the mates' records."""
    if part.mates == "files":
        with open_input(part.paths[0]) as one, open_input(part.paths[1]) as two:
            for i, (x, y) in enumerate(islice(zip(records(one), records(two), strict=False), part.limit or None)):
                yield part.paths[0], i, *x, *y
        return
    with open_input(part.paths[0]) as stream:
        found = records(stream)
        if part.mates == "one":
            found = (x + y for x, y in zip(found, found, strict=False))
        for i, rec in enumerate(islice(found, part.limit or None)):
            yield part.paths[0], i, *rec


def _batches(part: _Files) -> Iterator[pa.RecordBatch]:
    whole = None if part.limit else whole_files(part.paths, part.mates == "one")
    if whole is not None:
        yield from whole.batches()
        return
    names = [f.split()[0] for f in (PAIRS if part.mates else SCHEMA).split(", ")]
    rows = _rows(part)
    while block := list(islice(rows, _ROWS)):
        cols = zip(*block, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "read_id" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = [p for p in options.get("path", "").split(",") if p]
        self.limit, self.mates = int(options.get("limit", "0")), options.get("mates", "")

    def partitions(self):
        if self.mates == "files":
            return [_Files(tuple(self.files[i : i + 2]), self.limit, "files") for i in range(0, len(self.files), 2)]
        return [_Files((p,), self.limit, self.mates) for p in self.files]

    def read(self, partition):
        return _batches(partition)


#: Files whose time is so much before the latest seen are taken for old ones and passed over; what is younger is remembered by name.
FILE_AGE = 7 * 24 * 3600
#: Records of a file that have numbers of their own in a stream; a file's number stands above them.
_FILE_BITS = 40


@dataclass
class _Arrived(InputPartition):
    path: str
    number: int


class _Stream(DataSourceStreamReader):
    """The files of a folder as they arrive, in the order of their times and names; a file must be complete when it gets its name.

    An offset is the number of files so far with those that are younger than FILE_AGE, or came since the last committed batch; so it does
    not grow with the files that ever were. A file keeps its number, which makes the numbers of its records.
    """

    def __init__(self, options):
        self.folder = options["path"]
        self.most = int(options.get("maxFilesPerTrigger", "0"))
        self.age = float(options.get("maxFileAge", str(FILE_AGE)))
        self.now: dict = self.initialOffset()
        self.committed = 0

    def _there(self) -> list[tuple[float, str]]:
        from pyarrow import fs

        system, inner = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(inner))
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        return sorted((f.mtime.timestamp() if f.mtime else 0.0, scheme + f.path) for f in found if re.search(r"\.(fq|fastq)(\.gz)?$", f.path))

    def initialOffset(self):
        return {"count": 0, "latest": 0.0, "files": []}

    def latestOffset(self):
        known = {path for path, _, _ in self.now["files"]}
        oldest = self.now["latest"] - self.age
        new = [(time, path) for time, path in self._there() if path not in known and time >= oldest][: self.most or None]
        latest = max([self.now["latest"], *(t for t, _ in new)])
        count = self.now["count"]
        files = [f for f in self.now["files"] if f[2] >= latest - self.age or f[1] >= self.committed]
        files += [[path, count + i, time] for i, (time, path) in enumerate(new)]
        self.now = {"count": count + len(new), "latest": latest, "files": files}
        return self.now

    def partitions(self, start, end):
        if end["count"] > self.now["count"]:  # after a restart
            self.now = end
        return [_Arrived(path, number) for path, number, _ in end["files"] if number >= start["count"]]

    def read(self, partition):
        for batch in _batches(_Files((partition.path,), 0, "")):
            at = batch.schema.get_field_index("read_id")
            ids = pa.array(batch.column(at).to_numpy() + (partition.number << _FILE_BITS), pa.int64())
            yield batch.set_column(at, "read_id", ids)

    def commit(self, end):
        self.committed = max(self.committed, end["count"])


class FastqSource(DataSource):
    """Options: path (files, by commas; the folder of a stream), limit, and mates: files (two by two) or one (in turn in one file)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return PAIRS if self.options.get("mates") else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def _load(spark: SparkSession, paths: tuple[str, ...], limit: int, mates: str) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", ",".join(paths)).option("limit", str(limit)).option("mates", mates).load()


def read_fastq(spark: SparkSession, *paths: str, limit: int = 0) -> DataFrame:
    """All records of the files; limit: the first so many of each."""
    return _load(spark, paths, limit, "")


def read_single(spark: SparkSession, path: str, limit: int = 0, span: int = SPAN_BYTES) -> DataFrame:
    """read_id, name1, seq1, strand1, qual1; a file of over `span` bytes by many tasks where that can be."""
    whole = spans(spark, path, span, limit)
    d = read_fastq(spark, path, limit=limit) if whole is None else whole
    return d.select("read_id", *(F.col(c).alias(f"{c}1") for c in _RECORD))


def read_pairs(spark: SparkSession, path1: str, path2: str, limit: int = 0, span: int = SPAN_BYTES) -> DataFrame:
    """Mates by place in their files; what only one file has is left out. Where both files can be read by many tasks, each reads the same records of both."""
    one = index(spark, path1, span, 4 * limit)
    two = None if one is None else index(spark, path2, span, 4 * limit)
    if one is None or two is None:
        return _load(spark, (path1, path2), limit, "files").drop("file")
    return read_ranges(spark, ranges([one, two], span, False, limit), 2).drop("file")


def read_interleaved(spark: SparkSession, path: str, limit: int = 0, span: int = SPAN_BYTES) -> DataFrame:
    """Mates that follow each other in one file; a last record without a mate is left out."""
    found = index(spark, path, span, 8 * limit)
    if found is None:
        return _load(spark, (path,), limit, "one").drop("file")
    return read_ranges(spark, ranges([found], span, True, limit), 2).drop("file")


def read_samples(spark: SparkSession, samples: dict[str, tuple[str, str]], limit: int = 0, span: int = SPAN_BYTES) -> DataFrame:
    """sample, read_id, name1, ... of single reads, or of pairs, of many files in one table; large files by many tasks each."""
    paired = any(two for _, two in samples.values())
    found, small = [], []
    for one, two in samples.values():
        own = [index(spark, p, span, 4 * limit) for p in ((one, two) if paired else (one,))]
        if None in own:
            small += [one, two] if paired else [one]
        else:
            found += ranges(own, span, False, limit)
    parts = [_load(spark, tuple(small), limit, "files" if paired else "")] if small else []
    parts += [read_ranges(spark, found, 2 if paired else 1)] if found else []
    d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not paired:
        d = d.withColumnsRenamed({c: f"{c}1" for c in _RECORD})
    names = spark.createDataFrame([(one, s) for s, (one, _) in samples.items()], "file string, sample string")
    return d.join(F.broadcast(names), "file").drop("file")  # as many rows as samples


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 0) -> DataFrame:
    """The records of the FASTQ files that arrive in a folder; read_id is 2**40 times the file's number and counts on within the file."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("fastq").option("path", folder).option("maxFilesPerTrigger", str(files_at_once)).load()


def spans(spark: SparkSession, path: str, span: int = SPAN_BYTES, limit: int = 0) -> DataFrame | None:
    """The records of a file that many tasks read, each a range of them; None if it is small, packed in one go or irregular."""
    found = index(spark, path, span, 4 * limit)
    return None if found is None else read_ranges(spark, ranges([found], span, False, limit), 1)


def read_fasta(path: str) -> dict[str, str]:
    """Sequences by header, in the order of the headers; of equal headers the last counts."""
    out: dict[str, str] = {}
    header, parts = None, []
    with open_input(path) as stream:
        for line in lines(stream):
            text = line.decode("latin-1")
            if text.startswith(">"):
                if header is not None:
                    out[header] = "".join(parts)
                header, parts = text[1:].strip(), []
            elif header is not None:
                parts.append(_KEEP.sub("", text))
    if header is not None:
        out[header] = "".join(parts)
    return dict(sorted(out.items()))


def read_adapters(path: str, least: int = 6) -> list[str]:
    """The different sequences of a FASTA file that are long enough, in the order of their headers."""
    return list(dict.fromkeys(s for s in read_fasta(path).values() if len(s) >= least))


def read_barcodes(path: str) -> list[str]:
    """One barcode of A, C, G and T in each line; anything else is an error."""
    with open_input(path) as stream:
        found = [x.decode("latin-1").strip() for x in lines(stream)]
    found = [x for x in found if x]
    if bad := [x for x in found if not re.fullmatch("[ACGT]+", x)]:
        raise ValueError(f"not a barcode: {bad[0]}")
    return found


def mate_files(names: list[str], flag1: str = "R1", flag2: str = "R2", singles: bool = True) -> list[tuple[str, str]]:
    """(first, second or '') of each sample of a folder: files whose names hold a flag followed by . _ or -."""
    fastq = [n for n in sorted(names) if re.search(r"\.(fq|fastq)(\.gz)?$", n) and not n.startswith("Undetermined")]
    out, known = [], set(fastq)
    for n in fastq:
        if re.search(rf"{re.escape(flag1)}[._-]", n):
            other = re.sub(rf"{re.escape(flag1)}(?=[._-])", flag2, n)
            out.append((n, other if other in known else ""))
        elif singles and not re.search(rf"{re.escape(flag2)}[._-]", n):
            out.append((n, ""))
    return out
