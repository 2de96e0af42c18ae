"""Writing routed reads: by tasks, with a commit.

The sink is a Spark data source (`fastq_parts`). Each task writes what it has of a file as a part of its own (a gzip member where the name ends
in .gz) into a hidden folder beside the file, under a name that no other attempt has, and reports it; only parts that were reported
count. The commit puts down their order, which is that of the reads. If the write fails nothing stays. Then the parts are
joined, byte by byte, by one task for each file and moved to its name in one step, so that a file is there whole or not at all; a single part is
only moved. With `join=False` the parts stay as they are, in a folder of the file's name, for readers that take many.

Files may be on any file system that pyarrow opens, which all tasks must see.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strandflow.operators.single_steps import split_by_files, split_by_lines
from strandflow.plans.options import Options
from strandflow.plans.session import settle, shared_dir
from strandflow.sources.places import file_system

_COPY_BYTES = 4 << 20
_MANIFEST = "_parts.json"


def record_text() -> Column:
    """A routed record as one string of four lines."""
    return F.concat_ws("\n", "name", "seq", "strand", "qual")


def write_table(routed: DataFrame, path: str, compression: str | None = None, overwrite: bool = False) -> None:
    """A folder for each target below path, of text files whose order by name is the order of reads.

    Each partition holds a range of reads, so joined in order the files are the whole; this also holds of gzip files.
    """
    text = routed.repartitionByRange("read_id").sortWithinPartitions("target", "read_id", "mate").select("target", record_text().alias("value"))
    writer = text.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("target")
    writer.text(path, compression=compression or "none")


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = file_system(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def remove(path: str) -> None:
    """A file or a folder with all that is in it, if it is there."""
    from pyarrow import fs

    system, inner = file_system(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        system.delete_file(inner)


def write_text(path: str, text: str) -> None:
    system, inner = file_system(path)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(text.encode())


def _beside(path: str, run: str) -> str:
    """The folder of a file's parts."""
    folder, name = os.path.split(path)
    return os.path.join(folder, f".{name}.{run}")


def _bytes(lines: list[str]) -> bytes:
    """Records were read as Latin-1 and are written so; text from elsewhere that is not goes as UTF-8."""
    text = "\n".join(lines) + "\n"
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode()


@contextmanager
def _opened(path: str, level: int, packed: bool):
    system, inner = file_system(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        if packed:
            with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0, filename="") as z:
                yield z
        else:
            yield out


@dataclass
class _Written(WriterCommitMessage):
    """The parts of one task: file, part, records."""

    task: int
    parts: list[tuple[str, str, int]]


class _PartsWriter(DataSourceArrowWriter):
    """Rows of file and value, sorted by file within a task."""

    def __init__(self, options):
        self.run, self.level, self.files = options["run"], int(options["level"]), json.loads(options["files"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, attempt = task.partitionId(), task.taskAttemptId()
        parts: list[tuple[str, str, int]] = []
        try:
            for file, batches in _by_file(iterator):
                part = os.path.join(_beside(file, self.run), f"part-{number:06d}-{attempt}" + ".gz" * file.endswith(".gz"))
                parts.append((file, part, 0))
                with _opened(part, self.level, file.endswith(".gz")) as out:
                    records = 0
                    for values in batches:
                        out.write(_bytes(values))
                        records += len(values)
                parts[-1] = (file, part, records)
        except BaseException:
            for _, part, _ in parts:
                with suppress(OSError):
                    remove(part)
            raise
        return _Written(number, parts)

    def commit(self, messages):
        """The order of the reported parts; those of attempts that were lost go."""
        order: dict[str, list[str]] = {f: [] for f in self.files}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for file, part, _ in m.parts:
                order[file].append(part)
        for file, parts in order.items():
            _keep_only(_beside(file, self.run), parts)
        write_text(os.path.join(_beside(self.files[0], self.run), _MANIFEST), json.dumps(order))

    def abort(self, messages):
        for file in self.files:
            remove(_beside(file, self.run))


def _by_file(batches: Iterator[pa.RecordBatch]):
    """Each file with an iterator of lists of its records, which is to be used up before the next file."""
    rows = ((f, v) for b in batches for f, v in _runs(b))
    ahead = next(rows, None)

    def own(file):
        nonlocal ahead
        while ahead is not None and ahead[0] == file:
            yield ahead[1]
            ahead = next(rows, None)

    while ahead is not None:
        yield ahead[0], own(ahead[0])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    files, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[start]:
            yield files[start], values[start:i]
            start = i


def _keep_only(folder: str, parts: list[str]) -> None:
    from pyarrow import fs

    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    kept = {os.path.basename(p) for p in parts}
    for f in system.get_file_info(fs.FileSelector(inner)):
        if f.base_name not in kept:
            system.delete_file(f.path)


class PartsSink(DataSource):
    """Options: run (a name of its own), level (of gzip) and files (all names, as JSON)."""

    @classmethod
    def name(cls):
        return "fastq_parts"

    def writer(self, schema, overwrite):
        return _PartsWriter(self.options)


def write_parts(rows: DataFrame, files: list[str], level: int) -> tuple[str, dict[str, list[str]]]:
    """Write rows of file, read_id, mate and value; the name of this write and the parts of each file in order."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PartsSink)
    dealt = rows.repartitionByRange("file", "read_id").sortWithinPartitions("file", "read_id", "mate").select("file", "value")
    dealt.write.format("fastq_parts").mode("append").option("run", run).option("level", str(level)).option("files", json.dumps(files)).save()
    system, inner = file_system(os.path.join(_beside(files[0], run), _MANIFEST))
    with system.open_input_stream(inner, compression=None) as f:
        return run, json.loads(f.read())


def join_parts(spark: SparkSession, run: str, order: dict[str, list[str]]) -> None:
    """Each file from its parts, by a task of its own; a file without parts is empty."""
    rows = [(file, json.dumps(parts)) for file, parts in order.items()]
    todo = spark.createDataFrame(rows, "file string, parts string").repartition(len(rows), "file")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, parts in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                _join(file, json.loads(parts), run)
            yield b.select([0])

    todo.mapInArrow(join, "file string").collect()  # names only
    for file in order:
        remove(_beside(file, run))


def _join(file: str, parts: list[str], run: str) -> None:
    """Repeated by another attempt it gives the same: the parts stay until all files are there."""
    from pyspark import TaskContext

    system, inner = file_system(file)
    made = os.path.join(_beside(file, run), f"whole-{TaskContext.get().taskAttemptId()}")
    _, made_inner = file_system(made)
    with _opened(made, 1, not parts and file.endswith(".gz")) as out:
        for part in parts:
            for block in blocks(part):
                out.write(block)
    system.move(made_inner, inner)


def blocks(path: str) -> Iterator[bytes]:
    system, inner = file_system(path)
    with system.open_input_stream(inner, compression=None) as f:
        while block := f.read(_COPY_BYTES):
            yield block


def keep_parts(spark: SparkSession, run: str, order: dict[str, list[str]]) -> None:
    """Each file as a folder of its parts, named in order, in one move for each."""
    for file in order:
        system, inner = file_system(file)
        folder = file_system(_beside(file, run))[1]
        with suppress(FileNotFoundError):
            system.delete_file(os.path.join(folder, _MANIFEST))
        system.move(folder, inner)


def write_rows(rows: DataFrame, files: list[str], level: int, overwrite: bool, join: bool = True) -> None:
    """The files from rows of file, read_id, mate and value."""
    there = [p for p in files if exists(p)]
    if there and not overwrite:
        raise FileExistsError(there[0])
    run, order = write_parts(rows, files, level)
    if not join:
        for p in there:
            remove(p)
    (join_parts if join else keep_parts)(rows.sparkSession, run, order)


def write_samples(routed: DataFrame, files: dict[tuple[str, str], str], level: int = 4, overwrite: bool = True, join: bool = True) -> None:
    """The files of all samples in one write: `files` has the name for each sample and target."""
    table = routed.sparkSession.createDataFrame([(s, t, f) for (s, t), f in files.items()], "sample string, target string, file string")
    rows = routed.join(F.broadcast(table), ["sample", "target"]).select("file", "read_id", "mate", record_text().alias("value"))  # as many rows as files
    write_rows(rows, list(dict.fromkeys(files.values())), level, overwrite, join)


def write_files(routed: DataFrame, targets: dict[str, str], level: int = 4, overwrite: bool = True, join: bool = True) -> None:
    """One file for each name in `targets`, of the records of all targets with that name, in the order of reads."""
    name = F.create_map(*(F.lit(x) for t in targets.items() for x in t))[F.col("target")]
    rows = routed.where(F.col("target").isin(list(targets))).select(name.alias("file"), "read_id", "mate", record_text().alias("value"))
    write_rows(rows, list(dict.fromkeys(targets.values())), level, overwrite, join)


def write_stream(routed: DataFrame, targets: list[str], out) -> None:
    """The records of targets in the order of reads to an open binary stream of this process, which gets the bytes of parts that tasks wrote."""
    spark = routed.sparkSession
    file = f"{shared_dir(spark)}.fq"
    rows = routed.where(F.col("target").isin(targets)).select(F.lit(file).alias("file"), "read_id", "mate", record_text().alias("value"))
    run, order = write_parts(rows, [file], 1)
    for part in order[file]:
        for block in blocks(part):
            out.write(block)
    out.flush()
    remove(_beside(file, run))


def split_path(path: str, number: str) -> str:
    """The number before the file's name: out/a.fq becomes out/0001.a.fq."""
    return os.path.join(os.path.dirname(path), f"{number}.{os.path.basename(path)}")


def write_split(routed: DataFrame, targets: dict[str, str], o: Options, join: bool = True) -> list[str]:
    """The records of targets in files of their own for each number, o.split of them or as many as o.split_by_lines needs.

    Of o.split files those without reads are empty. The files' names are returned.
    """
    first = routed.where(F.col("target") == next(iter(targets))).select("read_id")
    numbered = split_by_files(first, o.split, o.split_digits) if o.split else split_by_lines(first, o.split_by_lines, o.split_digits)
    numbers = settle(numbered.select("read_id", "split_no"))
    if o.split:
        every = [str(i + 1).rjust(o.split_digits, "0") for i in range(o.split)]
    else:
        every = sorted(r.split_no for r in numbers.select("split_no").distinct().collect())
    files = list(dict.fromkeys(split_path(p, n) for p in targets.values() for n in every))
    place = lambda i: F.create_map(*(F.lit(x) for t, p in targets.items() for x in (t, split_path(p, "\0").split("\0")[i])))[F.col("target")]
    name = F.concat(place(0), "split_no", place(1))
    rows = routed.where(F.col("target").isin(list(targets))).join(numbers, "read_id").select(name.alias("file"), "read_id", "mate", record_text().alias("value"))
    if files:
        write_rows(rows, files, o.compression, not o.dont_overwrite, join)
    return files
