"""Reading tables and running Arrow batch functions, as all operators of this subpackage do it."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.plans.session import discard, expose, free_names, if_small, salted_join, settle, shared_dir, spread  # noqa: F401  (shared by the operators)

#: Bytes of an Arrow batch that Spark sends to Python: texts may be long.
BATCH_BYTES = 2 << 20
#: Bytes of text that numpy code handles at a time; a longer text is handled alone.
SLICE_BYTES = 1 << 21


def prepare(spark: SparkSession) -> SparkSession:
    """Make the library importable on workers and keep Arrow batches of long texts small."""
    expose(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id (long), text (null becomes empty) and the columns named, whatever else docs holds."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return docs.select(*cols, *(F.col(c) for c in more))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema, after: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with a function from batch to batch or batches; text batches are cut to SLICE_BYTES before. after: called at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        if after:
            after()
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give free memory back to the system: workers live on from task to task, and their allocators keep what large arrays took."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn, a function of one group's table, with release() after it."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return fn(table)
        finally:
            release()

    return run


def releasing2(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two tables; Spark counts the parameters."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return fn(left, right)
        finally:
            release()

    return run


def cut(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together hold at most `limit` bytes, or one row that alone is longer."""
    import numpy as np

    if "text" not in batch.schema.names or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(col: pa.Array):
    """The bytes of a string column without nulls, and each row's offsets in them, without a copy of the bytes."""
    import numpy as np

    if pa.types.is_large_string(col.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind, len(col) + 1, col.offset * width).astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))

