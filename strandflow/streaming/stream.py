"""Reads as a stream: the same steps on micro-batches, with duplicates remembered between them for a time.

Duplicates are found by keyed state: the digest of a read's sequences is kept for `within` after the batch in which it first came, by
the batch's own time, so that no read is ever late and the state is bounded by the reads of that time. Copies may come in one batch or in
several, from one file or many; of those in one batch any one stays. A column of event times can be used instead (`when`);
then reads that come later than `within` after the latest are dropped, as Spark does with late rows. The keys are kept in RocksDB
on the executors' disks, with a bounded cache, and their changes go to the checkpoint, so that they need not fit in the heaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandflow.functions.expressions import duplicate_key
from strandflow.operators import pipeline as run
from strandflow.plans.options import Options
from strandflow.plans.session import free_names

WITHIN = "1 hour"
_STORE = "spark.sql.streaming.stateStore"
#: How state is kept: bounded memory for all stores of an executor, changes only at each batch, and no lookup just to count keys.
STATE = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
}


def read_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 8) -> DataFrame:
    """Parquet files of reads as they arrive in a folder; for FASTQ files see sources.fastq.read_stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def without_duplicates(stream: DataFrame, seqs: list[str], when: str | None = None, within: str = WITHIN) -> DataFrame:
    """One read of each key; keys are forgotten after `within`, by the time of batches or by the column `when`."""
    key, time = free_names(stream, "key", "time")
    keyed = stream.withColumn(key, F.unhex(F.sha2(duplicate_key(*(F.col(s) for s in seqs)), 256)))
    if when is None:
        keyed = keyed.withColumn(time, F.current_timestamp())
    return keyed.withWatermark(when or time, within).dropDuplicatesWithinWatermark([key]).drop(key, time)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """The settings of STATE for queries that start within, which take them from the session then; what is set already stays."""
    own = [c for c in STATE if spark.conf.get(c, None) is None]
    for c in own:
        spark.conf.set(c, STATE[c])
    try:
        yield
    finally:
        for c in own:
            spark.conf.unset(c)


def process_stream(stream: DataFrame, o: Options, checkpoint: str, sink: Callable[[DataFrame, int], None], within: str = WITHIN) -> StreamingQuery:
    """Run all steps on each micro-batch; sink gets the routed reads and the batch's number. Returns when the input is used up.

    Batches follow each other until there is nothing new, so that a source that gives so many files at a time gives all of them.

    With o.dedup duplicates go before the batches, whatever file or batch they are in.
    """
    if o.dedup:
        stream = without_duplicates(run.taken(stream, o), [f"seq{m}" for m in ((1, 2) if o.paired else (1,))], within=within)
        o = replace(o, dedup=False, eval_duplication=False, phred64=False, reads_to_process=0)

    def each(batch: DataFrame, number: int) -> None:
        sink(run.routes(run.process(batch, o, run.routed_columns(batch, o)), o), number)

    with state_on_disk(stream.sparkSession):
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query
