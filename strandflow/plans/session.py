"""Small helpers about the Spark session that every query shares."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def expose(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library when it is not installed but only on the driver's path."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only where the setting is absent on one machine (tests) is a folder of our own set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/strandflow"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages never depend on executors' local files."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*settled: DataFrame) -> None:
    """Remove the files of tables written by settle() that nothing will read again."""
    for df in settled:
        if path := getattr(df, "_settled", None):
            discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bytes of a table, by its number of rows and the width stated for them, up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Keys that salted_join() broadcasts at most, and rows of a key from which on it may salt.
HOT_KEYS, HOT_ROWS = 1 << 17, 256


def if_small(df: DataFrame, width: int = 24) -> DataFrame:
    """df, a written table of `width` bytes a row, marked for broadcast if it is counted to be small; else Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def salted_join(rows: DataFrame, groups: DataFrame, on: str, size: str, spread_by: list[str], width: int = 24, how: str = "inner") -> DataFrame:
    """rows joined with groups, a written table of one row for each key and of `width` bytes a row, however many rows a key has.

    size is the column of groups with the number of rows of a key. Few groups are broadcast. Else the keys of more than
    `limit` rows are dealt over as many salts as they have times `limit` rows; limit is such that these keys, which go to
    all tasks, are HOT_KEYS at most. spread_by: columns of rows (which must be read from a table) that tell apart rows of one key.
    """
    total = groups.agg(F.count("*"), F.sum(size)).first()
    if total[0] * width <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), on, how)
    limit = max(HOT_ROWS, -(-(total[1] or 0) // HOT_KEYS))
    copies = F.expr(f"cast(({size} - 1) div {limit} as int)")
    salt, times = unused({*rows.columns, *groups.columns}, "salt", "copies")
    hot = groups.where(copies > 0).select(on, copies.alias(times))
    turn = F.pmod(F.xxhash64(*spread_by, F.spark_partition_id()), F.col(times) + 1).cast("int")
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(salt, F.coalesce(turn, F.lit(0))).drop(times)
    dealt = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), copies)))
    return salted.join(dealt, [on, salt], how).drop(salt)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of one's own that df does not have, in any case of letters."""
    return unused(df.columns, *wanted)


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names that are not among columns, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        own, i = f"__{name}", 0
        while own.lower() in taken:
            own, i = f"__{name}{i}", i + 1
        taken.add(own.lower())
        out.append(own)
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores at least: a small table is often one file, which one task would read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
