"""Each kernel as an operator of its own over read_id, name, seq, qual (or pairs), for use outside a whole run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import kernels as k
from strandflow.plans.options import Options
from strandflow.plans.session import settle


def apply(df: DataFrame, columns: list[str], fn: Callable[..., dict], schema: str) -> DataFrame:
    """The first column and what fn makes of the others, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = {columns[0]: b.column(0), **fn(*(b.column(i) for i in range(1, len(columns))))}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.select(*columns).mapInArrow(run, f"{columns[0]} long, {schema}")


def trim_poly_g(df: DataFrame, least: int = 10) -> DataFrame:
    return apply(df, ["read_id", "seq", "qual"], lambda s, q: {"trimmed_len": pa.array(k.poly_g(k.reads(s, q), least), pa.int32())}, "trimmed_len int")


def trim_poly_x(df: DataFrame, least: int = 10) -> DataFrame:
    def fn(s, q):
        n, base = k.poly_x(k.reads(s, q), least)
        return {"trimmed_len": pa.array(n, pa.int32()), "base": pa.array([None if x < 0 else chr(k.POLY_BASES[x]) for x in base.tolist()], pa.string())}

    return apply(df, ["read_id", "seq", "qual"], fn, "trimmed_len int, base string")


def quality_cut(df: DataFrame, how: k.Cut, front: int = 0, tail: int = 0) -> DataFrame:
    """seq and qual after cutting; null where a read is lost."""

    def fn(s, q):
        r, lost, begin = k.cut(k.reads(s, q), front, tail, how)
        gone = pa.array(lost)
        pick = lambda m: pc.if_else(gone, pa.scalar(None, pa.string()), k.texts(m, r.length))
        return {"seq": pick(r.seq), "qual": pick(r.qual), "front": pa.array(np.where(lost, 0, begin), pa.int32())}

    return apply(df, ["read_id", "seq", "qual"], fn, "seq string, qual string, front int")


def trim_adapter(df: DataFrame, adapters: list[str], literal: bool = False) -> DataFrame:
    """trimmed_len after the adapters are tried in turn."""

    def fn(s, q):
        r = k.reads(s, q)
        least = 4 if len(adapters) == 1 else k.adapters_least(len(adapters))
        for a in adapters:
            r = r.resized(np.maximum(np.minimum(k.adapter_at(r, a.encode(), least, literal), r.length), 0))
        return {"trimmed_len": pa.array(r.length, pa.int32())}

    return apply(df, ["read_id", "seq", "qual"], fn, "trimmed_len int")


def overlaps(df: DataFrame, limit: int = 5, least: int = 30, percent: float = 0.2, gaps: bool = False) -> DataFrame:
    """The overlap of each pair that has one."""

    def fn(s1, s2):
        ov = k.overlap(k.reads(s1, s1), k.reads(s2, s2), limit, least, percent, gaps)
        return {"overlapped": pa.array(ov.found), **{c: pa.array(v, pa.int32()) for c, v in (("offset", ov.offset), ("overlap_len", ov.length), ("diff", ov.diff))}}

    return apply(df, ["pair_id", "seq1", "seq2"], fn, "overlapped boolean, offset int, overlap_len int, diff int")


def results(df: DataFrame, o: Options) -> DataFrame:
    return apply(df, ["read_id", "seq", "qual"], lambda s, q: {"result": pa.array(k.classify(k.reads(s, q), o), pa.int32())}, "result int")


def placed(df: DataFrame, by: str = "read_id") -> tuple[DataFrame, int]:
    """df with `place`, each row's number from 0 in the order of `by`, and the number of rows.

    Rows are dealt into ranges and written; a range's rows are numbered by its own task, and the ranges' sizes, a row
    for each task, added up.
    """
    ranges = df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    ranges = settle(ranges.withColumn("_range", F.shiftright("_at", 33).cast("int")))
    sizes = sorted((r["_range"], r.n) for r in ranges.groupBy("_range").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, n in sizes:
        starts.append((k, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    inner = F.col("_at").bitwiseAND((1 << 33) - 1)
    out = ranges.join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + inner)  # as many rows as tasks
    return out.drop("_at", "_range", "_before"), total


def split_by_files(df: DataFrame, files: int, digits: int = 4) -> DataFrame:
    """Which of `files` runs of equal length by read_id each read is in, and the file's number as text; the first runs have one more where it does not go up."""
    d, n = placed(df)
    size, longer = divmod(n, files)
    edge, at = longer * (size + 1), F.col("place")
    first = F.floor(at / F.lit(size + 1))
    later = longer + F.floor((at - edge) / F.lit(max(size, 1)))
    d = d.withColumn("split_id", F.when(at < edge, first).otherwise(later).cast("int")).drop("place")
    return d.withColumn("split_no", numbered(F.col("split_id"), digits))


def split_by_lines(df: DataFrame, lines: int, digits: int = 4) -> DataFrame:
    """Runs of so many lines, four of them for each read."""
    d, _ = placed(df)
    d = d.withColumn("split_id", F.floor(F.col("place") / F.lit(lines // 4)).cast("int")).drop("place")
    return d.withColumn("split_no", numbered(F.col("split_id"), digits))


def numbered(split_id, digits: int):
    text = (split_id + 1).cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))
