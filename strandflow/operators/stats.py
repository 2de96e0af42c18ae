"""Statistics of reads as plain aggregations over partial sums made in numpy, a few rows from each batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.operators import kernels as k

#: The order in which k-mers are listed.
KMER_ORDER = ("ATCG", "0123")
#: Reads above which over-represented sequences of a length are reported, and of any other length. Fixed values.
REPORTED, REPORTED_ELSE = {10: 500, 20: 200, 40: 100, 100: 50}, 20


def cycle_sums(r: k.Reads) -> tuple[np.ndarray, list[np.ndarray]]:
    """256 times the cycle plus the base for each that occurs, with the reads, those of quality 20 and 30 and the sum of quality."""
    wide = r.seq.shape[1]
    inside = r.steps < r.length[:, None]
    seq, qual = r.seq[inside], r.qual[inside]
    # Counted together by cycle, base and quality, of those that occur.
    bases, quals = (np.flatnonzero(np.bincount(x, minlength=256)) for x in (seq, qual))
    codes = [np.zeros(256, np.int64) for _ in range(2)]
    for code, known in zip(codes, (bases, quals), strict=True):
        code[known] = np.arange(len(known))
    cycle = np.broadcast_to(np.arange(wide) * (len(bases) * len(quals)), inside.shape)[inside]
    n = np.bincount(cycle + (codes[0] * len(quals))[seq] + codes[1][qual], minlength=wide * len(bases) * len(quals))
    n = n.reshape(wide * len(bases), len(quals))
    sums = [n @ w.astype(np.int64) for w in (np.ones(len(quals)), quals >= 53, quals >= 63, quals - 33)]
    at = np.flatnonzero(sums[0])
    key = (np.arange(wide)[:, None] * 256 + bases).ravel()
    return key[at], [s[at] for s in sums]


def kmer_sums(m: np.ndarray, size: int = 5) -> tuple[list[str], np.ndarray]:
    """The k-mers of A, C, G and T that occur in a matrix of reads, and how often."""
    code = np.full(256, 4, np.uint8)
    for i, b in enumerate(b"ATCG"):
        code[b] = i
    c, total = code[m], np.zeros(4**size, np.int64)
    if c.shape[1] >= size:
        wide = c.shape[1] - size + 1
        key, ok = np.zeros((len(c), wide), np.int32), np.ones((len(c), wide), bool)
        for i in range(size):
            part = c[:, i : wide + i]
            key <<= 2
            key += part
            ok &= part < 4
        total += np.bincount(key[ok], minlength=len(total))
    at = np.flatnonzero(total)
    return ["".join("ATCG"[(x >> 2 * (size - 1 - i)) & 3] for i in range(size)) for x in at.tolist()], total[at]


def quality_sums(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qualities that occur and how often."""
    total = np.bincount(m[np.arange(m.shape[1]) < n[:, None]], minlength=256)
    at = np.flatnonzero(total)
    return at - 33, total[at].astype(np.int64)


def cycles(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """cycle, base, n, q20, q30, qual_sum: for each place and base the reads, those of quality 20 and 30 and the sum of quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sums = cycle_sums(k.reads(b.column(0), b.column(1)))
            cols = [pa.array(at // 256, pa.int32()), pa.array([chr(x) for x in (at % 256).tolist()], pa.string()), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(cols, names=["cycle", "base", "n", "q20", "q30", "qual_sum"])

    parts = df.select(seq, qual).mapInArrow(run, "cycle int, base string, n long, q20 long, q30 long, qual_sum long")
    return parts.groupBy("cycle", "base").agg(*(F.sum(c).alias(c) for c in ("n", "q20", "q30", "qual_sum")))


def curves(c: DataFrame) -> DataFrame:
    """cycle, n, mean quality, content of A, T, C, G, N and GC, and the mean quality of each base (the mean where it does not occur)."""
    per = lambda b, what: F.sum(F.when(F.col("base") == b, F.col(what)).otherwise(0))
    agg = c.groupBy("cycle").agg(F.sum("n").alias("n"), F.sum("qual_sum").alias("q"), *(per(b, "n").alias(f"n_{b}") for b in "ATCGN"), *(per(b, "qual_sum").alias(f"q_{b}") for b in "ATCGN"))
    share = lambda x, y: F.col(x).cast("double") / F.col(y)
    mean = share("q", "n")
    return agg.select(
        "cycle", "n", mean.alias("mean"), *(share(f"n_{b}", "n").alias(f"content_{b}") for b in "ATCGN"),
        ((F.col("n_G") + F.col("n_C")).cast("double") / F.col("n")).alias("content_GC"),
        *(F.when(F.col(f"n_{b}") > 0, F.expr(f"try_divide(cast(q_{b} as double), n_{b})")).otherwise(mean).alias(f"quality_{b}") for b in "ATCGN"),
    )


def kmers(df: DataFrame, seq: str = "seq", size: int = 5) -> DataFrame:
    """kmer and n: the windows of A, C, G and T only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, total = kmer_sums(k.matrix(b.column(0))[0], size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total)], names=["kmer", "n"])

    return df.select(seq).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def quality_histogram(df: DataFrame, qual: str = "qual") -> DataFrame:
    """q (without the offset 33) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, total = quality_sums(*k.matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total)], names=["q", "n"])

    return df.select(qual).mapInArrow(run, "q int, n long").groupBy("q").agg(F.sum("n").alias("n"))


def summary(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """reads, bases, q20, q30 and q40 bases, GC bases, mean length (whole number) and cycles."""
    above = lambda q: F.length(F.translate(F.col(qual), "".join(map(chr, range(33, 33 + q))), ""))
    gc = F.length(seq) - F.length(F.translate(F.col(seq), "GCgc", ""))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    d = df.where(F.col(seq).isNotNull()).agg(
        F.count("*").alias("reads"), total(F.length(seq)).alias("bases"), *(total(above(q)).alias(f"q{q}_bases") for q in (20, 30, 40)),
        total(gc).alias("gc_bases"), F.coalesce(F.max(F.length(seq)), F.lit(0)).cast("long").alias("cycles"),
    )
    return d.withColumn("mean_length", F.when(F.col("reads") > 0, F.expr("try_divide(bases - mod(bases, reads), reads)")).otherwise(0).cast("long"))


def insert_sizes(done: DataFrame) -> DataFrame:
    """insert_size (512: unknown or longer) and the pairs that have it."""
    return done.where(F.col("insert_size").isNotNull()).groupBy("insert_size").agg(F.count("*").alias("n"))


def insert_peak(sizes: DataFrame) -> DataFrame:
    """The most frequent known size, the least of equals."""
    return sizes.where("insert_size < 512").orderBy(F.desc("n"), F.asc("insert_size")).limit(1).select("insert_size", "n")


def adapter_counts(done: DataFrame, mate: int = 1) -> DataFrame:
    """adapter and n of one mate."""
    return done.select(F.explode(f"adapters{mate}").alias("adapter")).where("adapter != ''").groupBy("adapter").agg(F.count("*").alias("n"))


def adapter_report(counts: DataFrame, share: float = 0.01) -> DataFrame:
    """Adapters of at least a share of all, the rest as others; in report order: by length, then text."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    d = counts.crossJoin(total).withColumn("adapter", F.when(F.col("n") >= share * F.col("total"), F.col("adapter")).otherwise("others"))  # total: one row
    return d.groupBy("adapter").agg(F.sum("n").alias("n"))


def correction_matrix(done: DataFrame) -> DataFrame:
    """from_base, to_base and n."""
    d = done.select(F.explode("corrections").alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return d.select(F.substring("c", 1, 1).alias("from_base"), F.substring("c", 3, 1).alias("to_base"), "n")


def poly_counts(done: DataFrame, mates: tuple[int, ...] = (1,)) -> DataFrame:
    """base, reads and bases of homopolymer tails."""
    out = None
    for m in mates:
        part = done.where(F.col(f"poly{m}").isNotNull()).select(F.col(f"poly{m}").alias("base"), F.col(f"poly_len{m}").cast("long").alias("len"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("base").agg(F.count("*").alias("reads"), F.sum("len").alias("bases"))


def places_of(known: tuple[str, ...], column: pa.Array) -> Counter:
    """How often each of the sequences begins at each place of the reads; behind a hit the search goes on after it and one base more.

    Windows are found by a rolling hash of all places at once, and hits compared as text; only they are looped over.
    """
    m, length = k.matrix(column)
    texts, found, all_known = column.to_pylist(), Counter(), set(known)
    for size in sorted({len(s) for s in known if len(s) <= m.shape[1]}):
        own = sorted(s for s in all_known if len(s) == size)
        letters = np.frombuffer("".join(own).encode(), np.uint8).reshape(-1, size)
        hit = np.isin(k.run_hashes(m, size), k.run_hashes(letters, size)[:, 0])
        hit &= np.arange(hit.shape[1]) <= (length - size)[:, None]
        last, free = -1, 0
        for row, at in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            last, free = (row, 0) if row != last else (last, free)
            part = texts[row][at : at + size]
            if at >= free and part in all_known:
                found[part, at] += 1
                free = at + size + 1
    return found


def over_represented_places(df: DataFrame, candidates: DataFrame, seq: str = "seq", sampling: int = 20) -> DataFrame:
    """seq, place and n: where candidates begin in every sampling-th read by read_id."""
    known = tuple(sorted({r.seq for r in candidates.select("seq").collect()}))  # a small set by its making

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = places_of(known, b.column(0))
            cols = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int32()), pa.array(list(found.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["seq", "place", "n"])

    part = df.where(F.col("read_id") % sampling == 0).select(F.col(seq).alias("seq"))
    return part.mapInArrow(run, "seq string, place int, n long").groupBy("seq", "place").agg(F.sum("n").alias("n"))


def over_represented(df: DataFrame, candidates: DataFrame, seq: str = "seq", sampling: int = 20) -> DataFrame:
    """seq and n of candidates in every sampling-th read by read_id."""
    return over_represented_places(df, candidates, seq, sampling).groupBy("seq").agg(F.sum("n").alias("n"))


def reported(seq: str, n: int, sampling: int = 20) -> bool:
    """Whether a sequence that was counted in every sampling-th read is frequent enough for its length."""
    return n * sampling > REPORTED.get(len(seq), REPORTED_ELSE)


def over_represented_passed(counts: DataFrame, sampling: int = 20) -> DataFrame:
    """The sequences whose counts, times the sampling, pass the threshold for their length."""
    least = F.lit(REPORTED_ELSE)
    for size, most in REPORTED.items():
        least = F.when(F.length("seq") == size, most).otherwise(least)
    n = F.col("n") * sampling
    return counts.where(n > least)


def ranked_kmers(counts: DataFrame) -> DataFrame:
    """kmer, n and rank by count, ties in the order of KMER_ORDER."""
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.translate("kmer", *KMER_ORDER))))
