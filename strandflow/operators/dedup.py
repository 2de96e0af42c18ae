"""Exact duplicates: of reads with equal keys the first by read_id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.expressions import duplicate_key
from strandflow.plans import session
from strandflow.plans.session import free_names, salted_join, settle


def _key(df: DataFrame, seqs: list[str]) -> Column:
    """The digest of a read's sequences, of its sample too if reads of several are together."""
    own = duplicate_key(*(F.col(s) for s in seqs))
    return F.unhex(F.sha2(F.concat_ws("\n", "sample", own) if "sample" in df.columns else own, 256))


#: Bytes of the marks of duplicates, by MARK_BYTES for each 64 numbers in a row, up to which they are broadcast.
MARKS_BROADCAST, MARK_BYTES = 64 << 20, 24


def mark_duplicates(df: DataFrame, seqs: list[str]) -> DataFrame:
    """df with is_dup, within each sample if df has a column `sample`. Keys of several reads are found by an aggregation that combines within tasks, over ids and digests.

    Few such keys go to all tasks. Of many, only the ids of duplicates are made, and sent as one bit for each id: reads are
    shuffled only where these marks are too large for it (some 180 million numbers in a row). A read_id is one read's, within its sample.
    """
    key, first, last, reads = free_names(df, "key", "first", "last", "reads")
    keyed = df.withColumn(key, _key(df, seqs))
    own = ["sample"] if "sample" in df.columns else []
    found = keyed.groupBy(*own, key).agg(F.min("read_id").alias(first), F.max("read_id").alias(last), F.count("*").alias(reads))
    firsts = settle(found.where((F.col(reads) > 1) & F.col(key).isNotNull()))
    if firsts.count() * 72 <= session.BROADCAST_BYTES:
        out = keyed.join(F.broadcast(firsts.select(key, first)), key, "left")
        return out.withColumn("is_dup", F.coalesce(F.col("read_id") > F.col(first), F.lit(False))).drop(key, first)
    return _marked(df, _later(keyed, firsts, own, key, first, last, reads), own)


def _later(keyed: DataFrame, firsts: DataFrame, own: list[str], key: str, first: str, last: str, reads: str) -> DataFrame:
    """(sample,) read_id of duplicates: of two reads the last; of more, those after the first, which find their key by salts, so that no task needs to hold a key with a third of all reads."""
    later = firsts.where((F.col(reads) == 2) & (F.col(last) > F.col(first))).select(*own, F.col(last).alias("read_id"))
    more = firsts.where(F.col(reads) > 2).select(key, first, reads)
    if more.isEmpty():
        return later
    among = salted_join(keyed.select(*own, "read_id", key), more, key, reads, ["read_id"], 72)
    return later.unionByName(among.where(F.col("read_id") > F.col(first)).select(*own, "read_id"))


def _marked(df: DataFrame, later: DataFrame, own: list[str]) -> DataFrame:
    """df with is_dup, true for the ids in later, which are made to bits of 64 numbers each."""
    word, bits, of = free_names(df, "word", "bits", "of")
    at, place = F.shiftright("read_id", 6), "cast(pmod(read_id, 64) as int)"
    by = [F.col(c).alias(of) for c in own]
    marks = settle(later.groupBy(*by, at.alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias(bits)))
    if marks.count() * MARK_BYTES <= MARKS_BROADCAST:
        marks = F.broadcast(marks)
    same = [at == F.col(word), *(F.col(c).eqNullSafe(F.col(of)) for c in own)]
    hit = F.coalesce(F.bit_get(bits, F.expr(place)) == 1, F.lit(False))
    return df.join(marks, same, "left").withColumn("is_dup", hit).drop(word, bits, of)


def duplicate_counts(df: DataFrame, seqs: list[str]) -> DataFrame:
    """The same figures of reads that are not marked, for each sample if there is such a column: all but one of each key are duplicates."""
    by = ["sample"] if "sample" in df.columns else []
    per_key = df.groupBy(*by, _key(df, seqs).alias("key")).agg(F.count("*").alias("n"))
    d = per_key.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reads"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return d.withColumn("rate", _rate())


def _rate() -> Column:
    return F.when(F.col("reads") > 0, F.col("duplicates").cast("double") / F.col("reads")).otherwise(0.0)


def duplication_rate(marked: DataFrame) -> DataFrame:
    """reads, duplicates and their share (0 without reads)."""
    d = marked.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.col("is_dup").cast("long")), F.lit(0)).alias("duplicates"))
    return d.withColumn("rate", _rate())
