"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only. Every grouping is by the whole normalised text
besides its digest, so each stage compares full content:

1. local: within a map task, equal texts become one row with their count and largest doc_id;
2. salted: these rows meet in groups of digest and salt, so that no digest has all its rows in one task;
3. global: the salts' winners, at most `salts` rows for each text, meet by digest.

The winners' texts are then dropped, and each document finds its group by digest, for which the digests of large
groups are salted once more. Should several texts share a digest, the documents of such digests find their group by
text instead.

Defined cases: a null text counts as empty, and all empty texts are equal. Of equal texts the largest doc_id
stays; of repeated rows with that doc_id exactly one. A null doc_id is smaller than any other. Columns besides
doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import free_names, id_text, if_small, salted_join, settle

SALTS = 16


def ascii_lower(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)  # then lower() can only touch A-Z
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, norm (the text as it is compared) and its SHA-256 as bytes."""
    d = id_text(docs).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return d.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def classes(docs: DataFrame, salts: int = SALTS, digest=None) -> DataFrame:
    """digest, norm, keep_id, group_size: a row for each different text."""
    d = normalised(docs)
    if digest is not None:
        d = d.withColumn("digest", digest)
    d = d.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    salted = d.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def deduplicate(docs: DataFrame, salts: int = SALTS, digest=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of docs. `digest` replaces the digest in tests of collisions."""
    full = classes(docs, salts, digest)
    found = settle(full.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    members = normalised(docs)
    if digest is not None:
        members = members.withColumn("digest", digest)
    cols = ("doc_id", "keep_id", "group_size", "digest")
    rows = salted_join(members.select("doc_id", "digest"), found.where("texts = 1"), "digest", "group_size", ["doc_id"], 80).select(*cols)
    several = found.where("texts > 1").select("digest")
    if not several.isEmpty():
        rows = rows.unionByName(members.join(several, "digest", "left_semi").join(full, ["digest", "norm"]).select(*cols))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Repeated rows of a document that stays: they are counted, and the count is dealt out as one kept row and the others.
    keepers = rows.where(stays).groupBy(*cols).agg(F.count("*").alias("times"))
    keepers = keepers.select(*cols, F.explode(F.expr("transform(sequence(1L, times), i -> i = 1)")).alias("kept"))
    return rows.where(~stays).select(*cols, F.lit(False).alias("kept")).unionByName(keepers)


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns. Only ids and digests of rows that go are joined."""
    digest, own, gone, of, again = free_names(docs, "digest", "id", "gone", "of", "stays")
    d = docs.withColumn(digest, F.unhex(F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)))
    d = d.withColumn(own, F.col("doc_id").cast("long"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    away = settle(deduplicate(docs, salts).where(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("digest").alias(of), stays.alias(again)).distinct())
    same = F.col(own).eqNullSafe(F.col(gone)) & (F.col(digest) == F.col(of))
    out = d.join(if_small(away.where(~F.col(again))), same, "left_anti")
    repeated = away.where(again)
    if not repeated.isEmpty():
        out = out.join(repeated, same, "left_anti").unionByName(out.join(repeated, same, "left_semi").dropDuplicates([own, digest]))
    return out.drop(digest, own)
