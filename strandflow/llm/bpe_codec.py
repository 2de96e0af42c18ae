"""Byte-level BPE encoding of whole texts in overlapping chunks, and decoding.

Every text is cut into chunks that overlap: where it stands if it has at most `chunk` characters, into chunks of
`LOCAL` and `LOCAL_OVERLAP` characters; a longer one is dealt over tasks in chunks of `chunk` and `overlap`:

1. each chunk is pre-tokenised by itself;
2. two neighbours are stitched at the first boundary in their overlap that both have. From a common boundary
   on, both splits read the same characters and so agree: there they have resynchronised;
3. each chunk encodes its pre-tokens between its two stitches, and the ids are joined in order.

Boundaries within the last `_LOOK` characters of a chunk are not used, since what follows may change them. If
some overlap has no common boundary (say, a word longer than the overlap), the document is encoded in one piece.

Defined cases: a null text counts as empty and has no ids; special tokens' strings are ordinary text; repeated
rows are encoded alike, each its own row. Columns besides doc_id and text are ignored. Decoding joins the ids'
raw bytes, which for null ids are none; an id that the ranks leave out has no bytes, one beyond the last is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.llm import bpe
from strandflow.llm.common import batch_of, id_text, map_batches

CHUNK, OVERLAP = 32_768, 512
LOCAL, LOCAL_OVERLAP = 2_048, 256
#: A contraction reaches so far beyond a boundary; one more for the white-space rule.
_LOOK = 4


def boundaries(text: str, pieces: list[str], chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of a chunk begin and end, and which of these may be stitched to the chunk before and, from that one's view, to the one behind."""
    at = np.cumsum([0, *map(len, pieces)])
    return at, at[at < overlap], at[(at >= chunk) & (at <= len(text) - _LOOK)] - chunk


def encode_chunks(text: str, enc: bpe.Encoder, chunk: int = LOCAL, overlap: int = LOCAL_OVERLAP) -> bytes:
    """The ids of a text by overlapping chunks."""
    if len(text) <= chunk + overlap:
        return enc.encode(text)
    last = (len(text) - overlap - 1) // chunk
    ids: list[bytes] = []
    before, tail, begin = [], np.zeros(1, np.int64), 0
    for k in range(last + 1):
        own = text[k * chunk : (k + 1) * chunk + overlap]
        pieces = bpe.pieces(own)
        at, head, next_tail = boundaries(own, pieces, chunk, overlap)
        if k:
            common = np.intersect1d(tail, head)
            if not len(common):
                return enc.encode(text)
            ids += [enc[p] for p in before[begin : int(np.searchsorted(before_at, chunk + common[0]))]]
            begin = int(np.searchsorted(at, common[0]))
        before, before_at, tail = pieces, at, next_tail
    ids += [enc[p] for p in before[begin:]]
    return b"".join(ids)


def _encode_rows(df: DataFrame, ranks: str, local: tuple[int, int]) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = bpe.encoder(ranks)
        ids = [encode_chunks(t, enc, *local) for t in batch.column("text").to_pylist()]
        return batch_of(doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.binary()))

    return map_batches(df, run, "doc_id long, ids binary")


def encode_documents(docs: DataFrame, ranks: str, chunk: int = CHUNK, overlap: int = OVERLAP, local: tuple[int, int] = (LOCAL, LOCAL_OVERLAP)) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of docs, by the rank file `ranks`."""
    d = id_text(docs)
    short = _encode_rows(d.where(F.length("text") <= chunk + overlap), ranks, local)
    return short.unionByName(_encode_long(d.where(F.length("text") > chunk + overlap), ranks, chunk, overlap, local))


def _encode_long(d: DataFrame, ranks: str, chunk: int, overlap: int, local: tuple[int, int]) -> DataFrame:
    key = ["doc_id", "digest", "k"]
    last = F.expr(f"cast((length(text) - {overlap} - 1) div {chunk} as int)")
    cut = d.select("doc_id", F.sha2("text", 256).alias("digest"), last.alias("last"), "text", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    cut = cut.withColumn("text", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})"))
    # The texts' only shuffle: the chunks of one document go to different tasks, equal ones of repeated rows become one.
    cut = cut.groupBy(*key).agg(F.first("text").alias("text"), F.first("last").alias("last"), F.count("*").alias("copies"))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads, tails = [], []
        for text in batch.column("text").to_pylist():
            _, head, tail = boundaries(text, bpe.pieces(text), chunk, overlap)
            heads.append(head.tolist())
            tails.append(tail.tolist())
        own = {c: batch.column(c) for c in (*key, "last", "size")}
        return batch_of(**own, head=pa.array(heads, pa.list_(pa.int32())), tail=pa.array(tails, pa.list_(pa.int32())))

    ends = map_batches(cut.select(*key, "last", F.length("text").alias("size"), "text"), split, "doc_id long, digest string, k int, last int, size int, head array<int>, tail array<int>")
    of = Window.partitionBy("doc_id", "digest")
    by_k = of.orderBy("k")
    ends = ends.withColumns({
        "begin": F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by_k), "head"))),
        "end": F.when(F.col("k") == F.col("last"), F.col("size")).otherwise(chunk + F.array_min(F.array_intersect("tail", F.lead("head").over(by_k)))),
    })
    ends = ends.withColumn("stitched", F.min((F.col("begin").isNotNull() & F.col("end").isNotNull()).cast("int")).over(of))
    ends = ends.select(F.col("doc_id").alias("id"), F.col("digest").alias("dg"), F.col("k").alias("kk"), "begin", "end", "stitched")
    parts = cut.join(ends, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("dg")) & (F.col("k") == F.col("kk")))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, out = bpe.encoder(ranks), []
        for text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end")), strict=True):
            ids, at = [], begin
            for p in bpe.pieces(text[begin:]):
                if at >= end:
                    break
                at += len(p)
                ids.append(enc[p])
            assert at == end, "the stitch is no boundary"
            out.append(b"".join(ids))
        return batch_of(**{c: batch.column(c) for c in ("doc_id", "digest", "copies", "k")}, ids=pa.array(out, pa.binary()))

    fitting = parts.where("stitched = 1").select("doc_id", "digest", "copies", "k", "text", "begin", "end")
    encoded = map_batches(fitting, encode, "doc_id long, digest string, copies long, k int, ids binary")
    joined = encoded.groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = joined.select("doc_id", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"), "copies")
    joined = joined.select("doc_id", "ids", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "ids")
    apart = parts.where("stitched = 0").select("doc_id", "digest").distinct()
    apart = apart.withColumnsRenamed({"doc_id": "id", "digest": "dg"})
    whole = d.join(apart, F.col("doc_id").eqNullSafe(F.col("id")) & (F.sha2("text", 256) == F.col("dg")), "left_semi")
    return joined.unionByName(_encode_rows(whole, ranks, local))


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and data, the bytes that the ids stand for."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, out = bpe.id_bytes(ranks), []
        for ids in batch.column("ids").to_pylist():
            out.append(b"".join(map(raw.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())))
        return batch_of(doc_id=batch.column("doc_id"), ids=batch.column("ids"), data=pa.array(out, pa.binary()))

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, data binary")
