"""What is found out before a run, from bounded samples in file order: read length, chemistry, adapters, frequent sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.operators import kernels as k
from strandflow.operators.adapters import known_adapters
from strandflow.plans.session import discard, settle

#: Name prefixes of two-colour instruments. Fixed values.
TWO_COLOUR = ("@FS", "@MN", "@SH", "@NS", "@NB", "@NDX", "@VL", "@VH", "@A", "@NA", "@LH")
LENGTH_SAMPLE, ADAPTER_SAMPLE, VOTE_SAMPLE = 1000, 262_144, 100_000
ADAPTER_BASES, OVERREP_BASES = 151 * 262_144, 151 * 10_000
#: Reads below which no adapter is looked for.
LEAST_READS = 10_000
#: Bases to which a grown adapter is cut, bases from which on no 10-mer is looked for, and bases that are looked at on each side of one.
_MOST, _SEARCHED, _AROUND = 60, 500, 512
#: Lengths of candidate sequences and the counts they need. Fixed values.
OVERREP = {10: 500, 20: 100, 40: 20, 100: 5}


def read_length(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The longest of the first reads."""
    return df.where(F.col("read_id") < LENGTH_SAMPLE).agg(F.coalesce(F.max(F.length(seq)), F.lit(0)).alias("seq_len"))


def two_colour(df: DataFrame) -> DataFrame:
    """Whether the first read's name is of a two-colour instrument. Only the first reads are looked at, which a table of reads finds by read_id."""
    first = df.where(F.col("read_id") < LENGTH_SAMPLE).agg(F.min_by("name", "read_id").alias("name"))
    hit = F.lit(False)
    for p in TWO_COLOUR:
        hit = hit | F.col("name").startswith(p)
    return first.select(F.coalesce(hit, F.lit(False)).alias("two_colour"))


def ten_mers(df: DataFrame, seq: str = "seq", shift_tail: int = 1, top: int | None = 10) -> DataFrame:
    """The most frequent 10-mers behind base 20 that may be adapter: not low in complexity, not GC-rich; ties: the larger code first."""
    d = df.where(F.col("read_id") < ADAPTER_SAMPLE).select(F.col(seq).alias("s")).where(F.length("s") >= 30 + shift_tail)
    d = d.select(F.explode(F.expr(f"transform(sequence(20, length(s) - 10 - {shift_tail}), i -> substring(s, i + 1, 10))")).alias("kmer"))
    count = lambda b: 10 - F.length(F.replace("kmer", F.lit(b), F.lit("")))
    few = F.lit(True)
    for b in "ACGT":
        few = few & (count(b) < 6)
    d = d.where(F.col("kmer").rlike("^[ACGT]{10}$")).groupBy("kmer").agg(F.count("*").alias("n"))
    d = d.where(few & (count("G") + count("C") < 8) & ~F.col("kmer").startswith("GGGG"))
    return d.orderBy(F.desc("n"), F.desc(F.translate("kmer", "ATCG", "0123"))).limit(top) if top else d


def first_bases(df: DataFrame, reads: int, bases: int, seq: str = "seq") -> DataFrame:
    """The first reads in file order, at most `reads`, up to the one with which they come to `bases` bases."""
    d = df.where(F.col("read_id") < reads)
    if (d.agg(F.sum(F.length(seq).cast("long"))).first()[0] or 0) <= bases:
        return d
    # The running sum is over a bounded sample.
    before = F.coalesce(F.sum(F.length(seq).cast("long")).over(Window.orderBy("read_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_before", before).where(F.col("_before") < bases).drop("_before")


def adapter_votes(df: DataFrame, adapters: dict[str, str] | None = None, seq: str = "seq") -> DataFrame:
    """adapter, hits and mismatches: the first place in each sampled read where a known adapter fits over 8 bases or more, with one mismatch for 16 bases.

    So few mismatches leave one of the adapter's successive 8 bases whole, so that places are looked up by 8 bases.
    """
    items = sorted(adapters if adapters is not None else known_adapters())
    code = np.full(256, 1 << 20, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    weights = 4 ** np.arange(7, -1, -1)

    by = ["sample"] if "sample" in df.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in pc.unique(b.column(1)).to_pylist() if by else [None]:
                out = votes(b.column(0) if own is None else b.column(0).filter(pc.equal(b.column(1), own)))
                yield out if own is None else out.add_column(0, "sample", pa.array([own] * out.num_rows, pa.string()))

    def votes(column: pa.Array) -> pa.RecordBatch:
        r = k.reads(column, column)
        wide = max(r.seq.shape[1] - 7, 0)
        keys = sum(code[r.seq[:, i : i + wide]] * w for i, w in enumerate(weights.tolist())).ravel() if wide else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        hits, wrong = [], []
        for a in items:
            ad = np.frombuffer(a.encode(), np.uint8)
            found = [np.zeros((0, 2), np.int64)]
            for at in range(0, len(ad) - 7, 8):
                key = int((code[ad[at : at + 8]] * weights).sum())
                row, place = np.divmod(order[np.searchsorted(keys, key) : np.searchsorted(keys, key, "right")], max(wide, 1))
                found.append(np.stack([row, place - at], axis=1)[place >= at])
            row, place = np.unique(np.concatenate(found), axis=0).T
            size = np.minimum(r.length[row] - place, len(ad))
            s = np.pad(r.seq[row], ((0, 0), (0, len(ad))))
            part = np.take_along_axis(s, place[:, None] + np.arange(len(ad)), 1)
            d = ((part != ad) & (np.arange(len(ad)) < size[:, None])).sum(axis=1)
            ok = (size >= 8) & (d <= size // 16)
            row, d = row[ok], d[ok]
            first = np.r_[True, row[1:] != row[:-1]][: len(row)]  # by row and place
            hits.append(int(first.sum()))
            wrong.append(int(d[first].sum()))
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(hits, pa.int64()), pa.array(wrong, pa.int64())], names=["adapter", "hits", "mismatches"])

    d = df.where(F.col("read_id") < VOTE_SAMPLE).select(seq, *by).mapInArrow(run, "sample string, " * len(by) + "adapter string, hits long, mismatches long")
    return d.groupBy(*by, "adapter").agg(F.sum("hits").alias("hits"), F.sum("mismatches").alias("mismatches"))


def known_adapter(df: DataFrame, adapters: dict[str, str] | None = None, seq: str = "seq") -> str:
    """The adapter with most hits, if more than one read in 50 has it, or one in 200 almost without mismatches; else ''."""
    n = df.where(F.col("read_id") < VOTE_SAMPLE).count()
    best = adapter_votes(df, adapters, seq).orderBy(F.desc("hits"), "adapter").first()
    ok = best is not None and (best.hits > n / 50 or (best.hits > n / 200 and best.mismatches < best.hits))
    return best.adapter if ok else ""


def adapters_by_sample(df: DataFrame, adapters: dict[str, str] | None = None, seq: str = "seq") -> dict[str, str]:
    """The known adapter of each sample ('' where none has enough votes), of reads with a column `sample`; samples of under 10,000 reads have none.

    As known_adapter() for each, by the same jobs for all: each sample's first reads are counted and voted on.
    """
    d = df.where(F.col("read_id") < ADAPTER_SAMPLE).withColumn("_size", F.length(seq).cast("long"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("sample").orderBy("read_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The running sum is over a bounded sample of each sample's reads.
    first = d.withColumn("_before", before).where(F.col("_before") < ADAPTER_BASES)
    counts = {r["sample"]: r for r in first.groupBy("sample").agg(F.count("*").alias("n"), F.count_if(F.col("read_id") < VOTE_SAMPLE).alias("voting")).collect()}
    out = dict.fromkeys(counts, "")
    votes = adapter_votes(first, adapters, seq)
    best: dict[str, tuple] = {}
    for r in votes.collect():  # a row for each known adapter of each sample
        rank = (-r.hits, r.adapter)
        if r["sample"] not in best or rank < best[r["sample"]][0]:
            best[r["sample"]] = rank, r
    for s, (_, r) in best.items():
        n = counts[s].voting
        if counts[s].n >= LEAST_READS and (r.hits > n / 50 or (r.hits > n / 200 and r.mismatches < r.hits)):
            out[s] = r.adapter
    return out


def find_adapter(df: DataFrame, seq: str = "seq", adapters: dict[str, str] | None = None, literal: bool = False) -> str:
    """A known adapter, or one grown from a frequent 10-mer; '' if there is neither or there are under 10,000 reads.

    A grown adapter is cut to _MOST bases. What follows the 10-mer must end for want of reads, not in a fork; literal: what
    comes before it too.
    """
    sample = first_bases(df, ADAPTER_SAMPLE, ADAPTER_BASES, seq).select("read_id", F.col(seq).alias("seq"))
    if sample.count() < LEAST_READS:
        return ""
    if known := known_adapter(sample, adapters):
        return known
    known = sorted(adapters if adapters is not None else known_adapters())
    for r in grown_adapters(sample):
        grown = r["grown"][:_MOST]
        for a in known:
            if grown.startswith(a):
                return a
        if r["leaf_after"] and (r["leaf_before"] or not literal):
            return grown
    return ""


def grown_adapters(sample: DataFrame) -> list[dict]:
    """kmer, grown, leaf_after and leaf_before of each of the at most ten 10-mers that stand out in a sample of reads, the most frequent first.

    grown: the 10-mer between the dominant paths of what stands before and after it; leaf: whether a path ended for want of reads.
    """
    all_mers = ten_mers(sample, top=None)
    total = all_mers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    changes = lambda s: sum(a != b for a, b in zip(s, s[1:], strict=False))
    seeds = [r.kmer for r in ten_mers(sample).collect() if r.n >= 10 and r.n * 4**10 >= 20 * total and changes(r.kmer) >= 3]
    if not seeds:
        return []

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str]] = []
            for s in b.column(0).to_pylist():
                for seed in seeds:
                    at = s.find(seed, 20, len(s) - 1) if s else -1
                    while 0 <= at < _SEARCHED:
                        rows.append((f"{seed}>", s[at + 10 : len(s) - 1][:_AROUND]))
                        rows.append((f"{seed}<", s[max(0, at - _AROUND) : at][::-1]))
                        at = s.find(seed, at + 1, len(s) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["key", "text"])

    texts = settle(sample.select("seq").mapInArrow(around, "key string, text string").withColumn("text", F.substring_index("text", "N", 1)))
    paths = dominant_paths(texts)
    discard(texts)
    none = ("", True)
    out = []
    for s in seeds:
        (ahead, leaf_after), (back, leaf_before) = paths.get(f"{s}>", none), paths.get(f"{s}<", none)
        out.append({"kmer": s, "grown": back[::-1] + s + ahead, "leaf_after": leaf_after, "leaf_before": leaf_before})
    return out


def dominant_paths(texts: DataFrame, share: float = 0.95, least: int = 50, step: int = 16) -> dict[str, tuple[str, bool]]:
    """For each key the path from the root of the tree of its texts along children with a share of their parent's texts, and whether it ended for want of texts.

    texts: key (few) and text, a written table. No task and no group holds a tree: from where each path has come to, the nodes of the next `step` levels are counted by
    an aggregation that combines within tasks, and only nodes with the texts that a path needs come to the driver, until all paths have ended.
    """
    some = math.ceil(share * least)
    paths = {r.key: "" for r in texts.select("key").distinct().collect()}
    done: dict[str, tuple[str, bool]] = {}
    while left := sorted(paths.keys() - done.keys()):
        so_far = F.create_map(*(F.lit(x) for key in left for x in (key, paths[key])))
        d = texts.withColumn("path", so_far[F.col("key")]).where(F.col("path").isNotNull() & F.col("text").startswith(F.col("path")))
        d = d.select("key", F.expr(f"substring(text, length(path) + 1, {step})").alias("more"), (F.length("text") - F.length("path")).alias("size"))
        d = d.select("key", "more", "size", F.explode(F.sequence(F.lit(0), F.length("more"))).alias("level"))
        d = d.groupBy("key", F.expr("left(more, level)").alias("node")).agg(F.count("*").alias("n"), F.count_if(F.col("size") > F.col("level")).alias("longer"))
        rows = d.where(F.col("n") >= some).collect()  # of texts of a bounded sample, those that some texts share
        nodes = {(r.key, r.node): r for r in rows}
        below: dict[tuple[str, str], list] = {}
        for r in rows:
            if r.node:
                below.setdefault((r.key, r.node[:-1]), []).append(r)
        for key in left:
            at = ""
            while True:
                here = nodes.get((key, at))
                if here is None or here.longer < least:
                    done[key] = paths[key] + at, True
                    break
                if len(at) == step:
                    paths[key] += at
                    break
                best = next((r for r in below.get((key, at), []) if r.n >= share * here.longer), None)
                if best is None:
                    done[key] = paths[key] + at, False
                    break
                at = best.node
    return done


def over_represented_candidates(df: DataFrame, seq_len: int, seq: str = "seq", bases: int = OVERREP_BASES) -> DataFrame:
    """seq and n: frequent windows of the first bases, without those inside a longer one that is not much rarer."""
    # At most `bases` reads can count, as each has a base.
    d = first_bases(df.where(F.length(seq) > 0), bases, bases, seq).select(F.col(seq).alias("s"))
    sizes = {z: n for z, n in {**OVERREP, **({min(150, seq_len - 2): 3} if seq_len > 12 else {})}.items() if z > 0}

    def windows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the hashes of all windows, and where there are windows."""
        m, length = k.matrix(b.column(0))
        for size in (z for z in sizes if z <= m.shape[1]):
            h = k.run_hashes(m, size).view(np.int64)
            yield size, h, np.arange(h.shape[1]) <= (length - size)[:, None]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, h, inside in windows(b):
                values, n = np.unique(h[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size), pa.int32()), pa.array(values), pa.array(n)], names=["size", "h", "n"])

    least = F.create_map(*(F.lit(x) for item in sizes.items() for x in item))
    often = d.mapInArrow(counted, "size int, h long, n long").groupBy("size", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("size")])
    known = {z: np.sort(np.array([r.h for r in rows], np.int64)) for z, rows in _by_size(often.select("size", "h").collect()).items()}  # of a bounded sample

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reads, found = b.column(0).to_pylist(), []
            for size, h, inside in windows(b):
                row, at = np.nonzero(inside & np.isin(h, known.get(size, np.zeros(0, np.int64))))
                found += [reads[i][j : j + size] for i, j in zip(row.tolist(), at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["seq"])

    # Counted once more as text, so that equal hashes of different windows do no harm.
    c = d.mapInArrow(texts, "seq string").groupBy("seq").agg(F.count("*").alias("n")).where(F.col("n") >= least[F.length("seq")])
    longer = c.select(F.col("seq").alias("of"), F.col("n").alias("m"))
    # A theta join of two small sets: windows that pass their thresholds in a bounded sample.
    return c.join(longer, (F.length("of") > F.length("seq")) & F.col("of").contains(F.col("seq")) & (F.expr("n div m") < 10), "left_anti")


def _by_size(rows: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.size, []).append(r)
    return out
