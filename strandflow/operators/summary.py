"""All figures of a report as one mergeable partial state: one pass over Arrow batches emits it, one aggregation adds it up.

A state is rows of block, kind, key and place with four sums. Blocks are groups of reads (a mate before or after filtering) and `run`
(what happened to reads). Rows of equal block, kind, key and place are added, so that states merge in any order:

| kind | key | place | n, a, b, c |
|-|-|-|-|
| reads | | | reads |
| cycle | base | cycle | reads, those of quality 20 and 30, sum of quality |
| kmer | k-mer | | windows |
| quality | | quality | bases |
| frequent | candidate sequence | place in the read | occurrences |
| result, insert | | code, size | reads or pairs |
| adapter1, adapter2 | sequence cut off | | reads, less what the sketch gave up |
| cut1, cut2 | | | sequences cut off, bases in a, in b what the sketch gave up at most for each |
| trimmed1, trimmed2, dup, corrected, merged | | | reads; corrected: bases in a |
| poly | base | | reads, bases in a |

Sequences cut off are many and different, so that each task keeps a sketch of the frequent ones (`Frequent`), which bounds what is
shuffled. Where sketches gave nothing up the counts are exact; else the few that may have their share are counted again by themselves.

Reads of several samples have a column `sample`, and a state of their own for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.operators import kernels as k
from strandflow.operators import stats
from strandflow.plans.options import Options
from strandflow.plans.session import free_names

SCHEMA = "block string, kind string, key string, place int, n long, a long, b long, c long"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Places of a matrix of reads that is handled at a time; long reads go in fewer rows.
CELLS = 1 << 23


#: Sequences that a sketch keeps; it gives up less than one in so many of all there are.
ROOM = 400


class Frequent:
    """The frequent ones of many sequences, in bounded space: sketches of parts add up to one of the whole."""

    def __init__(self, room: int = ROOM):
        self.room, self.counts, self.total, self.bases, self.given_up = room, Counter(), 0, 0, 0

    def add(self, found: Counter) -> None:
        self.total += sum(found.values())
        self.bases += sum(len(x) * n for x, n in found.items())
        self.counts.update(found)
        if len(self.counts) > 4 * self.room:
            self.prune()

    def prune(self) -> None:
        """All counts less the one behind the first `room`; what has none left goes."""
        if len(self.counts) > self.room:
            less = sorted(self.counts.values(), reverse=True)[self.room]
            self.counts = Counter({x: n - less for x, n in self.counts.items() if n > less})
            self.given_up += less


@dataclass(frozen=True)
class Block:
    """Reads whose statistics are wanted: columns, which rows, and sequences to look for in every sampling-th read."""

    seq: str
    qual: str
    where: Column | None = None
    candidates: tuple[str, ...] = field(default=())
    sampling: int = 20


def summarize(df: DataFrame, blocks: dict[str, Block], run: Options | None = None) -> DataFrame:
    """The state of df, added up. run: df is the result of a run with these options, and what it did is counted too."""
    flags = dict(zip(blocks, free_names(df, *(f"in_{b}" for b in blocks)), strict=True))
    facts = _fact_columns(df, run) if run else []
    by = ["sample"] if "sample" in df.columns else []
    columns = list(dict.fromkeys([*by, *(c for b in blocks.values() for c in (b.seq, b.qual)), *facts, *(["read_id"] if any(b.candidates for b in blocks.values()) else [])]))
    rows = df.select(*columns, *(F.coalesce(F.lit(True) if b.where is None else b.where, F.lit(False)).alias(flags[n]) for n, b in blocks.items()))
    plain = {n: (b.seq, b.qual, b.candidates, b.sampling) for n, b in blocks.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda part, sample: part if sample is None else part.add_column(0, "sample", pa.array([sample] * part.num_rows, pa.string()))
        cut: dict[tuple, Frequent] = {}
        for batch, sample in _samples(batches) if by else ((b, None) for b in batches):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out: list[pa.RecordBatch] = []
            for name, (seq, qual, candidates, sampling) in plain.items():
                inside = pc.and_(col[flags[name]], pc.is_valid(col[seq]))
                own = [col[c].filter(inside) for c in (seq, qual)]
                ids = col["read_id"].filter(inside).to_numpy() if candidates else None
                out += _of_reads(name, *own, ids, candidates, sampling)
            if run:
                out += _of_run(col, run)
                for m in (m for m in (1, 2) if f"adapters{m}" in col):
                    cut.setdefault((sample, m), Frequent()).add(Counter(a for a in pc.list_flatten(col[f"adapters{m}"]).to_pylist() if a))
            for part in out:
                yield named(part, sample)
        for (sample, m), f in cut.items():
            f.prune()
            yield named(_rows("run", f"adapter{m}", list(f.counts), None, list(f.counts.values())), sample)
            yield named(_rows("run", f"cut{m}", n=[f.total], a=[f.bases], b=[f.given_up]), sample)

    added = rows.mapInArrow(partial, "sample string, " * len(by) + SCHEMA).groupBy(*by, "block", "kind", "key", "place")
    return added.agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "c")))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, str]]:
    for batch in batches:
        own = batch.column(batch.schema.get_field_index("sample"))
        for sample in pc.unique(own).to_pylist():
            yield batch.filter(pc.equal(own, sample)), sample


def _rows(block: str, kind: str, key=None, place=None, n=None, a=None, b=None, c=None) -> pa.RecordBatch:
    size = len(n)
    texts = lambda x: pa.array([x] * size if isinstance(x, str) else x, pa.string())
    longs = lambda x: pa.array(np.zeros(size, np.int64) if x is None else np.asarray(x, np.int64))
    cols = [texts(block), texts(kind), texts("" if key is None else key), pa.array(np.full(size, -1) if place is None else np.asarray(place), pa.int32()), *map(longs, (n, a, b, c))]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _of_reads(name: str, seq: pa.Array, qual: pa.Array, ids: np.ndarray | None, candidates: tuple[str, ...], sampling: int) -> Iterator[pa.RecordBatch]:
    length = pc.binary_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    yield _rows(name, "reads", n=[len(seq)])
    start = 0
    while start < len(seq):
        widest = np.maximum.accumulate(length[start:])
        stop = start + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, "right")))
        r = k.reads(seq.slice(start, stop - start), qual.slice(start, stop - start))
        at, sums = stats.cycle_sums(r)
        yield _rows(name, "cycle", [chr(x) for x in (at % 256).tolist()], at // 256, *sums)
        names, total = stats.kmer_sums(r.seq)
        yield _rows(name, "kmer", names, None, total)
        at, total = stats.quality_sums(r.qual, r.length)
        yield _rows(name, "quality", None, at, total)
        if candidates:
            some = np.flatnonzero(ids[start:stop] % sampling == 0)
            found = stats.places_of(candidates, seq.slice(start, stop - start).take(pa.array(some)))
            yield _rows(name, "frequent", [x for x, _ in found], [x for _, x in found], list(found.values()))
        start = stop


def _fact_columns(done: DataFrame, o: Options) -> list[str]:
    mates = (1, 2) if o.paired else (1,)
    wanted = ["result", "is_dup"]
    if o.adapter_trimming:
        wanted += [f"{c}{m}" for m in mates for c in ("trimmed", "adapters")]
    if o.poly_x:
        wanted += [f"{c}{m}" for m in mates for c in ("poly", "poly_len")]
    if o.paired:
        wanted += ["insert_size", "corrected1", "corrected2"]
        if o.merge:
            wanted += ["merged_seq", "merged_result", "lost1", "lost2", "result1", "result2"]
    return [c for c in wanted if c in done.columns]


def _of_run(col: dict[str, pa.Array], o: Options) -> Iterator[pa.RecordBatch]:
    mates = (1, 2) if o.paired else (1,)
    if "result" in col:
        for code, n in sorted(_results(col, o).items()):
            yield _rows("run", "result", None, [code], [n])
    if "is_dup" in col:
        yield _rows("run", "dup", n=[pc.sum(col["is_dup"].cast(pa.int64())).as_py() or 0], a=[len(col["is_dup"])])
    if "insert_size" in col:
        sizes = col["insert_size"].drop_null().to_numpy()
        at, n = np.unique(sizes, return_counts=True)
        yield _rows("run", "insert", None, at, n)
    for m in mates:
        if f"trimmed{m}" in col:
            yield _rows("run", f"trimmed{m}", n=[pc.sum(col[f"trimmed{m}"].cast(pa.int64())).as_py() or 0])
        if f"poly{m}" in col:
            base, size = col[f"poly{m}"].to_numpy(zero_copy_only=False), col[f"poly_len{m}"].to_numpy(zero_copy_only=False)
            for b in "ATCG":
                yield _rows("run", "poly", b, None, [int((base == b).sum())], [int(size[base == b].sum())])
    if "corrected1" in col:
        fixed = [col[f"corrected{m}"].to_numpy(zero_copy_only=False) for m in (1, 2)]
        yield _rows("run", "corrected", n=[sum(int((f > 0).sum()) for f in fixed)], a=[sum(int(f.sum()) for f in fixed)])
    if o.merge and "merged_seq" in col:
        yield _rows("run", "merged", n=[len(col["merged_seq"]) - col["merged_seq"].null_count])


def _results(col: dict[str, pa.Array], o: Options) -> Counter:
    """Reads by result: a pair counts twice by the worse of its mates, a merged one by its own result."""
    number = lambda c: col[c].to_numpy(zero_copy_only=False)
    result = number("result")
    if not (o.paired and o.merge and "merged_seq" in col):
        return _counted((result, 2 if o.paired else 1))
    merged = col["merged_seq"].is_valid().to_numpy(zero_copy_only=False)
    whole = ~merged & ~number("lost1").astype(bool) & ~number("lost2").astype(bool) & o.include_unmerged
    return _counted((number("merged_result")[merged], 2), (number("result1")[whole], 1), (number("result2")[whole], 1), (result[~merged & ~whole], 2))


def _counted(*codes: tuple[np.ndarray, int]) -> Counter:
    total: Counter = Counter()
    for values, weight in codes:
        at, n = np.unique(values.astype(np.int64), return_counts=True)
        total.update(dict(zip(at.tolist(), (n * weight).tolist(), strict=True)))
    return total


class Figures:
    """The state of one sample in the driver: as many rows as cycles, k-mers, qualities, codes and candidates, and adapters of a share."""

    def __init__(self):
        self.rows: dict[tuple[str, str], dict[tuple[str, int], tuple[int, int, int, int]]] = {}
        #: By mate: adapters of a hundredth of all that were cut at least, with the rest as others; and the bases cut.
        self.adapters: dict[int, dict[str, int]] = {1: {}, 2: {}}
        self.adapter_bases: dict[int, int] = {1: 0, 2: 0}

    def of(self, block: str, kind: str) -> dict[tuple[str, int], tuple[int, int, int, int]]:
        return self.rows.get((block, kind), {})

    def total(self, kind: str, what: int = 0, block: str = "run") -> int:
        return sum(v[what] for v in self.of(block, kind).values())


def figures(state: DataFrame, done: DataFrame | None = None, share: float = 0.01) -> dict[str, Figures]:
    """The figures of each sample of a written state ('' where there are no samples), by two jobs for all of them.

    done: what the state is of; where sketches gave something up its adapters are read once more, for the sequences that may have the share.
    """
    by = ["sample"] if "sample" in state.columns else []
    out: dict[str, Figures] = {}
    of = lambda r: out.setdefault(r["sample"] if by else "", Figures())
    is_adapter = F.col("kind").isin("adapter1", "adapter2")
    for r in state.where(~is_adapter).collect():
        of(r).rows.setdefault((r.block, r.kind), {})[r.key, r.place] = (r.n, r.a, r.b, r.c)
    mate = F.substring("kind", -1, 1).cast("int").alias("mate")
    totals = state.where(F.col("kind").isin("cut1", "cut2")).select(*by, mate, F.col("n").alias("total"), F.col("b").alias("given_up"))  # two rows a sample
    some = state.where(is_adapter).select(*by, mate, "key", "n").join(totals, [*by, "mate"]).where(F.col("n") + F.col("given_up") >= share * F.col("total"))
    counts: dict[tuple[str, int], dict[str, int]] = {}
    for r in some.collect():  # of each mate of a sample as many as can have the share
        counts.setdefault((r["sample"] if by else "", r.mate), {})[r.key] = r.n
    sure = lambda s, m: not out[s].total(f"cut{m}", 2)
    if unsure := {k: c for k, c in counts.items() if not sure(*k)}:
        counts |= _recounted(done, unsure)
    for s, f in out.items():
        for m in (1, 2):
            total = f.total(f"cut{m}")
            found = {x: n for x, n in counts.get((s, m), {}).items() if n >= share * total}
            rest = total - sum(found.values())
            f.adapters[m] = {x: found[x] for x in sorted(found, key=lambda x: (len(x), x))} | ({"others": rest} if rest else {})
            f.adapter_bases[m] = f.total(f"cut{m}", 1)
    return out


def _recounted(done: DataFrame, unsure: dict[tuple[str, int], dict[str, int]]) -> dict[tuple[str, int], dict[str, int]]:
    """How often the sequences named were cut off; only these are counted and shuffled, of the columns with adapters."""
    by = ["sample"] if "sample" in done.columns else []
    wanted = done.sparkSession.createDataFrame([(s, m, x) for (s, m), c in unsure.items() for x in c], "sample string, mate int, key string")
    mates = [m for m in (1, 2) if f"adapters{m}" in done.columns]
    each = [done.select(*by, F.lit(m).alias("mate"), F.explode(f"adapters{m}").alias("key")) for m in mates]
    rows = each[0] if len(each) == 1 else each[0].unionByName(each[1])
    found = rows.join(F.broadcast(wanted), [*by, "mate", "key"]).groupBy(*by, "mate", "key").agg(F.count("*").alias("n"))  # under 200 a mate
    out: dict[tuple[str, int], dict[str, int]] = {k: {} for k in unsure}
    for r in found.collect():
        out[r["sample"] if by else "", r.mate][r.key] = r.n
    return out
