"""Single-end and paired-end runs: native steps in expressions, all kernels fused into one pass over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions import expressions as ex
from strandflow.operators import kernels as k
from strandflow.operators.dedup import mark_duplicates
from strandflow.plans.options import RESULTS, Options


def taken(df: DataFrame, o: Options) -> DataFrame:
    """The reads of a run as all steps and statistics see them: the first ones if there is a limit, qualities at the offset 33."""
    if o.reads_to_process:
        df = df.where(F.col("read_id") < o.reads_to_process)
    if o.phred64:
        df = df.withColumns({f"qual{m}": ex.phred33(F.col(f"qual{m}")) for m in ((1, 2) if o.paired else (1,))})
    return df


def prepared(df: DataFrame, o: Options) -> DataFrame:
    """The steps before kernels, on read_id, name1, seq1, qual1 (and the same of mate 2), with is_dup."""
    mates = (1, 2) if o.paired else (1,)
    df = taken(df, o)
    df = mark_duplicates(df, [f"seq{m}" for m in mates]) if o.eval_duplication and (o.dedup or not o.dup_calc_accuracy) else df.withColumn("is_dup", F.lit(False))
    listed = F.lit(False)
    if o.index_blacklist1:
        listed = listed | ex.index_matches(ex.first_index(F.col("name1")), o.index_blacklist1, o.index_threshold)
    if o.index_blacklist2 and o.paired:
        listed = listed | ex.index_matches(ex.last_index(F.col("name2")), o.index_blacklist2, o.index_threshold)
    df = df.where(~listed)
    if o.fix_mgi_id:
        df = df.withColumns({f"name{m}": ex.fix_mgi(F.col(f"name{m}")) for m in mates})
    return with_umis(df, o) if o.umi else df


def with_umis(df: DataFrame, o: Options) -> DataFrame:
    """Identifiers moved from indexes or reads into the names."""
    c, mates = F.col, (1, 2) if o.paired else (1,)
    start = lambda m: F.substring(c(f"seq{m}"), 1, o.umi_len)
    loc, always = o.umi_loc, o.umi_loc in ("per_index", "per_read")
    last = c("name2") if o.paired else c("name1")
    joined = lambda a, b: F.concat(a, F.lit("_"), b)
    umi: Column = {
        "index1": lambda: ex.first_index(c("name1")), "index2": lambda: ex.last_index(last), "read1": lambda: start(1), "read2": lambda: start(2),
        "per_index": lambda: joined(ex.first_index(c("name1")), ex.last_index(last)) if o.paired else ex.first_index(c("name1")),
        "per_read": lambda: joined(start(1), start(2)) if o.paired else start(1),
    }[loc]()
    df = df.withColumn("_umi", umi)
    new = {f"name{m}": ex.with_umi(c(f"name{m}"), c("_umi"), o.umi_prefix, o.umi_delim, always and o.paired) for m in mates}
    for m in mates:
        if loc == f"read{m}" or loc == "per_read":
            n = F.length(start(m)) + o.umi_skip
            new |= {f"{what}{m}": ex.trim_front(c(f"{what}{m}"), n) for what in ("seq", "qual")}
    return df.withColumns(new).drop("_umi")


SINGLE = (
    "read_id long, is_dup boolean, name1 string, seq1 string, strand1 string, qual1 string, lost1 boolean, front1 int, result1 int, result int, dimer boolean, "
    "trimmed1 boolean, adapters1 array<string>, poly1 string, poly_len1 int"
)
PAIRED = (
    SINGLE + ", name2 string, seq2 string, strand2 string, qual2 string, lost2 boolean, front2 int, result2 int, trimmed2 boolean, adapters2 array<string>, poly2 string, poly_len2 int, "
    "overlapped boolean, offset int, overlap_len int, diff int, gap boolean, insert_size int, corrected1 int, corrected2 int, corrections array<string>, "
    "merged_name string, merged_seq string, merged_qual string, merged_result int, overlap_seq string, overlap_qual string"
)


def process(df: DataFrame, o: Options, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Every read or pair after all steps, with what each step did to it. df as for prepared(), and strand1, strand2 and sample if it has them.

    wanted: the only columns to make, in any order; of the rest nothing leaves the pass over Arrow batches, and of names
    and strands nothing enters it.
    """
    o = o.validated()
    mates = (1, 2) if o.paired else (1,)
    fields = {f.split()[0]: f for f in (PAIRED if o.paired else SINGLE).split(", ")}
    given = [f"strand{m}" for m in mates if f"strand{m}" in df.columns]
    if "sample" in df.columns:
        fields["sample"] = "sample string"
    columns = [c for c in fields if (wanted is None or c in wanted) and (not c.startswith("strand") or c in given)]
    if wanted is not None and (unknown := set(wanted) - set(columns)):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    if wanted is not None and "is_dup" not in wanted and not o.dedup:
        o = replace(o, eval_duplication=False)
    needed = {"read_id", "is_dup", *columns} | ({"name1"} if "merged_name" in columns else set())
    names = ["read_id", "is_dup", *(["sample"] if "sample" in columns else []), *(f"{c}{m}" for m in mates for c in ("name", "seq", "strand", "qual") if c in ("seq", "qual") or f"{c}{m}" in needed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = _batch(b, o, set(columns))
                yield pa.RecordBatch.from_arrays([cols[c]() for c in columns], names=columns)

    return prepared(df, o).select(*names).mapInArrow(run, ", ".join(fields[c] for c in columns))


def _batch(b: pa.RecordBatch, o: Options, wanted: set[str]) -> dict[str, Callable[[], pa.Array]]:
    """What makes each column; steps of which nothing is wanted are left out where they change no other."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    n, cut = b.num_rows, k.Cut(o.cut_front, o.cut_tail, o.cut_right)
    mates = (1, 2) if o.paired else (1,)
    r, lost, front = {}, {}, {}
    for m in mates:
        f, t = (o.trim_front1, o.trim_tail1) if m == 1 else (o.of_mate2("trim_front"), o.of_mate2("trim_tail"))
        r[m], lost[m], front[m] = k.cut(k.reads(col[f"seq{m}"], col[f"qual{m}"]), f, t, cut)
    whole = ~np.any([lost[m] for m in mates], axis=0)  # steps on pairs need both mates
    if o.poly_g:
        for m in mates:
            r[m] = r[m].resized(np.where(whole, k.poly_g(r[m], o.poly_g_min), r[m].length))
    out: dict[str, Callable[[], pa.Array]] = {}
    adapters = {m: [[] for _ in range(n)] if f"adapters{m}" in wanted else None for m in mates}
    trimmed = {m: np.zeros(n, bool) for m in mates}
    percent = o.overlap_diff_percent / 100.0
    find = lambda limit=percent, gaps=False: _only(k.overlap(r[1], r[2], o.overlap_diff_limit, o.overlap_require, limit, gaps), whole)
    if o.paired:
        in_use = o.correction or o.adapter_trimming or wanted & {"insert_size", "overlapped", "offset", "overlap_len", "diff", "gap"}
        ov = find() if in_use else k.no_overlap(n)
        size = np.where(ov.offset > 0, r[1].length + r[2].length - ov.length, ov.length) + front[1] + front[2]
        out["insert_size"] = lambda: pa.array(np.where(ov.found, np.minimum(size, 512), 512), pa.int32(), mask=~whole)
        for_adapter = find(gaps=True) if o.gap_overlap else ov
        fixed, changes = (np.zeros(n, np.int64), np.zeros(n, np.int64)), []
        if o.correction:
            before = r
            a, c, n1, n2, _ = k.correct(r[1], r[2], for_adapter)
            r, fixed = {1: a, 2: c}, (n1, n2)
            changes = _changes(before, r, fixed) if "corrections" in wanted else []
        if o.adapter_trimming:
            by = for_adapter.found & (for_adapter.offset < 0)
            for m, other in ((1, 2), (2, 1)):
                _cut_at(r, m, np.where(by, np.minimum(r[m].length, for_adapter.length + front[other]), r[m].length), by, adapters, trimmed)
    if o.adapter_trimming:
        todo = whole & ~trimmed[1] if o.paired else whole
        given = {1: o.adapter, 2: o.adapter_r2}
        for m in mates:
            if given[m] and given[m] != "auto":
                _by_sequence(r, m, given[m], todo, 4, o.literal, adapters, trimmed)
        for m in mates:
            for a in o.adapter_list:
                _by_sequence(r, m, a, whole, k.adapters_least(len(o.adapter_list)), o.literal, adapters, trimmed)
    dimer = whole & np.any([trimmed[m] for m in mates], axis=0) & np.all([r[m].length <= o.dimer_max_len for m in mates], axis=0)
    if o.paired and wanted & {"overlap_seq", "overlap_qual"}:
        shared = find(0.0) if o.overlapped_out else k.no_overlap(n)
        start = np.maximum(shared.offset, 0)
        part = r[1].dropped(np.where(shared.found, start, 0)).resized(np.where(shared.found, shared.length, 0))
        out |= {f"overlap_{w}": lambda x=x: _masked(k.texts(x, part.length), ~shared.found) for w, x in (("seq", part.seq), ("qual", part.qual))}
    for m in mates:
        base, at = np.full(n, -1), r[m].length
        if o.poly_x:
            at, base = k.poly_x(r[m], o.poly_x_min)
            base = np.where(whole, base, -1)
            at = np.where(whole, at, r[m].length)
        out |= {f"poly{m}": lambda base=base: pa.array([None if x < 0 else chr(k.POLY_BASES[x]) for x in base.tolist()], pa.string()), f"poly_len{m}": lambda cut=r[m].length - at: pa.array(cut, pa.int32())}
        r[m] = r[m].resized(at)
        most = o.max_len1 if m == 1 else o.of_mate2("max_len")
        if most:
            r[m] = r[m].resized(np.where(whole, np.minimum(r[m].length, most), r[m].length))
    if wanted & {"result", *(f"result{m}" for m in mates)}:
        results = {m: np.where(dimer, 28, np.where(lost[m], 16, k.classify(r[m], o))) for m in mates}
        out |= {f"result{m}": lambda m=m: pa.array(results[m], pa.int32()) for m in mates}
        out["result"] = lambda: pa.array(np.max(list(results.values()), axis=0), pa.int32())
    for m in mates:
        out |= {c: lambda c=c: col[c] for c in (f"name{m}", f"strand{m}")}
        out |= {
            f"seq{m}": lambda m=m: _masked(k.texts(r[m].seq, r[m].length), lost[m]), f"qual{m}": lambda m=m: _masked(k.texts(r[m].qual, r[m].length), lost[m]),
            f"lost{m}": lambda m=m: pa.array(lost[m]), f"front{m}": lambda m=m: pa.array(front[m], pa.int32()),
            f"trimmed{m}": lambda m=m: pa.array(trimmed[m]), f"adapters{m}": lambda m=m: pa.array(adapters[m], pa.list_(pa.string())),
        }
    if "sample" in col:
        out["sample"] = lambda: col["sample"]
    out |= {"read_id": lambda: col["read_id"], "is_dup": lambda: col["is_dup"], "dimer": lambda: pa.array(dimer)}
    if o.paired:
        out |= {"overlapped": lambda: pa.array(ov.found), "gap": lambda: pa.array(ov.gap), "corrections": lambda: pa.array(changes or [[]] * n, pa.list_(pa.string()))}
        numbers = {"offset": ov.offset, "overlap_len": ov.length, "diff": ov.diff, "corrected1": fixed[0], "corrected2": fixed[1]}
        out |= {c: lambda v=v: pa.array(v, pa.int32()) for c, v in numbers.items()}
        if wanted & {"merged_name", "merged_seq", "merged_qual", "merged_result"}:
            out |= {c: lambda v=v: v for c, v in _merged(col, r, find() if o.merge else None, n, o, wanted).items()}
    return out


def _masked(a: pa.Array, gone: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), a)


def _only(ov: k.Overlap, whole: np.ndarray) -> k.Overlap:
    return k.Overlap(*(np.where(whole, x, 0).astype(x.dtype) for x in (ov.found, ov.offset, ov.length, ov.diff, ov.gap)))


def _changes(before: dict, after: dict, fixed: tuple) -> list[list[str]]:
    """The bases that correction replaced, as from>to."""
    out: list[list[str]] = [[] for _ in range(len(fixed[0]))]
    for m in (1, 2):
        for i, p in zip(*np.nonzero(before[m].seq != after[m].seq), strict=True):
            out[i].append(f"{chr(before[m].seq[i, p])}>{chr(after[m].seq[i, p])}")
    return out


def _cut_at(r: dict, m: int, length: np.ndarray, some: np.ndarray, adapters: dict, trimmed: dict) -> None:
    """Cut mate m to length where some; what goes is noted as its adapter."""
    own = r[m]
    for i in np.flatnonzero(some).tolist() if adapters[m] is not None else ():
        if own.length[i] > length[i]:
            adapters[m][i].append(own.seq[i, length[i] : own.length[i]].tobytes().decode("latin-1"))
    r[m] = own.resized(np.where(some, length, own.length))
    trimmed[m] |= some


def _by_sequence(r: dict, m: int, adapter: str, some: np.ndarray, least: int, literal: bool, adapters: dict, trimmed: dict) -> None:
    at = k.adapter_at(r[m], adapter.encode(), least, literal)
    hit = some & (at < r[m].length)
    early = np.flatnonzero(hit & (at < 0))
    for i in early.tolist() if adapters[m] is not None else ():
        adapters[m][i].append(adapter[: len(adapter) + int(at[i])])
    trimmed[m] |= hit
    inside = hit & (at >= 0)
    _cut_at(r, m, at, inside, adapters, trimmed)
    r[m] = r[m].resized(np.where(hit & (at < 0), 0, r[m].length))


def _merged(col: dict, r: dict, ov: k.Overlap | None, n: int, o: Options, wanted: set[str]) -> dict[str, pa.Array]:
    if ov is None:
        none = pa.nulls(n, pa.string())
        return {"merged_name": none, "merged_seq": none, "merged_qual": none, "merged_result": pa.nulls(n, pa.int32())}
    rc = r[2].complemented()
    len1 = np.where(ov.found, ov.length + np.maximum(ov.offset, 0), 0)
    len2 = np.where(ov.found & (ov.offset > 0), r[2].length - ov.length, 0)
    head, tail = r[1].resized(len1), rc.dropped(np.where(len2 > 0, ov.length, 0)).resized(len2)
    join = lambda a, b: pc.binary_join_element_wise(a, b, "")
    seq = join(k.texts(head.seq, head.length), k.texts(tail.seq, tail.length))
    qual = join(k.texts(head.qual, head.length), k.texts(tail.qual, tail.length))
    gone = ~ov.found
    out = {"merged_seq": _masked(seq, gone), "merged_qual": _masked(qual, gone)}
    if "merged_result" in wanted:
        out["merged_result"] = pa.array(k.classify(k.reads(seq, qual), o), pa.int32(), mask=gone)
    if "merged_name" in wanted:
        name = [f"{x} merged_{a}_{b}" for x, a, b in zip(col["name1"].to_pylist(), len1.tolist(), len2.tolist(), strict=True)]
        out["merged_name"] = _masked(pa.array(name, pa.string()), gone)
    return out


def filter_counts(done: DataFrame, o: Options) -> DataFrame:
    """result and reads: how many reads each result has. A pair counts twice, by the worse of its mates."""
    weight = 2 if o.paired else 1
    results = F.array(F.struct(F.col("result").alias("result"), F.lit(weight).alias("w")))
    if o.paired and o.merge:
        one = F.array(F.struct(F.col("merged_result").alias("result"), F.lit(2).alias("w")))
        each = F.array(*(F.struct(F.col(f"result{m}").alias("result"), F.lit(1).alias("w")) for m in (1, 2)))
        both = ~F.col("lost1") & ~F.col("lost2")
        results = F.when(F.col("merged_seq").isNotNull(), one).when(both & F.lit(o.include_unmerged), each).otherwise(results)
    d = done.select(F.explode(results).alias("x")).groupBy("x.result").agg(F.sum("x.w").cast("long").alias("reads"))
    return d.select("result", "reads")


def routed_columns(df: DataFrame, o: Options) -> tuple[str, ...]:
    """The columns of process(df, o) that routes() reads."""
    mates = (1, 2) if o.paired else (1,)
    own = [c for c in ("sample", *(f"strand{m}" for m in mates)) if c in df.columns]
    out = ["read_id", "is_dup", *own, *(f"{c}{m}" for m in mates for c in ("name", "seq", "qual", "result"))]
    if not o.paired:
        return (*out, "result")
    if o.merge:
        out += ["lost1", "lost2", *(f"merged_{c}" for c in ("name", "seq", "qual", "result"))]
    return (*out, *(("overlap_seq", "overlap_qual") if o.overlapped_out else ()))


def routes(done: DataFrame, o: Options) -> DataFrame:
    """One row for each record written: (sample,) read_id, mate (0: merged), target, name (with its tag in failed), seq, strand, qual.

    Targets: out1, out2, unpaired1, unpaired2, failed, merged, overlapped. Pairs of which both mates fail go to
    failed too, as documented; with o.literal they are written nowhere.
    """
    tag = F.create_map(*(x for c, t in RESULTS.items() for x in (F.lit(c), F.lit(t))))
    strand = lambda m: (F.col(f"strand{m}") if f"strand{m}" in done.columns else F.lit("+")).alias("strand")
    rec = lambda m, target, name=None: F.struct(F.lit(m).alias("mate"), F.lit(target).alias("target"), (F.col(f"name{m}") if name is None else name).alias("name"), F.col(f"seq{m}").alias("seq"), strand(m), F.col(f"qual{m}").alias("qual"))
    failed = lambda m, why=None: rec(m, "failed", F.concat_ws(" ", f"name{m}", F.lit(why) if why else tag[F.col(f"result{m}")]))
    none = F.array().cast("array<struct<mate:int,target:string,name:string,seq:string,strand:string,qual:string>>")
    emit = ~F.col("is_dup") if o.dedup else F.lit(True)
    if not o.paired:
        out = F.when(emit & (F.col("result") == 0), F.array(rec(1, "out1")))
        out = out.when((F.col("result") != 0) & F.lit(bool(o.failed_out)), F.array(failed(1))) if o.failed_out else out
        rows = out.otherwise(none)
    else:
        ok1, ok2 = F.col("result1") == 0, F.col("result2") == 0
        to_failed = lambda *r: F.array(*r) if o.failed_out else none
        left = F.concat(F.array(rec(1, "unpaired1")), to_failed(failed(2))) if o.unpaired1 else to_failed(failed(1, "paired_read_is_failing"), failed(2))
        right_to = "unpaired2" if o.unpaired2 and o.unpaired2 != o.unpaired1 else "unpaired1" if o.unpaired1 or o.unpaired2 else ""
        right = F.concat(F.array(rec(2, right_to)), to_failed(failed(1))) if right_to else to_failed(failed(1), failed(2, "paired_read_is_failing"))
        both_failed = none if o.literal else to_failed(failed(1), failed(2))
        plain = F.when(~emit, none).when(ok1 & ok2, F.array(rec(1, "out1"), rec(2, "out2"))).when(ok1, left).when(ok2, right).otherwise(both_failed)
        rows = plain
        if o.merge:
            one = F.struct(F.lit(0).alias("mate"), F.lit("merged").alias("target"), F.col("merged_name").alias("name"), F.col("merged_seq").alias("seq"), strand(1), F.col("merged_qual").alias("qual"))
            rows = F.when(F.col("merged_seq").isNotNull(), F.when(F.col("merged_result") == 0, F.array(one)).otherwise(none))
            if o.include_unmerged:
                each = [F.when(emit & (F.col(f"result{m}") == 0), F.array(rec(m, "merged"))).otherwise(none) for m in (1, 2)]
                rows = rows.when(~F.col("lost1") & ~F.col("lost2"), F.concat(*each))
            rows = rows.otherwise(plain)
        if o.overlapped_out:
            part = F.struct(F.lit(1).alias("mate"), F.lit("overlapped").alias("target"), F.col("name1").alias("name"), F.col("overlap_seq").alias("seq"), strand(1), F.col("overlap_qual").alias("qual"))
            rows = F.concat(rows, F.when(F.col("overlap_seq").isNotNull(), F.array(part)).otherwise(none))
    own = [c for c in ("sample", "read_id") if c in done.columns]
    return done.select(*own, F.explode(rows).alias("r")).select(*own, "r.*")
