"""All registered queries of the read-processing operators, with their oracles."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions import expressions as ex
from strandflow.operators import bit_filter, detect, stats
from strandflow.operators import kernels as k
from strandflow.operators import pipeline as run
from strandflow.operators import single_steps as step
from strandflow.operators.adapters import known_adapters
from strandflow.operators.dedup import duplication_rate, mark_duplicates
from strandflow.operators.summary import Block, summarize
from strandflow.plans import report
from strandflow.plans.fixture import first_single, oracle, pairs, pairs_folder, single
from strandflow.plans.options import UMI_PLACES, Options
from strandflow.plans.session import expose, shared_dir
from strandflow.streaming import stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
R1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
R2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"
#: Adapters that the queries try in turn or vote on.
FOUR = (R1, R2, "CTGTCTCTTATACACATCT", "TGGAATTCTCGGGTGCCAAGG")


def query(sql: str | None = None, source=pairs, plain: bool = False, name: str | None = None):
    """Register a function of a DataFrame of reads; sql is DuckDB SQL over `reads` (the pairs), plain: over the tables."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(source(expose(spark), sf_dir))
        QUERIES[key].__name__ = key
        if sql:
            ORACLES[key] = sql if plain else oracle(sql)
        return fn

    return register


# Sources and names

_TAIL = "string_split(substr(name1, 1, length(name1) - 2), ':')[-1]"
_FIRST = f"CASE WHEN contains({_TAIL}, '+') THEN split_part({_TAIL}, '+', 1) ELSE {_TAIL} || right(name1, 2) END"
_LAST = "regexp_extract(name2, '[:+]([^:+]*.{2})$', 1)"


@query("SELECT pair_id, name1, name2, seq1, qual1, seq2, qual2 FROM reads")
def reads_pairs(d):
    return d


@query("SELECT pair_id, 1 AS mate, name1 AS name, seq1 AS seq, qual1 AS qual FROM reads UNION ALL SELECT pair_id, 2, name2, seq2, qual2 FROM reads")
def reads_interleaved(d):
    mates = F.explode(F.array(*(F.struct(F.lit(m).alias("mate"), *(F.col(f"{c}{m}").alias(c) for c in ("name", "seq", "qual"))) for m in (1, 2))))
    return d.select("pair_id", mates.alias("r")).select("pair_id", "r.*")


@query("SELECT pair_id, reverse(translate(regexp_replace(seq1, '[^ACGTacgt]', 'N', 'g'), 'ACGTNacgt', 'TGCANTGCA')) AS rc1, reverse(translate(seq2, 'ACGTN', 'TGCAN')) AS rc2 FROM reads")
def reads_revcomp(d):
    return d.select("pair_id", *(ex.reverse_complement(F.col(f"seq{m}")).alias(f"rc{m}") for m in (1, 2)))


@query("SELECT pair_id, array_to_string(list_transform(range(1, length(qual1) + 1), lambda i: chr(greatest(33, ascii(qual1[i]) - 31))), '') AS qual FROM reads")
def reads_phred64(d):
    return d.select("pair_id", ex.phred33(F.col("qual1")).alias("qual"))


@query("SELECT pair_id FROM reads WHERE pair_id < 100")
def reads_limit(d):
    return d.where(F.col("pair_id") < 100).select("pair_id")


@query(f"SELECT pair_id, {_FIRST} AS first1, {_LAST} AS last2 FROM reads")
def name_indexes(d):
    return d.select("pair_id", ex.first_index(F.col("name1")).alias("first1"), ex.last_index(F.col("name2")).alias("last2"))


@query("SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN '@m' || pair_id ELSE '@m' || pair_id || ' /' || (pair_id % 3) END AS name FROM reads")
def name_fix_mgi(d):
    raw = F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("@m"), "pair_id")).otherwise(F.concat(F.lit("@m"), "pair_id", F.lit("/"), F.col("pair_id") % 3))
    return d.select("pair_id", ex.fix_mgi(raw).alias("name"))


def _umi(loc: str):
    o = Options(paired=True, umi=True, umi_loc=loc, umi_len=8 if "read" in loc else 0, umi_skip=2 if "read" in loc else 0, umi_prefix="UMI" if "1" in loc else "")
    first, last = _FIRST, _LAST
    umi = {"index1": first, "index2": last, "read1": "substr(seq1, 1, 8)", "read2": "substr(seq2, 1, 8)", "per_index": f"({first}) || '_' || {last}", "per_read": "substr(seq1, 1, 8) || '_' || substr(seq2, 1, 8)"}[loc]
    tag = f"':{o.umi_prefix + '_' if o.umi_prefix else ''}' || ({umi})"
    cut = lambda m, c: f"substr({c}{m}, 11)" if loc in (f"read{m}", "per_read") else f"{c}{m}"
    cols = ", ".join(f"substr(name{m}, 1, instr(name{m}, ' ') - 1) || {tag} || substr(name{m}, instr(name{m}, ' ')) AS name{m}, {cut(m, 'seq')} AS seq{m}, {cut(m, 'qual')} AS qual{m}" for m in (1, 2))
    query(f"SELECT pair_id, {cols} FROM reads", name=f"umi_{loc}")(lambda d: run.with_umis(d, o).select("pair_id", "name1", "seq1", "qual1", "name2", "seq2", "qual2"))


for _loc in UMI_PLACES:
    _umi(_loc)

# Filters. In SQL, as the operators define them: counts by position.

_LOW = "length(qual1) - length(translate(qual1, '!\"#$%&''()*+,-./', ''))"
_NS = "length(seq1) - length(replace(seq1, 'N', ''))"
_MEAN = "list_sum(list_transform(range(1, length(qual1) + 1), lambda i: ascii(qual1[i]) - 33)) // length(qual1)"
_CHANGES = "list_sum(list_transform(range(1, length(seq1)), lambda i: CASE WHEN seq1[i] <> seq1[i + 1] THEN 1 ELSE 0 END))"
_QUALITY = f"({_LOW}) > 40 * length(seq1) / 100.0"
_CODE = f"CASE WHEN length(seq1) = 0 THEN 16 WHEN {_QUALITY} THEN 20 WHEN {_NS} > 5 THEN 12 WHEN length(seq1) < 15 THEN 16 ELSE 0 END"
OFF = {"quality_filter": False, "length_filter": False}


def _filter(name: str, o: Options, sql: str):
    query(f"SELECT pair_id AS read_id, ({sql})::INT AS result FROM reads", single, name=name)(lambda d: step.results(d, o))


_filter("filter_quality", Options(n_base_limit=1000, length_filter=False), f"CASE WHEN {_QUALITY} THEN 20 ELSE 0 END")
_filter("filter_avg_qual", Options(n_base_limit=1000, unqualified_percent=100, average_quality=28, length_filter=False), f"CASE WHEN {_MEAN} < 28 THEN 20 ELSE 0 END")
_filter("filter_n", Options(unqualified_percent=100, length_filter=False), f"CASE WHEN {_NS} > 5 THEN 12 ELSE 0 END")
_filter("filter_length", Options(quality_filter=False, length_required=101), "CASE WHEN length(seq1) < 101 THEN 16 ELSE 0 END")
_filter("filter_too_long", Options(quality_filter=False, length_limit=99), "CASE WHEN length(seq1) > 99 THEN 17 ELSE 0 END")
_filter("filter_complexity", Options(complexity_filter=True, complexity_percent=45, **OFF), f"CASE WHEN ({_CHANGES})::DOUBLE / (length(seq1) - 1) < 0.45 THEN 24 ELSE 0 END")


@query(f"SELECT code::INT AS result, count(*) AS reads FROM (SELECT {_CODE} AS code FROM reads) GROUP BY code", single)
def filter_result_counts(d):
    return step.results(d, Options()).groupBy("result").agg(F.count("*").alias("reads"))


_CODE2 = _CODE.replace("seq1", "seq2").replace("qual1", "qual2")


@query(f"SELECT code::INT AS result, 2 * count(*) AS reads FROM (SELECT greatest({_CODE}, {_CODE2}) AS code FROM reads) GROUP BY code")
def filter_pair_max(d):
    o = Options(paired=True, adapter_trimming=False)
    return run.filter_counts(_done(d, o, "result"), o)


_BARCODES = ("ACGTACGT", "AAAAAAAA", "CCGT")


@query(f"SELECT pair_id FROM (SELECT pair_id, {_FIRST} AS ix FROM reads) WHERE NOT ("
       + " OR ".join(f"hamming(substr(ix, 1, {len(b)}), substr('{b}', 1, length(ix))) <= 2" for b in _BARCODES) + ")")
def filter_index_blacklist(d):
    return d.where(~ex.index_matches(ex.first_index(F.col("name1")), _BARCODES, 2)).select("pair_id")


# Trimming. Positions are rows in SQL.


@query("SELECT pair_id AS read_id, substr(seq1, 6, length(seq1) - 8) AS seq, substr(qual1, 6, length(seq1) - 8) AS qual FROM reads", single)
def trim_global(d):
    return step.quality_cut(d, k.Cut(), 5, 3).select("read_id", "seq", "qual")


@query("SELECT pair_id AS read_id, substr(seq1, 1, 60) AS seq FROM reads", single)
def trim_max_len(d):
    done = run.process(d.withColumnsRenamed({"name": "name1", "seq": "seq1", "qual": "qual1"}), Options(max_len1=60, adapter_trimming=False, **OFF), ("read_id", "seq1"))
    return done.select("read_id", F.col("seq1").alias("seq"))


_POS = "p AS (SELECT pair_id AS id, length(seq1) AS l, i, ascii(qual1[i + 1]) AS q, seq1[i + 1] AS b FROM reads, unnest(range(0, length(seq1))) AS t(i))"
_KEPT = "SELECT r.pair_id AS read_id, CASE WHEN x.n > 0 AND x.s < length(seq1) - 1 THEN substr(seq1, x.s + 1, x.n) END AS seq, CASE WHEN x.n > 0 AND x.s < length(seq1) - 1 THEN substr(qual1, x.s + 1, x.n) END AS qual FROM reads r JOIN x ON r.pair_id = x.id"
_FRONT = (
    "w AS (SELECT id, l, i, sum(q) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM p), "
    "f AS (SELECT id, any_value(l) AS l, coalesce(min(i) FILTER (i + 4 < l AND s >= 4 * 53), greatest(any_value(l) - 4, 0)) AS s0 FROM w GROUP BY id), "
    "g AS (SELECT id, l, CASE WHEN s0 > 0 THEN s0 + 3 ELSE s0 END AS s1 FROM f)"
)


@query(f"SELECT * FROM (WITH {_POS}, {_FRONT}, x AS (SELECT g.id, coalesce(min(p.i) FILTER (p.i >= s1 AND b <> 'N'), any_value(g.l)) AS s, 1000 AS n FROM g JOIN p USING (id) GROUP BY g.id) {_KEPT})", single)
def cut_front(d):
    return step.quality_cut(d, k.Cut(front=(4, 20))).select("read_id", "seq", "qual")


@query(
    f"SELECT * FROM (WITH {_POS}, w AS (SELECT id, l, i, b, sum(q) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM p), "
    "f AS (SELECT id, any_value(l) AS l, coalesce(max(i) FILTER (i - 4 >= 0 AND s >= 4 * 53), 3) AS t0 FROM w GROUP BY id), "
    "g AS (SELECT id, l, CASE WHEN t0 < l - 1 THEN t0 - 3 ELSE t0 END AS t FROM f), "
    f"x AS (SELECT g.id, 0 AS s, coalesce(max(p.i) FILTER (p.i <= t AND b <> 'N'), -1) + 1 AS n FROM g JOIN p USING (id) GROUP BY g.id) {_KEPT})",
    single,
)
def cut_tail(d):
    return step.quality_cut(d, k.Cut(tail=(4, 20))).select("read_id", "seq", "qual")


@query(
    f"SELECT * FROM (WITH {_POS}, w AS (SELECT id, l, i, q, sum(q) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM p), "
    "f AS (SELECT id, any_value(l) AS l, min(i) FILTER (i + 4 < l AND s < 4 * 53) AS s0 FROM w GROUP BY id), "
    "x AS (SELECT f.id, 0 AS s, CASE WHEN any_value(s0) IS NULL THEN any_value(f.l) ELSE least(coalesce(min(p.i) FILTER (p.i >= s0 AND q < 53), any_value(f.l) - 1), any_value(f.l) - 1) END AS n FROM f JOIN p USING (id) GROUP BY f.id) "
    f"{_KEPT})",
    single,
)
def cut_right(d):
    return step.quality_cut(d, k.Cut(right=(4, 20))).select("read_id", "seq", "qual")


_BACK = "p AS (SELECT pair_id AS id, length(seq1) AS l, i, seq1[length(seq1) - i] AS b FROM reads, unnest(range(0, length(seq1))) AS t(i))"


@query(
    f"SELECT * FROM (WITH {_BACK}, c AS (SELECT *, sum(CASE WHEN b <> 'G' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS m FROM p), "
    "v AS (SELECT id, any_value(l) AS l, coalesce(min(i) FILTER (m > 5 OR (m > (i + 1) // 8 AND i >= 9)), any_value(l)) AS stop FROM c GROUP BY id) "
    "SELECT v.id AS read_id, (CASE WHEN any_value(stop) >= 10 THEN any_value(v.l) - 1 - coalesce(max(i) FILTER (b = 'G' AND i <= stop), 0) ELSE any_value(v.l) END)::INT AS trimmed_len FROM v JOIN c USING (id) GROUP BY v.id)",
    single,
)
def trim_polyg(d):
    return step.trim_poly_g(d)


_TALLY = ", ".join(f"sum(CASE WHEN b IN ('{b}', 'N') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS n{b}" for b in "ATCG")


_POLYX = (
    f"SELECT * FROM (WITH {_BACK}, c AS (SELECT *, {_TALLY} FROM p), "
    "v AS (SELECT id, any_value(l) AS l, coalesce(min(i) FILTER (i + 1 - greatest(nA, nT, nC, nG) > least(5, (i + 1) // 8) AND (i >= 8 OR i + 1 >= 9)), any_value(l)) AS stop FROM c GROUP BY id), "
    "w AS (SELECT v.*, CASE greatest(nA, nT, nC, nG) WHEN nA THEN 'A' WHEN nT THEN 'T' WHEN nC THEN 'C' ELSE 'G' END AS best FROM v JOIN c ON c.id = v.id AND c.i = least(v.stop, v.l - 1)) "
    "SELECT w.id AS read_id, (CASE WHEN any_value(stop) + 1 >= 10 THEN any_value(w.l) - 1 - coalesce(max(i) FILTER (b = best AND i <= stop), -1) ELSE any_value(w.l) END)::INT AS trimmed_len, "
    "CASE WHEN any_value(stop) + 1 >= 10 THEN any_value(best) END AS base FROM w JOIN c USING (id) GROUP BY w.id)"
)


@query(_POLYX, single)
def trim_polyx(d):
    return step.trim_poly_x(d)


@query(f"SELECT base, count(*) AS reads, sum(l - trimmed_len)::BIGINT AS bases FROM ({_POLYX}) JOIN (SELECT pair_id AS read_id, length(seq1) AS l FROM reads) USING (read_id) WHERE base IS NOT NULL GROUP BY base", single)
def polyx_counts(d):
    return stats.poly_counts(run.process(as_single(d), Options(poly_x=True, adapter_trimming=False, **OFF), ("poly1", "poly_len1")))


@query(
    f"SELECT * FROM (WITH {_POS}, w AS (SELECT *, sum(q) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM p), "
    "f AS (SELECT id, any_value(l) AS l, coalesce(min(i) FILTER (i >= 2 AND i + 4 < l - 1 AND s >= 4 * 53), greatest(any_value(l) - 5, 2)) + 3 AS s1 FROM w GROUP BY id), "
    "g AS (SELECT f.id, any_value(f.l) AS l, coalesce(min(i) FILTER (i >= s1 AND b <> 'N'), greatest(any_value(f.l), any_value(s1))) AS st FROM f JOIN p USING (id) GROUP BY f.id), "
    "h AS (SELECT g.id, any_value(g.l) AS l, any_value(st) AS st, coalesce(max(i + 3) FILTER (i + 3 <= g.l - 2 AND i - 1 >= st AND s >= 4 * 53), least(any_value(g.l) - 2, any_value(st) + 3)) AS t0 FROM g JOIN w USING (id) GROUP BY g.id), "
    "k AS (SELECT h.id, any_value(h.l) AS l, any_value(st) AS st, coalesce(max(i) FILTER (i <= CASE WHEN t0 < h.l - 1 THEN t0 - 3 ELSE t0 END AND b <> 'N'), -1) AS t FROM h JOIN p USING (id) GROUP BY h.id), "
    "x AS (SELECT id, st AS s, CASE WHEN l - st - 5 > 0 THEN t - st + 1 ELSE 0 END AS n FROM k) "
    f"{_KEPT})",
    single,
)
def cut_combined(d):
    return step.quality_cut(d, k.Cut((4, 20), (4, 20)), 2, 1).select("read_id", "seq", "qual")


# Overlaps: offsets are rows in SQL, the first that fits counts.

_OV = (
    "rc AS (SELECT pair_id AS id, seq1, qual1, seq2, qual2, reverse(translate(seq2, 'ACGTN', 'TGCAN')) AS s2, length(seq1) AS l1, length(seq2) AS l2 FROM reads), "
    "o AS (SELECT *, k, CASE WHEN k < 1000 THEN k ELSE 1000 - k END AS off FROM rc, unnest(list_concat(range(0, 70), range(1000, 1070))) AS t(k)), "
    "c AS (SELECT *, CASE WHEN off >= 0 AND k < 1000 THEN least(l1 - off, l2) ELSE least(l1, l2 + off) END AS ol FROM o WHERE (k < 1000 AND off < l1 - 30) OR (k >= 1000 AND -off < l2 - 30)), "
    "h AS (SELECT *, substr(seq1, greatest(off, 0) + 1, ol) AS a, substr(s2, greatest(-off, 0) + 1, ol) AS b FROM c), "
    "m AS (SELECT *, hamming(a, b) AS d, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM h WHERE hamming(substr(a, 1, 50), substr(b, 1, 50)) <= least(5, floor(ol * 0.2))), "
    "ov AS (SELECT id, off, ol, d FROM m WHERE rn = 1)"
)


@query(f"SELECT * FROM (WITH {_OV} SELECT id AS pair_id, off::INT AS \"offset\", ol::INT AS overlap_len, d::INT AS diff FROM ov)")
def overlap(d):
    return step.overlaps(d).where("overlapped").drop("overlapped")


_GAPS = (
    "g AS (SELECT * FROM (SELECT *, least(5, floor(ol * 0.2)) AS most FROM h WHERE id NOT IN (SELECT id FROM ov)) WHERE ol > 1 AND hamming(substr(a, 1, ol::INT - 1), substr(b, 1, ol::INT - 1)) <= most + 5), "
    "g1 AS (SELECT *, unnest([false, true]) AS swap FROM g), g2 AS (SELECT id, k, off, ol, most, swap, CASE WHEN swap THEN b ELSE a END AS x, CASE WHEN swap THEN a ELSE b END AS y FROM g1), "
    "g3 AS (SELECT *, (substr(x, ol::INT, 1) <> substr(y, ol::INT - 1, 1))::INT AS last FROM g2 WHERE ol > 2), "
    "g4 AS (SELECT *, unnest(range(1, ol::INT - 1)) AS j FROM g3 WHERE hamming(substr(x, 1, ol::INT - 2), substr(y, 1, ol::INT - 2)) + last <= most), "
    "g5 AS (SELECT id, k, swap, any_value(off) AS off, any_value(ol) AS ol, any_value(most) AS most, min(hamming(substr(x, 1, j::INT), substr(y, 1, j::INT)) + hamming(substr(x, j::INT + 2, ol::INT - 1 - j::INT), substr(y, j::INT + 1, ol::INT - 1 - j::INT))) AS d FROM g4 GROUP BY id, k, swap), "
    "g6 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, swap) AS rn FROM g5 WHERE d <= most)"
)


@query(f"SELECT * FROM (WITH {_OV}, {_GAPS} SELECT id AS pair_id, off::INT AS \"offset\", ol::INT AS overlap_len, d::INT AS diff FROM ov UNION ALL SELECT id, off::INT, ol::INT, d::INT FROM g6 WHERE rn = 1)")
def overlap_gapped(d):
    return step.overlaps(d, gaps=True).where("overlapped").drop("overlapped")


_SIZE = f"WITH {_OV} SELECT least(512, coalesce(CASE WHEN off > 0 THEN l1 + l2 - ol ELSE ol END, 512))::INT AS insert_size, count(*) AS n FROM rc LEFT JOIN ov USING (id) GROUP BY 1"
PLAIN = Options(paired=True, **OFF)


def _done(d: DataFrame, o: Options, *wanted: str) -> DataFrame:
    """The run's columns `wanted`; without any, all of them."""
    return run.process(d.withColumnRenamed("pair_id", "read_id"), o, wanted or None)


@query(f"SELECT * FROM ({_SIZE})")
def overlap_insert_size(d):
    return stats.insert_sizes(_done(d, PLAIN, "insert_size"))


@query(f"SELECT * FROM ({_SIZE}) WHERE insert_size < 512 ORDER BY n DESC, insert_size LIMIT 1")
def insert_size_peak(d):
    return stats.insert_peak(stats.insert_sizes(_done(d, PLAIN, "insert_size")))


_FIX = (
    f"{_OV}, b AS (SELECT id, greatest(off, 0) + j AS p1, l2 - greatest(0, -off) - 1 - j AS p2 FROM ov JOIN rc USING (id), unnest(range(0, ol)) AS t(j) WHERE d > 0), "
    "e AS (SELECT id, p1, p2, seq1[p1 + 1] AS x, translate(seq2[p2 + 1], 'ACGTN', 'TGCAN') AS y, qual1[p1 + 1] AS qx, qual2[p2 + 1] AS qy FROM b JOIN rc USING (id)), "
    "fix AS (SELECT *, CASE WHEN x <> y AND ascii(qx) >= 63 AND ascii(qy) <= 47 THEN 2 WHEN x <> y AND ascii(qy) >= 63 AND ascii(qx) <= 47 THEN 1 ELSE 0 END AS m FROM e)"
)


_CORRECTED = (
    f"WITH {_FIX}, "
    "n1 AS (SELECT rc.id, string_agg(coalesce(y, seq1[i + 1]), '' ORDER BY i) AS seq1, string_agg(coalesce(qy, qual1[i + 1]), '' ORDER BY i) AS qual1 FROM rc, unnest(range(0, l1)) AS t(i) LEFT JOIN fix ON fix.id = rc.id AND fix.p1 = i AND m = 1 GROUP BY rc.id), "
    "n2 AS (SELECT rc.id, string_agg(coalesce(translate(x, 'ACGTN', 'TGCAN'), seq2[i + 1]), '' ORDER BY i) AS seq2, string_agg(coalesce(qx, qual2[i + 1]), '' ORDER BY i) AS qual2 FROM rc, unnest(range(0, l2)) AS t(i) LEFT JOIN fix ON fix.id = rc.id AND fix.p2 = i AND m = 2 GROUP BY rc.id) "
    "SELECT id AS pair_id, seq1, qual1, seq2, qual2 FROM n1 JOIN n2 USING (id)"
)


@query(f"SELECT pair_id AS read_id, seq1, qual1, seq2, qual2 FROM ({_CORRECTED})")
def correct_bases(d):
    return _done(d, Options(paired=True, correction=True, adapter_trimming=False, **OFF), "read_id", "seq1", "qual1", "seq2", "qual2")


@query(f"SELECT * FROM (WITH {_FIX} SELECT CASE m WHEN 1 THEN x ELSE translate(y, 'ACGTN', 'TGCAN') END AS from_base, CASE m WHEN 1 THEN y ELSE translate(x, 'ACGTN', 'TGCAN') END AS to_base, count(*) AS n FROM fix WHERE m > 0 GROUP BY ALL)")
def correction_matrix(d):
    return stats.correction_matrix(_done(d, Options(paired=True, correction=True, adapter_trimming=False, **OFF), "corrections"))


# Adapters

_CUT = f"{_OV}, t AS (SELECT id, seq1, seq2, qual1, qual2, CASE WHEN off < 0 THEN least(l1, ol) ELSE l1 END AS k1, CASE WHEN off < 0 THEN least(l2, ol) ELSE l2 END AS k2, coalesce(off < 0, false) AS hit FROM rc LEFT JOIN ov USING (id))"


@query(f"SELECT * FROM (WITH {_CUT} SELECT id AS read_id, substr(seq1, 1, k1) AS seq1, substr(seq2, 1, k2) AS seq2, hit AS trimmed1 FROM t)")
def adapter_overlap(d):
    return _done(d, PLAIN, "read_id", "seq1", "seq2", "trimmed1")


@query(f"SELECT * FROM (WITH {_CUT} SELECT substr(seq1, k1 + 1) AS adapter, count(*) AS n FROM t WHERE hit AND k1 < length(seq1) GROUP BY 1)")
def adapter_counts(d):
    return stats.adapter_counts(_done(d, PLAIN, "adapters1"))


@query(f"SELECT * FROM (WITH {_CUT} SELECT 2 * sum(hit::BIGINT)::BIGINT AS trimmed_reads, sum(length(seq1) - k1 + length(seq2) - k2)::BIGINT AS trimmed_bases FROM t)")
def adapter_trimmed(d):
    done = _done(d, PLAIN, "trimmed1", "trimmed2", "adapters1", "adapters2")
    bases = F.expr("aggregate(concat(adapters1, adapters2), 0L, (x, a) -> x + length(a))")
    reads = F.col("trimmed1").cast("long") + F.col("trimmed2").cast("long")
    return done.agg(F.sum(reads).alias("trimmed_reads"), F.sum(bases).alias("trimmed_bases"))


@query(
    f"SELECT * FROM (WITH {_CUT}, a AS (SELECT substr(seq1, k1 + 1) AS adapter, count(*) AS n FROM t WHERE hit AND k1 < length(seq1) GROUP BY 1) "
    "SELECT CASE WHEN n >= 0.01 * (SELECT sum(n) FROM a) THEN adapter ELSE 'others' END AS adapter, sum(n)::BIGINT AS n FROM a GROUP BY 1)"
)
def adapter_report(d):
    return stats.adapter_report(stats.adapter_counts(_done(d, PLAIN, "adapters1")))


def _adapter_sql(adapter: str, seq: str, ids: str) -> str:
    """The first place where the adapter fits without gaps; a read of which it does not keeps its length."""
    n = len(adapter)
    return (
        f"SELECT {ids}.id, coalesce(min(greatest(i, 0)) FILTER (hamming(substr(s, greatest(i, 0) + 1, cl - greatest(-i, 0)), substr('{adapter}', greatest(-i, 0) + 1, cl - greatest(-i, 0))) <= cl // 8), any_value(length(s))) AS n "
        f"FROM (SELECT id, {seq} AS s, i, least(length({seq}) - i, {n}) AS cl FROM {ids}, unnest(range(-4, 100)) AS t(i) WHERE i < length({seq}) - 4) AS {ids} GROUP BY {ids}.id"
    )


_SIMPLE = "src AS (SELECT pair_id AS id, seq1 FROM reads)"


def _no_gaps(d: DataFrame, adapter: str, least: int = 4) -> DataFrame:
    """Only comparisons without gaps, which SQL restates."""

    def fn(s, q):
        r = k.reads(s, q)
        return {"trimmed_len": pa.array(np.maximum(k.adapter_at(r, adapter.encode(), least, gaps=False), 0), pa.int32())}

    return step.apply(d, ["read_id", "seq", "qual"], fn, "trimmed_len int")


def _gapped_sql(adapter: str, of: str, name: str) -> str:
    """CTEs, the last of which is `name`(id, s, n): the place of the adapter in each s of the table `of`(id, s), without gaps, else with a base more in the read, else with one less."""
    n = len(adapter)
    plain = f"hamming(substr(s, greatest(i, 0) + 1, cl - greatest(-i, 0)), substr('{adapter}', greatest(-i, 0) + 1, cl - greatest(-i, 0))) <= cl // 8"
    last = {"more": f"substr(s, i + size + 1, 1) <> substr('{adapter}', size::INT, 1)", "less": f"substr('{adapter}', size::INT + 1, 1) <> substr(s, i + size, 1)"}
    behind = {"more": f"hamming(substr(s, i + {{j}} + 2, size - {{j}}), substr('{adapter}', {{j}} + 1, size - {{j}}))", "less": f"hamming(substr('{adapter}', {{j}} + 2, size - {{j}}), substr(s, i + {{j}} + 1, size - {{j}}))"}
    before = f"hamming(substr(s, i + 1, {{j}}), substr('{adapter}', 1, {{j}}))"
    ctes = [f"{name}_p AS (SELECT id, min(greatest(i, 0)) AS i FROM (SELECT id, s, i, least(length(s) - i, {n}) AS cl FROM {of}, unnest(range(-4, 100)) AS t(i) WHERE i < length(s) - 4) WHERE {plain} GROUP BY id)"]
    done = [f"{name}_p"]
    for kind, size, left in (("more", f"least(length(s) - i - 1, {n})", 5), ("less", f"least(length(s) - i, {n - 1})", 4)):
        out = " ".join(f"AND id NOT IN (SELECT id FROM {x})" for x in done)
        half = "(size // 2)"
        at = f"SELECT * FROM (SELECT id, s, i, {size} AS size FROM {of}, unnest(range(0, 100)) AS t(i) WHERE i < length(s) - {left} {out}) WHERE size >= 8 AND ({before.format(j=half)} <= size // 8 - 1 OR {behind[kind].format(j=half)} <= size // 8 - 1)"
        ctes.append(f"{name}_{kind} AS (SELECT id, min(i) AS i FROM (SELECT *, unnest(range(1, size)) AS j FROM ({at})) WHERE {before.format(j='j')} + ({last[kind]})::INT <= size // 8 - 1 AND {before.format(j='j')} + {behind[kind].format(j='j')} <= size // 8 - 1 GROUP BY id)")
        done.append(f"{name}_{kind}")
    joins = " ".join(f"LEFT JOIN {x} ON {x}.id = o.id" for x in done)
    return ", ".join(ctes) + f", {name} AS (SELECT o.id, s, coalesce({', '.join(f'{x}.i' for x in done)}, length(s)) AS n FROM {of} o {joins})"


@query(f"SELECT id AS read_id, n::INT AS trimmed_len FROM (WITH {_SIMPLE} {_adapter_sql(R1, 'seq1', 'src')})", single)
def adapter_sequence(d):
    return _no_gaps(d, R1)


_READS1 = "r0 AS (SELECT pair_id AS id, seq1 AS s FROM reads)"


@query(f"SELECT * FROM (WITH {_READS1}, {_gapped_sql(R1, 'r0', 'x')} SELECT id AS read_id, n::INT AS trimmed_len FROM x)", single)
def adapter_sequence_gapped(d):
    return step.trim_adapter(d, [R1])


def _in_turn(adapters: list[str]) -> str:
    """CTEs from r0 on; the reads after adapter k are r{k}."""
    return ", ".join(f"{_gapped_sql(a, f'r{i}', f'x{i}')}, r{i + 1} AS (SELECT id, substr(s, 1, n) AS s FROM x{i})" for i, a in enumerate(adapters))


@query(f"SELECT * FROM (WITH {_READS1}, {_in_turn(sorted(FOUR))} SELECT id AS read_id, length(s)::INT AS trimmed_len FROM r{len(FOUR)})", single)
def adapter_fasta(d):
    return step.trim_adapter(d, sorted(FOUR))


_MIXED = (
    f"WITH {_CUT}, m1 AS (SELECT id, seq1 AS s FROM t WHERE NOT hit), m2 AS (SELECT id, seq2 AS s FROM t WHERE NOT hit), {_gapped_sql(R1, 'm1', 'y1')}, {_gapped_sql(R2, 'm2', 'y2')}, "
    "b1 AS (SELECT id, substr(seq1, 1, k1) AS s FROM t WHERE hit UNION ALL SELECT id, substr(s, 1, n) FROM y1), b2 AS (SELECT id, substr(seq2, 1, k2) AS s FROM t WHERE hit UNION ALL SELECT id, substr(s, 1, n) FROM y2), "
    f"{_gapped_sql(FOUR[2], 'b1', 'z1')}, {_gapped_sql(FOUR[2], 'b2', 'z2')} "
    "SELECT t.id AS read_id, substr(z1.s, 1, z1.n) AS seq1, substr(z2.s, 1, z2.n) AS seq2, hit OR coalesce(y1.n < length(y1.s), false) OR z1.n < length(z1.s) AS trimmed1, hit OR coalesce(y2.n < length(y2.s), false) OR z2.n < length(z2.s) AS trimmed2 "
    "FROM t JOIN z1 ON z1.id = t.id JOIN z2 ON z2.id = t.id LEFT JOIN y1 ON y1.id = t.id LEFT JOIN y2 ON y2.id = t.id"
)


@query(f"SELECT * FROM ({_MIXED})")
def adapter_precedence(d):
    """Overlaps first, the mates' adapters where there is none, listed adapters always."""
    return _done(d, replace(PLAIN, adapter=R1, adapter_r2=R2, adapter_list=(FOUR[2],)), "read_id", "seq1", "seq2", "trimmed1", "trimmed2")


@query(f"SELECT * FROM (WITH {_CUT} SELECT id AS read_id FROM t WHERE hit AND least(k1, length(seq1)) <= 45 AND least(k2, length(seq2)) <= 45)")
def adapter_dimer(d):
    return _done(d, Options(paired=True, dimer_max_len=45, **OFF), "read_id", "dimer").where("dimer").select("read_id")


# Merging and overlapped regions

# Merging corrects first and looks for overlaps again.
_AGAIN = _OV.replace("FROM reads)", "FROM reads2)")
_MERGED = (
    f"WITH reads2 AS (SELECT * FROM ({_CORRECTED})), {_AGAIN} SELECT ov.id AS read_id, name1 || ' merged_' || (ol + greatest(off, 0)) || '_' || (CASE WHEN off > 0 THEN l2 - ol ELSE 0 END) AS merged_name, substr(seq1, 1, ol + greatest(off, 0)) || CASE WHEN off > 0 THEN substr(s2, ol + 1) ELSE '' END AS merged_seq, "
    "substr(qual1, 1, ol + greatest(off, 0)) || CASE WHEN off > 0 THEN substr(reverse(qual2), ol + 1) ELSE '' END AS merged_qual FROM ov JOIN rc USING (id) JOIN (SELECT pair_id AS id, name1 FROM reads) USING (id)"
)
MERGE = Options(paired=True, merge=True, adapter_trimming=False, **OFF)


@query(f"SELECT * FROM ({_MERGED})")
def merge_pairs(d):
    return _done(d, MERGE, "read_id", "merged_name", "merged_seq", "merged_qual").where("merged_seq is not null")


@query(f"SELECT count(*) AS pairs, sum(length(merged_seq))::BIGINT AS bases FROM ({_MERGED})")
def merge_counts(d):
    return _done(d, MERGE, "merged_seq").where("merged_seq is not null").agg(F.count("*").alias("pairs"), F.sum(F.length("merged_seq")).alias("bases"))


@query(
    f"SELECT * FROM (WITH {_OV.replace('least(5, floor(ol * 0.2))', '0')} SELECT id AS read_id, substr(seq1, greatest(off, 0) + 1, ol) AS overlap_seq FROM ov JOIN rc USING (id))"
)
def overlapped_region(d):
    done = _done(d, Options(paired=True, adapter_trimming=False, overlapped_out="x", **OFF), "read_id", "overlap_seq")
    return done.where("overlap_seq is not null")


# Duplicates

_KEYED = "SELECT pair_id, row_number() OVER (PARTITION BY regexp_replace({}, '[^ACGT]', 'N', 'g') ORDER BY pair_id) > 1 AS is_dup FROM reads"


@query(_KEYED.format("seq1 || seq2"))
def dedup_pairs(d):
    return mark_duplicates(d.withColumnRenamed("pair_id", "read_id"), ["seq1", "seq2"]).select(F.col("read_id").alias("pair_id"), "is_dup")


@query(_KEYED.format("seq1"), single)
def dedup_single(d):
    return mark_duplicates(d, ["seq"]).select(F.col("read_id").alias("pair_id"), "is_dup")


@query(f"SELECT count(*) AS reads, sum(is_dup::BIGINT)::BIGINT AS duplicates, sum(is_dup::BIGINT)::DOUBLE / count(*) AS rate FROM ({_KEYED.format('seq1 || seq2')})")
def dup_rate(d):
    return duplication_rate(mark_duplicates(d.withColumnRenamed("pair_id", "read_id"), ["seq1", "seq2"]))


# Statistics

_CYC = "SELECT i::INT AS cycle, seq1[i + 1] AS base, count(*) AS n, sum((ascii(qual1[i + 1]) >= 53)::BIGINT)::BIGINT AS q20, sum((ascii(qual1[i + 1]) >= 63)::BIGINT)::BIGINT AS q30, sum(ascii(qual1[i + 1]) - 33)::BIGINT AS qual_sum FROM reads, unnest(range(0, length(seq1))) AS t(i) GROUP BY ALL"


@query(_CYC, single)
def stats_cycle(d):
    return stats.cycles(d)


_PER = lambda b, c: f"sum(CASE WHEN base = '{b}' THEN {c} ELSE 0 END)"


@query(f"SELECT cycle, sum(qual_sum)::DOUBLE / sum(n) AS mean, " + ", ".join(f"CASE WHEN {_PER(b, 'n')} > 0 THEN {_PER(b, 'qual_sum')}::DOUBLE / nullif({_PER(b, 'n')}, 0) ELSE sum(qual_sum)::DOUBLE / sum(n) END AS quality_{b}" for b in "ATCGN") + f" FROM ({_CYC}) GROUP BY cycle", single)  # noqa: F541
def stats_quality_curve(d):
    return stats.curves(stats.cycles(d)).select("cycle", "mean", *(f"quality_{b}" for b in "ATCGN"))


@query("SELECT cycle, " + ", ".join(f"{_PER(b, 'n')}::DOUBLE / sum(n) AS content_{b}" for b in "ATCGN") + f", ({_PER('G', 'n')} + {_PER('C', 'n')})::DOUBLE / sum(n) AS \"content_GC\" FROM ({_CYC}) GROUP BY cycle", single)
def stats_content_curve(d):
    return stats.curves(stats.cycles(d)).select("cycle", *(f"content_{b}" for b in ("A", "T", "C", "G", "N", "GC")))


ORACLE_KMER = "SELECT kmer, count(*) AS n FROM (SELECT substr(seq1, i, 5) AS kmer FROM reads, unnest(range(1, length(seq1) - 3)) AS t(i)) WHERE regexp_full_match(kmer, '[ACGT]{5}') GROUP BY kmer"
ORACLE_QUALITY = "SELECT (ascii(qual1[i + 1]) - 33)::INT AS q, count(*) AS n FROM reads, unnest(range(0, length(qual1))) AS t(i) GROUP BY 1"


@query(ORACLE_KMER, single)
def stats_kmer5(d):
    return stats.kmers(d)


@query(ORACLE_QUALITY, single)
def stats_qual_hist(d):
    return stats.quality_histogram(d)


_SUM = (
    "SELECT count(*) AS reads, sum(length({s}))::BIGINT AS bases, "
    + ", ".join(f"sum(list_sum(list_transform(range(1, length({{q}}) + 1), lambda i: CASE WHEN ascii({{q}}[i]) >= {33 + q} THEN 1 ELSE 0 END)))::BIGINT AS q{q}_bases" for q in (20, 30, 40))
    + ", sum(length({s}) - length(translate({s}, 'GC', '')))::BIGINT AS gc_bases, max(length({s}))::BIGINT AS cycles, (sum(length({s})) // count(*))::BIGINT AS mean_length FROM {t}"
)


@query(_SUM.format(s="seq1", q="qual1", t="reads"), single)
def stats_summary(d):
    return stats.summary(d)


_SIZES = {**detect.OVERREP, 98: 3}
_FREQUENT = (
    "d AS (SELECT * FROM (SELECT seq1 AS s, coalesce(sum(length(seq1)) OVER (ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM reads) WHERE b < 1510000), c AS (SELECT seq, max(n) AS n FROM ("
    + " UNION ALL ".join(f"SELECT substr(s, i, {size}) AS seq, count(*) AS n FROM d, unnest(range(1, length(s) - {size - 2})) AS t(i) GROUP BY 1 HAVING count(*) >= {least}" for size, least in _SIZES.items())
    + ") GROUP BY seq), o AS (SELECT seq, n FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS f WHERE length(f.seq) > length(c.seq) AND contains(f.seq, c.seq) AND c.n // f.n < 10))"
)
_HITS = (
    f"{_FREQUENT}, w AS (SELECT pair_id AS id, z, i, substr(seq1, i + 1, z) AS seq FROM reads, (SELECT DISTINCT length(seq) AS z FROM o), unnest(range(0, length(seq1) - z + 1)) AS t(i) WHERE pair_id % 20 = 0), "
    "l AS (SELECT id, z, list_reduce(list([i] ORDER BY i), lambda a, b: CASE WHEN b[1] > a[-1] + z THEN list_concat(a, b) ELSE a END) AS places FROM w JOIN o USING (seq) GROUP BY id, z), "
    "k AS (SELECT id, z, unnest(places) AS i FROM l)"
)


@query(f"SELECT * FROM (WITH {_FREQUENT} SELECT seq, n FROM o)", single)
def overrep_candidates(d):
    return detect.over_represented_candidates(d, 100)


@query(f"SELECT * FROM (WITH {_HITS} SELECT seq, count(*) AS n FROM k JOIN w USING (id, z, i) GROUP BY seq)", single)
def overrep_counts(d):
    return stats.over_represented(d, detect.over_represented_candidates(d, 100))


@query(f"SELECT * FROM (WITH {_HITS} SELECT seq, i::INT AS place, count(*) AS n FROM k JOIN w USING (id, z, i) GROUP BY seq, i)", single)
def overrep_places(d):
    return stats.over_represented_places(d, detect.over_represented_candidates(d, 100))


# Detection


@query("SELECT max(length(seq1)) FILTER (pair_id < 1000)::INT AS seq_len FROM reads", first_single)
def detect_seq_len(d):
    return detect.read_length(d)


@query("SELECT regexp_matches(arg_min(name1, pair_id), '^(" + "|".join(detect.TWO_COLOUR) + ")') AS two_colour FROM reads", first_single)
def detect_two_color(d):
    return detect.two_colour(d)


#: Bits of the filters of a query: few, so that the first ones are full, and those of two levels.
_BITS = (10, 20, 25)
_FILTERS = " UNION ALL ".join(
    f"SELECT {b} AS bits, scale::INT AS scale, n AS reads, ones FROM (SELECT scale, count(*) AS n, count(DISTINCT h & {(1 << b) - 1}) AS ones FROM k JOIN range(0, 41) AS t(scale) ON z >= scale GROUP BY scale) WHERE ones <= {int(0.86 * (1 << b))} QUALIFY scale = min(scale) OVER ()" for b in _BITS
)


@query(
    "SELECT bits, scale, reads, ones, round(greatest(0, 1 + (1 << bits) * ln(1 - ones / (1 << bits)::DOUBLE) / reads), 6) AS rate FROM (WITH h AS (SELECT ('0x' || substr(sha256(regexp_replace(seq1 || seq2, '[^ACGT]', 'N', 'g')), 1, 15))::BIGINT AS h FROM reads), "
    f"k AS (SELECT h, CASE WHEN h >> 20 = 0 THEN 40 ELSE 40 - length(bin(h >> 20)) END AS z FROM h) {_FILTERS})"
)
def dup_rate_filters(d):
    """The filter that the share of duplicates is estimated from, at sizes of few bits and of levels 1 and 6, and that estimate."""
    out = []
    for bits in _BITS:
        rows = bit_filter.filters(d, ["seq1", "seq2"], bits).collect()
        r, rate = bit_filter.used(rows, bits)
        out.append((bits, r.scale, r.reads, r.ones, round(rate, 6)))
    return d.sparkSession.createDataFrame(out, "bits int, scale int, reads long, ones long, rate double")


_TEN = (
    "SELECT kmer, n FROM (SELECT kmer, count(*) AS n FROM (SELECT substr(seq1, i + 1, 10) AS kmer FROM reads, unnest(range(20, length(seq1) - 10)) AS t(i) WHERE pair_id < 262144) "
    "WHERE regexp_full_match(kmer, '[ACGT]{10}') GROUP BY kmer) WHERE "
    + " AND ".join(f"10 - length(replace(kmer, '{b}', '')) < 6" for b in "ACGT")
    + " AND length(translate(kmer, 'AT', '')) < 8 AND kmer NOT LIKE 'GGGG%' ORDER BY n DESC, translate(kmer, 'ATCG', '0123') DESC LIMIT 10"
)


@query(f"SELECT * FROM ({_TEN})", first_single)
def detect_kmer10_top(d):
    return detect.ten_mers(d)


_VOTES = (
    " UNION ALL ".join(
        f"SELECT '{a}' AS adapter, count(*) AS hits, coalesce(sum(d), 0)::BIGINT AS mismatches FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM "
        f"(SELECT pair_id AS id, i, least(length(seq1) - i, {len(a)}) AS cl, hamming(substr(seq1, i + 1, least(length(seq1) - i, {len(a)})), substr('{a}', 1, least(length(seq1) - i, {len(a)}))) AS d FROM reads, unnest(range(0, length(seq1) - 7)) AS t(i) WHERE pair_id < 100000) WHERE d <= cl // 16) WHERE rn = 1"
        for a in sorted(FOUR)
    )
)


@query(_VOTES, first_single)
def detect_known_adapter(d):
    return detect.adapter_votes(d, dict.fromkeys(FOUR, ""))


#: So few mismatches leave one of an adapter's successive 8 bases whole, by which places are joined.
_ALL_VOTES = (
    "WITH a(adapter) AS (VALUES " + ", ".join(f"('{x}')" for x in sorted(known_adapters())) + "), e AS (SELECT adapter, j, substr(adapter, j + 1, 8) AS k FROM a, unnest(range(0, length(adapter) - 7, 8)) AS t(j)), "
    "p AS (SELECT pair_id AS id, seq1, i, substr(seq1, i + 1, 8) AS k FROM reads, unnest(range(0, length(seq1) - 7)) AS t(i) WHERE pair_id < 100000), "
    "c AS (SELECT DISTINCT id, adapter, seq1, i - j AS place FROM p JOIN e USING (k) WHERE i >= j), f AS (SELECT *, least(length(seq1) - place, length(adapter)) AS cl FROM c), "
    "h AS (SELECT id, adapter, place, cl, hamming(substr(seq1, place + 1, cl), substr(adapter, 1, cl)) AS d FROM f), "
    "w AS (SELECT adapter, d FROM h WHERE cl >= 8 AND d <= cl // 16 QUALIFY row_number() OVER (PARTITION BY id, adapter ORDER BY place) = 1) "
    "SELECT a.adapter, count(w.adapter) AS hits, coalesce(sum(w.d), 0)::BIGINT AS mismatches FROM a LEFT JOIN w ON w.adapter = a.adapter GROUP BY a.adapter"
)


@query(f"SELECT * FROM ({_ALL_VOTES})", first_single)
def detect_known_adapters(d):
    """The vote of all adapters that detection knows."""
    return detect.adapter_votes(d)


# These reads hold a known adapter, so that the vote decides; detect_unlisted_adapter grows one from 10-mers.
@query(
    f"SELECT CASE WHEN n < 10000 OR NOT (hits > n / 50.0 OR hits > n / 200.0 AND mismatches < hits) THEN '' ELSE adapter END AS adapter FROM ({_VOTES}), (SELECT count(*) AS n FROM reads WHERE pair_id < 100000) ORDER BY hits DESC, adapter LIMIT 1", first_single
)
def detect_adapter(d):
    return d.sparkSession.createDataFrame([(detect.find_adapter(d, adapters=dict.fromkeys(FOUR, "")),)], "adapter string")


#: An adapter of no kit, which reads are made to end with.
UNLISTED = "GTCATGACTGGATCCTTAGCATGCAACTGGTACCATTGCA"
_GROWN = (
    f"WITH s AS (SELECT concat(substr(seq1, 1, (20 + pair_id % 21)::INT), substr('{UNLISTED}', 1, (24 + pair_id % 17)::INT)) AS seq FROM reads WHERE pair_id < 262144), "
    "m AS (SELECT kmer, count(*) AS n FROM (SELECT substr(seq, i + 1, 10) AS kmer FROM s, unnest(range(20, length(seq) - 10)) AS t(i)) WHERE regexp_full_match(kmer, '[ACGT]{10}') GROUP BY kmer), "
    "f AS (SELECT * FROM m WHERE " + " AND ".join(f"10 - length(replace(kmer, '{b}', '')) < 6" for b in "ACGT") + " AND length(translate(kmer, 'AT', '')) < 8 AND kmer NOT LIKE 'GGGG%'), "
    "z AS (SELECT kmer FROM (SELECT * FROM f ORDER BY n DESC, translate(kmer, 'ATCG', '0123') DESC LIMIT 10) WHERE n >= 10 AND n * 1048576 >= 20 * (SELECT sum(n) FROM f) AND len([j for j in range(1, 10) if substr(kmer, j, 1) <> substr(kmer, j + 1, 1)]) >= 3), "
    "o AS (SELECT kmer, seq, i FROM (SELECT seq, i, substr(seq, i + 1, 10) AS kmer FROM s, unnest(range(20, least(length(seq) - 10, 500))) AS t(i)) JOIN z USING (kmer)), "
    "x AS (SELECT kmer, 'after' AS side, split_part(substr(seq, i + 11, length(seq) - 11 - i), 'N', 1) AS t FROM o UNION ALL SELECT kmer, 'before', split_part(reverse(substr(seq, 1, i)), 'N', 1) FROM o), "
    "node AS (SELECT kmer, side, substr(t, 1, d) AS p, count(*) AS n, count(*) FILTER (length(t) > d) AS longer FROM x, unnest(range(0, length(t) + 1)) AS u(d) GROUP BY ALL), "
    "good AS (SELECT c.kmer, c.side, c.p FROM node c JOIN node f ON f.kmer = c.kmer AND f.side = c.side AND f.p = substr(c.p, 1, length(c.p) - 1) WHERE c.p <> '' AND f.longer >= 50 AND c.n >= 0.95 * f.longer), "
    "whole AS (SELECT c.kmer, c.side, c.p FROM good c JOIN good g ON g.kmer = c.kmer AND g.side = c.side AND starts_with(c.p, g.p) GROUP BY ALL HAVING count(*) = length(c.p)), "
    "path AS (SELECT kmer, side, coalesce(max_by(p, length(p)), '') AS p FROM (SELECT kmer, side, p FROM whole UNION ALL SELECT DISTINCT kmer, side, '' FROM x) GROUP BY ALL), "
    "e AS (SELECT kmer, side, p, longer < 50 AS leaf FROM path JOIN node USING (kmer, side, p)) "
    "SELECT a.kmer, concat(reverse(b.p), a.kmer, a.p) AS grown, a.leaf AS leaf_after, b.leaf AS leaf_before FROM e a JOIN e b USING (kmer) WHERE a.side = 'after' AND b.side = 'before'"
)


@query(f"SELECT * FROM ({_GROWN})", first_single)
def detect_unlisted_adapter(d):
    """What grows from the 10-mers that stand out where reads end with an adapter that is not known."""
    own = F.expr(f"concat(substr(seq, 1, cast(20 + read_id % 21 as int)), substr('{UNLISTED}', 1, cast(24 + read_id % 17 as int)))")
    found = detect.grown_adapters(d.where(F.col("read_id") < detect.ADAPTER_SAMPLE).select("read_id", own.alias("seq")))
    return d.sparkSession.createDataFrame([tuple(r.values()) for r in found], "kmer string, grown string, leaf_after boolean, leaf_before boolean")


# Routing and whole runs

ROUTED = Options(paired=True, adapter_trimming=False, unpaired1="u1", unpaired2="u2", failed_out="f", eval_duplication=False)
ROUTED_COLUMNS = ("read_id", "is_dup", *(f"{c}{m}" for m in (1, 2) for c in ("name", "seq", "qual", "result")))
_BOTH = f"SELECT pair_id AS id, {_CODE} AS c1, {_CODE2} AS c2, seq1, qual1, seq2, qual2, name1, name2 FROM reads"
_WHY = "CASE {} WHEN 12 THEN 'failed_too_many_n_bases' WHEN 16 THEN 'failed_too_short' WHEN 20 THEN 'failed_quality_filter' END"


@query(
    f"SELECT id AS read_id, mate, target FROM (WITH b AS ({_BOTH}) "
    "SELECT id, 1 AS mate, CASE WHEN c1 = 0 AND c2 = 0 THEN 'out1' WHEN c1 = 0 THEN 'unpaired1' ELSE 'failed' END AS target FROM b UNION ALL "
    "SELECT id, 2, CASE WHEN c1 = 0 AND c2 = 0 THEN 'out2' WHEN c2 = 0 THEN 'unpaired2' ELSE 'failed' END FROM b)"
)
def route_outputs(d):
    return run.routes(_done(d, ROUTED, *ROUTED_COLUMNS), ROUTED).select("read_id", "mate", "target")


@query(
    f"SELECT id AS read_id, mate, name, seq FROM (WITH b AS ({_BOTH}) SELECT id, 1 AS mate, name1 || ' ' || {_WHY.format('c1')} AS name, seq1 AS seq FROM b WHERE c1 > 0 UNION ALL SELECT id, 2, name2 || ' ' || {_WHY.format('c2')}, seq2 FROM b WHERE c2 > 0)"
)
def route_failed_tags(d):
    return run.routes(_done(d, ROUTED, *ROUTED_COLUMNS), ROUTED).where("target = 'failed'").select("read_id", "mate", "name", "seq")


_TRIMMED = f"SELECT c.pair_id, substr(c.seq1, 1, k1) AS seq1, substr(c.qual1, 1, k1) AS qual1, substr(c.seq2, 1, k2) AS seq2, substr(c.qual2, 1, k2) AS qual2, hit, name1, name2 FROM ({_CORRECTED}) AS c JOIN (SELECT * FROM (WITH {_CUT} SELECT id, k1, k2, hit FROM t)) ON id = c.pair_id JOIN (SELECT pair_id, name1, name2 FROM reads) USING (pair_id)"
_ROUTE_MERGED = (
    f"WITH reads3 AS (SELECT * FROM ({_TRIMMED})), {_OV.replace('FROM reads)', 'FROM reads3)')}, "
    "mm AS (SELECT ov.id, name1 || ' merged_' || (ol + greatest(off, 0)) || '_' || (CASE WHEN off > 0 THEN l2 - ol ELSE 0 END) AS name, substr(r.seq1, 1, ol + greatest(off, 0)) || CASE WHEN off > 0 THEN substr(s2, ol + 1) ELSE '' END AS seq1, "
    "substr(r.qual1, 1, ol + greatest(off, 0)) || CASE WHEN off > 0 THEN substr(reverse(r.qual2), ol + 1) ELSE '' END AS qual1 FROM ov JOIN rc USING (id) JOIN reads3 AS r ON r.pair_id = ov.id), "
    "un AS (SELECT *, hit AND length(seq1) <= 2 AND length(seq2) <= 2 AS dimer FROM reads3 WHERE pair_id NOT IN (SELECT id FROM ov)) "
    f"SELECT id AS read_id, 0 AS mate, 'merged' AS target, name, seq1 AS seq, '+' AS strand, qual1 AS qual FROM mm WHERE ({_CODE}) = 0 "
    f"UNION ALL SELECT pair_id, 1, 'merged', name1, seq1, '+', qual1 FROM un WHERE NOT dimer AND ({_CODE}) = 0 UNION ALL SELECT pair_id, 2, 'merged', name2, seq2, '+', qual2 FROM un WHERE NOT dimer AND ({_CODE2}) = 0"
)


@query(f"SELECT * FROM ({_ROUTE_MERGED})")
def route_merged(d):
    o = Options(paired=True, merge=True, include_unmerged=True, merged_out="m", failed_out="f", eval_duplication=False).validated()
    wanted = (*ROUTED_COLUMNS, "lost1", "lost2", *(f"merged_{c}" for c in ("name", "seq", "qual", "result")))
    return run.routes(_done(d, o, *wanted), o)


@query(f"SELECT pair_id AS read_id, 1 AS mate, 'out1' AS target, name1 AS name, seq1 AS seq, qual1 AS qual FROM reads JOIN ({_KEYED.format('seq1')}) USING (pair_id) WHERE NOT is_dup AND ({_CODE}) = 0", single)
def route_without_duplicates(d):
    o = Options(adapter_trimming=False, dedup=True, out1="o")
    return run.routes(run.process(as_single(d), o, ("read_id", "is_dup", "name1", "seq1", "qual1", "result")), o).drop("strand")


@query("SELECT pair_id AS read_id, (ntile(7) OVER (ORDER BY pair_id) - 1)::INT AS split_id, lpad((ntile(7) OVER (ORDER BY pair_id))::VARCHAR, 4, '0') AS split_no FROM reads", single)
def split_by_files(d):
    return step.split_by_files(d.select("read_id"), 7)


@query("SELECT pair_id AS read_id, ((row_number() OVER (ORDER BY pair_id) - 1) // 1000)::INT AS split_id, lpad((((row_number() OVER (ORDER BY pair_id) - 1) // 1000) + 1)::VARCHAR, 4, '0') AS split_no FROM reads", single)
def split_by_lines(d):
    return step.split_by_lines(d.select("read_id"), 4000)


def as_single(d: DataFrame) -> DataFrame:
    return d.withColumnsRenamed({"name": "name1", "seq": "seq1", "qual": "qual1"})


@query(f"SELECT pair_id AS read_id, ({_CODE})::INT AS result, seq1 AS seq, is_dup FROM reads JOIN ({_KEYED.format('seq1')}) USING (pair_id)", single)
def pipeline_se(d):
    done = run.process(as_single(d), Options(adapter_trimming=False), ("read_id", "result", "seq1", "is_dup"))
    return done.withColumnRenamed("seq1", "seq")


@query(
    f"SELECT * FROM (WITH {_CUT}, u AS (SELECT id, substr(seq1, 1, k1) AS seq1, substr(seq2, 1, k2) AS seq2, substr(qual1, 1, k1) AS qual1, substr(qual2, 1, k2) AS qual2, hit, hit AND k1 <= 2 AND k2 <= 2 AS dimer FROM t), "
    f"dup AS ({_KEYED.format('seq1 || seq2')}) "
    f"SELECT id AS read_id, seq1, seq2, (CASE WHEN dimer THEN 28 ELSE {_CODE} END)::INT AS result1, (CASE WHEN dimer THEN 28 ELSE {_CODE2} END)::INT AS result2, hit AS trimmed1, is_dup FROM u JOIN dup ON dup.pair_id = u.id)"
)
def pipeline_pe(d):
    return _done(d, Options(paired=True), "read_id", "seq1", "seq2", "result1", "result2", "trimmed1", "is_dup")


@query(
    "SELECT 'before' AS phase, * FROM (" + _SUM.format(s="seq1", q="qual1", t="reads") + f") UNION ALL SELECT 'after', * FROM ({_SUM.format(s='seq1', q='qual1', t=f'(SELECT * FROM reads WHERE ({_CODE}) = 0)')})", single
)
def report_before_after(d):
    done = run.process(as_single(d), Options(adapter_trimming=False), ("result", "seq1", "qual1"))
    after = stats.summary(done.where("result = 0"), "seq1", "qual1")
    return stats.summary(d).select(F.lit("before").alias("phase"), "*").unionByName(after.select(F.lit("after").alias("phase"), "*"))


def _state_sql(block: str, t: str) -> str:
    """The part of a state that is about the reads of a table."""
    of = lambda sql: "(" + sql.replace("FROM reads", f"FROM {t}") + ")"
    return (
        f"SELECT '{block}' AS block, 'reads' AS kind, '' AS key, (-1)::INT AS place, count(*) AS n, 0 AS a, 0 AS b, 0 AS c FROM {t} UNION ALL SELECT '{block}', 'cycle', base, cycle, n, q20, q30, qual_sum FROM {of(_CYC)} "
        f"UNION ALL SELECT '{block}', 'kmer', kmer, -1, n, 0, 0, 0 FROM {of(ORACLE_KMER)} UNION ALL SELECT '{block}', 'quality', '', q, n, 0, 0, 0 FROM {of(ORACLE_QUALITY)}"
    )


@query(
    f"SELECT * FROM (WITH kept AS (SELECT * FROM reads WHERE ({_CODE}) = 0) {_state_sql('before', 'reads')} UNION ALL {_state_sql('after', 'kept')} "
    f"UNION ALL SELECT 'run', 'result', '', ({_CODE})::INT AS code, count(*), 0, 0, 0 FROM reads GROUP BY code UNION ALL SELECT 'run', 'dup', '', -1, sum(is_dup::BIGINT)::BIGINT, count(*), 0, 0 FROM ({_KEYED.format('seq1')}))",
    single,
)
def report_state(d):
    """All figures of a run's report: one pass over the reads, one over what was done."""
    o, d = Options(adapter_trimming=False), as_single(d)
    done = run.process(d, o, ("read_id", "is_dup", "result", "seq1", "qual1"))
    return summarize(d, {"before": Block("seq1", "qual1")}).unionByName(summarize(done, {"after": Block("seq1", "qual1", F.col("result") == 0)}, o))


@query(
    f"SELECT phase, reads, bases, q20_bases, q30_bases, q40_bases, cycles FROM (SELECT 'before' AS phase, * FROM ({_SUM.format(s='seq1', q='qual1', t='reads')}) "
    f"UNION ALL SELECT 'after', * FROM ({_SUM.format(s='seq1', q='qual1', t=f'(SELECT * FROM reads WHERE ({_CODE}) = 0)')}))",
    single,
)
def report_phred64(d):
    """The same reads with qualities at the offset 64: a report has them at 33, before filtering too."""
    old = "".join(map(chr, range(33, 96)))
    d = as_single(d).withColumn("qual1", F.translate("qual1", old, "".join(chr(ord(c) + 31) for c in old)))
    o = Options(adapter_trimming=False, phred64=True)
    out = report.build(d, run.process(d, o), o)
    names = ("total_reads", "total_bases", "q20_bases", "q30_bases", "q40_bases", "total_cycles")
    rows = [(phase, *(out[f"read1_{phase}_filtering"][c] for c in names)) for phase in ("before", "after")]
    return d.sparkSession.createDataFrame(rows, "phase string, reads long, bases long, q20_bases long, q30_bases long, q40_bases long, cycles long")


@query(
    f"SELECT (SELECT sum(is_dup::BIGINT)::DOUBLE / count(*) FROM ({_KEYED.format('seq1 || seq2')})) AS rate, count(*) AS pairs FROM (SELECT {_FIRST} AS ix FROM reads) WHERE NOT ("
    + " OR ".join(f"hamming(substr(ix, 1, {len(b)}), substr('{b}', 1, length(ix))) <= 2" for b in _BARCODES) + ")"
)
def dup_rate_blacklist(d):
    """Reads that an index list keeps out count as duplicates too."""
    d = d.withColumnRenamed("pair_id", "read_id")
    o = Options(paired=True, adapter_trimming=False, index_blacklist1=_BARCODES, index_threshold=2)
    wanted = ("result", "insert_size", *(f"{c}{m}" for m in (1, 2) for c in ("seq", "qual", "corrected")))
    done = run.process(d, replace(o, eval_duplication=False), wanted)  # the report counts the keys of all reads
    out = report.build(d, done, o)
    kept = sum(out["filtering_result"].values()) // 2
    return d.sparkSession.createDataFrame([(out["duplication"]["rate"], kept)], "rate double, pairs long")


@query(
    f"SELECT id AS read_id, mate, target FROM (WITH b AS ({_BOTH}), dup AS ({_KEYED.format('seq1 || seq2')}), c AS (SELECT * FROM b JOIN dup ON dup.pair_id = b.id WHERE NOT is_dup) "
    "SELECT id, 1 AS mate, CASE WHEN c1 = 0 AND c2 = 0 THEN 'out1' WHEN c1 = 0 THEN 'unpaired1' ELSE 'failed' END AS target FROM c UNION ALL "
    "SELECT id, 2, CASE WHEN c1 = 0 AND c2 = 0 THEN 'out2' WHEN c2 = 0 THEN 'unpaired2' ELSE 'failed' END FROM c)"
)
def route_pairs_without_duplicates(d):
    o = replace(ROUTED, dedup=True, eval_duplication=True)
    return run.routes(_done(d, o, *ROUTED_COLUMNS), o).select("read_id", "mate", "target")


@query("SELECT seq1, seq2, 1 AS copies FROM reads GROUP BY seq1, seq2", pairs_folder)
def stream_dedup(folder):
    """The written pairs as a stream of batches of two files: one of each key stays, in whatever batch its copies come."""
    spark, path = folder
    source = stream.read_stream(spark, path, "pair_id long, name1 string, name2 string, seq1 string, qual1 string, seq2 string, qual2 string", 2).withColumnRenamed("pair_id", "read_id")
    o, out = Options(paired=True, dedup=True, adapter_trimming=False, quality_filter=False, length_filter=False), shared_dir(spark)
    stream.process_stream(source, o, shared_dir(spark), lambda batch, number: batch.select("read_id", "mate", "seq").write.mode("overwrite").parquet(f"{out}/batch={number}"))
    d = spark.read.parquet(out)
    both = d.groupBy("read_id").agg(*(F.max(F.when(F.col("mate") == m, F.col("seq"))).alias(f"seq{m}") for m in (1, 2)))
    return both.groupBy("seq1", "seq2").agg(F.count("*").cast("int").alias("copies"))
