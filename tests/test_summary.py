"""A report from one pass over each table: figures as the separate statistics have them, and how often the tables are read."""

import random

import pytest
from pyspark.sql import functions as F

from strandflow.operators import dedup, stats, summary
from strandflow.operators import pipeline as run
from strandflow.plans import report
from strandflow.plans.options import Options
from tests.test_files import COMP

R1, R2 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT"


def pairs(spark, n=300):
    rnd, rows = random.Random(5), []
    for i in range(n):
        frag = "".join(rnd.choice("ACGT") for _ in range(rnd.randint(20, 150))) if i % 7 or not rows else rows[-1][7]
        one, two = (frag + R1 + "G" * 99)[:90], (frag[::-1].translate(COMP) + R2 + "A" * 99)[:90]
        if i % 11 == 0:
            one = one[:40] + "N" * 8 + one[48:]
        q = lambda: "".join(rnd.choice("#5?IIII") for _ in range(90))
        rows.append((i, f"@r{i}:ACGT", one, q(), f"@r{i}:ACGT", two, q(), frag))
    return spark.createDataFrame([r[:7] for r in rows], "read_id long, name1 string, seq1 string, qual1 string, name2 string, seq2 string, qual2 string").repartition(3)


RUNS = [
    Options(paired=True, correction=True, poly_x=True, complexity_filter=True), Options(paired=True, merge=True, merged_out="m"), Options(paired=True, dedup=True, poly_g=True, cut_tail=(4, 20)),
    Options(paired=True, merge=True, include_unmerged=True, stdout=True), Options(adapter=R1), Options(adapter_trimming=False, eval_duplication=False),
]


@pytest.mark.parametrize("o", RUNS, ids=range(len(RUNS)))
def test_figures_are_those_of_separate_statistics(spark, o):
    raw = pairs(spark)
    o = o.validated()
    done = run.process(raw, o).cache()
    out = report.build(raw, done, o)
    mates = (1, 2) if o.paired else (1,)
    blocks = {f"read{m}_before_filtering": (raw, f"seq{m}", f"qual{m}") for m in mates}
    kept = done.where((F.col("result") == 0) & (~F.col("is_dup") if o.dedup else F.lit(True)))
    blocks |= {"merged_and_filtered": (done.where("merged_seq is not null and merged_result = 0"), "merged_seq", "merged_qual")} if o.merge else {f"read{m}_after_filtering": (kept, f"seq{m}", f"qual{m}") for m in mates}
    for name, (d, seq, qual) in blocks.items():
        b = out[name]
        s = stats.summary(d, seq, qual).first()
        assert [b[c] for c in ("total_reads", "total_bases", "q20_bases", "q30_bases", "q40_bases", "total_cycles")] == [s[c] for c in ("reads", "bases", "q20_bases", "q30_bases", "q40_bases", "cycles")]
        curves = [r.asDict() for r in stats.curves(stats.cycles(d, seq, qual)).orderBy("cycle").collect()]
        assert b["quality_curves"] == {**{x: [round(c[f"quality_{x}"], 6) for c in curves] for x in "ATCG"}, "mean": [round(c["mean"], 6) for c in curves]}
        assert b["content_curves"] == {x: [round(c[f"content_{x}"], 6) for c in curves] for x in ("A", "T", "C", "G", "N", "GC")}
        assert b["kmer_count"] == {r.kmer: r.n for r in stats.kmers(d, seq).collect()}
        assert b["_quality_histogram"] == {r.q: r.n for r in stats.quality_histogram(d, qual).collect()}
    counts = {r.result: r.reads for r in run.filter_counts(done, o).collect()}
    names = dict(report._FILTERS)
    assert {k: v for k, v in out["filtering_result"].items() if v and k in names.values()} == {names[c]: n for c, n in counts.items() if c in names}
    if o.eval_duplication:
        assert out["duplication"]["rate"] == dedup.duplication_rate(done).first().rate
    if o.paired:
        sizes = {r.insert_size: r.n for r in stats.insert_sizes(done).collect()}
        assert out["insert_size"]["histogram"] == [sizes.get(i, 0) for i in range(512)] and out["insert_size"]["unknown"] == sizes.get(512, 0)
        assert out["adapter_cutting"]["read2_adapter_counts"] == {r.adapter: r.n for r in stats.adapter_report(stats.adapter_counts(done, 2)).collect()}
    if o.adapter_trimming:
        found = {m: {r.adapter: r.n for r in stats.adapter_counts(done, m).collect()} for m in mates}
        assert out["adapter_cutting"]["adapter_trimmed_bases"] == sum(len(a) * n for f in found.values() for a, n in f.items())
        assert out["adapter_cutting"]["adapter_trimmed_reads"] == sum(done.where(f"trimmed{m}").count() for m in mates) > 0
    if o.poly_x:
        assert out["polyx_trimming"]["polyx_trimmed_reads"] == {b: n for b, n in {**dict.fromkeys("ATCG", 0), **{r.base: r.reads for r in stats.poly_counts(done, mates).collect()}}.items()}
    done.unpersist()


def test_each_table_is_read_once(spark):
    o = Options(paired=True, correction=True, overrep=True, overrep_sampling=1)
    raw = pairs(spark)
    done = spark.createDataFrame(run.process(raw, o).collect(), run.process(raw, o).schema)
    seen = {"raw": spark.sparkContext.accumulator(0), "done": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        acc = seen[name]

        def through(batches):
            for b in batches:
                acc.add(b.num_rows)
                yield b

        return df.mapInArrow(through, df.schema)

    known = spark.createDataFrame([(R1[:10],)], "seq string")
    out = report.build(counted(raw, "raw"), counted(done, "done"), o, overrep={1: known, 2: known})
    assert out["read1_before_filtering"]["total_reads"] == 300
    assert {k: v.value for k, v in seen.items()} == {"raw": 300, "done": 300}


def test_states_merge_and_long_reads_go_in_few_rows(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, s := "".join(rnd.choice("ACGTN") for _ in range(rnd.choice((0, 3, 50, 2000)))), "I" * len(s)) for i in range(60)]
    d = spark.createDataFrame([*rows, (99, None, None)], "read_id long, s string, q string")
    whole = {tuple(r) for r in summary.summarize(d.coalesce(1), {"x": summary.Block("s", "q", candidates=("ACG",), sampling=1)}).collect()}
    monkeypatch.setattr(summary, "CELLS", 3000)
    assert {tuple(r) for r in summary.summarize(d.repartition(4), {"x": summary.Block("s", "q", candidates=("ACG",), sampling=1)}).collect()} == whole
    assert max(r[3] for r in whole if r[1] == "cycle") == 1999


def test_pictures_of_long_reads_are_bounded():
    assert report.drawn(300) == list(range(1, 301))
    at = report.drawn(100_000)
    assert at[:42] == [*range(1, 41), 42, 44] and at[-1] == 100_000 and len(at) < 220
    assert report.curve_picture({"mean": [30.0] * 100_000}).count(",") == len(at)


def test_phred64_and_listed_reads_in_reports(spark):
    raw = pairs(spark)
    shifted = raw.withColumns({f"qual{m}": F.expr(f"array_join(transform(split(qual{m}, ''), c -> char(ascii(c) + 31)), '')") for m in (1, 2)})
    o = Options(paired=True, phred64=True)
    a, b = report.build(shifted, run.process(shifted, o), o), report.build(raw, run.process(raw, Options(paired=True)), Options(paired=True))
    assert {k: v for k, v in a.items() if k != "command"} == {k: v for k, v in b.items() if k != "command"}
    listed = Options(paired=True, index_blacklist1=("ACGT",))
    out = report.build(raw, run.process(raw, listed), listed)
    assert out["duplication"] == b["duplication"] and out["duplication"]["rate"] > 0 and out["read1_after_filtering"]["total_reads"] == 0


def adapters_of(spark, found, parts):
    """done, as far as adapters go: each read with the sequence cut off."""
    rows = [(0, False, [x], bool(x)) for x in found]
    return spark.createDataFrame(rows, "result int, is_dup boolean, adapters1 array<string>, trimmed1 boolean").withColumns({"seq1": F.lit("A"), "qual1": F.lit("I")}).repartition(parts)


@pytest.mark.parametrize("room", [400, 120, 101])
def test_frequent_adapters_of_many_different_ones(spark, monkeypatch, room):
    monkeypatch.setattr(summary.Frequent.__init__, "__defaults__", (room,))
    rnd = random.Random(7)
    tails = ["".join(rnd.choice("ACGT") for _ in range(12)) for _ in range(3000)]
    found = tails + ["AGATCGG"] * 900 + ["AGAT"] * 52 + ["CTGTC"] * 39 + [""] * 100
    rnd.shuffle(found)
    d = adapters_of(spark, found, 3)
    o = Options(adapter=R1)
    state = summary.summarize(d, {"x": summary.Block("seq1", "qual1")}, o).cache()
    f = summary.figures(state, d)[""]
    total = len(found) - 100
    assert total == 3991 and f.adapters[1] == {"AGAT": 52, "AGATCGG": 900, "others": total - 952}
    assert f.adapter_bases[1] == sum(map(len, found))
    if room < 400:
        assert f.total("cut1", 2) > 0 and f.total("cut1", 2) <= total / room * 1.01 + 3
    # What is shuffled is bounded by the sketches' room, not by how many there are.
    assert state.where("kind = 'adapter1'").agg(F.count("*")).first()[0] <= 3 * room
    state.unpersist()


def test_sketches_bound_what_they_give_up():
    rnd = random.Random(1)
    for room in (5, 50):
        f, true = summary.Frequent(room), summary.Counter()
        for _ in range(40):
            part = summary.Counter(str(int(rnd.expovariate(0.05))) for _ in range(300))
            f.add(part)
            true.update(part)
        f.prune()
        assert f.total == 12_000 and f.given_up <= f.total / room and len(f.counts) <= room
        assert all(true[x] - f.given_up <= f.counts[x] <= true[x] for x in true)
