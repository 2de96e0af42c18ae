"""python -m strandflow.cli: a run over files, with reports; or over all samples of a folder."""

from __future__ import annotations

import argparse
import dataclasses
import functools
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandflow.operators import detect
from strandflow.operators import pipeline as run
from strandflow.plans import report
from strandflow.plans.options import Options
from strandflow.plans.session import discard, discard_path, expose, settle, shared_dir
from strandflow.sources import fastq
from strandflow.sources.sinks import exists, write_files, write_samples, write_split, write_stream, write_text


def parser() -> argparse.ArgumentParser:
    """An option for each field of Options, and the files."""
    p = argparse.ArgumentParser(prog="strandflow")
    for name in ("in1", "in2", "json", "html", "adapter_fasta", "adapter_table", "filter_by_index1", "filter_by_index2", "in_dir", "out_dir", "report_title"):
        p.add_argument(f"--{name}", default="")
    for f in dataclasses.fields(Options):
        kind = str(f.type)
        if kind.startswith("bool"):
            p.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=f.default)
        elif "tuple[int, int]" in kind:
            p.add_argument(f"--{f.name}", nargs=2, type=int, metavar=("WINDOW", "QUALITY"), default=f.default)
        elif "tuple" not in kind:
            p.add_argument(f"--{f.name}", type=int if "int" in kind else str, default=f.default)
    p.add_argument("--join", action=argparse.BooleanOptionalAction, default=True, help="each output as one file; else as a folder of parts in order")
    return p


def options_of(a: argparse.Namespace) -> Options:
    names = {f.name for f in dataclasses.fields(Options)}
    o = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in vars(a).items() if k in names})
    lists = {"adapter_list": tuple(fastq.read_adapters(a.adapter_fasta)) if a.adapter_fasta else ()}
    lists |= {f"index_blacklist{i}": tuple(fastq.read_barcodes(getattr(a, f"filter_by_index{i}"))) if getattr(a, f"filter_by_index{i}") else () for i in (1, 2)}
    return dataclasses.replace(o, paired=bool(a.in2) or a.interleaved_in, **lists)


def detected(raw, o: Options, table: str = "") -> Options:
    """Options with what is found out from the reads: adapters (single reads, or pairs on demand) and two-colour chemistry."""
    first = raw.select("read_id", F.col("name1").alias("name"), F.col("seq1").alias("seq"))
    if o.poly_g is None and detect.two_colour(first).first().two_colour:
        o = dataclasses.replace(o, poly_g=True)
    known = {s: name for name, s in fastq.read_fasta(table).items()} if table else None
    if o.adapter_trimming and (not o.paired and o.adapter in ("", "auto") or o.paired and o.detect_adapter_for_pe):
        o = dataclasses.replace(o, adapter=detect.find_adapter(first, adapters=known, literal=o.literal))
        if o.paired:
            second = raw.select("read_id", F.col("seq2").alias("seq"))
            o = dataclasses.replace(o, adapter_r2=detect.find_adapter(second, adapters=known, literal=o.literal))
    return o


def spooled(spark: SparkSession, stream) -> str:
    """What comes in on stream as a file of the folder that all executors share."""
    from pyarrow import fs

    path = f"{shared_dir(spark)}.fq"
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        while block := stream.read(1 << 20):
            out.write(block)
    return path


def guard(a: argparse.Namespace, o: Options) -> None:
    """No output may be there if none is to be overwritten."""
    if o.dont_overwrite:
        for p in (o.out1, o.out2, o.unpaired1, o.unpaired2, o.failed_out, o.merged_out, o.overlapped_out, a.json, a.html):
            if p and exists(p):
                raise FileExistsError(p)


def run_files(spark: SparkSession, a: argparse.Namespace) -> dict:
    o = options_of(a).with_names(a.in1, a.in2)
    guard(a, o)
    path = spooled(spark, sys.stdin.buffer) if o.stdin else a.in1
    read = fastq.read_interleaved if o.interleaved_in else fastq.read_single
    raw = fastq.read_pairs(spark, path, a.in2, o.reads_to_process) if a.in2 else read(spark, path, o.reads_to_process)
    raw = settle(raw)
    o = (o if o.stdin else detected(raw, o, a.adapter_table)).validated()
    done = settle(run.process(raw, o))
    overrep = {}
    for m in ((1, 2) if o.paired else (1,)) if o.overrep else ():
        reads = raw.select("read_id", F.col(f"seq{m}").alias("seq"))
        overrep[m] = settle(detect.over_represented_candidates(reads, detect.read_length(reads).first()[0]))
    places = {"out1": o.out1, "out2": o.out2, "unpaired1": o.unpaired1, "unpaired2": o.unpaired2 or o.unpaired1, "failed": o.failed_out, "merged": o.merged_out, "overlapped": o.overlapped_out}
    places = {k: v for k, v in places.items() if v}
    routed = run.routes(done, o)
    if o.stdout:
        write_stream(routed, ["merged"] if o.merge else ["out1", "out2"], sys.stdout.buffer)
    elif o.split or o.split_by_lines:
        write_split(routed, {t: places.pop(t) for t in ("out1", "out2") if t in places}, o, a.join)
    if o.stdout:
        places = {t: p for t, p in places.items() if t not in ("out1", "out2", "merged")}
    if places:
        write_files(routed, places, o.compression, not o.dont_overwrite, a.join)
    if o.stdin:
        discard_path(spark, path)
    out = report.build(raw, done, o, " ".join(sys.argv), overrep)
    discard(raw, done, *overrep.values())
    if a.json:
        write_text(a.json, report.to_json(out))
    if a.html:
        write_text(a.html, report.to_html(out, a.report_title or "Read report"))
    print(report.to_text(out), file=sys.stderr)
    return out


def detected_by_sample(raw, o: Options, samples: list[str], table: str = "") -> dict[str, Options]:
    """As detected() for each sample, by the same jobs for all; only a sample without a known adapter is looked at alone, for an unknown one."""
    out = dict.fromkeys(samples, o)
    if o.poly_g is None:
        firsts = raw.where(F.col("read_id") < detect.LENGTH_SAMPLE).groupBy("sample").agg(F.min_by("name1", "read_id").alias("name")).collect()
        two = {r["sample"]: r.name.startswith(detect.TWO_COLOUR) for r in firsts}
        out = {s: dataclasses.replace(x, poly_g=True) if two.get(s) else x for s, x in out.items()}
    known = {s: name for name, s in fastq.read_fasta(table).items()} if table else None
    if o.adapter_trimming and (not o.paired and o.adapter in ("", "auto") or o.paired and o.detect_adapter_for_pe):
        for m, field in ((1, "adapter"), (2, "adapter_r2"))[: 1 + o.paired]:
            reads = raw.select("sample", "read_id", F.col(f"seq{m}").alias("seq"))
            found = detect.adapters_by_sample(reads, known)
            for s in samples:
                own = found.get(s) or detect.find_adapter(reads.where(F.col("sample") == s).drop("sample"), adapters=known, literal=o.literal)
                out[s] = dataclasses.replace(out[s], **{field: own})
    return {s: x.validated() for s, x in out.items()}


def run_samples(spark: SparkSession, a: argparse.Namespace, samples: dict[str, tuple[str, str]]) -> dict[str, dict]:
    """Samples that are all single reads, or all pairs, as one run: a sample's name goes with its reads through all steps."""
    own = argparse.Namespace(**{**vars(a), "in2": next(iter(samples.values()))[1]})
    place = lambda p: os.path.join(a.out_dir, os.path.basename(p))
    files = {(s, t): place(p) for s, pair in samples.items() for t, p in zip(("out1", "out2"), pair, strict=True) if p}
    o = options_of(own)
    if o.dont_overwrite:
        for p in (*files.values(), *(place(f"{s}.json") for s in samples)):
            if exists(p):
                raise FileExistsError(p)
    raw = settle(fastq.read_samples(spark, samples, o.reads_to_process))
    options = detected_by_sample(raw, o, list(samples), a.adapter_table)
    alike: dict[Options, list[str]] = {}
    for s, x in options.items():
        alike.setdefault(x, []).append(s)
    parts = [run.process(raw.where(F.col("sample").isin(names)), x) for x, names in alike.items()]
    done = settle(functools.reduce(lambda x, y: x.unionByName(y), parts))
    write_samples(run.routes(done, next(iter(alike))), files, o.compression, not o.dont_overwrite, a.join)
    out = report.build_samples(raw, done, options, " ".join(sys.argv))
    for s, r in out.items():
        write_text(place(f"{s}.json"), report.to_json(r))
    discard(raw, done)
    return out


def run_folder(spark: SparkSession, a: argparse.Namespace) -> dict[str, dict]:
    """Every sample of --in_dir, with outputs and reports in --out_dir: pairs in one run and single reads in another.

    Runs that split outputs, merge mates or count over-represented sequences, whose candidates differ, take one sample after another.
    """
    out = {}
    Path(a.out_dir).mkdir(parents=True, exist_ok=True)
    found = fastq.mate_files(os.listdir(a.in_dir))
    if not (a.split or a.split_by_lines or a.merge or a.overrep):
        for paired in (True, False):
            some = {one: (os.path.join(a.in_dir, one), os.path.join(a.in_dir, two) if two else "") for one, two in found if bool(two) == paired}
            out |= run_samples(spark, a, some) if some else {}
        found = []
    for one, two in found:
        own = argparse.Namespace(**vars(a))
        own.in1, own.in2 = os.path.join(a.in_dir, one), os.path.join(a.in_dir, two) if two else ""
        own.out1, own.out2 = os.path.join(a.out_dir, one), os.path.join(a.out_dir, two) if two else ""
        own.json = os.path.join(a.out_dir, f"{one}.json")
        out[one] = run_files(spark, own)
    rows = report.batch_summary(out)
    Path(a.out_dir, "overall.html").write_text(report.to_html({r["sample"]: r for r in rows} | report.batch_curves(out), "All samples"))
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = expose(SparkSession.builder.appName("strandflow").getOrCreate())
    run_folder(spark, a) if a.in_dir else run_files(spark, a)


if __name__ == "__main__":
    main()
