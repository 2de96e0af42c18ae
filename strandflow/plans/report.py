"""The report of a run: small aggregates, gathered and put in order."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.operators import pipeline as run
from strandflow.operators import stats
from strandflow.operators.bit_filter import approximate_rates
from strandflow.operators.dedup import duplicate_counts
from strandflow.operators.summary import Block, Figures, figures, summarize
from strandflow.plans.options import Options
from strandflow.plans.session import discard, settle

VERSION = "1"
_FILTERS = ((0, "passed_filter_reads"), (20, "low_quality_reads"), (12, "too_many_N_reads"), (24, "low_complexity_reads"), (28, "adapter_dimer_reads"), (16, "too_short_reads"), (17, "too_long_reads"))


def _whole(parts: list[dict]) -> dict:
    total = {c: sum(p[c] for p in parts) for c in ("reads", "bases", "q20_bases", "q30_bases", "gc_bases")}
    rate = lambda c: total[c] / total["bases"] if total["bases"] else 0.0
    out = {"total_reads": total["reads"], "total_bases": total["bases"], "q20_bases": total["q20_bases"], "q30_bases": total["q30_bases"], "q20_rate": rate("q20_bases"), "q30_rate": rate("q30_bases")}
    out |= {f"read{i}_mean_length": p["mean_length"] for i, p in enumerate(parts, 1)}
    return out | {"gc_content": rate("gc_bases")}


def _block(f: Figures, name: str, sampling: int = 0) -> dict:
    """The statistics of one mate in one phase. What begins with _ is for the pictures only; sampling: of sequences looked for."""
    cycles: dict[int, dict[str, tuple]] = {}
    for (base, at), sums in f.of(name, "cycle").items():
        cycles.setdefault(at, {})[base] = sums
    order = [cycles[c] for c in sorted(cycles)]
    whole = [[sum(v[i] for v in c.values()) for i in range(4)] for c in order]  # reads, of quality 20 and 30, sum of quality
    n_of = lambda c, b: c[b][0] if b in c else 0
    quality = {q: v[0] for (_, q), v in sorted(f.of(name, "quality").items())}
    reads, bases = f.total("reads", block=name), sum(w[0] for w in whole)
    s = {"reads": reads, "bases": bases, "q20_bases": sum(w[1] for w in whole), "q30_bases": sum(w[2] for w in whole), "q40_bases": sum(n for q, n in quality.items() if q >= 40)}
    s |= {"gc_bases": sum(n_of(c, b) for c in order for b in "GCgc"), "cycles": len(order), "mean_length": bases // reads if reads else 0}
    mean = [w[3] / w[0] for w in whole]
    line = lambda b: [round(c[b][3] / c[b][0] if b in c else m, 6) for c, m in zip(order, mean, strict=True)]
    share = lambda bs: [round(sum(n_of(c, b) for b in bs) / w[0], 6) for c, w in zip(order, whole, strict=True)]
    out = {"total_reads": reads, "total_bases": bases, "q20_bases": s["q20_bases"], "q30_bases": s["q30_bases"], "q40_bases": s["q40_bases"], "total_cycles": s["cycles"]}
    out["quality_curves"] = {**{b: line(b) for b in "ATCG"}, "mean": [round(m, 6) for m in mean]}
    out["content_curves"] = {**{b: share(b) for b in "ATCGN"}, "GC": share("GC")}
    kmers = {x: v[0] for (x, _), v in f.of(name, "kmer").items()}
    out["kmer_count"] = {x: kmers[x] for x in sorted(kmers, key=lambda x: x.translate(str.maketrans(*stats.KMER_ORDER)))}
    out["_quality_histogram"] = quality
    if sampling:
        places: dict[str, dict[int, int]] = {}
        for (x, at), v in sorted(f.of(name, "frequent").items()):
            places.setdefault(x, {})[at] = v[0]
        places = {x: p for x, p in places.items() if stats.reported(x, sum(p.values()), sampling)}
        out["overrepresented_sequences"] = {x: sum(p.values()) for x, p in places.items()}
        out["_overrepresented_places"] = places
    return {"summary": s, "report": out}


def build(raw: DataFrame, done: DataFrame, o: Options, command: str = "", overrep: dict[int, DataFrame] | None = None) -> dict:
    """raw: the reads as they came; done: the result of process() over them, best written; overrep: of each mate the candidates to count.

    Each is read once, into a state (operators.summary) that is written before it is looked at; raw once more for the keys of all
    reads where an index list keeps some from `done`.
    """
    return build_samples(raw, done, {"": o}, command, overrep)[""]


def build_samples(raw: DataFrame, done: DataFrame, options: dict[str, Options], command: str = "", overrep: dict[int, DataFrame] | None = None) -> dict[str, dict]:
    """The reports of all samples, by the same jobs as for one. Reads have a column `sample`; the options may differ in what was detected."""
    o = next(iter(options.values()))
    mates = (1, 2) if o.paired else (1,)
    known = {m: tuple(sorted({r.seq for r in c.select("seq").collect()})) for m, c in (overrep or {}).items()}  # small sets by their making
    block = lambda m, seq, qual, where=None: Block(seq, qual, where, known.get(m, ()), o.overrep_sampling)
    raw = run.taken(raw, o)
    emit = F.lit(True) if not o.dedup else ~F.col("is_dup")
    if o.merge:
        kept = {"merged_and_filtered": block(1, "merged_seq", "merged_qual", F.expr("merged_seq is not null and merged_result = 0"))}
    else:
        kept = {f"read{m}_after_filtering": block(m, f"seq{m}", f"qual{m}", (F.col("result") == 0) & emit) for m in mates}
    states = [settle(summarize(raw, {f"read{m}_before_filtering": block(m, f"seq{m}", f"qual{m}") for m in mates})), settle(summarize(done, kept, o))]
    first, then = figures(states[0]), figures(states[1], done)
    rates = {}
    if o.eval_duplication and o.dup_calc_accuracy and not o.dedup:
        rates = dict.fromkeys(options, 0.0) | approximate_rates(raw, [f"seq{m}" for m in mates], o.dup_calc_accuracy)
    elif o.eval_duplication and (o.index_blacklist1 or o.index_blacklist2):
        rates = {r["sample"] if "sample" in raw.columns else "": r.rate for r in duplicate_counts(raw, [f"seq{m}" for m in mates]).collect()}
    discard(*states)
    none = Figures()
    return {s: _report(first.get(s, none), then.get(s, none), own, list(kept), set(known), rates.get(s), command) for s, own in options.items()}


def _report(first: Figures, f: Figures, o: Options, kept: list[str], known: set[int], rate: float | None, command: str) -> dict:
    """The report of one sample from its figures before and after; known: mates of which sequences were looked for; rate: of duplicates, where it is not in the figures."""
    mates = (1, 2) if o.paired else (1,)
    before = {m: _block(first, f"read{m}_before_filtering", o.overrep_sampling if m in known else 0) for m in mates}
    after = {name: _block(f, name, o.overrep_sampling if (2 if name.startswith("read2") else 1) in known else 0) for name in kept}
    counts = {code: v[0] for (_, code), v in f.of("run", "result").items()}
    filtering = {}
    for code, name in _FILTERS:
        if code == 24 and not o.complexity_filter or code == 28 and not o.adapter_trimming:
            continue
        filtering[name] = counts.get(code, 0)
        if code == 0 and o.paired and o.correction:
            filtering |= {"corrected_reads": f.total("corrected"), "corrected_bases": f.total("corrected", 1)}
    out = {"summary": {"version": VERSION, "sequencing": f"{'paired' if o.paired else 'single'} end", "before_filtering": _whole([before[m]["summary"] for m in mates]), "after_filtering": _whole([a["summary"] for a in after.values()])}, "filtering_result": filtering}
    if o.eval_duplication:
        if rate is None:
            rate = f.total("dup") / f.total("dup", 1) if f.total("dup", 1) else 0.0
        out["duplication"] = {"rate": rate}
    if o.paired:
        sizes = {size: v[0] for (_, size), v in f.of("run", "insert").items()}
        known_sizes = {k: v for k, v in sizes.items() if k < 512}
        peak = min((k for k, v in known_sizes.items() if v == max(known_sizes.values())), default=0)
        out["insert_size"] = {"peak": peak, "unknown": sizes.get(512, 0), "histogram": [known_sizes.get(i, 0) for i in range(512)]}
    if o.adapter_trimming and (o.paired or o.adapter not in ("", "auto")):
        cut = {"adapter_trimmed_reads": sum(f.total(f"trimmed{m}") for m in mates), "adapter_trimmed_bases": sum(f.adapter_bases[m] for m in mates)}
        for m in mates:
            cut[f"read{m}_adapter_sequence"] = (o.adapter if m == 1 else o.adapter_r2) or "unspecified"
            cut[f"read{m}_adapter_counts"] = f.adapters[m]
        out["adapter_cutting"] = cut
    if o.poly_x:
        poly = {b: v for (b, _), v in f.of("run", "poly").items()}
        count = lambda i: {b: poly[b][i] if b in poly else 0 for b in "ATCG"}
        out["polyx_trimming"] = {"total_polyx_trimmed_reads": sum(count(0).values()), "polyx_trimmed_reads": count(0), "total_polyx_trimmed_bases": sum(count(1).values()), "polyx_trimmed_bases": count(1)}
    for m in mates:
        out[f"read{m}_before_filtering"] = before[m]["report"]
    for name, a in after.items():
        out[name] = a["report"]
    if o.merge:
        out["_merged_pairs"] = f.total("merged")
    return out | {"command": command}


#: Reads of more cycles are long; of these the first FULL are drawn, then each that is STEP times as far. Fixed values.
LONG, FULL, STEP = 300, 40, 1.05


def drawn(cycles: int) -> list[int]:
    """The cycles (from 1) that a picture of curves has: all, or of long reads ever fewer, with the last."""
    if cycles <= LONG:
        return list(range(1, cycles + 1))
    out, at = list(range(1, FULL + 1)), FULL * STEP
    while at < cycles:
        out.append(int(at))
        at *= STEP
    return out if out[-1] == cycles else [*out, cycles]


def to_json(report: dict) -> str:
    """Doubles to six digits; without what is for the pictures only."""
    tidy = lambda x: {k: tidy(v) for k, v in x.items() if not str(k).startswith("_")} if isinstance(x, dict) else [tidy(v) for v in x] if isinstance(x, list) else float(f"{x:.6g}") if isinstance(x, float) else x
    return json.dumps(tidy(report), indent=1)


def to_html(report: dict, title: str = "Read report") -> str:
    """Tables of the report's figures and lines of its curves, without scripts."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]

    def rows(d: dict) -> str:
        cell = lambda v: html.escape(f"{v:.4g}" if isinstance(v, float) else str(v))
        return "<table>" + "".join(f"<tr><th>{html.escape(str(k))}<td>{cell(v)}" for k, v in d.items() if not isinstance(v, dict | list)) + "</table>"

    for key, value in report.items():
        if not isinstance(value, dict):
            continue
        parts.append(f"<h2>{html.escape(key)}</h2>" + rows(value))
        for name, inner in value.items():
            if name in ("_quality_histogram", "kmer_count", "_overrepresented_places") or name == "overrepresented_sequences" and "_overrepresented_places" in value:
                if name == "_quality_histogram" and inner:
                    parts.append("<h3>quality histogram</h3>" + bars(inner))
                elif name == "kmer_count" and inner:
                    parts.append("<h3>5-mers</h3>" + heat_table(inner))
                elif name == "overrepresented_sequences":
                    parts.append("<h3>over-represented sequences</h3>" + overrep_table(inner, value["_overrepresented_places"], value.get("total_bases", 0)))
            elif name == "histogram" and isinstance(inner, list) and any(inner):
                parts.append("<h3>insert sizes</h3>" + bars(dict(enumerate(inner))))
            elif isinstance(inner, dict) and inner and all(isinstance(v, list) for v in inner.values()):
                parts.append(f"<h3>{html.escape(name)}</h3>" + curve_picture(inner))
            elif isinstance(inner, dict):
                parts.append(f"<h3>{html.escape(name)}</h3>" + rows(inner))
            elif isinstance(inner, list):
                parts.append(f"<h3>{html.escape(name)}</h3>" + curve_picture({name: inner}))
    return "\n".join(parts)


def bars(counts: dict[int, int], width: int = 640, height: int = 160) -> str:
    """A bar for each number from the least to the largest that occurs."""
    some = {k: v for k, v in counts.items() if v}
    low, high, most = min(some), max(some), max(some.values())
    each = width / (high - low + 1)
    out = [f'<svg width="{width}" height="{height + 16}" viewBox="0 0 {width} {height + 16}">']
    for k, v in sorted(some.items()):
        tall = v / most * (height - 4)
        out.append(f'<rect x="{(k - low) * each:.1f}" y="{height - tall:.1f}" width="{max(each - 0.5, 0.5):.1f}" height="{tall:.1f}" fill="#1b6ca8"><title>{k}: {v}</title></rect>')
    return "".join([*out, f'<text x="0" y="{height + 13}" font-size="11">{low}</text><text x="{width}" y="{height + 13}" font-size="11" text-anchor="end">{high}</text></svg>'])


def heat_table(counts: dict[str, int]) -> str:
    """The k-mers by their first two bases and the others; darker is more frequent, the mean is in the middle."""
    heads, tails = sorted({x[:2] for x in counts}), sorted({x[2:] for x in counts})
    mean = sum(counts.values()) / max(1, len(counts))
    rows = []
    for h in heads:
        cells = []
        for t in tails:
            n = counts.get(h + t, 0)
            share = min(1.0, n / mean / 2) if mean else 0.0
            cells.append(f'<td style="background:rgba(27,108,168,{share:.2f})" title="{h}{t}: {n} ({n / mean if mean else 0:.2f} times the mean)">{h}{t}')
        rows.append(f"<tr><th>{h}" + "".join(cells))
    return '<table style="font:7px monospace">' + "<tr><th>" + "".join(f"<th>{t}" for t in tails) + "".join(rows) + "</table>"


def overrep_table(counts: dict[str, int], places: dict[str, dict[int, int]], bases: int) -> str:
    """Sequence, count with its share of bases, and where it begins."""
    rows = ["<tr><th>sequence<th>count (share of bases)<th>places"]
    for s, n in counts.items():
        share = 100 * n * len(s) / bases if bases else 0.0
        rows.append(f"<tr><td><code>{html.escape(s)}</code><td>{n} ({share:.4g}%)<td>{bars(places[s], 240, 40)}")
    return "<table>" + "".join(rows) + "</table>"


def batch_curves(reports: dict[str, dict]) -> dict[str, dict]:
    """Mean quality and GC content by cycle of all samples, before and after; shorter samples are padded with their last value."""
    out: dict[str, dict] = {}
    for block in ("read1_before_filtering", "read2_before_filtering", "read1_after_filtering", "read2_after_filtering", "merged_and_filtered"):
        for what, curve in (("quality_curves", "mean"), ("content_curves", "GC")):
            own = {name: r[block][what][curve] for name, r in sorted(reports.items()) if block in r and r[block][what][curve]}
            if own:
                most = max(map(len, own.values()))
                out.setdefault(block, {})[f"{what}: {curve}"] = {name: v + [v[-1]] * (most - len(v)) for name, v in own.items()}
    return out


def curve_picture(curves: dict[str, list], width: int = 640, height: int = 160) -> str:
    """Lines over cycles; of long reads with the cycles that `drawn` names, side by side."""
    curves = {name: [v[c - 1] for c in drawn(len(v))] for name, v in curves.items()}
    most = max((max(v) for v in curves.values() if v), default=0) or 1
    shades = ("#1b6ca8", "#c1442e", "#2e8540", "#8a6d00", "#6b3fa0", "#444")
    out = [f'<svg width="{width}" height="{height}" viewBox="0 0 {width} {height}">']
    for (name, v), shade in zip(curves.items(), shades * 3, strict=False):
        at = " ".join(f"{i * width / max(1, len(v) - 1):.1f},{height - 4 - x / most * (height - 8):.1f}" for i, x in enumerate(v))
        out.append(f'<polyline fill="none" stroke="{shade}" points="{at}"><title>{html.escape(name)}</title></polyline>')
    return "".join([*out, "</svg>"])


#: Names of blocks and what stands before their figures on a terminal.
_BLOCKS = {"read1_before_filtering": "Read 1 before filtering", "read2_before_filtering": "Read 2 before filtering", "read1_after_filtering": "Read 1 after filtering", "read2_after_filtering": "Read 2 after filtering", "merged_and_filtered": "Merged and filtered"}


def to_text(report: dict) -> str:
    """The figures of a run in lines for a terminal: each mate before and after, results, duplicates, insert size, merging."""
    lines = []
    for name, title in _BLOCKS.items():
        if b := report.get(name):
            lines += [title, f"  reads: {b['total_reads']}", f"  bases: {b['total_bases']}"]
            lines += [f"  Q{q} bases: {b[f'q{q}_bases']} ({100 * b[f'q{q}_bases'] / b['total_bases'] if b['total_bases'] else 0.0:.4g}%)" for q in (20, 30, 40)]
    lines.append("Results")
    lines += [f"  {k.replace('_', ' ')}: {v}" for k, v in report["filtering_result"].items()]
    if cut := report.get("adapter_cutting"):
        lines += [f"  {k.replace('_', ' ')}: {cut[k]}" for k in ("adapter_trimmed_reads", "adapter_trimmed_bases")]
    if poly := report.get("polyx_trimming"):
        lines += [f"  {k.removeprefix('total_').replace('_', ' ')}: {poly[k]}" for k in ("total_polyx_trimmed_reads", "total_polyx_trimmed_bases")]
    if "duplication" in report:
        lines.append(f"Duplication: {100 * report['duplication']['rate']:.4g}%")
    if "insert_size" in report:
        lines.append(f"Insert size peak: {report['insert_size']['peak']}")
    if "_merged_pairs" in report:
        pairs, first = report["_merged_pairs"], report["read1_before_filtering"]["total_reads"]
        kept = report["merged_and_filtered"]["total_reads"]
        lines.append(f"Pairs merged: {pairs} ({100 * pairs / first if first else 0.0:.4g}% of pairs, {100 * pairs / kept if kept else 0.0:.4g}% of reads after filtering)")
    return "\n".join(lines)


def batch_summary(reports: dict[str, dict]) -> list[dict]:
    """One row for each sample, for the overview of a folder."""
    out = []
    for name, r in sorted(reports.items()):
        before, after = r["summary"]["before_filtering"], r["summary"]["after_filtering"]
        out.append({"sample": name, "reads": before["total_reads"], "bases": before["total_bases"], "q30_rate": before["q30_rate"], "gc_content": before["gc_content"], "kept_reads": after["total_reads"], "kept_bases": after["total_bases"], "duplication": r.get("duplication", {}).get("rate", 0.0)})
    return out
