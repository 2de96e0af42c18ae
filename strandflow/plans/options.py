"""The plan of a run: which steps are on and with what settings, and the rules that settings must keep."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Result codes; of a pair's two the larger counts. Fixed values.
RESULTS = {
    0: "passed_filter", 4: "failed_polyx_filter", 8: "failed_bad_overlap", 12: "failed_too_many_n_bases", 16: "failed_too_short",
    17: "failed_too_long", 20: "failed_quality_filter", 24: "failed_low_complexity", 28: "failed_adapter_dimer",
}
UMI_PLACES = ("index1", "index2", "read1", "read2", "per_index", "per_read")


@dataclass(frozen=True)
class Options:
    paired: bool = False
    # inputs and outputs
    phred64: bool = False
    reads_to_process: int = 0
    fix_mgi_id: bool = False
    compression: int = 4
    interleaved_in: bool = False
    stdin: bool = False
    stdout: bool = False
    out1: str = ""
    out2: str = ""
    unpaired1: str = ""
    unpaired2: str = ""
    failed_out: str = ""
    overlapped_out: str = ""
    merge: bool = False
    merged_out: str = ""
    include_unmerged: bool = False
    dont_overwrite: bool = False
    # adapters
    adapter_trimming: bool = True
    adapter: str = ""
    adapter_r2: str = ""
    adapter_list: tuple[str, ...] = ()
    detect_adapter_for_pe: bool = False
    gap_overlap: bool = False
    dimer_max_len: int = 2
    # global trimming; those of the second mate follow the first's where None
    trim_front1: int = 0
    trim_tail1: int = 0
    max_len1: int = 0
    trim_front2: int | None = None
    trim_tail2: int | None = None
    max_len2: int | None = None
    # duplicates
    dedup: bool = False
    eval_duplication: bool = True
    #: 0: duplicates are found exactly; 1 to 6: where they stay, their share is estimated by filters, the finer the higher.
    dup_calc_accuracy: int = 0
    # homopolymer tails
    poly_g: bool | None = None  # None: on where names are of a two-colour instrument
    poly_g_min: int = 10
    poly_x: bool = False
    poly_x_min: int = 10
    # quality cuts: window and mean quality, None where off
    cut_front: tuple[int, int] | None = None
    cut_tail: tuple[int, int] | None = None
    cut_right: tuple[int, int] | None = None
    # filters
    quality_filter: bool = True
    qualified_quality: int = 15
    unqualified_percent: int = 40
    n_base_limit: int = 5
    average_quality: int = 0
    length_filter: bool = True
    length_required: int = 15
    length_limit: int = 0
    complexity_filter: bool = False
    complexity_percent: int = 30
    index_blacklist1: tuple[str, ...] = ()
    index_blacklist2: tuple[str, ...] = ()
    index_threshold: int = 0
    # overlaps
    correction: bool = False
    overlap_require: int = 30
    overlap_diff_limit: int = 5
    overlap_diff_percent: int = 20
    # identifiers
    umi: bool = False
    umi_loc: str = ""
    umi_len: int = 0
    umi_prefix: str = ""
    umi_skip: int = 0
    umi_delim: str = ":"
    # reports and splitting
    overrep: bool = False
    overrep_sampling: int = 20
    split: int = 0
    split_by_lines: int = 0
    split_digits: int = 4
    #: Follow the tool's literal behaviour where it departs from its documentation.
    literal: bool = False

    def of_mate2(self, name: str) -> int:
        own = getattr(self, f"{name}2")
        return getattr(self, f"{name}1") if own is None else own

    def validated(self) -> Options:
        """These options after the silent overrides; settings that contradict each other raise ValueError."""
        o = self if self.poly_g is not None else replace(self, poly_g=False)
        need = _need
        if o.merge:
            need(o.paired, "merging needs pairs")
            need(not (o.split or o.split_by_lines), "merged output cannot be split")
            o = replace(o, correction=True)
            if o.include_unmerged:
                o = replace(o, out1="", out2="", unpaired1="", unpaired2="")
        need(not (o.stdout and (o.split or o.split_by_lines)), "standard output cannot be split")
        need(not (o.split and o.split_by_lines), "split by files or by lines, not both")
        need(not o.split or 2 <= o.split <= 999, "2 to 999 files")
        need(not o.split_by_lines or (o.split_by_lines >= 1000 and o.split_by_lines % 4 == 0), "lines of a file: 1000 or more, a multiple of 4")
        need(0 <= o.split_digits <= 10, "0 to 10 digits")
        if o.split or o.split_by_lines:
            o = replace(o, unpaired1="", unpaired2="")
        if not o.paired:
            o = replace(o, unpaired1="", unpaired2="", overlapped_out="", correction=False)
        for name, low, high in (
            ("compression", 1, 9), ("poly_g_min", 1, 1000), ("poly_x_min", 1, 1000), ("qualified_quality", 0, 93), ("unqualified_percent", 0, 100),
            ("n_base_limit", 0, 1000), ("average_quality", 0, 93), ("complexity_percent", 0, 100), ("overlap_diff_percent", 0, 100),
            ("overrep_sampling", 1, 10000), ("overlap_require", 0, 10**6), ("overlap_diff_limit", 0, 10**6), ("reads_to_process", 0, 2**62),
            ("dup_calc_accuracy", 0, 6), ("trim_front1", 0, 10**6), ("trim_tail1", 0, 10**6), ("length_required", 0, 10**6), ("length_limit", 0, 10**6),
        ):
            need(low <= getattr(o, name) <= high, f"{name}: {low} to {high}")
        for name in ("cut_front", "cut_tail", "cut_right"):
            if cut := getattr(o, name):
                need(1 <= cut[0] <= 1000 and 1 <= cut[1] <= 30, f"{name}: a window of 1 to 1000, a mean quality of 1 to 30")
        for a in (o.adapter, o.adapter_r2):
            need(not a or a == "auto" or (len(a) > 3 and re.fullmatch("[ACGT]+", a)), "adapters are over 3 bases of ACGT")
        if o.adapter and o.adapter != "auto" and not o.adapter_r2 and o.paired:
            o = replace(o, adapter_r2=o.adapter)
        if o.umi:
            need(o.umi_loc in UMI_PLACES, f"umi_loc: one of {', '.join(UMI_PLACES)}")
            need(o.paired or o.umi_loc not in ("index2", "read2"), "that place needs pairs")
            if o.umi_loc in ("read1", "read2", "per_read"):
                need(1 <= o.umi_len <= 100 and 0 <= o.umi_skip <= 100, "umi_len: 1 to 100; umi_skip: 0 to 100")
            need(not o.umi_prefix or re.fullmatch("[A-Za-z0-9]{1,9}", o.umi_prefix), "umi_prefix: under 10 letters or digits")
        for b in (*o.index_blacklist1, *o.index_blacklist2):
            need(re.fullmatch("[ACGT]+", b), "barcodes are of ACGT")
        if o.dedup:
            o = replace(o, eval_duplication=True)
        return o

    def with_names(self, in1: str = "", in2: str = "") -> Options:
        """These options after the rules on names of inputs and outputs; names that contradict each other raise ValueError.

        Names that have no use in a run are dropped: outputs of files when all goes to standard output, those that merging
        with unmerged reads, single reads or split outputs do not have.
        """
        o, need = self, _need
        pairs = bool(in2) or o.interleaved_in
        need(in1 or o.stdin, "the reads need a file or standard input" if not in2 else "a second input without a first")
        need(not (in2 and o.interleaved_in), "interleaved reads have no second input")
        if o.stdout:
            o = replace(o, out1="", out2="")
        if o.merge:
            need(pairs, "merging needs pairs")
            if not o.merged_out and not o.stdout and o.out1 and not o.out2:
                o = replace(o, merged_out=o.out1, out1="")
            if o.include_unmerged:
                o = replace(o, out1="", out2="", unpaired1="", unpaired2="")
            need(o.merged_out or o.stdout, "merging needs a merged output or standard output")
        else:
            o = replace(o, merged_out="")
        need(pairs or not o.out2, "a second output needs a second input or interleaved reads")
        if pairs:
            need(not o.out1 or o.out2, "pairs need a second output with the first")
            need(o.out1 or not o.out2 or o.merge, "pairs need a first output with the second")
        if not pairs:
            o = replace(o, unpaired1="", unpaired2="", overlapped_out="")
        if o.split or o.split_by_lines:
            o = replace(o, unpaired1="", unpaired2="")
        names = [(n, getattr(o, n)) for n in ("out1", "out2", "unpaired1", "unpaired2", "failed_out", "merged_out", "overlapped_out")]
        for i, (a, x) in enumerate(names):
            for b, y in names[i + 1 :]:
                need(not x or x != y or (a, b) == ("unpaired1", "unpaired2"), f"{a} and {b} need different names")
        return o


def _need(holds, message: str) -> None:
    if not holds:
        raise ValueError(message)
