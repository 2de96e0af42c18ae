"""Column expressions for reads: everything that needs no kernel stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phred+64 characters and what they are in Phred+33; lower ones become the lowest.
_FROM64 = "".join(map(chr, range(33, 127)))
_TO33 = "".join(chr(max(33, c - 31)) for c in range(33, 127))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTNacgt", "TGCANTGCA"))


def phred33(qual64: Column) -> Column:
    return F.translate(qual64, _FROM64, _TO33)


def trim_front(text: Column, n: Column) -> Column:
    """Without the first n characters, but never without the last."""
    return F.substring(text, F.least(F.length(text) - 1, n) + 1, F.length(text))


def first_index(name: Column) -> Column:
    """Between the last colon and the plus behind it; the last two characters are neither."""
    inner = F.substring(name, F.lit(1), F.length(name) - 2)
    place = F.length(name) - 2 - F.instr(F.reverse(inner), ":") + 1  # of the last colon, from 1
    tail = F.substring(name, place + 1, F.length(name))
    inner_tail = F.substring(inner, place + 1, F.length(name))
    has = F.instr(inner, ":") > 0
    found = F.when(F.instr(inner_tail, "+") > 0, F.substring_index(inner_tail, "+", 1)).otherwise(tail)
    return F.when((F.length(name) < 5) | ~has, "").otherwise(found)


def last_index(name: Column) -> Column:
    """Behind the last colon or plus that is not among the last two characters."""
    inner = F.substring(name, F.lit(1), F.length(name) - 2)
    back = F.reverse(F.translate(inner, "+", ":"))
    has = F.instr(back, ":") > 0
    return F.when((F.length(name) < 5) | ~has, "").otherwise(F.substring(name, F.length(inner) - F.instr(back, ":") + 2, F.length(name)))


def fix_mgi(name: Column) -> Column:
    """A space before the closing /1 or /2."""
    return F.regexp_replace(name, "/([12])$", " /$1")


def with_umi(name: Column, umi: Column, prefix: str = "", delim: str = ":", always: bool = False) -> Column:
    """The identifier put before the name's first space, or at its end."""
    tag = F.concat(F.lit(delim + (f"{prefix}_" if prefix else "")), umi)
    at = F.instr(name, " ")
    new = F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), tag, F.substring(name, at, F.length(name)))).otherwise(F.concat(name, tag))
    return new if always else F.when(umi == "", name).otherwise(new)


def low_quality_bases(qual: Column, quality: int) -> Column:
    low = "".join(map(chr, range(33, 33 + quality)))
    return F.length(qual) - F.length(F.translate(qual, low, "")) if low else F.lit(0)


def n_bases(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def duplicate_key(*seqs: Column) -> Column:
    """Mates joined without a separator, with one letter for all but A, C, G and T."""
    return F.regexp_replace(F.concat(*seqs), "[^ACGT]", "N")


def index_matches(index: Column, barcodes: tuple[str, ...], threshold: int) -> Column:
    """Whether some barcode differs from the index in at most `threshold` places of their common length.

    The index is bound once, as an array of one: written out for each place of each barcode it would make code that is too long to compile.
    """
    if not barcodes:
        return F.lit(False)

    def matches(own: Column) -> Column:
        hit = F.lit(False)
        for b in barcodes:
            wrong = F.lit(0)
            for i, base in enumerate(b, 1):
                wrong = wrong + F.when((F.length(own) >= i) & (F.substring(own, i, 1) != base), 1).otherwise(0)
            hit = hit | (wrong <= threshold)
        return hit

    return F.exists(F.array(index), matches)
