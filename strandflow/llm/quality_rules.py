"""Rule-based quality filtering with adaptive thresholds, in DataFrame and SQL functions alone.

Each document is measured (words, symbols, repeated lines, repeated five-word windows). Instead of fixed
cutoffs, fences come from mergeable KLL quantile sketches: one for each language and source, which merge
into one for each language and one for all. A group with fewer than `support` documents takes the fences of
its language, and a language with too few those of the whole corpus. The fences, a small table of a row
for each group, are written to the shared folder and joined back.

Defined cases: a null or empty text has no words, so every count is 0 and base_failed is true. Null languages
and sources form groups of their own. Repeated rows are judged each by itself. Ties at a fence are kept.
Columns besides doc_id, text, lang and source are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Fences:
    """A value fails when it lies more than `reach` times the quartile range (or `spread`, if larger) outside the quartiles."""

    reach: float = 3.0
    support: int = 30
    sketch_k: int = 4096
    symbol_spread: float = 0.05
    length_spread: float = 1.0
    line_spread: float = 0.15


#: Measure, the field of Fences with its least spread, and whether a low value fails too.
MEASURES = (("symbol_rate", "symbol_spread", False), ("word_length", "length_spread", True), ("line_rate", "line_spread", False))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    d = d.withColumn("w", F.array_remove(F.split("text", SPACE), "")).withColumn("n", F.size("w"))
    windows = F.expr("if(n < 5, array(), transform(sequence(1, n - 4), i -> xxhash64(slice(w, i, 5))))")
    d = d.withColumn("hashes", windows)
    # Equal windows have equal hashes: only a text with equal hashes needs its windows sorted as text.
    exact = "if(size(array_distinct(hashes)) = size(hashes), null, sort_array(transform(sequence(1, n - 4), i -> struct(array_join(slice(w, i, 5), ' ') as k, i as p))))"
    d = d.withColumn("ordered", F.expr(exact))
    twice = "filter(sequence(0, size(ordered) - 1), j -> (j > 0 and ordered[greatest(j - 1, 0)].k = ordered[j].k) or (j < size(ordered) - 1 and ordered[least(j + 1, size(ordered) - 1)].k = ordered[j].k))"
    d = d.withColumn("starts", F.expr(f"if(ordered is null, null, sort_array(transform({twice}, j -> ordered[j].p)))"))
    covered = "transform(sequence(0, size(starts) - 2), j -> least(5, starts[j + 1] - starts[j]))"
    repeat = F.expr(f"case when starts is null or size(starts) = 0 then 0 when size(starts) = 1 then 5 else 5 + aggregate({covered}, 0, (a, x) -> a + x) end")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    return d.select(
        "doc_id", "lang", "source",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        repeat.cast("long").alias("n_repeat_words"),
    ).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates(m: DataFrame) -> DataFrame:
    """The measures that fences bound; null (never out of bounds) without words or lines."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double"))
    return m.withColumns({"symbol_rate": per("n_symbols", "n_words"), "word_length": per("word_chars", "n_words"), "line_rate": per("n_dup_lines", "n_lines")})


def fences(m: DataFrame, how: Fences = Fences()) -> DataFrame:
    """lang, source and low_*, high_* of each measure, from sketches of all documents that have words."""
    names = [k for k, _, _ in MEASURES]
    own = (
        rates(m).where("n_words > 0").groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k, F.lit(how.sketch_k)).alias(k) for k in names))
    )
    own = settle(own)
    merged = lambda d, *by: d.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(k, F.lit(how.sketch_k)).alias(k) for k in names))
    by_lang = merged(own, "lang")
    all_of = merged(by_lang)

    def bounds(d: DataFrame, level: str) -> DataFrame:
        out = d
        for k, spread, low in MEASURES:
            q1, q3 = (F.kll_sketch_get_quantile_double(k, F.lit(q)) for q in (0.25, 0.75))
            reach = F.lit(how.reach) * F.greatest(q3 - q1, F.lit(getattr(how, spread)))
            out = out.withColumn(f"high_{k}", q3 + reach).withColumn(f"low_{k}", q1 - reach if low else F.lit(float("-inf")))
        return out.drop(*names).withColumnsRenamed({c: f"{level}_{c}" for c in ("n", *(f"{e}_{k}" for k in names for e in ("high", "low")))})

    own, by_lang, all_of = bounds(own, "s"), bounds(by_lang, "l"), bounds(all_of, "a")
    by_lang = by_lang.withColumnRenamed("lang", "of_lang")
    all_levels = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang"))).crossJoin(all_of)  # all_of is one row
    pick = lambda c: F.when(F.col("s_n") >= how.support, F.col(f"s_{c}")).when(F.col("l_n") >= how.support, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return all_levels.select("lang", "source", *(pick(f"{e}_{k}").alias(f"{e}_{k}") for k in names for e in ("low", "high")))


def filter_documents(docs: DataFrame, how: Fences = Fences()) -> DataFrame:
    """Every document with its counts, its group's fences, base_failed and kept."""
    m = settle(measure(docs))  # read by the sketches and by the join
    f = settle(fences(m, how)).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    d = rates(m).join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    within = F.lit(True)
    for k, _, _ in MEASURES:
        within = within & F.coalesce(F.col(k).between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(True))
    return d.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)
