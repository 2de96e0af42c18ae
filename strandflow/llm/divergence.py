"""An audit of how far the sources of a language differ in their words, counted and summed by DuckDB in hash shards.

Terms are runs of ASCII letters and characters beyond ASCII, of which only A-Z are lower-cased. Each language keeps
the V terms that at least `min_docs` of its documents have. A group (language and source) and a language as a whole give
a kept term the part per 10**9 p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), N being the sum of its counts of kept
terms; two such parts differ by floor((p - q)**2 / (p + q)). All numbers are integers, of 128 bits where they are multiplied.

1. Each Arrow batch becomes a table of words, which DuckDB counts by row, then by language, source and term; Spark adds
   the counts up, within tasks first, so that a term that all documents have is one row of each task.
2. The counts are dealt over shards by a hash of language and term, about `CELLS` counts in each. In each shard DuckDB drops
   rare terms; Spark adds up N and V of the groups.
3. With these, which go to each shard, DuckDB sums the differences of each two sources over the shard's terms and ranks the terms
   of each group. Spark adds the sums of pairs up and ranks them, and ranks the first `top` terms of all shards.

Terms with counts in few sources stand in a shard as these only; DuckDB fills in the others for so many terms at a
time that there are at most `DENSE` parts. A shard has all sources of a term, so the result has no term twice.

Defined cases: null text, lang and source are ''. A group without terms is compared like the others (its counts are
0); in a language without kept terms all pairs have the value 0 and no terms are ranked; a language of one source has
no pairs. Rows that repeat are documents of their own; a long text is one document; equal values rank by the item's
bytes in UTF-8. An empty table gives no rows. doc_id and other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandflow.llm.common import discard, map_batches, releasing, releasing2, settle, utf8

MIN_DOCS, TOP = 10, 10
#: Counts of a term in a group that one shard holds on average, and parts (term and source) that are filled in at a time.
CELLS, DENSE = 200_000, 1_000_000

_COUNT = """
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
FROM (SELECT row, term, count(*) AS n FROM words GROUP BY row, term) JOIN rows USING (row) GROUP BY lang, source, term
"""

_KEEP = """
SELECT shard, lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::INT AS first
FROM cells QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {min_docs}
"""

#: q: the part in the whole language; p: that in one of its sources, also in those without the term.
_PARTS = """
CREATE OR REPLACE TEMP TABLE parts AS
SELECT t.lang, k.number, k.term, t.source, coalesce(c.n, 0) AS n,
       (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (t.n_group + 2 * t.v))::BIGINT AS p,
       (1 + 1000000000::HUGEINT * (k.n + 2) // (t.n_lang + 2 * t.v))::BIGINT AS q
FROM kept k JOIN totals t ON t.lang = k.lang LEFT JOIN cells c ON c.lang = k.lang AND c.term = k.term AND c.source = t.source
WHERE k.number >= {start} AND k.number < {stop}
"""

_PAIRS = """
SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
FROM parts a JOIN parts b ON a.number = b.number AND a.source < b.source GROUP BY ALL
"""

_TERMS = """
SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM parts WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}
"""


def connection():
    """DuckDB in memory with one thread, in the task that Spark gave it."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


@lru_cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it belongs to a term, and what it is in lower case."""
    code = np.arange(256)
    upper = (code >= 0x41) & (code <= 0x5A)
    return upper | ((code >= 0x61) & (code <= 0x7A)) | (code >= 0x80), np.where(upper, code + 32, code).astype(np.uint8)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row and the term of each occurrence in the texts."""
    inside, lower = _letters()
    data, offsets = utf8(texts)
    is_in = inside[data]
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = is_in[heads]  # a text does not continue the one before
    starts = np.flatnonzero(begins)
    row = np.searchsorted(offsets, starts, "right") - 1
    # Places among the bytes inside terms, which alone are kept.
    at = np.append((np.cumsum(is_in) - 1)[starts], is_in.sum()).astype(np.int64)
    kept = lower[data[is_in]]
    return row, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(kept))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term with n (occurrences) and docs (rows that have it), added up over all rows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, term = words_of(batch.column("text"))
        number = np.arange(batch.num_rows)
        with connection() as con:
            con.register("words", pa.table({"row": row, "term": term}))
            con.register("rows", pa.table({"row": number, "lang": batch.column("lang"), "source": batch.column("source")}))
            found = con.sql(_COUNT).to_arrow_table()
        return _one_batch(found, _schema)

    schema = "lang string, source string, term string, n long, docs long"
    _schema = _arrow(schema)
    return map_batches(docs, count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS, dense: int = DENSE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = settle(named.groupBy("lang", "source").agg(F.count("*").alias("rows")))
    counted = settle(count_terms(named))
    shards = max(named.sparkSession.sparkContext.defaultParallelism, -(-counted.count() // cells))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = settle(_keep(dealt, min_docs))
    discard(counted)
    totals = settle(_totals(groups, kept))
    found = settle(_differences(kept, totals, shards, top, dense))
    discard(kept)

    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # Languages without kept terms: every two sources, and nothing to sum.
    bare = totals.where("v = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(turned).unionByName(zero).withColumn("part", F.lit("pair"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    ranked = pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _keep(dealt: DataFrame, min_docs: int) -> DataFrame:
    """The counts of the terms that enough documents of a language have; first: 1 in one row of each such term."""
    schema = "shard int, lang string, source string, term string, n long, first int"
    arrow = _arrow(schema)

    def keep(cells: pa.Table) -> pa.Table:
        with connection() as con:
            con.register("cells", cells)
            return _like(con.sql(_KEEP.format(min_docs=min_docs)).to_arrow_table(), arrow)

    return dealt.groupBy("shard").applyInArrow(releasing(keep), schema)


def _totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang and source of each group with n_group, n_lang and v."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.sum("first").alias("v"))
    over = Window.partitionBy("lang")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return groups.join(sums, ["lang", "source"], "left").select("lang", "source", none("n_group").alias("n_group"), F.sum(none("n_group")).over(over).alias("n_lang"), F.sum(none("v")).over(over).alias("v"))


def _differences(kept: DataFrame, totals: DataFrame, shards: int, top: int, dense: int) -> DataFrame:
    """lang, source, part, item, value: of each shard the sums of its pairs (source < item) and its first terms."""
    schema = "lang string, source string, part string, item string, value long"
    arrow = _arrow(schema)
    each = totals.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def compare(cells: pa.Table, totals: pa.Table) -> pa.Table:
        if not cells.num_rows:
            return arrow.empty_table()
        with connection() as con:
            con.register("cells_of", cells)
            con.register("totals_of", totals)
            con.execute("CREATE TEMP TABLE cells AS SELECT lang, source, term, n FROM cells_of")
            con.execute("CREATE TEMP TABLE totals AS SELECT lang, source, n_group, n_lang, v FROM totals_of")
            con.execute("CREATE TEMP TABLE kept AS SELECT lang, term, sum(n)::HUGEINT AS n, row_number() OVER (ORDER BY lang, term) - 1 AS number FROM cells GROUP BY lang, term")
            n_terms = con.execute("SELECT count(*) FROM kept").fetchone()[0]
            most = con.execute("SELECT max(n) FROM (SELECT count(*) AS n FROM totals GROUP BY lang)").fetchone()[0]
            step, out = max(dense // most, 1), []
            for start in range(0, n_terms, step):
                con.execute(_PARTS.format(start=start, stop=start + step))
                for part, sql in (("pair", _PAIRS), ("term", _TERMS.format(top=top))):
                    found = con.sql(sql).to_arrow_table()
                    out.append(_like(found.append_column("part", pa.array([part] * found.num_rows, pa.string())), arrow))
        return pa.concat_tables(out)

    return kept.groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(releasing2(compare), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])


def _like(found: pa.Table, schema: pa.Schema) -> pa.Table:
    return found.select(schema.names).cast(schema)


def _one_batch(found: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    rows = _like(found, schema).combine_chunks().to_batches()
    return rows[0] if rows else pa.RecordBatch.from_pylist([], schema)
