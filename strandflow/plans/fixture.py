"""Sequencing reads derived from the table orders by SQL that Spark and DuckDB read alike: one pair for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators.detect import ADAPTER_SAMPLE
from strandflow.plans.session import shared_dir, spread

READS = r"""
with b as (
  select o_orderkey as k,
         case when o_orderkey % 10 = 0 then o_orderkey - 1 else o_orderkey end as fk      -- 10% exact duplicate pairs
  from {orders}),
f as (select k, fk, translate(concat(md5(concat('p:', cast(k as string))), md5(concat('q:', cast(k as string))), md5(concat('r:', cast(k as string))), md5(concat('s:', cast(k as string)))),'0123456789abcdef','#05:?ACEFFGGHHII') as q,
         case when fk % 17 = 0 then substr(concat(repeat('A',60), concat(translate(md5(concat('a:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('b:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('c:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('d:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('e:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('f:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('g:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('h:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'))), 1, 80)           -- low complexity
              else substr(concat(translate(md5(concat('a:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('b:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('c:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('d:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('e:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('f:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('g:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT'), translate(md5(concat('h:', cast(fk as string))),'0123456789abcdef','ACGTACGTACGTACGT')), 1, cast(40 + (fk * 37) % 200 as int)) end as fr           -- insert size 40..239
  from b),
g as (select k, fk, q, fr,
         case when fk % 13 = 0 then concat(fr, repeat('A',100))                           -- polyA tail
              else concat(fr, 'AGATCGGAAGAGCACACGTCTGAACTCCAGTCA', repeat('G',100)) end as t1,
         concat(reverse(translate(fr,'ACGT','TGCA')), 'AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT', repeat('G',100)) as t2
  from f),
h as (select k, fk, q, fr, substr(t2,1,100) as s2,
         case when fk % 11 = 0 then concat('NNNNNNNN', substr(t1,9,92))                   -- too many N
              when fk % 7 = 0  then concat(substr(t1,1,19), translate(substr(t1,20,1),'ACGT','CGTA'), substr(t1,21,80)) -- 1 mismatch
              else substr(t1,1,100) end as s1
  from g)
select k as pair_id,
  concat('@NS500:1:FC:1:', cast(k as string), ':1:1 1:N:0:', substr(fr,1,8), '+', substr(fr,9,8)) as name1,
  concat('@NS500:1:FC:1:', cast(k as string), ':1:1 2:N:0:', substr(fr,1,8), '+', substr(fr,9,8)) as name2,
  s1 as seq1,
  case when fk % 5 = 0 then concat(substr(q,1,50), repeat('#',50))                        -- low-quality tail
       when fk % 7 = 0 then concat(substr(q,1,19), '#', substr(q,21,80)) else substr(q,1,100) end as qual1,
  s2 as seq2, reverse(substr(q,20,100)) as qual2
from h
"""


#: Bytes of a row group before packing: some 50,000 pairs, so that a file can be read by several tasks.
ROW_GROUP = 32 << 20
#: The tables of reads written so far, by application, input and the bound of pair_id (None: all).
_written: dict[tuple[str, str, int | None], str] = {}


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, name1, name2, seq1, qual1, seq2, qual2.

    The derivation stands for a sequencer: it is done once for an application and input and written to the shared
    folder, so that queries scan reads as they would scan a file of them.
    """
    return spark.read.parquet(pairs_folder(spark, sf_dir)[1])


def derived(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """The pairs, of keys that are spread over the cores before anything is made of them: a key has 8 bytes, a pair some 500."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(READS, orders=spread(keys if below is None else keys.where(F.col("o_orderkey") < below)))


def pairs_folder(spark: SparkSession, sf_dir: str, below: int | None = None) -> tuple[SparkSession, str]:
    """The session and the folder that the pairs were written to, packed with zstd (190 bytes a pair), in groups that tasks read by themselves."""
    key = (spark.sparkContext.applicationId, sf_dir, below)
    if key not in _written:
        path = shared_dir(spark)
        derived(spark, sf_dir, below).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
        _written[key] = path
    return spark, _written[key]


def single(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """read_id, name, seq, qual: the first mates."""
    d = spark.read.parquet(pairs_folder(spark, sf_dir, below)[1])
    return d.select(F.col("pair_id").alias("read_id"), F.col("name1").alias("name"), F.col("seq1").alias("seq"), F.col("qual1").alias("qual"))


def first_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As single(), of the reads that detection looks at: those below detect.ADAPTER_SAMPLE, which are all that its queries ask for."""
    return single(spark, sf_dir, ADAPTER_SAMPLE)


def oracle(query: str) -> str:
    """DuckDB SQL over `reads`, the same pairs."""
    return f"WITH reads AS ({READS.replace('{orders}', 'orders')}) {query}"
