"""Helpers shared by the document operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.session import materialise

#: Hand a narrow stage result over through the cluster's shared folder; a lost executor then costs a re-read only.
cut = materialise

#: Bits of a membership sieve: 256 rows of 4 KB, so 1 MB is broadcast whatever the data look like.
SIEVE_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the key and the text (null counts as empty); other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)).cast("bigint")


def sieve(members: DataFrame, key: Column) -> DataFrame:
    """Bit set of hashed keys: at most ``SIEVE_BITS / 32768`` rows of 4 KB, built with map-side combine."""
    slot = members.select(_slot(key).alias("_slot"))
    return slot.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )


def with_sieve(df: DataFrame, key: Column, bits: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: false where the key is surely not among the members. The broadcast side has a fixed size."""
    slot = _slot(key)
    probe = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).withColumn("_pos", F.bitmap_bit_position(slot))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_pos div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.expr("_pos % 8").cast("int")
    return (
        probe.join(F.broadcast(bits), "_bucket", "left")
        .withColumn(flag, F.coalesce(F.getbit(byte, hit) == 1, F.lit(False)))
        .drop("_bucket", "_pos", "_bits")
    )


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)
