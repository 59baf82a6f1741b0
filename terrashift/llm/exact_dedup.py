"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each level only decides which documents go on: a document whose length (then length and prefix) nobody shares is
settled. What goes from one level to the next is a bit set of fixed size, so texts are never shuffled; false hits of
the bit set only let a few more documents reach the next level. The last level hashes the whole text of the survivors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import id_and_text, sieve, with_sieve

PREFIX_CHARS = 128


def _shared(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that at least two rows have; counted with map-side combine, so a hot key is one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept (and text_sha256 with ``digest``).

    Texts are equal when identical; the row with the largest id of a group stays. Null text counts as empty, and all
    empty texts are one group. Rows that repeat an id and text count one by one and share its decision. A null id loses
    to any other id; a group of null ids only has keep_id null and is kept. An empty table gives an empty result.
    """
    base = id_and_text(docs, id_col, text_col)
    length = F.octet_length("text")
    by_length = sieve(_shared(base.select(length.alias("l")), "l"), F.struct("l"))
    first = with_sieve(base.withColumn("l", length), F.struct("l"), by_length, "_same_length")
    prefixed = first.withColumn("p", F.when(F.col("_same_length"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS))))
    by_prefix = sieve(_shared(prefixed.where("p is not null").select("l", "p"), "l", "p"), F.struct("l", "p"))
    second = with_sieve(prefixed, F.struct("l", "p"), by_prefix, "_same_prefix")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    survives = F.col("_same_length") & F.col("_same_prefix")
    marked = second.select(
        "doc_id", F.when(survives, sha).alias("_full"), *([sha.alias("text_sha256")] if digest else [])
    )
    groups = (
        marked.where("_full is not null")
        .groupBy("_full")
        .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .withColumnRenamed("_full", "_key")
    )
    # Settled rows get a key of their own, so that they don't meet in the partition of null.
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string"))
    joined = marked.withColumn("_key", F.coalesce("_full", alone)).join(groups, "_key", "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        *(["text_sha256"] if digest else []),
    )
