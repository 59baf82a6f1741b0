"""Distributed LSD radix sort: stable counting-sort passes, with destinations from global prefix offsets.

Rows have places 0, 1, 2, ... in a global sequence that is cut into chunks. A pass counts the rows of every (digit, chunk),
adds the counts up digit by digit and, within a digit, chunk by chunk, and sends each row to its digit's offset plus its
stable place among the chunk's rows of that digit. After a pass over each digit, from the least significant one on, a row's
place is its final rank. A pass moves every row once; no group is larger than a chunk, however often a key repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut

DIGIT_BITS = 8
CHUNK_BITS = 14
_SIGN = -(1 << 63)


def _unsigned(key: Column, descending: bool) -> Column:
    """A bigint whose bits, read as an unsigned number, rise in the order wanted."""
    up = key.cast("bigint").bitwiseXOR(F.lit(_SIGN))
    return F.bitwise_not(up) if descending else up


def _digit(key: str, d: int) -> Column:
    return F.shiftrightunsigned(F.col(key), DIGIT_BITS * d).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")


def _before(order) -> Column:
    """Sum of the counts before a row."""
    return F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    keyed = rows.withColumn("_digit", digit).withColumn("_chunk", F.shiftright("_place", CHUNK_BITS))
    counts = cut(keyed.groupBy("_digit", "_chunk").agg(F.count(F.lit(1)).alias("_n")), "radix-counts")
    # One row for each value of a digit, 256 at most, and one for each chunk that has it.
    digits = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select("_digit", _before(Window.orderBy("_digit")).alias("_base"))
    chunks = counts.select("_digit", "_chunk", _before(Window.partitionBy("_digit").orderBy("_chunk")).alias("_from"))
    offsets = chunks.join(F.broadcast(digits), "_digit").select("_digit", "_chunk", (F.col("_base") + F.col("_from")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_digit", "_chunk").orderBy("_place")) - 1
    moved = keyed.withColumn("_local", local).join(offsets, ["_digit", "_chunk"])
    kept = [c for c in rows.columns if c != "_place"]
    return cut(moved.select(*kept, (F.col("_offset") + F.col("_local")).alias("_place")), "radix-pass")


def radix_ranks(df: DataFrame, keys: list[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """``df`` with its rows' ranks 1, 2, 3, ... by ``keys``: (bigint column, descending) pairs, the most significant first.

    Keys are not null. Rows with equal keys get consecutive ranks in the order in which they lie in the table. Digits in
    which all keys agree need no pass: two bitwise aggregates find them. An empty table gives an empty result.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[_unsigned(F.col(c), down).alias(n) for n, (c, down) in zip(names, keys)])
    # Places before the first pass need only be distinct; written once, they survive a lost executor.
    rows = cut(keyed.withColumn("_place", F.monotonically_increasing_id()), "radix-start")
    seen = rows.agg(*[f(n).alias(f"{n}{k}") for n in names for k, f in (("o", F.bit_or), ("a", F.bit_and))]).first()
    passes = []
    for n in reversed(names):
        differ = ((seen[f"{n}o"] or 0) ^ (seen[f"{n}a"] or 0)) & ((1 << 64) - 1)
        passes += [(n, d) for d in range(64 // DIGIT_BITS) if differ >> (DIGIT_BITS * d) & ((1 << DIGIT_BITS) - 1)]
    # One pass at least, since it turns distinct places into consecutive ones.
    for n, d in passes or [(names[-1], 0)]:
        rows = _pass(rows, _digit(n, d))
    return rows.select(*df.columns, (F.col("_place") + 1).alias(rank))
