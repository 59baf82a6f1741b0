"""Weighted isotonic regression by distributed pool-adjacent-violators.

Equal scores are merged first. Ranges of ordered scores are pooled by themselves, which leaves rising blocks: the lower hull
of the range's cumulative sums. Neighbouring ranges are then pooled in pairs, pairs of pairs, and so on. Before each of
these rounds blocks that can no longer change are set aside: a block whose mean lies above all means to its left and below
all to its right stays as it is, and nothing is ever pooled across it. So what moves on are the blocks that still compete,
and where scores are well ordered, none do. The driver sees two numbers per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.session import materialise

_BLOCK = "g int, lo double, hi double, w double, s double"


def pooled(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pool neighbours while a mean is not above the one before it; ``s`` are weighted sums, in ascending order of ``lo``."""
    out: list[list[float]] = []
    for a, b, c, d in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist()):
        out.append([a, b, c, d])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, b, c, d = out.pop()
            out[-1][1] = b
            out[-1][2] += c
            out[-1][3] += d
    return tuple(np.array(out, float).reshape(-1, 4).T)


def _pool_group(frame: pd.DataFrame) -> pd.DataFrame:
    f = frame.sort_values("lo")
    lo, hi, w, s = pooled(*(f[c].to_numpy() for c in ("lo", "hi", "w", "s")))
    return pd.DataFrame({"g": int(f["g"].iloc[0]), "lo": lo, "hi": hi, "w": w, "s": s})


def _settled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that stay as they are, and the rest."""
    mean = F.col("s") / F.col("w")
    ends = {r["g"]: (r["low"], r["high"]) for r in blocks.groupBy("g").agg(F.min(mean).alias("low"), F.max(mean).alias("high")).collect()}
    above, below, high, low = {}, {}, -np.inf, np.inf
    for g in sorted(ends):
        above[g], high = high, max(high, ends[g][1])
    for g in sorted(ends, reverse=True):
        below[g], low = low, min(low, ends[g][0])
    # One row for each range of scores.
    limits = blocks.sparkSession.createDataFrame([(g, float(above[g]), float(below[g])) for g in ends], "g int, above double, below double")
    known = blocks.join(F.broadcast(limits), "g").withColumn("_stays", (mean > F.col("above")) & (mean < F.col("below")))
    columns = ["g", "lo", "hi", "w", "s"]
    return known.where("_stays").select(*columns), known.where("not _stays").select(*columns)


def fit_isotonic_blocks(scored: DataFrame, score: str, label: Column, weight: Column, rows_per_task: int = 500_000) -> DataFrame:
    """(lo, hi, value): the steps of the weighted monotone fit of ``label`` on ``score``; one row per step.

    ``lo`` and ``hi`` are the smallest and largest score of a step. Rows without a score or a label, and those without
    positive weight, take no part. ``rows_per_task`` bounds the distinct scores that a task of the first round pools.
    """
    part = scored.where(F.col(score).isNotNull() & label.isNotNull() & (weight > 0))
    tied = part.groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(weight).alias("w"), F.sum(weight * label).alias("s"))
    tied = materialise(tied, "tied")
    tasks = max(1, -(-tied.count() // rows_per_task))
    # The range's number, written with the rows, is fixed from here on.
    ranged = tied.repartitionByRange(tasks, "lo").sortWithinPartitions("lo")

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        whole = [f for f in frames if len(f)]
        if whole:
            f = pd.concat(whole)
            lo, hi, w, s = pooled(f["lo"].to_numpy(), f["lo"].to_numpy(), f["w"].to_numpy(), f["s"].to_numpy())
            yield pd.DataFrame({"g": TaskContext.get().partitionId(), "lo": lo, "hi": hi, "w": w, "s": s})

    blocks = materialise(ranged.mapInPandas(first, _BLOCK), "blocks")
    done = []
    while tasks > 1:
        if blocks.isEmpty():
            break
        fixed, rest = _settled(blocks)
        done.append(materialise(fixed, "settled"))
        again = rest.withColumn("g", F.shiftright("g", 1))
        blocks = materialise(again.groupBy("g").applyInPandas(_pool_group, _BLOCK), "blocks")
        tasks = -(-tasks // 2)
    for d in done:
        blocks = blocks.unionByName(d)
    return blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"))


#: Cells of the score axis by which scores meet steps.
CELLS = 1 << 14


def _cell(x: Column, low: Column, high: Column) -> Column:
    return F.floor((x - low) / F.greatest(high - low, F.lit(1e-300)) * F.lit(CELLS)).cast("int")


def _pieces(blocks: DataFrame, low: Column, high: Column) -> DataFrame:
    """The fitted line in half-open pieces: flat over each step, straight between steps, each in the cells it touches."""
    placed = blocks.withColumn("c", _cell(F.col("lo"), low, high))
    within = Window.partitionBy("c").orderBy("lo")
    # The first step of every cell follows the last one of the cell before: a row for each cell, CELLS at most.
    heads = placed.groupBy("c").agg(F.min(F.struct("lo", "value")).alias("h"))
    heads = heads.select(F.lag("c").over(Window.orderBy("c")).alias("c"), "h")
    full = placed.withColumn("n", F.lead(F.struct("lo", "value")).over(within)).join(heads, "c", "left")
    full = full.withColumn("n", F.coalesce("n", "h"))
    flat = F.struct(F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.col("value").alias("y0"), F.col("value").alias("y1"))
    on = F.struct(
        F.col("hi").alias("x0"), F.coalesce("n.lo", F.lit(float("inf"))).alias("x1"), F.col("value").alias("y0"), F.coalesce("n.value", "value").alias("y1")
    )
    pieces = full.select(F.explode(F.array(flat, on)).alias("p")).select("p.*").where("x0 < x1")
    return pieces.withColumn("_c", F.explode(F.sequence(_cell(F.col("x0"), low, high), _cell(F.least(F.col("x1"), high), low, high))))


def apply_isotonic_blocks(blocks: DataFrame, df: DataFrame, score: str = "y_score", name: str = "p_isotonic") -> DataFrame:
    """Add the calibrated value: that of the step, or on the line between two steps; beyond the ends that of the end.

    Rows meet the pieces of the line in cells of the score axis; exactly one piece holds a score. Null and NaN scores, and
    all scores where no step was fitted, get null.
    """
    blocks = materialise(blocks, "steps")
    low, high = blocks.agg(F.min("lo")).scalar(), blocks.agg(F.max("hi")).scalar()
    at = F.col(score).cast("double")
    x = F.when(at.isNotNull() & ~F.isnan(at), F.greatest(low, F.least(high, at)))
    placed = df.withColumn("_x", x).withColumn("_cell", _cell(F.col("_x"), low, high))
    pieces = _pieces(blocks, low, high)
    met = placed.join(pieces, (F.col("_cell") == F.col("_c")) & (F.col("_x") >= F.col("x0")) & (F.col("_x") < F.col("x1")), "left")
    y = F.when(F.col("x1") == float("inf"), F.col("y0")).otherwise(
        F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("_x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    )
    return met.withColumn(name, F.when(y.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), y)))).drop("_x", "_cell", "_c", "x0", "x1", "y0", "y1")
