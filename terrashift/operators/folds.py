"""Spatial fold assignment: exact block quotas, balanced rare classes and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.config import FoldSpec
from terrashift.functions import expressions as E
from terrashift.operators.ordered import global_rank
from terrashift.session import materialise

#: Partners that a block is rated with in one round: ``_DRAWS`` shuffles of the blocks, the next ``_NEXT`` in each.
_DRAWS = 4
_NEXT = 16
_BUCKET = 256
#: Swaps of a round that are considered for each pair of folds.
_PER_PAIR = 64


def size_class(blocks: DataFrame, spec: FoldSpec) -> Column:
    """How much of the per-fold targets a block takes, relative to the average block, in whole steps."""
    sums = blocks.agg(
        F.struct(F.count(F.lit(1)).alias("b"), *[F.sum(c).alias(c) for c, _ in spec.weights]).alias("t")
    ).scalar()
    share = None
    for c, w in spec.weights:
        part = F.col(c).cast("double") * F.lit(w) / (sums[c].cast("double") / F.lit(float(spec.k)))
        part = F.coalesce(F.when(sums[c] > 0, part), F.lit(0.0))
        share = part if share is None else share + part
    return F.floor(share * sums["b"].cast("double") * F.lit(20.0)).cast("bigint")


def snake_folds(blocks: DataFrame, spec: FoldSpec = FoldSpec(), method: str = "xxhash") -> DataFrame:
    """Deal blocks from large to small in alternating direction.

    Every fold gets floor(B/k) blocks and the first B mod k folds one more. Equal blocks are ordered by key hash.
    """
    ranked = global_rank(
        blocks.withColumn("size_class", size_class(blocks, spec)), [], "size_class", ["block_id"], spec.seed,
        descending=True, method=method,
    )
    k = F.lit(spec.k)
    forward = (F.floor(F.col("pos") / k) % 2 == 0) | (F.col("pos") >= F.col("tot_n") - F.col("tot_n") % k)
    fold = F.when(forward, F.col("pos") % k).otherwise(k - 1 - F.col("pos") % k).cast("int")
    return ranked.select(*blocks.columns, fold.alias("fold"))


def _term(total: Column | float, target: float):
    d = (total - target) / target
    return d * d


def imbalance(totals: dict[int, dict[str, float]], spec: FoldSpec) -> float:
    out = 0.0
    for c, w in spec.weights:
        target = sum(t[c] for t in totals.values()) / spec.k
        if target:
            out += w * sum(_term(t[c], target) for t in totals.values())
    return out


def balanced_folds(blocks: DataFrame, spec: FoldSpec = FoldSpec(), method: str = "xxhash") -> DataFrame:
    """Snake draft followed by swaps between folds, which keep the quotas.

    Each round rates every block with 64 partners on the executors (through shuffled buckets of fixed size) against the k
    fold totals. The best swaps of each pair of folds reach the driver, which applies those that still lower the
    imbalance. So a round moves at most ``_PER_PAIR`` swaps for each
    pair of folds and the list of moved blocks is bounded by rounds and folds, whatever the number of blocks. The search
    ends once every total is within ``spec.enough_pct`` of its target, after ``spec.patience`` rounds in a row without a
    gain, each with other partners, or after ``spec.max_rounds``.
    """
    cols = [c for c, _ in spec.weights]
    base = materialise(snake_folds(blocks, spec, method), "draft")
    spark = base.sparkSession
    rows = base.groupBy("fold").agg(F.count(F.lit(1)).alias("_b"), *[F.sum(c).alias(c) for c in cols]).collect()
    totals = {r["fold"]: {c: float(r[c] or 0) for c in cols} for r in rows}
    n_blocks = sum(r["_b"] for r in rows)
    targets = {c: sum(t[c] for t in totals.values()) / spec.k for c in cols}
    used = [(c, w) for c, w in spec.weights if targets[c] > 0]
    moved: dict[str, int] = {}
    fruitless = 0

    def patched() -> DataFrame:
        if not moved:
            return base
        # At most two blocks for each swap: the bound is in the docstring.
        patch = spark.createDataFrame(list(moved.items()), "block_id string, _new int")
        return base.join(F.broadcast(patch), "block_id", "left").withColumn("fold", F.coalesce("_new", "fold")).drop("_new")

    for r in range(spec.max_rounds):
        if all(abs(t[c] / targets[c] - 1) * 100 <= spec.enough_pct for t in totals.values() for c, _ in used):
            break
        lookup = {
            c: F.create_map(*[x for f, t in totals.items() for x in (F.lit(f), F.lit(t[c]))]) for c, _ in used
        }
        buckets = max(1, n_blocks // _BUCKET)
        me = F.struct("block_id", "fold", *cols)
        drawn = (
            patched()
            .withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1))))
            .withColumn("_u", E.uniform([F.col("block_id"), F.col("_s")], spec.seed + 1 + r, method))
            .withColumn("_h", F.floor(F.col("_u") * buckets))
        )
        w = Window.partitionBy("_s", "_h").orderBy("_u", "block_id")
        ahead = F.array(*[F.lead(me, i).over(w) for i in range(1, _NEXT + 1)])
        pairs = drawn.select(me.alias("a"), ahead.alias("bs")).select("a", F.explode("bs").alias("b")).where("b is not null and a.fold <> b.fold")
        gain = F.lit(0.0)
        for c, wt in used:
            ta, tb = lookup[c][F.col("a.fold")], lookup[c][F.col("b.fold")]
            d = F.col(f"a.{c}") - F.col(f"b.{c}")
            gain = gain + F.lit(wt) * (
                _term(ta - d, targets[c]) + _term(tb + d, targets[c]) - _term(ta, targets[c]) - _term(tb, targets[c])
            )
        rated = pairs.withColumn("gain", gain).where("gain < -1e-12")
        # Ranks are cut off before the shuffle, so a task hands on a few swaps for each pair of folds.
        sides = F.array_sort(F.array("a.fold", "b.fold"))
        place = F.row_number().over(Window.partitionBy("sides").orderBy("gain", "a.block_id", "b.block_id"))
        best = rated.withColumn("sides", sides).withColumn("_at", place).where(F.col("_at") <= _PER_PAIR).select("gain", "a", "b").collect()
        best.sort(key=lambda p: (p["gain"], p["a"]["block_id"], p["b"]["block_id"]))
        touched: set[str] = set()
        for p in best:
            a, b = p["a"], p["b"]
            if a["block_id"] in touched or b["block_id"] in touched:
                continue
            before = imbalance(totals, spec)
            for c in cols:
                totals[a["fold"]][c] += b[c] - a[c]
                totals[b["fold"]][c] += a[c] - b[c]
            if imbalance(totals, spec) < before - 1e-12:
                moved[a["block_id"]], moved[b["block_id"]] = b["fold"], a["fold"]
                touched |= {a["block_id"], b["block_id"]}
            else:
                for c in cols:
                    totals[a["fold"]][c] += a[c] - b[c]
                    totals[b["fold"]][c] += b[c] - a[c]
        fruitless = 0 if touched else fruitless + 1
        if fruitless >= spec.patience:
            break
    return patched()


def accept(summary: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Verdict on a fold summary: worst deviation per balanced column, quota spread and acceptance."""
    worst = {c: F.max(F.abs(f"{c}_pct_dev")) for c in ("rows", "n1", "n2")}
    agg = summary.agg(
        *[e.alias(f"worst_{c}") for c, e in worst.items()], (F.max("blocks") - F.min("blocks")).alias("quota_spread")
    )
    ok = F.greatest(*[F.coalesce(F.col(f"worst_{c}"), F.lit(0.0)) for c in worst]) < tolerance_pct
    return agg.withColumn("accepted", ok & (F.col("quota_spread") <= 1))


def with_fold(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """Attach folds to samples.

    Left without a hint: the fold table is broadcast while its size allows, and beyond that a sort-merge join with
    skew handling splits a hot block.
    """
    return samples.join(folds.select("block_id", "fold"), "block_id")
