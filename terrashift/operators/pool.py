"""Distance-weighted training pool and key-hashed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import PoolSpec
from terrashift.functions import expressions as E
from terrashift.operators import summaries as S
from terrashift.operators.ordered import global_rank


def fold_calibration(samples: DataFrame, dist: str, spec: PoolSpec, rows_per_fold: int) -> DataFrame:
    """Decay constant of every fold in closed form, with the three conditions under which it is valid (k rows)."""
    lab = F.col("label")
    agg = samples.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(lab == 1).alias("n1"),
        F.count_if(lab == 2).alias("n2"),
        F.count_if(lab == 0).alias("n0"),
        F.avg(F.when(lab == 0, F.exp(-F.col(dist) / F.lit(spec.tau_m)))).alias("mean_decay"),
    )
    budget = F.lit(rows_per_fold) - spec.dup * F.col("n1") - F.col("n2")
    a = E.ratio(E.ratio(F.col("budget0"), F.col("n0")) - spec.floor, F.col("mean_decay"))
    p_max = spec.floor + F.col("a") * F.exp(F.lit(-30.0 / spec.tau_m))
    return (
        agg.withColumn("budget0", budget.cast("bigint"))
        .withColumn("a", a)
        .withColumn("p_max", p_max)
        .withColumn(
            "verdict",
            F.when(F.col("budget0") <= 0, "rare classes exceed the budget")
            .when(~(F.col("a") > 0), "floor exceeds the budget")
            .when(~(F.col("p_max") < 1), "keep rate saturates")
            .otherwise("ok"),
        )
    )


def natural_multiplier(calibration: DataFrame) -> DataFrame:
    """Negatives per positive before any sampling; label 2 counts as negative (one row)."""
    return calibration.agg(E.ratio(F.sum("n0") + F.sum("n2"), F.sum("n1")).alias("pos_weight_mult"))


def draw(
    samples: DataFrame, calibration: DataFrame, dist: str, spec: PoolSpec, mult: Column | float | None = None,
    keys: tuple[str, ...] = ("row", "col"),
) -> DataFrame:
    """Poisson draw with inverse-probability weights.

    A map-only pass over the samples: the k calibration rows are broadcast, the draw hangs on the pixel key, and
    duplicates come from exploding a positive in place instead of a second scan.
    """
    mult = spec.pos_weight_mult if mult is None else mult
    if mult is None:
        mult = natural_multiplier(calibration).scalar()
    mult = mult if isinstance(mult, Column) else F.lit(float(mult))
    c = F.broadcast(calibration.select("fold", F.col("a").alias("_a")))
    p = E.inclusion_probability(F.col("label"), F.col(dist), F.col("_a"), spec.tau_m, spec.floor)
    cast = "string" if spec.hash_method == "md5" else "bigint"
    u = E.uniform([F.col(k).cast(cast) for k in keys], spec.seed, spec.hash_method)
    kept = samples.join(c, "fold").withColumn("p_include", p).where(u < F.col("p_include"))
    copies = F.when(F.col("label") == 1, F.lit(spec.dup)).otherwise(F.lit(1))
    return (
        kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .withColumn("sample_weight", F.when(F.col("label") == 1, mult / F.lit(spec.dup)).otherwise(1.0 / F.col("p_include")))
        .withColumn("label_bin", (F.col("label") == 1).cast("int"))
        .withColumn("is_dup", F.col("_copy") > 1)
        .drop("_a", "_copy")
    )


def positive_weight_errors(pool: DataFrame, expected: Column) -> DataFrame:
    pos = F.col("label") == 1
    return pool.agg(
        F.count_if(pos).alias("positives"),
        F.count_if(pos & (F.abs(F.col("sample_weight") - expected) > 1e-9)).alias("wrong_weight"),
    )


def misplaced_blocks(pool: DataFrame, folds: DataFrame) -> DataFrame:
    """(block, fold) pairs of a pool that the fold table does not have; must be empty."""
    return pool.select("block_id", "fold").distinct().join(folds.select("block_id", "fold"), ["block_id", "fold"], "left_anti")


def fold_sample(df: DataFrame, n: int, seed: int, method: str = "xxhash", keys=("row", "col")) -> DataFrame:
    """About ``n`` rows of every fold by key hash at rate min(1, n / N); the k rates are broadcast."""
    rate = df.groupBy("fold").agg(F.least(F.lit(1.0), F.lit(float(n)) / F.count(F.lit(1))).alias("_rate"))
    cast = "string" if method == "md5" else "bigint"
    u = E.uniform([F.col(k).cast(cast) for k in keys], seed, method)
    return df.join(F.broadcast(rate), "fold").where(u < F.col("_rate")).drop("_rate")


def mean_normalised(df: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """Weight divided by the mean of its fold or another key."""
    mean = df.groupBy(*keys).agg(F.avg(weight).alias("_mean"))
    # No hint: the planner broadcasts the means while they are small and otherwise shuffles, splitting hot keys.
    return df.join(mean, keys).withColumn("weight_norm", E.ratio(F.col(weight), F.col("_mean"))).drop("_mean")


def subsample_runs(df: DataFrame, key: str, runs: int, frac: float, seed: int, method: str = "xxhash") -> DataFrame:
    """``runs`` independent subsamples of exactly floor(frac * n) keys without replacement."""
    rep = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("_one", F.lit(1))
    ranked = global_rank(rep, ["run"], "_one", [key, "run"], seed, method=method)
    return ranked.where(F.col("pos") < F.floor(F.lit(frac) * F.col("tot_n"))).drop("_one", "pos", "tot_n")


def stratum(label_bin: Column, dist_z: Column, near_z: float = -1.0) -> Column:
    """Positives, negatives near development, other negatives."""
    return F.when(label_bin == 1, "positive").when(dist_z <= near_z, "near").otherwise("other")


def stratified_batches(
    df: DataFrame, keys: list[str], n_batches: int, batch_size: int, fractions: dict[str, float], rest: str, seed: int,
    method: str = "xxhash",
) -> DataFrame:
    """Batches with a fixed number of rows per stratum, drawn with replacement: (batch, slot, stratum, keys...).

    All strata are drawn with replacement, also the large one: a batch of some thousand rows from millions repeats a row
    of it rarely, and every slot stays independent of all others, so batches can be drawn in any order.
    The stratum sizes, one row per stratum, are broadcast; rows of a stratum get a hash position, every slot draws a position: deterministic and without a driver loop.
    """
    sizes = {s: max(1, int(batch_size * f)) for s, f in fractions.items()}
    sizes[rest] = batch_size - sum(sizes.values())
    ranked = global_rank(df.select("stratum", *keys).withColumn("_one", F.lit(1)), ["stratum"], "_one", keys, seed, method=method)
    counts = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    which, start = F.lit(rest), 0
    for s, size in sizes.items():
        which = F.when(F.col("slot").between(start, start + size - 1), F.lit(s)).otherwise(which)
        start += size
    spark = df.sparkSession
    slots = (
        spark.range(n_batches * batch_size)
        .select(F.floor(F.col("id") / F.lit(float(batch_size))).cast("int").alias("batch"), (F.col("id") % batch_size).cast("int").alias("slot"))
        .withColumn("stratum", which)
        .join(F.broadcast(counts), "stratum")
    )
    cast = "string" if method == "md5" else "bigint"
    u = E.uniform([F.col("batch").cast(cast), F.col("slot").cast(cast)], seed + 1, method)
    picked = slots.withColumn("pos", F.floor(u * F.col("_n")).cast("bigint"))
    return picked.join(ranked.select("stratum", *keys, "pos"), ["stratum", "pos"]).select("batch", "slot", "stratum", *keys)


def dataset_report(samples: DataFrame, pool: DataFrame, folds: DataFrame) -> DataFrame:
    """Natural counts, pool composition and block counts side by side, one row per fold."""
    blocks = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("blocks"))
    return S.natural_composition(samples).join(S.pool_composition(pool, ["fold"]), "fold").join(blocks, "fold")


def distance_report(samples: DataFrame, pool: DataFrame, dist: str) -> DataFrame:
    """Distance quantiles of the natural and the drawn sets, stacked with a tag."""
    parts = [
        (samples, 0, "natural_label0"),
        (pool, 0, "pool_label0"),
        (samples, 1, "natural_label1"),
        (samples, 2, "natural_label2"),
    ]
    out = None
    for df, label, tag in parts:
        q = S.distance_quantiles(df.where(F.col("label") == label), dist, ["fold"], tag)
        out = q if out is None else out.unionByName(q)
    return out
