"""Order statistics that never put a whole group into one task.

Running totals use three levels: rows fall into order-preserving coarse and fine buckets, bucket totals are prefix-summed
level by level, and the running sum inside a fine bucket is a window over that bucket only. Rows with equal values are
collapsed to counts first, with map-side combine, so a value that holds a third of all rows is one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.functions.expressions import uniform

_STEPS = 256
_FINE = 16
_SHIFT = 300_000


def magnitude_bucket(v: Column) -> Column:
    """Monotone bucket of a number: 256 coarse steps per octave, each cut into 65,536 fine ones.

    A fine bucket holds numbers within four parts in 10**8 of each other, at most one 32-bit float. NaN has the last
    bucket of all and the infinities have end buckets of their own, in Spark's order of doubles.
    """
    v = v.cast("double")
    far = F.lit(float("inf"))
    size = F.when((v == 0) | F.isnan(v) | (F.abs(v) == far), F.lit(1.0)).otherwise(F.abs(v))
    m = F.floor((F.log2(size) * F.lit(_STEPS) + F.lit(_SHIFT)) * F.lit(1 << _FINE)).cast("bigint")
    end = F.lit((4 * _SHIFT) << _FINE).cast("bigint")
    return (
        F.when(F.isnan(v), end + 1).when(v == far, end).when(v == -far, -end).when(v > 0, m).when(v < 0, -m)
        .otherwise(F.lit(0).cast("bigint"))
    )


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[Column],
    sums: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<name>`` (inclusive running sum in order) and ``tot_<name>`` (group total) for each of ``sums``.

    ``bucket`` must be monotone in ``order``; ``descending`` says which way the buckets run. Keys must not be null. Its
    upper bits are a coarse bucket: totals are prefix-summed over the coarse buckets, over the fine buckets within a coarse
    one, and over the rows of a fine one, so no window holds a whole group.
    """
    # A bucket that cannot be null needs no null filter, so both branches share one shuffle of the input.
    d = df.withColumn("_b", F.coalesce(bucket, F.lit(0).cast("bigint")))
    names = list(sums)
    fine = d.groupBy(*keys, "_b").agg(*[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()])
    fine = fine.withColumn("_g", F.shiftright("_b", _FINE))
    coarse = fine.groupBy(*keys, "_g").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in names])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))

    def along(w, c: str):
        return w.orderBy(F.desc(c) if descending else F.asc(c)).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    starts = coarse.select(
        *keys, "_g",
        *[(F.sum(f"_s_{n}").over(along(group, "_g")) - F.col(f"_s_{n}")).alias(f"_p_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(group).alias(f"tot_{n}") for n in names],
    )
    within = Window.partitionBy(*keys, "_g")
    steps = fine.select(
        *keys, "_g", "_b", *[(F.sum(f"_s_{n}").over(along(within, "_b")) - F.col(f"_s_{n}")).alias(f"_q_{n}") for n in names]
    )
    offsets = steps.join(starts, [*keys, "_g"]).select(
        *keys, "_b", *[(F.col(f"_p_{n}") + F.col(f"_q_{n}")).alias(f"_o_{n}") for n in names], *[f"tot_{n}" for n in names]
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.select("*", *[F.sum(e).over(inside).alias(f"_c_{n}") for n, e in sums.items()])
    joined = local.join(offsets, [*keys, "_b"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_c_{n}")).alias(f"cum_{n}") for n in names],
        *[F.col(f"tot_{n}") for n in names],
    )


def quantiles(df: DataFrame, keys: list[str], value: str, probs) -> DataFrame:
    """Exact linear-interpolated quantiles, one row (keys, knot, p, q) per group and probability; nulls ignored."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    run = running_totals(counted, keys, magnitude_bucket(F.col("_v")), [F.asc("_v")], {"n": F.col("_n")})
    last = F.col("tot_n") - 1
    first, end = F.col("cum_n") - F.col("_n"), F.col("cum_n")

    def covers(rank: Column) -> Column:
        return (rank >= first) & (rank < end)

    long = _candidate_knots(run, list(probs), first, end, last)
    rank = F.col("p") * last
    return (
        long.select(
            *keys, "knot", "p",
            F.when(covers(F.floor(rank)), F.col("_v")).alias("_lo"),
            F.when(covers(F.ceil(rank)), F.col("_v")).alias("_hi"),
            (rank - F.floor(rank)).alias("_f"),
        )
        .where("_lo is not null or _hi is not null")
        .groupBy(*keys, "knot", "p")
        .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_f").alias("_f"))
        .select(*keys, "knot", "p", _between(F.col("_lo"), F.col("_hi"), F.col("_f")).alias("q"))
    )


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """Linear interpolation; equal ends (also infinite ones) and whole ranks give the end itself."""
    return F.when((share == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * share)


def _candidate_knots(run: DataFrame, probs: list, first: Column, end: Column, last: Column) -> DataFrame:
    """Rows repeated for the probabilities whose rank may fall on them.

    Evenly spaced probabilities are found by arithmetic, so almost all rows drop out in generated code.
    """
    table = F.array(*[F.lit(float(p)) for p in probs])
    m = len(probs)
    step = (probs[-1] - probs[0]) / (m - 1) if m > 1 else 1.0
    even = m > 1 and all(abs(probs[0] + i * step - p) < 1e-9 for i, p in enumerate(probs))
    if even:
        def at(rank: Column) -> Column:
            share = F.coalesce(F.try_divide(rank.cast("double"), last.cast("double")), F.lit(0.0))
            return (share - F.lit(float(probs[0]))) / F.lit(step)

        lo = F.greatest(F.lit(0), F.ceil(at(first - 1) - 1e-6).cast("int"))
        hi = F.least(F.lit(m - 1), F.floor(at(end) + 1e-6).cast("int"))
        single = last == 0
        spread = run.withColumn("_a", F.when(single, 0).otherwise(lo)).withColumn("_z", F.when(single, m - 1).otherwise(hi))
        spread = spread.where("_a <= _z").withColumn("knot", F.explode(F.sequence("_a", "_z")))
    else:
        spread = run.withColumn("knot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return spread.withColumn("p", F.element_at(table, F.col("knot") + 1))


def quantile_columns(df: DataFrame, keys: list[str], value: str, named: dict[str, float]) -> DataFrame:
    """The same quantiles as one wide row per group."""
    long = quantiles(df, keys, value, list(named.values()))
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("knot") == i, F.col("q"))).alias(n) for i, n in enumerate(named)])


def quantile_vector(df: DataFrame, keys: list[str], value: str, probs) -> DataFrame:
    """The same quantiles as one array per group; its length is the number of probabilities."""
    long = quantiles(df, keys, value, probs)
    packed = F.array_sort(F.collect_list(F.struct("knot", "q")))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s["q"]).alias("q"))


def global_rank(
    df: DataFrame,
    keys: list[str],
    value: str,
    tie: list[str],
    seed: int = 0,
    descending: bool = False,
    method: str = "xxhash",
    slices: int = 65_536,
) -> DataFrame:
    """Add ``pos`` (0-based position by value, then by key hash, then by key) and ``tot_n`` for every row.

    Rows of equal value are cut into hash slices. Offsets come from slice counts, so the rows themselves move once,
    on (keys, value, slice), and neither a long group nor a long tie meets in one task.
    """
    d = df.withColumn("_u", uniform([F.col(c) for c in tie], seed, method)).withColumn(
        "_slice", F.floor(F.col("_u") * F.lit(slices))
    )
    cells = d.groupBy(*keys, value, "_slice").agg(F.count(F.lit(1)).alias("_m"))
    values = cells.groupBy(*keys, value).agg(F.sum("_m").alias("_n"))
    order = [F.desc(value) if descending else F.asc(value)]
    starts = running_totals(
        values, keys, magnitude_bucket(F.col(value)), order, {"n": F.col("_n")}, descending=descending
    ).select(*keys, value, (F.col("cum_n") - F.col("_n")).alias("_start"), "tot_n")
    along = Window.partitionBy(*keys, value).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = cells.withColumn("_before", F.sum("_m").over(along) - F.col("_m"))
    offsets = before.join(starts, [*keys, value]).select(
        *keys, value, "_slice", (F.col("_start") + F.col("_before")).alias("_offset"), "tot_n"
    )
    inside = Window.partitionBy(*keys, value, "_slice").orderBy("_u", *tie)
    return (
        d.join(offsets, [*keys, value, "_slice"])
        .withColumn("pos", (F.col("_offset") + F.row_number().over(inside) - 1).cast("bigint"))
        .select(*df.columns, "pos", "tot_n")
    )


def equal_count_bin(pos: Column, total: Column, bins: int) -> Column:
    """0-based bin of a position when ``total`` rows are cut into ``bins`` parts, larger parts first."""
    base, extra = F.floor(total / F.lit(bins)), total % bins
    cut = extra * (base + 1)
    late = extra + F.floor(F.try_divide((pos - cut).cast("double"), base.cast("double")))
    return F.when(pos < cut, F.floor(pos / (base + 1))).otherwise(late).cast("int")


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: int, method: str = "xxhash") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by key hash: the same rows on every run and partitioning.

    Only the one hash slice that holds the cut-off is ranked; all slices below it pass as they are.
    """
    slices = 65_536
    d = df.withColumn("_u", uniform([F.col(k) for k in keys], seed, method)).withColumn(
        "_b", F.floor(F.col("_u") * slices)
    )
    sizes = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = sizes.select("_b", "_n", (F.lit(n) - (F.sum("_n").over(along) - F.col("_n"))).alias("_room")).where("_room > 0")
    kept = d.join(room, "_b")
    whole = kept.where("_n <= _room").select(*df.columns)
    edge = kept.where("_n > _room").withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_b").orderBy("_u", *keys))
    )
    return whole.unionByName(edge.where("_rn <= _room").select(*df.columns))


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows in an order; ``n`` is a small report length, so Spark keeps ``n`` rows per task."""
    return df.orderBy(*order).limit(n)
