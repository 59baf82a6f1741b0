"""Counts, shares, composition and distribution summaries of labelled pixels and weighted pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.functions import lattice as L
from terrashift.operators.ordered import quantile_columns, quantile_vector, quantiles


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def row_and_key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows and exact distinct keys; the keys are collapsed before the final count."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.sum("_n").alias("n_rows"), F.count(key).alias("n_keys"))
    )


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, n1, n2 per group: all rows, conversions to developed, conversions to something else."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("label") == 1).alias("n1"),
        count_where(F.col("label") == 2).alias("n2"),
    )


def with_share(df: DataFrame, value: str, within: list[str], name: str, scale: float = 1.0) -> DataFrame:
    """Share of a group total; meant for aggregated tables."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.lit(scale) * E.ratio(F.col(value), F.sum(value).over(w)))


def value_counts(df: DataFrame, keys: list[str], share: str = "share", scale: float = 1.0) -> DataFrame:
    return with_share(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "n", [], share, scale)


def conditional_rates(df: DataFrame, given: str, outcome: str, scale: float = 100.0) -> DataFrame:
    """P(outcome | given)."""
    counts = df.groupBy(given, outcome).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", [given], "rate", scale)


def crosstab(df: DataFrame, row: str, col: str, values: list, prefix: str) -> DataFrame:
    """Counts of a fixed list of column values per row value, zero where a pair does not occur."""
    return df.groupBy(row).agg(
        *[count_where(F.col(col) == v).alias(f"{prefix}{v}".replace(" ", "_").lower()) for v in values]
    )


def reindexed_counts(df: DataFrame, col: str, names: dict[int, str], total: DataFrame) -> DataFrame:
    """Counts for a fixed code list, zero filled, with area and percentage of ``total`` rows (a one-row ``n_total``)."""
    spark = df.sparkSession
    dim = spark.createDataFrame(list(names.items()), "code int, name string")
    counts = df.where(F.col(col).isin(*names)).groupBy(F.col(col).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    out = dim.join(counts, "code", "left").withColumn("pixels", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.withColumn("n_total", total.select("n_total").scalar()).select(
        "code", "name", "pixels",
        (F.col("pixels") * C.PIXEL_KM2).alias("area_km2"),
        (100 * E.ratio(F.col("pixels"), F.col("n_total"))).alias("pct"),
    )


def label_balance(df: DataFrame) -> DataFrame:
    return value_counts(df, ["label", "label_name"], "frac")


def fold_summary(blocks: DataFrame) -> DataFrame:
    """Blocks, rows and rare classes per fold with the percentage deviation from the mean over folds."""
    per = blocks.groupBy("fold").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum("n").alias("rows"),
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
    )
    every = Window.partitionBy(F.lit(0))
    return per.select(
        "*", *[((E.ratio(F.col(c), F.avg(c).over(every)) - 1) * 100).alias(f"{c}_pct_dev") for c in ("rows", "n1", "n2")]
    )


def distance_quantiles(df: DataFrame, dist: str, keys: list[str], tag: str) -> DataFrame:
    """Seven report quantiles and the mean per group, tagged with the name of the set."""
    named = {f"p{round(p * 100)}": p for p in C.REPORT_PROBS}
    q = quantile_columns(df, keys, dist, named)
    mean = df.groupBy(*keys).agg(F.avg(dist).alias("mean"))
    return q.join(mean, keys).withColumn("dist_set", F.lit(tag))


def block_profiles(df: DataFrame, dist: str, lat=None, probs=C.PROFILE_PROBS) -> DataFrame:
    """Counts, moments, null audit, cell centre and the quantile function ``q`` of every block."""
    lat = lat or C.Lattice().with_cell(C.BLOCK_M)
    base = df.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(F.col("label") == 1).alias("n1"),
        count_where(F.col("label") == 2).alias("n2"),
        F.avg("x").alias("x_mean"),
        F.avg("y").alias("y_mean"),
        F.avg(dist).alias("mean_dist_m"),
        F.min(dist).alias("min_dist_m"),
        F.max(dist).alias("max_dist_m"),
        (F.count(F.lit(1)) - F.count(dist)).alias("n_null_dist"),
    )
    row, col = L.parse_block_id(F.col("block_id"))
    vec = quantile_vector(df, ["block_id"], dist, probs)
    return (
        base.join(vec, "block_id", "left")
        .withColumn("block_row", row)
        .withColumn("block_col", col)
        .withColumn("x_center", L.center_x(F.col("block_col"), lat))
        .withColumn("y_center", L.center_y(F.col("block_row"), lat))
    )


def profile_checks(profiles: DataFrame, min_dist: float = 30.0) -> DataFrame:
    """One row per invariant that a profile table must satisfy, with the number of violating blocks."""
    finite = F.forall("q", lambda v: v.isNotNull() & ~F.isnan(v))
    checks = {
        "null_distance": F.col("n_null_dist") > 0,
        "non_finite_quantile": ~finite,
        "below_one_pixel": F.col("min_dist_m") < min_dist,
        "decreasing_quantiles": ~E.is_nondecreasing(F.col("q")),
    }
    agg = profiles.agg(
        (F.count("block_id") - F.countDistinct("block_id")).alias("duplicate_block"),
        *[count_where(c).alias(n) for n, c in checks.items()],
    )
    return agg.unpivot([], ["duplicate_block", *checks], "check", "violations")


def block_size_summary(blocks: DataFrame, min_pixels: int) -> DataFrame:
    """Smallest, median and largest block; how many are small and what share of rows they hold."""
    med = quantile_columns(blocks, [], "n", {"median_n": 0.5})
    small = F.col("n") < min_pixels
    agg = blocks.agg(
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        count_where(small).alias("small_blocks"),
        (100 * E.ratio(F.sum(F.when(small, F.col("n")).otherwise(0)), F.sum("n"))).alias("small_rows_pct"),
    )
    return agg.withColumn("median_n", med.scalar())


def ecdf(df: DataFrame, keys: list[str], dist: str, tag: str) -> DataFrame:
    """Cumulative distribution read off 199 quantiles per group."""
    return quantiles(df, keys, dist, C.ECDF_PROBS).withColumn("curve", F.lit(tag))


def decile_bins(df: DataFrame, dist: str) -> DataFrame:
    """Decile edges over the whole table, one row per bin (0..9) with bounds and a readable label."""
    edges = quantile_vector(df, [], dist, [i / 10 for i in range(1, 10)])
    e = F.col("q")
    text = F.transform(e, lambda v: F.format_number(v, 0))
    bins = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("decile")
    low = F.when(F.col("decile") > 0, F.try_element_at(e, F.col("decile")))
    high = F.when(F.col("decile") < 9, F.try_element_at(e, F.col("decile") + 1))
    label = (
        F.when(F.col("decile") == 0, F.concat(F.lit("< "), F.element_at(text, 1), F.lit(" m")))
        .when(F.col("decile") == 9, F.concat(F.lit("> "), F.element_at(text, 9), F.lit(" m")))
        .otherwise(
            F.concat(F.try_element_at(text, F.col("decile")), F.lit(" to "), F.try_element_at(text, F.col("decile") + 1), F.lit(" m"))
        )
    )
    return edges.select("q", text.alias("_t"), bins).select("decile", low.alias("low"), high.alias("high"), label.alias("label"))


def group_median_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    med = quantile_columns(df, keys, value, {"median": 0.5})
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).join(med, keys)


def fold_moments(df: DataFrame, dist: str) -> DataFrame:
    """n, sum and sum of squares of ln(1 + d) per fold: one scan serves every leave-out combination."""
    z = F.log1p(F.col(dist))
    return df.groupBy("fold").agg(F.count(dist).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("ss"))


def leave_out_normaliser(moments: DataFrame, k: int, extra_offset: int | None = None) -> DataFrame:
    """Mean and sample deviation of ln(1 + d) over all folds but the held-out one.

    With ``extra_offset`` the fold (held_out + offset) mod k is left out too. The input has k rows.
    """
    held = moments.select(F.col("fold").alias("held_out"))
    out = F.array(F.col("held_out")) if extra_offset is None else F.array(
        F.col("held_out"), (F.col("held_out") + extra_offset) % k
    )
    pairs = moments.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("held_out")).where(
        ~F.array_contains(out, F.col("fold"))
    )
    pairs = pairs.join(F.broadcast(held), "held_out")
    agg = pairs.groupBy("held_out").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = E.ratio(F.col("s"), F.col("n"))
    var = E.ratio(F.col("ss") - F.col("s") * mean, F.col("n") - 1)
    return agg.select("held_out", mean.alias("log_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("log_std"))


def band_bounds(df: DataFrame, bands: str = "bands") -> DataFrame:
    """Smallest and largest band value and the number of values, nulls excluded; arrays are reduced in place."""
    present = F.filter(bands, lambda v: v.isNotNull())
    return df.agg(
        F.min(F.array_min(present)).alias("min_val"),
        F.max(F.array_max(present)).alias("max_val"),
        F.sum(F.size(present)).cast("bigint").alias("n_vals"),
    )


def tile_screen(df: DataFrame, value: Column, top: int = 10) -> DataFrame:
    """Per-tile moments of one band with the z-score of the tile mean; the ``top`` most unusual tiles."""
    per = df.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    overall = per.agg(F.struct(F.avg("mean").alias("m"), F.stddev_samp("mean").alias("sd")).alias("o")).scalar()
    scored = per.withColumn("z", E.ratio(F.col("mean") - overall["m"], overall["sd"]))
    return scored.orderBy(F.abs("z").desc(), "tile_id").limit(top)


def log_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    lo, hi = E.log_bin_edges(F.col("bin_idx"))
    counts = df.groupBy(*keys, E.log_bin(F.col(value)).alias("bin_idx")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("left_m", lo).withColumn("right_m", hi)


def density_histogram(df: DataFrame, keys: list[str], value: Column, high: float, bins: int) -> DataFrame:
    """Equal-width density histogram on [0, high]; values outside are left out of the total too."""
    width = high / bins
    counts = (
        df.select(*keys, E.equal_width_bin(value, 0.0, high, bins).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return with_share(counts, "n", keys, "density", 1.0 / width)


def pool_composition(pool: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, weight and effective size of a weighted pool, by row count and by weight."""
    w, pos = F.col("sample_weight"), F.col("label") == 1
    agg = pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pool_rows"),
        count_where(F.col("label") == 0).alias("pool_n0"),
        count_where(pos).alias("pool_n1"),
        count_where(F.col("label") == 2).alias("pool_n2"),
        F.sum(w).alias("sum_w"),
        F.sum(w * w).alias("sum_w2"),
        F.sum(F.when(pos, w).otherwise(0.0)).alias("pos_w"),
    )
    return agg.select(
        *keys, "pool_rows", "pool_n0", "pool_n1", "pool_n2", "sum_w",
        E.ratio(F.col("sum_w"), F.col("pool_rows")).alias("mean_weight"),
        (100 * E.ratio(F.col("pool_n1"), F.col("pool_rows"))).alias("pos_share_rows_pct"),
        (100 * E.ratio(F.col("pos_w"), F.col("sum_w"))).alias("pos_share_weight_pct"),
        E.ratio(F.col("sum_w") * F.col("sum_w"), F.col("sum_w2")).alias("kish_ess"),
    )


def natural_composition(samples: DataFrame) -> DataFrame:
    return samples.groupBy("fold").agg(
        F.count(F.lit(1)).alias("nat_rows"),
        *[count_where(F.col("label") == v).alias(f"nat_n{v}") for v in (0, 1, 2)],
    ).withColumn("nat_prevalence_pct", 100 * E.ratio(F.col("nat_n1"), F.col("nat_rows"))).withColumn(
        "converted_acres", F.col("nat_n1") * C.PIXEL_ACRES
    )


def with_training_rows(per_fold: DataFrame, rows: str) -> DataFrame:
    total = F.sum(rows).over(Window.partitionBy(F.lit(0)))
    return per_fold.withColumn("training_rows", total - F.col(rows))


def append_mean_std(per_fold: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Fold rows followed by a ``mean`` and a ``std`` row (sample deviation)."""
    rows = per_fold.select(F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in cols])
    mean = rows.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("mean").alias(key), *cols)
    std = rows.agg(*[F.stddev_samp(c).alias(c) for c in cols]).select(F.lit("std").alias(key), *cols)
    return rows.unionByName(mean).unionByName(std)


def coverage_stats(df: DataFrame, keys: list[str], bands: str = "bands") -> DataFrame:
    """Decoded range over covered bytes and the fraction of pixels whose first band is nodata."""
    covered = F.filter(bands, lambda v: v != C.BAND_NODATA)
    dec = lambda c: (c - C.BAND_OFFSET) / C.BAND_SCALE
    return df.groupBy(*keys).agg(
        dec(F.min(F.array_min(covered))).alias("decoded_min"),
        dec(F.max(F.array_max(covered))).alias("decoded_max"),
        F.avg((F.element_at(bands, 1) == C.BAND_NODATA).cast("int")).alias("nodata_frac"),
    )


def destination_shares(df: DataFrame, top: int = 3) -> DataFrame:
    """Land cover that pixels with label 2 turned into, ranked, with share and running share of the first ones."""
    ranked = value_counts(df.where("label = 2"), ["lc_2024"], "pct_of_other", 100.0)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc("lc_2024"))
    return ranked.select(
        "lc_2024",
        E.code_name(F.col("lc_2024"), C.OTHER_NAMES).alias("destination"),
        F.col("n").alias("pixels"),
        "pct_of_other",
        F.row_number().over(w).alias("rank"),
        (F.row_number().over(w) <= top).alias("is_top"),
    )


def max_min_ratio(df: DataFrame, cols: list[str]) -> Column:
    return E.ratio(F.greatest(*cols), F.least(*cols))
