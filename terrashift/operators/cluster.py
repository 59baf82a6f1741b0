"""Clustering of distance profiles: the Euclidean distance of quantile functions is the 2-Wasserstein distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.config import ClusterSpec
from terrashift.functions import expressions as E
from terrashift.operators import lloyd
from terrashift.operators import summaries as S
from terrashift.operators.ordered import quantile_columns
from terrashift.operators.pool import subsample_runs
from terrashift.session import materialise, scratch_path


def log_profiles(profiles: DataFrame, shape_only: bool = False) -> DataFrame:
    """Add ``x``: log10 of the quantile function, with its own median removed for the shape alone."""
    x = F.transform("q", lambda v: F.log10(v))
    out = profiles.withColumn("x", x)
    return out.withColumn("x", E.array_minus(F.col("x"), E.array_median(F.col("x")))) if shape_only else out


def variance_shares(profiles: DataFrame) -> DataFrame:
    """Between-block sum of squares split into level, shape and their cross term (input with ``x``)."""
    long = profiles.select(E.array_median(F.col("x")).alias("l"), F.posexplode("x").alias("knot", "v")).withColumn(
        "s", F.col("v") - F.col("l")
    )
    per = long.groupBy("knot").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(e).alias(n) for n, e in {
            "sv": F.col("v"), "svv": F.col("v") * F.col("v"), "sl": F.col("l"), "sll": F.col("l") * F.col("l"),
            "ss": F.col("s"), "sss": F.col("s") * F.col("s"), "sls": F.col("l") * F.col("s"),
        }.items()],
    )

    def centred(ab: str, a: str, b: str) -> Column:
        return F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))

    out = per.agg(
        centred("svv", "sv", "sv").alias("total"), centred("sll", "sl", "sl").alias("level"),
        centred("sss", "ss", "ss").alias("shape"), (2 * centred("sls", "sl", "ss")).alias("cross"),
    )
    return out.select("total", *[E.ratio(F.col(c), F.col("total")).alias(f"{c}_share") for c in ("level", "shape", "cross")])


def _rows(x: DataFrame, key: str = "block_id") -> DataFrame:
    """Rows as the batched fit takes them; all are in subsample 0."""
    return x.select(key, "x", F.array(F.lit(0)).alias("runs"), F.xxhash64(key).alias("h"))


def nearest(x: str, centers: np.ndarray) -> Column:
    """(distance, position) of the nearest of a few centres; of equally near ones the first."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    far = F.transform(table, lambda c, i: F.struct(E.array_distance(F.col(x), c).alias("distance"), i.alias("cluster")))
    return F.array_min(far)


def cluster_blocks(profiles: DataFrame, spec: ClusterSpec = ClusterSpec(), shape_only: bool = False) -> DataFrame:
    """Fit on large blocks, assign every block, number clusters by the median of their centroid."""
    x = log_profiles(profiles, shape_only).withColumn("is_small", F.col("n") < spec.min_pixels)
    fit = lloyd.spread(materialise(_rows(x.where(~F.col("is_small"))), "fit"))
    centers = lloyd.fit(fit, lloyd.Plan((spec.k,), starts=spec.n_init, seed=spec.seed)).best(spec.k)
    centers = centers[np.argsort(np.median(centers, axis=1), kind="stable")]
    level_x = F.transform("q", lambda v: F.log10(v))
    return x.withColumn("_at", nearest("x", centers)).select(
        "block_id", F.col("_at.cluster").cast("tinyint").alias("cluster"), "is_small", F.col("_at.distance").alias("dist_to_centroid"),
        E.array_median(level_x).alias("level"), spread("q").alias("spread"),
    )


def spread(q: str) -> Column:
    """log10 interquartile range of a 39-knot profile (knots 0.250 and 0.750)."""
    return F.log10(F.element_at(q, 30)) - F.log10(F.element_at(q, 10))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    return adjusted_rand_of_cells(df.groupBy(*(keys or []), a, b).agg(F.count(F.lit(1)).alias("n")), a, b, keys)


def adjusted_rand_of_cells(cells: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """The same from a table with a count ``n`` for each pair of labels."""
    keys = keys or []

    def pairs(c: Column) -> Column:
        return F.sum(c.cast("double") * (c - 1) / 2)

    def side(col: str, name: str) -> DataFrame:
        return cells.groupBy(*keys, col).agg(F.sum("n").alias("m")).groupBy(*keys).agg(pairs(F.col("m")).alias(name))

    both = cells.groupBy(*keys).agg(pairs(F.col("n")).alias("_ab"), F.sum("n").alias("_n"))
    if keys:
        j = both.join(side(a, "_a"), keys).join(side(b, "_b"), keys)
    else:
        j = both.withColumn("_a", side(a, "_a").scalar()).withColumn("_b", side(b, "_b").scalar())
    expected = F.try_divide(F.col("_a") * F.col("_b"), F.col("_n").cast("double") * (F.col("_n") - 1) / 2)
    ari = F.try_divide(F.col("_ab") - expected, (F.col("_a") + F.col("_b")) / 2 - expected)
    return j.select(*keys, F.coalesce(ari, F.lit(1.0)).alias("ari"))


def _knot_means(df: DataFrame, keys: list[str], vec: str, d: int) -> DataFrame:
    cols = [F.avg(F.element_at(vec, i + 1)).alias(f"_m{i}") for i in range(d)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *cols).select(
        *keys, "_n", F.array(*[f"_m{i}" for i in range(d)]).alias("_mean")
    )


def calinski_harabasz(df: DataFrame, label: str, vec: str, d: int) -> DataFrame:
    """Between over within variance; cluster means are one row per cluster, joined without a hint."""
    means = _knot_means(df, [label], vec, d)
    within = df.join(means, label).agg(
        F.sum(F.pow(E.array_distance(F.col(vec), F.col("_mean")), 2.0)).alias("w")
    )
    grand = _knot_means(df, [], vec, d).select("_mean").scalar()
    between = means.withColumn("_grand", grand).agg(
        F.sum(F.col("_n") * F.pow(E.array_distance(F.col("_mean"), F.col("_grand")), 2.0)).alias("b"),
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"),
    )
    return between.withColumn("w", within.scalar()).select(
        F.col("w").alias("inertia"),
        E.ratio(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("calinski_harabasz"),
    )


#: Rows that the exact silhouette accepts: beyond them its quadratic work is days.
MOST_EXACT = 400_000


#: Rows of a chunk at most: two chunks of vectors and a slice of their distances are what a task holds.
LARGEST_CHUNK = 4096


def _chunks(n: int, least: int) -> int:
    return max(1, -(-n // max(least, min(LARGEST_CHUNK, n // 16))))


def _pair_distances(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Euclidean distances of rows from rows, some rows of ``a`` at a time.

    By a matrix product; where that cancels, rows being near to each other for their size, by differences.
    """
    middle = b.mean(0)
    a, b = a - middle, b - middle
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    for s in range(0, len(a), 64):
        own = a[s : s + 64]
        size = sa[s : s + 64, None] + sb
        d = size - 2 * (own @ b.T)
        i, j = np.nonzero(d < 1e-5 * size)
        d[i, j] = ((own[i] - b[j]) ** 2).sum(1)
        yield np.sqrt(np.maximum(d, 0, out=d), out=d)


def silhouette(df: DataFrame, key: str, label: str, vec: str, chunk: int = 1024) -> DataFrame:
    """Exact Euclidean silhouette, mean over rows.

    Rows are packed into chunks of ``chunk`` rows or more, a sixteenth of all as long as these are few enough for a task:
    rows are copied as often as there are chunks, so these grow with the table. Every unordered pair of chunks is compared once, by a task that returns
    distance sums per row and cluster for both sides, so a chunk is copied to half of the others. The work is quadratic by
    definition: more than ``MOST_EXACT`` rows are refused. ``squared_silhouette`` needs one pass.
    """
    n = df.count()
    if n > MOST_EXACT:
        raise ValueError(f"the exact silhouette compares all pairs; {n} rows are more than {MOST_EXACT}: use squared_silhouette")
    parts = _chunks(n, chunk)
    packed = df.select(key, F.col(label).cast("int").alias("_l"), F.col(vec).alias("_v")).withColumn(
        "_c", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    )
    # Written once and read twice: two relations, so that each side of the cogroup keeps its own columns.
    path = scratch_path(df.sparkSession, "chunks")
    packed.write.parquet(path)
    packed, again = (df.sparkSession.read.schema(packed.schema).parquet(path) for _ in range(2))
    left = packed.withColumn("_d", F.explode(F.sequence(F.col("_c"), F.lit(parts - 1)))).select(
        F.col("_c").alias("i"), F.col("_d").alias("j"), key, "_l", "_v"
    )
    right = again.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_c")))).select(
        F.col("_d").alias("i"), F.col("_c").alias("j"), key, "_l", "_v"
    )
    columns = {"key": "str", "own": "int", "other": "int", "s": "float"}

    def sums_of(a: pd.DataFrame, dist: np.ndarray, labels: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
        hot = np.zeros((dist.shape[1], len(labels)))
        hot[np.arange(len(pos)), pos] = 1.0
        return pd.DataFrame(
            {"key": np.repeat(a[key].astype(str).to_numpy(), len(labels)), "own": np.repeat(a["_l"].to_numpy(), len(labels)),
             "other": np.tile(labels, len(a)), "s": (dist @ hot).ravel()}
        )

    def compare(pair: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in columns.items()})
        va, vb = np.stack(a["_v"].to_numpy()).astype(float), np.stack(b["_v"].to_numpy()).astype(float)
        dist = np.concatenate(list(_pair_distances(va, vb)))
        out = [sums_of(a, dist, *np.unique(b["_l"].to_numpy(), return_inverse=True))]
        if pair[0] != pair[1]:
            out.append(sums_of(b, dist.T, *np.unique(a["_l"].to_numpy(), return_inverse=True)))
        return pd.concat(out)

    sums = (
        left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
        .applyInPandas(compare, "key string, own int, other int, s double")
        .groupBy("key", "own", "other").agg(F.sum("s").alias("s"))
    )
    sizes = packed.groupBy(F.col("_l").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    same = F.col("own") == F.col("other")
    per = sums.join(sizes, "other").groupBy("key").agg(
        F.max(F.when(same, E.ratio(F.col("s"), F.col("m") - 1))).alias("a"),
        F.min(F.when(~same, F.col("s") / F.col("m"))).alias("b"),
    )
    value = F.coalesce(E.ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.agg(F.avg(value).alias("silhouette"))


def squared_silhouette(df: DataFrame, key: str, label: str, vec: str, d: int) -> DataFrame:
    """Silhouette with squared Euclidean distances, mean over rows, in one pass over the rows.

    The mean squared distance from x to a cluster of n rows is |x|^2 + s / n - 2 x.y / n with y the sum and s the sum of
    squares of its rows, so a table with a row for each cluster is all that rows are compared with. A row alone in its
    cluster counts as 0, as does any row when there is one cluster only.
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    own = df.select(key, F.col(label).cast("int").alias("_l"), F.col(vec).alias("_v")).withColumn("_sq", dot(F.col("_v"), F.col("_v")))
    stats = own.groupBy("_l").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_sq").alias("_s"), *[F.sum(F.element_at("_v", i + 1)).alias(f"_y{i}") for i in range(d)]
    ).select(F.col("_l").alias("_o"), "_n", "_s", F.array(*[f"_y{i}" for i in range(d)]).alias("_y"))
    # One array with an element for each cluster goes to every row.
    table = stats.agg(F.collect_list(F.struct("_o", "_n", "_s", "_y")).alias("t")).scalar()
    each = own.withColumn("_c", F.explode(table)).select(key, "_l", "_v", "_sq", "_c.*")
    total = F.greatest(F.lit(0.0), F.col("_sq") * F.col("_n") + F.col("_s") - 2 * dot(F.col("_v"), F.col("_y")))
    mine = F.col("_l") == F.col("_o")
    per = each.withColumn("_t", total).groupBy(key).agg(
        F.max(F.when(mine, E.ratio(F.col("_t"), F.col("_n") - 1))).alias("a"), F.min(F.when(~mine, F.col("_t") / F.col("_n"))).alias("b")
    )
    value = F.coalesce(E.ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return per.agg(F.avg(value).alias("silhouette"))


def sweep(profiles: DataFrame, spec: ClusterSpec = ClusterSpec(), shape_only: bool = False) -> DataFrame:
    """Quality of every k: inertia, silhouette, Calinski-Harabasz, and stability under resampling.

    All models, from each k over the subsamples to their starts, are fitted at once, one job an iteration.
    """
    large = log_profiles(profiles.where(F.col("n") >= spec.min_pixels), shape_only).select("block_id", "x")
    drawn = subsample_runs(large.select("block_id"), "block_id", spec.runs, spec.frac, spec.seed)
    runs = drawn.groupBy("block_id").agg(F.collect_list(F.col("run") + 1).alias("_in"))
    member = F.concat(F.array(F.lit(0)), F.coalesce("_in", F.array().cast("array<int>"))).alias("runs")
    rows = lloyd.spread(materialise(large.join(runs, "block_id", "left").select("x", member, F.xxhash64("block_id").alias("h")), "profiles"))
    plan = lloyd.Plan(spec.k_range, subsamples=spec.runs + 1, starts=spec.n_init, seed=spec.seed)
    fitted = lloyd.fit(rows, plan)
    quality = profiles.sparkSession.createDataFrame(
        lloyd.quality(rows, fitted, plan), "k int, inertia double, silhouette double, calinski_harabasz double"
    )
    ari = adjusted_rand_of_cells(lloyd.contingency(rows, fitted, plan), "a", "b", ["k", "run"])
    stability = ari.groupBy("k").agg(F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"))
    return quality.join(stability, "k", "left")


def cluster_report(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Blocks, rows, conversion rates and pixel-weighted distance quantiles per cluster."""
    # Knots of the 39-knot grid that hold these probabilities (1-based).
    knots = {"p10_m": 4, "p25_m": 10, "p50_m": 20, "p75_m": 30, "p90_m": 36}
    j = profiles.join(clusters.select("block_id", "cluster", "is_small"), "block_id")
    agg = j.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("is_small").alias("small"),
        F.sum("n").alias("rows"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"),
        *[E.ratio(F.sum(F.element_at("q", i) * F.col("n")), F.sum("n")).alias(c) for c, i in knots.items()],
    )
    return agg.withColumn("pct_label1", 100 * E.ratio(F.col("n1"), F.col("rows"))).withColumn(
        "pct_label2", 100 * E.ratio(F.col("n2"), F.col("rows"))
    )


def cluster_by_fold(clusters: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Blocks per cluster and fold with the largest-to-smallest ratio."""
    tab = S.crosstab(clusters.join(folds.select("block_id", "fold"), "block_id"), "cluster", "fold", list(range(k)), "fold_")
    return tab.withColumn("max_over_min", S.max_min_ratio(tab, [f"fold_{i}" for i in range(k)]))


def knot_bands(profiles: DataFrame, clusters: DataFrame) -> DataFrame:
    """10th, 50th and 90th percentile over member blocks at every knot of every cluster."""
    long = profiles.join(clusters.select("block_id", "cluster"), "block_id").select(
        "cluster", F.posexplode("q").alias("at", "v")
    )
    return quantile_columns(long, ["cluster", "at"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}).withColumnRenamed("at", "knot")
