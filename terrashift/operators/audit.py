"""Reconciliation and completeness checks between tables that should agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E


def reconcile(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Full-outer comparison of two key tables: keys on one side only and differing values (one row)."""
    l = left.select(F.col(key).alias("_kl"), *[F.col(c).alias(f"_l_{c}") for c in cols])
    r = right.select(F.col(key).alias("_kr"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = l.join(r, F.col("_kl") == F.col("_kr"), "full_outer")
    both = F.col("_kl").isNotNull() & F.col("_kr").isNotNull()
    return j.agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_kr").isNull()).alias("left_only"),
        F.count_if(F.col("_kl").isNull()).alias("right_only"),
        *[F.count_if(both & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))).alias(f"{c}_differs") for c in cols],
    )


def expected_keys(tiles: DataFrame, years) -> DataFrame:
    """Every tile in every year; the years are a literal list exploded in place."""
    return tiles.select("tile_id", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))


def never_submitted(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    return expected.join(manifest.select("tile_id", "year"), ["tile_id", "year"], "left_anti")


def with_task_state(manifest: DataFrame, states: DataFrame) -> DataFrame:
    """Manifest with the current task state, UNKNOWN where the task is not listed."""
    return manifest.drop("status").join(states.select("task_id", F.col("state").alias("_s")), "task_id", "left").select(
        *manifest.drop("status").columns, F.coalesce("_s", F.lit("UNKNOWN")).alias("status")
    )


def state_counts(manifest: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    rows = manifest if expected is None else manifest.join(expected, ["tile_id", "year"], "left_semi")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def completed_without_file(manifest: DataFrame, files: DataFrame, stem: str = r"^(.*r\d{3,}_c\d{3,})") -> DataFrame:
    """Completed entries whose description starts no file name.

    The prefix test is an equi-join on the stem of the file name, which a pattern recovers.
    """
    stems = files.select(F.regexp_extract("file_name", stem, 1).alias("description")).distinct()
    return manifest.where("status = 'COMPLETED'").join(stems, "description", "left_anti")


def patch_difference(a: DataFrame, b: DataFrame, keys: list[str], bands: str, n_bands: int = C.N_BANDS) -> DataFrame:
    """Differing cells and largest difference per band of two rasters with band arrays on the same keys.

    Cells meet once with all their bands; bands become rows only after the aggregate.
    """
    j = a.select(*keys, F.col(bands).alias("_a")).join(b.select(*keys, F.col(bands).alias("_b")), keys)
    d = j.select(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))).alias("d"))
    each = [F.element_at("d", i + 1) for i in range(n_bands)]
    one = d.agg(*[F.struct(F.count_if(e > 0).alias("n_diff"), F.max(e).alias("max_abs_diff")).alias(f"b{i}") for i, e in enumerate(each)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("band"), F.col(f"b{i}").alias("v")) for i in range(n_bands)])
    return one.select(F.explode(rows).alias("e")).select("e.band", "e.v.n_diff", "e.v.max_abs_diff").where("max_abs_diff is not null")


def validation_verdict(range_ok: Column, aligned: Column, matches: Column, n_granules: Column) -> Column:
    """VALID, FAILED or INCONCLUSIVE; a mismatch is only inconclusive where several granules overlap."""
    return (
        F.when(~range_ok | ~F.coalesce(aligned, F.lit(True)) | (~matches & (n_granules <= 1)), "FAILED")
        .when(~matches, "INCONCLUSIVE")
        .otherwise("VALID")
    )


def range_ok(low: Column, high: Column, tol: float = 0.01) -> Column:
    return F.coalesce((low >= -1 - tol) & (high <= 1 + tol), F.lit(False))


def nearest_valid(pixels: DataFrame, keys: list[str], valid: Column, mid: float) -> DataFrame:
    """Valid pixel closest to a tile's middle per tile; the smaller (row, col) on ties."""
    d2 = (F.col("tile_row") - mid) * (F.col("tile_row") - mid) + (F.col("tile_col") - mid) * (F.col("tile_col") - mid)
    return (
        pixels.where(valid).groupBy(*keys)
        .agg(F.min(F.struct(d2.alias("d2"), "tile_row", "tile_col")).alias("m"))
        .select(*keys, "m.d2", "m.tile_row", "m.tile_col")
    )


def run_status(expected: DataFrame, artefacts: DataFrame, keys: list[str]) -> DataFrame:
    """How many of the expected artefacts exist, per kind."""
    done = artefacts.select("kind", *keys).distinct().withColumn("_d", F.lit(True))
    return (
        expected.join(done, ["kind", *keys], "left").groupBy("kind")
        .agg(F.count_if(F.col("_d")).alias("done"), F.count(F.lit(1)).alias("expected"))
    )


def nodata_share(df: DataFrame, bands: str = "bands") -> DataFrame:
    return df.agg(F.avg((~E.has_coverage(F.col(bands))).cast("int")).alias("nodata_share"))


def areas(counts: DataFrame, n: str) -> DataFrame:
    return counts.withColumn("area_km2", F.col(n) * C.PIXEL_KM2).withColumn("acres", F.col(n) * C.PIXEL_ACRES)
