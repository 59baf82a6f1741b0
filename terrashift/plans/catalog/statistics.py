"""Counts, shares, quantiles, histograms, windows and top-k reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.operators import audit as A
from terrashift.operators import ordered as O
from terrashift.operators import summaries as S
from terrashift.plans.fixtures import DIST, Fixtures
from terrashift.plans.registry import register


def _round(df, digits: int, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("row_and_tile_counts", "A1", "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT tile_id) AS n_keys FROM smp")
def row_and_tile_counts(fx: Fixtures):
    return S.row_and_key_counts(fx.samples, "tile_id")


@register("block_class_counts", "A2 T1", "SELECT * FROM blk")
def block_class_counts(fx: Fixtures):
    return S.class_counts(fx.samples, ["block_id"]).orderBy("block_id")


@register("fold_decay_means", "A3", "SELECT fold, n, n1, n2, n0, round(mean_decay, 9) AS mean_decay FROM cal0")
def fold_decay_means(fx: Fixtures):
    return _round(fx.calibration.select("fold", "n", "n1", "n2", "n0", "mean_decay"), 9, "mean_decay")


@register("fold_balance_summary", "A4", """
    f AS (SELECT fold, COUNT(*) AS blocks, CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n1) AS BIGINT) AS n1, CAST(SUM(n2) AS BIGINT) AS n2 FROM fld GROUP BY fold)
    SELECT *, round((rows / avg(rows) OVER () - 1) * 100, 6) AS rows_pct_dev, round((n1 / avg(n1) OVER () - 1) * 100, 6) AS n1_pct_dev, round((n2 / avg(n2) OVER () - 1) * 100, 6) AS n2_pct_dev FROM f""")
def fold_balance_summary(fx: Fixtures):
    return _round(S.fold_summary(fx.folds), 6, "rows_pct_dev", "n1_pct_dev", "n2_pct_dev")


@register("label_balance", "A5 W4", "SELECT label, label_name, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (), 9) AS frac FROM smp GROUP BY 1, 2")
def label_balance(fx: Fixtures):
    return _round(S.label_balance(fx.samples), 9, "frac")


@register("distance_quantiles_by_fold", "A7 U2", """
    SELECT fold, 'label_' || label AS dist_set, round(quantile_cont(dist_m, 0.01), 8) AS p1, round(quantile_cont(dist_m, 0.1), 8) AS p10, round(quantile_cont(dist_m, 0.25), 8) AS p25, round(quantile_cont(dist_m, 0.5), 8) AS p50,
      round(quantile_cont(dist_m, 0.75), 8) AS p75, round(quantile_cont(dist_m, 0.9), 8) AS p90, round(quantile_cont(dist_m, 0.99), 8) AS p99, round(avg(dist_m), 6) AS mean FROM sf GROUP BY fold, label""")
def distance_quantiles_by_fold(fx: Fixtures):
    q = S.distance_quantiles(fx.samples_fold, DIST, ["fold", "label"], "label").withColumn("dist_set", F.concat(F.lit("label_"), "label"))
    return _round(_round(q.drop("label"), 8, *[f"p{round(p * 100)}" for p in C.REPORT_PROBS]), 6, "mean")


@register("lineitem_price_quantiles", "A7", """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.01), 6) AS p1, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def lineitem_price_quantiles(fx: Fixtures):
    q = O.quantile_columns(fx.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    return _round(q, 6, "p1", "p50", "p99")


_P = ", ".join(f"{p:.4f}" for p in C.PROFILE_PROBS)


@register("block_distance_profiles", "A8 X6", f"""
    SELECT block_id, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS n1, COUNT(*) FILTER (label = 2) AS n2, round(avg(x), 4) AS x_mean, round(avg(y), 4) AS y_mean, round(avg(dist_m), 6) AS mean_dist_m,
      min(dist_m) AS min_dist_m, max(dist_m) AS max_dist_m, COUNT(*) - COUNT(dist_m) AS n_null_dist,
      CAST(substr(block_id, 2, 4) AS INTEGER) AS block_row, CAST(substr(block_id, 7) AS INTEGER) AS block_col,
      -2415585.0::DOUBLE + (CAST(substr(block_id, 7) AS INTEGER) + 0.5::DOUBLE) * 480 AS x_center, 3314805.0::DOUBLE - (CAST(substr(block_id, 2, 4) AS INTEGER) + 0.5::DOUBLE) * 480 AS y_center,
      round(list_extract(quantile_cont(dist_m, [{_P}]), 1), 8) AS q0025, round(list_extract(quantile_cont(dist_m, [{_P}]), 20), 8) AS q0500, round(list_extract(quantile_cont(dist_m, [{_P}]), 39), 8) AS q0975,
      round(list_sum(quantile_cont(dist_m, [{_P}])), 4) AS q_sum FROM smp GROUP BY block_id""")
def block_distance_profiles(fx: Fixtures):
    p = fx.profiles
    out = p.withColumns(
        {"q0025": F.element_at("q", 1), "q0500": F.element_at("q", 20), "q0975": F.element_at("q", 39), "q_sum": F.aggregate("q", F.lit(0.0), lambda a, v: a + v)}
    ).drop("q")
    out = _round(_round(out, 6, "mean_dist_m"), 8, "q0025", "q0500", "q0975")
    return _round(out, 4, "x_mean", "y_mean", "q_sum")


@register("profile_invariants", "W8 A8", """
    SELECT check_name AS "check", CAST(0 AS BIGINT) AS violations FROM (SELECT unnest(['duplicate_block', 'null_distance', 'non_finite_quantile', 'below_one_pixel', 'decreasing_quantiles']) AS check_name)
    WHERE (SELECT COUNT(*) FROM blk) = (SELECT COUNT(DISTINCT block_id) FROM smp WHERE dist_m >= 30)""")
def profile_invariants(fx: Fixtures):
    return S.profile_checks(fx.profiles)


@register("fold_distance_ecdf", "A9", f"""
    SELECT fold, k.i AS knot, round(quantile_cont(dist_m, [{", ".join(f"{p:.4f}" for p in C.ECDF_PROBS)}])[k.i + 1], 8) AS q FROM sf, (SELECT unnest(range(0, 199))::INTEGER AS i) k WHERE label = 0 GROUP BY fold, k.i""")
def fold_distance_ecdf(fx: Fixtures):
    e = S.ecdf(fx.samples_fold.where("label = 0"), ["fold"], DIST, "natural")
    return e.select("fold", "knot", F.round("q", 8).alias("q"))


@register("distance_decile_bins", "A10", """
    e AS (SELECT quantile_cont(dist_m, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM smp)
    SELECT CAST(i AS INTEGER) AS decile, CASE WHEN i > 0 THEN round(q[i], 8) END AS low, CASE WHEN i < 9 THEN round(q[i + 1], 8) END AS high FROM e, (SELECT unnest(range(0, 10)) AS i)""")
def distance_decile_bins(fx: Fixtures):
    b = S.decile_bins(fx.stored, DIST)
    return b.select("decile", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@register("distance_decile_labels", "A10 X8", """
    e AS (SELECT quantile_cont(dist_m, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM smp),
    t AS (SELECT q, [printf('%,d', CAST(round_even(v, 0) AS BIGINT)) for v in q] AS t FROM e)
    SELECT CASE WHEN d = 0 THEN '< ' || t[1] || ' m' WHEN d = 9 THEN '> ' || t[9] || ' m' ELSE t[d] || ' to ' || t[d + 1] || ' m' END AS label, COUNT(*) AS n
    FROM (SELECT len([v for v in q if v <= dist_m]) AS d, t FROM smp, t) GROUP BY 1""")
def distance_decile_labels(fx: Fixtures):
    """Rows per decile, the bin found by counting edges not above the distance."""
    bins = S.decile_bins(fx.stored, DIST)
    edges = O.quantile_vector(fx.stored, [], DIST, [i / 10 for i in range(1, 10)]).select("q").scalar()
    n = fx.stored.groupBy(E.digitize(F.col(DIST), edges, 9).alias("decile")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(n, "decile").select("label", "n")


@register("median_distance_by_label", "A11", "SELECT label_name, COUNT(*) AS n, round(avg(dist_m), 6) AS mean, round(median(dist_m), 8) AS median FROM smp GROUP BY 1")
def median_distance_by_label(fx: Fixtures):
    return _round(_round(S.group_median_mean(fx.stored, ["label_name"], DIST), 6, "mean"), 8, "median")


@register("leave_one_out_normaliser", "A12 A24 D13", """
    SELECT CAST(h AS INTEGER) AS held_out, round(avg(ln(1 + dist_m)), 8) AS log_mean, round(stddev_samp(ln(1 + dist_m)), 8) AS log_std FROM sf, (SELECT unnest(range(0, 5)) AS h) WHERE fold <> h GROUP BY h""")
def leave_one_out_normaliser(fx: Fixtures):
    n = S.leave_out_normaliser(S.fold_moments(fx.samples_fold, DIST), 5)
    return _round(n, 8, "log_mean", "log_std")


@register("leave_two_out_normaliser", "A12", """
    SELECT CAST(h AS INTEGER) AS held_out, round(avg(ln(1 + dist_m)), 8) AS log_mean, round(stddev_samp(ln(1 + dist_m)), 8) AS log_std FROM sf, (SELECT unnest(range(0, 5)) AS h) WHERE fold NOT IN (h, (h + 1) % 5) GROUP BY h""")
def leave_two_out_normaliser(fx: Fixtures):
    n = S.leave_out_normaliser(S.fold_moments(fx.samples_fold, DIST), 5, extra_offset=1)
    return _round(n, 8, "log_mean", "log_std")


@register("band_value_bounds", "A13 A30", """
    v AS (SELECT year, unnest(bands) AS b FROM til)
    SELECT year, round(min((b - 128) / 127.0::DOUBLE), 6) AS min_val, round(max((b - 128) / 127.0::DOUBLE), 6) AS max_val, COUNT(*) AS n_vals FROM v WHERE b <> 0 GROUP BY year""")
def band_value_bounds(fx: Fixtures):
    d = fx.tiles.select("year", F.filter(E.decode_bands(F.col("bands")), lambda v: v.isNotNull()).alias("b"))
    g = d.groupBy("year").agg(
        F.min(F.array_min("b")).alias("min_val"), F.max(F.array_max("b")).alias("max_val"), F.sum(F.size("b")).alias("n_vals")
    )
    return g.select("year", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("min_val", "max_val")], "n_vals")


@register("unpivoted_band_bounds", "A13", """
    v AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT round(min(v), 6) AS min_val, round(max(v), 6) AS max_val, COUNT(v) AS n_vals FROM v""")
def unpivoted_band_bounds(fx: Fixtures):
    b = S.band_bounds(fx.table("embeddings"), "embedding")
    return b.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("min_val", "max_val")], "n_vals")


@register("tile_outlier_screen", "A14 W5 T2", """
    t AS (SELECT tile_id, COUNT(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM (SELECT tile_id, (bands[1] - 128) / 127.0::DOUBLE AS v FROM til WHERE year = 2019 AND bands[1] <> 0) GROUP BY tile_id)
    SELECT tile_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, round(z, 5) AS z FROM (SELECT *, (mean - avg(mean) OVER ()) / stddev_samp(mean) OVER () AS z FROM t) ORDER BY abs(z) DESC, tile_id LIMIT 10""")
def tile_outlier_screen(fx: Fixtures):
    b = F.element_at("bands", 1)
    t = fx.tiles.where((F.col("year") == 2019) & (b != 0)).withColumn("v", (b - 128) / F.lit(127.0))
    return _round(_round(S.tile_screen(t, F.col("v")), 6, "mean", "std", "min", "max"), 5, "z")


@register("destination_counts", "A15 A29 T2", """
    SELECT lc_2024, CASE lc_2024 WHEN 11 THEN 'Open Water' WHEN 31 THEN 'Barren Land' WHEN 41 THEN 'Deciduous Forest' WHEN 42 THEN 'Evergreen Forest' WHEN 43 THEN 'Mixed Forest' WHEN 52 THEN 'Shrub/Scrub'
      WHEN 71 THEN 'Grassland/Herbaceous' WHEN 81 THEN 'Pasture/Hay' WHEN 82 THEN 'Cultivated Crops' END AS destination, COUNT(*) AS pixels, round(100 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct_of_other,
      CAST(row_number() OVER (ORDER BY COUNT(*) DESC, lc_2024) AS INTEGER) AS rank, row_number() OVER (ORDER BY COUNT(*) DESC, lc_2024) <= 3 AS is_top FROM smp WHERE label = 2 GROUP BY lc_2024""")
def destination_counts(fx: Fixtures):
    return _round(S.destination_shares(fx.samples), 6, "pct_of_other")


@register("top_destination_breakdown", "A17 A29 J17", """
    r AS (SELECT lc_2024 FROM smp WHERE label = 2 GROUP BY 1 ORDER BY COUNT(*) DESC, lc_2024 LIMIT 3), t AS (SELECT lc_2019, COUNT(*) AS tot FROM smp GROUP BY 1)
    SELECT s.lc_2019, s.lc_2024, COUNT(*) AS pixels, round(100.0::DOUBLE * COUNT(*) / any_value(tot), 6) AS pct_of_2019_wetland FROM smp s JOIN r USING (lc_2024) JOIN t USING (lc_2019) WHERE label = 2 GROUP BY 1, 2""")
def top_destination_breakdown(fx: Fixtures):
    s = fx.stored
    top = S.destination_shares(s).where("is_top").select("lc_2024")
    totals = s.groupBy("lc_2019").agg(F.count(F.lit(1)).alias("tot"))
    n = s.where("label = 2").groupBy("lc_2019", "lc_2024").agg(F.count(F.lit(1)).alias("pixels"))
    return n.join(top, "lc_2024").join(totals, "lc_2019").select(
        "lc_2019", "lc_2024", "pixels", F.round(100 * E.ratio(F.col("pixels"), F.col("tot")), 6).alias("pct_of_2019_wetland")
    )


@register("conversion_rate_by_class", "A16", "SELECT lc_2019, label, COUNT(*) AS n, round(100 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY lc_2019), 6) AS rate FROM smp GROUP BY 1, 2")
def conversion_rate_by_class(fx: Fixtures):
    return _round(S.conditional_rates(fx.samples, "lc_2019", "label"), 6, "rate")


@register("class_by_label_crosstab", "A17", """
    SELECT lc_2019, COUNT(*) FILTER (label = 0) AS label_0, COUNT(*) FILTER (label = 1) AS label_1, COUNT(*) FILTER (label = 2) AS label_2 FROM smp GROUP BY 1""")
def class_by_label_crosstab(fx: Fixtures):
    return S.crosstab(fx.samples, "lc_2019", "label", [0, 1, 2], "label_")


@register("lineitem_flag_crosstab", "A17", "SELECT l_returnflag, COUNT(*) FILTER (l_linestatus = 'F') AS status_f, COUNT(*) FILTER (l_linestatus = 'O') AS status_o FROM lineitem GROUP BY 1")
def lineitem_flag_crosstab(fx: Fixtures):
    return S.crosstab(fx.table("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "status_")


@register("developed_intensity_counts", "A18 A28", """
    d AS (SELECT unnest([21, 22, 23, 24])::INTEGER AS code, unnest(['Open Space', 'Low Intensity', 'Medium Intensity', 'High Intensity']) AS name)
    SELECT code, name, COUNT(s.lc_2024) AS pixels, round(COUNT(s.lc_2024) * 900 / 1e6, 6) AS area_km2, round(100.0::DOUBLE * COUNT(s.lc_2024) / (SELECT COUNT(*) FROM smp), 6) AS pct
    FROM d LEFT JOIN (SELECT * FROM smp WHERE label = 1) s ON s.lc_2024 = code GROUP BY 1, 2""")
def developed_intensity_counts(fx: Fixtures):
    total = fx.stored.agg(F.count(F.lit(1)).alias("n_total"))
    return _round(S.reindexed_counts(fx.stored.where("label = 1"), "lc_2024", C.DEVELOPED_NAMES, total), 6, "area_km2", "pct")


@register("label_areas", "A28 A29", f"SELECT label, COUNT(*) AS n, round(COUNT(*) * 900 / 1e6, 6) AS area_km2, round(COUNT(*) * 900 / {C.M2_PER_ACRE}::DOUBLE, 4) AS acres FROM smp GROUP BY 1")
def label_areas(fx: Fixtures):
    a = A.areas(fx.samples.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "n")
    return _round(_round(a, 6, "area_km2"), 4, "acres")


@register("converted_share", "A29", "SELECT COUNT(*) AS n, COUNT(*) FILTER (label <> 0) AS converted, round(100.0::DOUBLE * COUNT(*) FILTER (label <> 0) / COUNT(*), 6) AS converted_pct FROM smp")
def converted_share(fx: Fixtures):
    g = fx.samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != 0).alias("converted"))
    return g.withColumn("converted_pct", F.round(100 * E.ratio(F.col("converted"), F.col("n")), 6))


@register("log_distance_histogram", "A22", """
    SELECT label_name, CAST(floor(log10(dist_m) / 0.05::DOUBLE) AS BIGINT) AS bin_idx, COUNT(*) AS n, round(pow(10, floor(log10(dist_m) / 0.05::DOUBLE) * 0.05::DOUBLE), 4) AS left_m, round(pow(10, (floor(log10(dist_m) / 0.05::DOUBLE) + 1) * 0.05::DOUBLE), 4) AS right_m
    FROM smp GROUP BY ALL""")
def log_distance_histogram(fx: Fixtures):
    return _round(S.log_histogram(fx.samples, ["label_name"], DIST), 4, "left_m", "right_m")


_TOP = math.log10(150_001.0)


@register("distance_density_histogram", "A23", f"""
    v AS (SELECT label = 1 AS converter, log10(dist_m + 1) AS v FROM smp), b AS (SELECT converter, CAST(least(floor(v / ({_TOP!r}::DOUBLE / 59)) + 1, 59) AS INTEGER) AS bin FROM v WHERE v BETWEEN 0 AND {_TOP!r}::DOUBLE)
    SELECT converter, bin, COUNT(*) AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY converter) / ({_TOP!r}::DOUBLE / 59), 6) AS density FROM b GROUP BY 1, 2""")
def distance_density_histogram(fx: Fixtures):
    s = fx.samples.withColumn("converter", F.col("label") == 1)
    return _round(S.density_histogram(s, ["converter"], F.log10(F.col(DIST) + 1), _TOP, 59), 6, "density")


@register("lineitem_price_histogram", "A22 A23", """
    SELECT l_linestatus, CAST(floor(log10(l_extendedprice) / 0.05::DOUBLE) AS BIGINT) AS bin_idx, COUNT(*) AS n FROM lineitem GROUP BY 1, 2""")
def lineitem_price_histogram(fx: Fixtures):
    return S.log_histogram(fx.table("lineitem"), ["l_linestatus"], "l_extendedprice").drop("left_m", "right_m")


@register("fold_training_rows", "A24", "SELECT fold, COUNT(*) AS pool_rows, CAST(SUM(COUNT(*)) OVER () - COUNT(*) AS BIGINT) AS training_rows FROM pool GROUP BY fold")
def fold_training_rows(fx: Fixtures):
    return S.with_training_rows(fx.pool.groupBy("fold").agg(F.count(F.lit(1)).alias("pool_rows")), "pool_rows")


@register("fold_rows_with_mean_std", "A25 T2", """
    f AS (SELECT fold, COUNT(*)::DOUBLE AS n, avg(dist_m) AS d FROM sf GROUP BY fold)
    SELECT CAST(fold AS VARCHAR) AS fold, round(n, 4) AS n, round(d, 4) AS d FROM f UNION ALL SELECT 'mean', round(avg(n), 4), round(avg(d), 4) FROM f UNION ALL SELECT 'std', round(stddev_samp(n), 4), round(stddev_samp(d), 4) FROM f""")
def fold_rows_with_mean_std(fx: Fixtures):
    f = fx.samples_fold.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(DIST).alias("d"))
    return _round(S.append_mean_std(f, "fold", ["n", "d"]), 4, "n", "d")


@register("event_state_counts", "A26", "SELECT event_type AS status, COUNT(*) AS n FROM events GROUP BY 1")
def event_state_counts(fx: Fixtures):
    return A.state_counts(fx.table("events").withColumnRenamed("event_type", "status")).orderBy("status")


@register("tile_coverage", "A30 P8", """
    v AS (SELECT tile_id, year, bands[1] AS b1, list_min([b for b in bands if b <> 0]) AS lo, list_max([b for b in bands if b <> 0]) AS hi FROM til)
    SELECT tile_id, year, round((min(lo) - 128) / 127.0::DOUBLE, 6) AS decoded_min, round((max(hi) - 128) / 127.0::DOUBLE, 6) AS decoded_max, round(avg(CAST(b1 = 0 AS INTEGER)), 9) AS nodata_frac FROM v GROUP BY 1, 2""")
def tile_coverage(fx: Fixtures):
    return _round(_round(S.coverage_stats(fx.tiles, ["tile_id", "year"]), 6, "decoded_min", "decoded_max"), 9, "nodata_frac")


@register("patch_difference", "A31 T2", """
    v AS (SELECT row, col, year, unnest(bands) AS b, generate_subscripts(bands, 1) AS band FROM til)
    SELECT CAST(x.band AS INTEGER) AS band, COUNT(*) FILTER (x.b <> y.b) AS n_diff, CAST(max(abs(x.b - y.b)) AS INTEGER) AS max_abs_diff FROM v x JOIN v y ON x.row = y.row AND x.col = y.col AND x.band = y.band WHERE x.year = 2018 AND y.year = 2019
    GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5""")
def patch_difference(fx: Fixtures):
    """Compare two yearly rasters cell by cell; the five worst bands."""
    a, b = (fx.tiles.where(F.col("year") == y) for y in (2018, 2019))
    return O.top_by(A.patch_difference(a, b, ["row", "col"], "bands"), 5, F.desc("max_abs_diff"), F.asc("band"))


@register("block_size_summary", "A32", """
    SELECT min(n) AS min_n, max(n) AS max_n, median(n) AS median_n, COUNT(*) FILTER (n < 100) AS small_blocks, round(100.0::DOUBLE * coalesce(SUM(n) FILTER (n < 100), 0) / SUM(n), 6) AS small_rows_pct FROM blk""")
def block_size_summary(fx: Fixtures):
    return _round(S.block_size_summary(fx.blocks, 100), 6, "small_rows_pct")


@register("equal_count_distance_bins", "W6", """
    SELECT bin, COUNT(*) AS n, round(min(dist_m), 4) AS low, round(max(dist_m), 4) AS high FROM (SELECT dist_m, CAST(ntile(10) OVER (ORDER BY dist_m) - 1 AS INTEGER) AS bin FROM smp) GROUP BY bin""")
def equal_count_distance_bins(fx: Fixtures):
    r = O.global_rank(fx.stored.select("row", "col", DIST), [], DIST, ["row", "col"])
    g = r.groupBy(O.equal_count_bin(F.col("pos"), F.col("tot_n"), 10).alias("bin"))
    return _round(g.agg(F.count(F.lit(1)).alias("n"), F.min(DIST).alias("low"), F.max(DIST).alias("high")), 4, "low", "high")


@register("block_size_order", "W9 T1", """
    SELECT block_id, CAST(row_number() OVER (ORDER BY n DESC, (('0x' || substr(md5(block_id || '|0'), 1, 8))::BIGINT), block_id) - 1 AS BIGINT) AS pos FROM blk""")
def block_size_order(fx: Fixtures):
    return O.global_rank(fx.blocks, [], "n", ["block_id"], 0, descending=True, method="md5").select("block_id", "pos")


@register("exact_pixel_sample", "D6", """
    SELECT row, col, label FROM smp ORDER BY (('0x' || substr(md5(concat_ws('|', row, col, '5')), 1, 8))::BIGINT), row, col LIMIT 2000""")
def exact_pixel_sample(fx: Fixtures):
    """A sample of exactly 2,000 pixels, decided by key hash."""
    return O.exact_sample(fx.stored.select("row", "col", "label"), ["row", "col"], 2000, 5, "md5")


@register("quantiles_with_nan_and_infinity", "A7 A11", """
    v AS (SELECT l_returnflag AS flag, CASE WHEN l_orderkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 13 = 0 THEN 'Infinity'::DOUBLE WHEN l_orderkey % 17 = 0 THEN '-Infinity'::DOUBLE ELSE l_extendedprice * l_discount - 500 END AS x FROM lineitem)
    SELECT flag, round(quantile_cont(x, 0.0), 6) AS q00, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 1.0), 6) AS q100 FROM v GROUP BY 1""")
def quantiles_with_nan_and_infinity(fx: Fixtures):
    """Order statistics of doubles with both infinities and NaN, which comes last."""
    k = F.col("l_orderkey")
    x = (
        F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).when(k % 17 == 0, float("-inf"))
        .otherwise(F.col("l_extendedprice") * F.col("l_discount") - 500)
    )
    v = fx.table("lineitem").select(F.col("l_returnflag").alias("flag"), x.alias("x"))
    named = {"q00": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    return O.quantile_columns(v, ["flag"], "x", named).select("flag", *[F.round(c, 6).alias(c) for c in named])
