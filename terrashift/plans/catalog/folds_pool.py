"""Fold assignment, calibration, draws, samples and dataset reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.operators import folds as fo
from terrashift.operators import pool as po
from terrashift.operators import summaries as S
from terrashift.plans.fixtures import DIST, FOLDS, K, POOL, Fixtures, sql_uniform
from terrashift.plans.registry import register


def _round(df, digits: int, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("snake_fold_assignment", "D7 W9", "SELECT block_id, n, n1, n2, fold FROM fld")
def snake_fold_assignment(fx: Fixtures):
    return fx.folds


@register("balanced_fold_assignment", "D7 D8")
def balanced_fold_assignment(fx: Fixtures):
    """Snake draft improved by swaps; iterative, so there is no SQL form."""
    return fo.balanced_folds(fx.blocks, FOLDS, method="md5")


@register("balanced_fold_quotas", "D7 D8", """
    SELECT CAST(f AS INTEGER) AS fold, CAST(b // 5 + CAST(f < b % 5 AS INTEGER) AS BIGINT) AS blocks, true AS not_worse FROM tgt, (SELECT unnest(range(0, 5)) AS f)""")
def balanced_fold_quotas(fx: Fixtures):
    """Block quotas are exact and the swaps never raise the imbalance of the draft."""
    def cost(df):
        t = df.groupBy("fold").agg(*[F.sum(c).cast("double").alias(c) for c, _ in FOLDS.weights])
        parts = [F.lit(w) * F.sum(F.pow(F.col(c), 2.0)) / F.pow(F.avg(c), 2.0) for c, w in FOLDS.weights]
        return t.agg((parts[0] + parts[1] + parts[2]).alias("c"))

    balanced = fo.balanced_folds(fx.blocks, FOLDS, method="md5")
    before = cost(fx.folds).scalar()
    out = balanced.groupBy("fold").agg(F.count(F.lit(1)).alias("blocks"))
    return out.withColumn("not_worse", cost(balanced).scalar() <= before + F.lit(1e-9))


@register("fold_acceptance", "D8", """
    f AS (SELECT fold, COUNT(*) AS blocks, SUM(n) AS r, SUM(n1) AS n1, SUM(n2) AS n2 FROM fld GROUP BY fold),
    w AS (SELECT max(abs((r / (SELECT avg(r) FROM f) - 1) * 100)) AS wr, max(abs((n1 / (SELECT avg(n1) FROM f) - 1) * 100)) AS w1, max(abs((n2 / (SELECT avg(n2) FROM f) - 1) * 100)) AS w2, max(blocks) - min(blocks) AS s FROM f)
    SELECT round(wr, 6) AS worst_rows, round(w1, 6) AS worst_n1, round(w2, 6) AS worst_n2, s AS quota_spread, greatest(wr, w1, w2) < 25 AND s <= 1 AS accepted FROM w""")
def fold_acceptance(fx: Fixtures):
    return _round(fo.accept(S.fold_summary(fx.folds), 25.0), 6, "worst_rows", "worst_n1", "worst_n2")


@register("swap_fold_acceptance", "D7 D8", "SELECT b % 5 <> 0 AS uneven_quota, true AS rows_ok, true AS n1_ok, true AS n2_ok, true AS accepted FROM tgt")
def swap_fold_acceptance(fx: Fixtures):
    """The swap result against the rule of production: every fold within 1 % of the mean in rows and in both classes."""
    r = fo.accept(S.fold_summary(fo.balanced_folds(fx.blocks, FOLDS, method="md5")), 1.0)
    return r.select(
        (F.col("quota_spread") == 1).alias("uneven_quota"), (F.col("worst_rows") < 1).alias("rows_ok"), (F.col("worst_n1") < 1).alias("n1_ok"),
        (F.col("worst_n2") < 1).alias("n2_ok"), "accepted",
    )


@register("fold_calibration", "D1 A3", """
    SELECT fold, n, n1, n2, n0, budget0, round(mean_decay, 9) AS mean_decay, round(a, 8) AS a, round(p_max, 8) AS p_max,
      CASE WHEN budget0 <= 0 THEN 'rare classes exceed the budget' WHEN NOT a > 0 THEN 'floor exceeds the budget' WHEN NOT p_max < 1 THEN 'keep rate saturates' ELSE 'ok' END AS verdict FROM cal""")
def fold_calibration(fx: Fixtures):
    return _round(_round(fx.calibration, 9, "mean_decay"), 8, "a", "p_max")


@register("infeasible_calibration", "D1", """
    SELECT fold, CASE WHEN 10 - 2 * n1 - n2 <= 0 THEN 'rare classes exceed the budget' ELSE 'other' END AS verdict FROM cal0""")
def infeasible_calibration(fx: Fixtures):
    """A budget that the rare classes alone exceed is reported, not drawn."""
    return po.fold_calibration(fx.samples_fold, DIST, POOL, 10).select("fold", "verdict")


@register("natural_positive_multiplier", "D2", "SELECT round(m, 8) AS pos_weight_mult FROM mul")
def natural_positive_multiplier(fx: Fixtures):
    return _round(po.natural_multiplier(fx.calibration), 8, "pos_weight_mult")


@register("inclusion_probabilities", "D3 X1", "SELECT row, col, fold, label, round(p_include, 7) AS p_include FROM scr")
def inclusion_probabilities(fx: Fixtures):
    c = F.broadcast(fx.calibration.select("fold", "a"))
    p = E.inclusion_probability(F.col("label"), F.col(DIST), F.col("a"), POOL.tau_m, POOL.floor)
    return fx.samples_fold.join(c, "fold").select("row", "col", "fold", "label", F.round(p, 7).alias("p_include"))


@register("key_hash_uniform", "X3", f"SELECT row, col, {sql_uniform('row', 'col', seed=42)} AS u FROM smp")
def key_hash_uniform(fx: Fixtures):
    return fx.stored.select("row", "col", E.uniform([F.col("row"), F.col("col")], 42, "md5").alias("u"))


@register("weighted_pool_draw", "D4 U1 J3 X10", """
    SELECT row, col, block_id, fold, label, label_bin, is_dup, round(p_include, 7) AS p_include, round(sample_weight, 6) AS sample_weight FROM pool""")
def weighted_pool_draw(fx: Fixtures):
    p = fx.pool.select("row", "col", "block_id", "fold", "label", "label_bin", "is_dup", "p_include", "sample_weight")
    return _round(_round(p, 7, "p_include"), 6, "sample_weight")


@register("fast_hash_pool_draw", "D4")
def fast_hash_pool_draw(fx: Fixtures):
    """The same draw with the fast hash; equal in distribution, so there is no SQL form."""
    from dataclasses import replace

    return po.draw(fx.samples_fold, fx.calibration, DIST, replace(POOL, hash_method="xxhash")).select(
        "row", "col", "fold", "label", "is_dup", "sample_weight"
    )


@register("fold_key_sample", "D5", f"""
    r AS (SELECT fold, least(1.0::DOUBLE, 500.0::DOUBLE / COUNT(*)) AS rate FROM sf GROUP BY fold)
    SELECT row, col, fold FROM sf JOIN r USING (fold) WHERE {sql_uniform('row', 'col', seed=99)} < rate""")
def fold_key_sample(fx: Fixtures):
    return po.fold_sample(fx.samples_fold, 500, 99, "md5").select("row", "col", "fold")


@register("independent_key_samples", "D5", f"""
    SELECT COUNT(*) FILTER (a < 0.2::DOUBLE) AS first, COUNT(*) FILTER (b < 0.2::DOUBLE) AS second, COUNT(*) FILTER (a < 0.2::DOUBLE AND b < 0.2::DOUBLE) AS both FROM (SELECT {sql_uniform('row', 'col', seed=99)} AS a, {sql_uniform('row', 'col', seed=21)} AS b FROM smp)""")
def independent_key_samples(fx: Fixtures):
    k = [F.col("row"), F.col("col")]
    a, b = E.uniform(k, 99, "md5") < 0.2, E.uniform(k, 21, "md5") < 0.2
    return fx.stored.agg(F.count_if(a).alias("first"), F.count_if(b).alias("second"), F.count_if(a & b).alias("both"))


@register("stratified_batches", "D9", f"""
    z AS (SELECT avg(ln(1 + dist_m)) AS m, stddev_samp(ln(1 + dist_m)) AS s FROM smp),
    st AS (SELECT row, col, CASE WHEN label = 1 THEN 'positive' WHEN (ln(1 + dist_m) - m) / s <= -1 THEN 'near' ELSE 'other' END AS stratum FROM smp, z),
    rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {sql_uniform('row', 'col', seed=3)}, row, col) - 1 AS pos, COUNT(*) OVER (PARTITION BY stratum) AS k FROM st),
    sl AS (SELECT b AS batch, s AS slot, CASE WHEN s < 6 THEN 'positive' WHEN s < 12 THEN 'near' ELSE 'other' END AS stratum FROM (SELECT unnest(range(0, (SELECT COUNT(*) // 64 FROM smp))) AS b), (SELECT unnest(range(0, 64)) AS s)),
    dr AS (SELECT sl.*, floor({sql_uniform('batch', 'slot', seed=4)} * k) AS pos FROM sl JOIN (SELECT DISTINCT stratum, k FROM rk) USING (stratum))
    SELECT CAST(batch AS INTEGER) AS batch, CAST(slot AS INTEGER) AS slot, dr.stratum, row, col FROM dr JOIN rk ON dr.stratum = rk.stratum AND dr.pos = rk.pos""")
def stratified_batches(fx: Fixtures):
    z = fx.stored.agg(F.struct(F.avg(F.log1p(DIST)).alias("m"), F.stddev_samp(F.log1p(DIST)).alias("s"), F.count(F.lit(1)).alias("n")).alias("z"))
    stats = z.first()["z"]
    s = fx.stored.select(
        "row", "col", po.stratum((F.col("label") == 1).cast("int"), (F.log1p(DIST) - stats["m"]) / stats["s"]).alias("stratum")
    )
    return po.stratified_batches(s, ["row", "col"], stats["n"] // 64, 64, {"positive": 0.1, "near": 0.1}, "other", 3, "md5")


@register("block_subsamples", "D10", f"""
    r AS (SELECT block_id, CAST(run AS INTEGER) AS run, row_number() OVER (PARTITION BY run ORDER BY {sql_uniform('block_id', 'run', seed=0)}, block_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY run) AS k FROM blk, (SELECT unnest(range(0, 20)) AS run))
    SELECT block_id, run FROM r WHERE pos < floor(0.8::DOUBLE * k)""")
def block_subsamples(fx: Fixtures):
    return po.subsample_runs(fx.blocks.select("block_id"), "block_id", 20, 0.8, 0, "md5")


@register("positive_weight_check", "D11", "SELECT COUNT(*) FILTER (label = 1) AS positives, CAST(0 AS BIGINT) AS wrong_weight FROM pool")
def positive_weight_check(fx: Fixtures):
    m = po.natural_multiplier(fx.calibration).scalar()
    return po.positive_weight_errors(fx.pool, m / POOL.dup)


_COMP = """fold, COUNT(*) AS pool_rows, COUNT(*) FILTER (label = 0) AS pool_n0, COUNT(*) FILTER (label = 1) AS pool_n1, COUNT(*) FILTER (label = 2) AS pool_n2, round(SUM(sample_weight), 4) AS sum_w,
      round(avg(sample_weight), 6) AS mean_weight, round(100.0::DOUBLE * COUNT(*) FILTER (label = 1) / COUNT(*), 6) AS pos_share_rows_pct, round(100 * SUM(CASE WHEN label = 1 THEN sample_weight ELSE 0 END) / SUM(sample_weight), 6) AS pos_share_weight_pct,
      round(pow(SUM(sample_weight), 2) / SUM(sample_weight * sample_weight), 4) AS kish_ess FROM pool GROUP BY fold"""


@register("pool_composition", "A6", f"SELECT {_COMP}")
def pool_composition(fx: Fixtures):
    c = S.pool_composition(fx.pool, ["fold"])
    return _round(_round(c, 6, "mean_weight", "pos_share_rows_pct", "pos_share_weight_pct"), 4, "sum_w", "kish_ess")


@register("dataset_report", "D12 A6 J18", f"""
    p AS (SELECT {_COMP}), b AS (SELECT fold, COUNT(*) AS blocks FROM fld GROUP BY fold),
    n AS (SELECT fold, COUNT(*) AS nat_rows, COUNT(*) FILTER (label = 0) AS nat_n0, COUNT(*) FILTER (label = 1) AS nat_n1, COUNT(*) FILTER (label = 2) AS nat_n2,
      round(100.0::DOUBLE * COUNT(*) FILTER (label = 1) / COUNT(*), 6) AS nat_prevalence_pct, round(COUNT(*) FILTER (label = 1) * 900 / {C.M2_PER_ACRE}::DOUBLE, 4) AS converted_acres FROM sf GROUP BY fold)
    SELECT * FROM n JOIN p USING (fold) JOIN b USING (fold)""")
def dataset_report(fx: Fixtures):
    r = po.dataset_report(fx.samples_fold, fx.pool, fx.folds)
    r = _round(r, 6, "mean_weight", "pos_share_rows_pct", "pos_share_weight_pct", "nat_prevalence_pct")
    return _round(r, 4, "sum_w", "kish_ess", "converted_acres")


_Q = ", ".join(f"round(quantile_cont(dist_m, {p}), 8) AS p{round(p * 100)}" for p in C.REPORT_PROBS) + ", round(avg(dist_m), 6) AS mean"


@register("dataset_distance_report", "D12 A7 U2", f"""
    SELECT fold, 'natural_label0' AS dist_set, {_Q} FROM sf WHERE label = 0 GROUP BY fold UNION ALL SELECT fold, 'pool_label0', {_Q} FROM pool WHERE label = 0 GROUP BY fold
    UNION ALL SELECT fold, 'natural_label1', {_Q} FROM sf WHERE label = 1 GROUP BY fold UNION ALL SELECT fold, 'natural_label2', {_Q} FROM sf WHERE label = 2 GROUP BY fold""")
def dataset_distance_report(fx: Fixtures):
    r = po.distance_report(fx.samples_fold, fx.pool, DIST)
    return _round(_round(r, 8, *[f"p{round(p * 100)}" for p in C.REPORT_PROBS]), 6, "mean")


@register("normalised_distance", "D13 X1", """
    n AS (SELECT CAST(h AS INTEGER) AS h, avg(ln(1 + dist_m)) AS m, stddev_samp(ln(1 + dist_m)) AS s FROM sf, (SELECT unnest(range(0, 5)) AS h) WHERE fold <> h GROUP BY h)
    SELECT row, col, fold, round((ln(1 + dist_m) - m) / s, 7) AS dist_z FROM sf JOIN n ON fold = h""")
def normalised_distance(fx: Fixtures):
    """Each row normalised with the statistics of the other folds only."""
    n = S.leave_out_normaliser(S.fold_moments(fx.samples_fold, DIST), K).withColumnRenamed("held_out", "fold")
    return fx.samples_fold.join(F.broadcast(n), "fold").select(
        "row", "col", "fold", F.round((F.log1p(DIST) - F.col("log_mean")) / F.col("log_std"), 7).alias("dist_z")
    )


@register("mean_normalised_weights", "D14", "SELECT row, col, is_dup, round(sample_weight / avg(sample_weight) OVER (PARTITION BY fold), 6) AS weight_norm FROM pool")
def mean_normalised_weights(fx: Fixtures):
    return _round(po.mean_normalised(fx.pool, "sample_weight", ["fold"]).select("row", "col", "is_dup", "weight_norm"), 6, "weight_norm")


@register("unboosted_pool_weights", "X9 X10", """
    SELECT fold, round(SUM(CASE WHEN label = 1 THEN sample_weight / m ELSE sample_weight END), 4) AS natural_weight, round(SUM(p_include / (p_include + m * (1 - p_include))), 6) AS p_sum FROM pool, mul GROUP BY fold""")
def unboosted_pool_weights(fx: Fixtures):
    m = po.natural_multiplier(fx.calibration).scalar()
    return fx.pool.withColumn("m", m).groupBy("fold").agg(
        F.round(F.sum(E.natural_weight(F.col("sample_weight"), F.col("label"), F.col("m"))), 4).alias("natural_weight"),
        F.round(F.sum(E.unboost(F.col("p_include"), F.col("m"))), 6).alias("p_sum"),
    )




@register("pool_counts_by_fold", "A17 A6", "SELECT fold, COUNT(*) FILTER (label_bin = 0) AS bin_0, COUNT(*) FILTER (label_bin = 1) AS bin_1 FROM pool GROUP BY fold")
def pool_counts_by_fold(fx: Fixtures):
    return S.crosstab(fx.pool, "fold", "label_bin", [0, 1], "bin_")


@register("pool_distance_histogram", "A22", "SELECT fold, CAST(floor(log10(dist_m) / 0.05::DOUBLE) AS BIGINT) AS bin_idx, COUNT(*) AS n FROM pool GROUP BY 1, 2")
def pool_distance_histogram(fx: Fixtures):
    return S.log_histogram(fx.pool, ["fold"], DIST).drop("left_m", "right_m")


@register("pool_distance_ecdf", "A9", f"""
    SELECT fold, k.i AS knot, round(quantile_cont(dist_m, [{", ".join(f"{p:.4f}" for p in C.ECDF_PROBS)}])[k.i + 1], 8) AS q FROM pool, (SELECT unnest(range(0, 199))::INTEGER AS i) k WHERE label = 0 GROUP BY fold, k.i""")
def pool_distance_ecdf(fx: Fixtures):
    return S.ecdf(fx.pool.where("label = 0"), ["fold"], DIST, "pool").select("fold", "knot", F.round("q", 8).alias("q"))
