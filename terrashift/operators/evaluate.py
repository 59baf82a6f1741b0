"""Rank metrics, operating points, calibration and error breakdowns of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.operators.ordered import equal_count_bin, global_rank, magnitude_bucket, running_totals


def score_counts(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives of every group and distinct score: all that a curve needs of the rows."""
    return scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )


def score_curve(scored: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """One row per group and distinct score with cumulative hits from the highest score down.

    Ties share a row, as a threshold cannot separate them. Precision, recall and the false-positive rate follow.
    """
    return curve_of_counts(score_counts(scored, keys, score, label), keys)


def curve_of_counts(tied: DataFrame, keys: list[str]) -> DataFrame:
    """The same from ``score_counts``."""
    run = running_totals(
        tied, keys, magnitude_bucket(F.col("threshold")), [F.desc("threshold")],
        {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True,
    ).select(*keys, "threshold", "pos", "neg", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
             F.col("tot_tp").alias("n_pos"), F.col("tot_fp").alias("n_neg"))
    return run.withColumns(
        {
            "precision": E.ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": E.ratio(F.col("tp"), F.col("n_pos")),
            "fpr": E.ratio(F.col("fp"), F.col("n_neg")),
        }
    )


def rank_metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision, trapezoid PR-AUC and ROC-AUC, all from per-row terms of the curve."""
    step = E.ratio(F.col("pos"), F.col("n_pos"))
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    prev = F.coalesce(E.ratio(tp0, tp0 + fp0), F.lit(1.0))
    area = E.ratio(F.col("neg") * (F.col("tp") - F.col("pos") / 2), F.col("n_pos") * F.col("n_neg"))
    return curve.groupBy(*keys).agg(
        F.sum(step * F.col("precision")).alias("avg_precision"),
        F.sum(step * (F.col("precision") + prev) / 2).alias("pr_auc"),
        F.sum(area).alias("roc_auc"),
    )


def best_f1(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold with the best F1 per group (lowest on ties) and what it gives."""
    p, r = F.col("precision"), F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    acc = E.ratio(F.col("tp") + F.col("n_neg") - F.col("fp"), F.col("n_pos") + F.col("n_neg"))
    top = curve.groupBy(*keys).agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t"), p.alias("precision"), r.alias("recall"), acc.alias("accuracy"))).alias("m")
    )
    return top.select(
        *keys, (-F.col("m.t")).alias("best_threshold"), "m.precision", "m.recall", "m.f1", "m.accuracy"
    )


def calibration_errors(scored: DataFrame, keys: list[str], label: str, p_cal: str, p_iso: str | None = None) -> DataFrame:
    """Prevalence, Brier score and predicted against actual area."""
    y, p = F.col(label), F.col(p_cal)
    aggs = [
        F.avg(y).alias("prevalence"),
        F.avg((p - y) * (p - y)).alias("brier"),
        (F.sum(p) * C.PIXEL_ACRES).alias("pred_acres"),
        (F.sum(y) * C.PIXEL_ACRES).alias("actual_acres"),
        (100 * (E.ratio(F.sum(p), F.sum(y)) - 1)).alias("acres_error_pct"),
    ]
    if p_iso:
        aggs.append((100 * (E.ratio(F.sum(p_iso), F.sum(y)) - 1)).alias("acres_error_isotonic_pct"))
    return scored.groupBy(*keys).agg(*aggs)


def fold_metrics(scored: DataFrame, keys: list[str], score: str, label: str, mult: float, p_iso: str | None = None) -> DataFrame:
    """Everything a fold summary row holds; the threshold is reported on the calibrated scale."""
    curve = score_curve(scored, keys, score, label)
    cal = calibration_errors(scored.withColumn("_p", E.unboost(F.col(score), mult)), keys, label, "_p", p_iso)
    best = best_f1(curve, keys).withColumn("best_threshold", E.unboost(F.col("best_threshold"), mult))
    return rank_metrics(curve, keys).join(best, keys).join(cal, keys)


def reliability(scored: DataFrame, keys: list[str], score: str, label: str, tie: list[str], bins: int = 10, method: str = "xxhash") -> DataFrame:
    """Predicted against observed rate in equal-count bins of the score."""
    ranked = global_rank(scored, keys, score, tie, method=method)
    return (
        ranked.withColumn("bin", equal_count_bin(F.col("pos"), F.col("tot_n"), bins))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("pred_mean"), F.avg(F.col(label)).alias("obs_rate"))
    )


def threshold_metrics(scored: DataFrame, keys: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Precision (0 where undefined), recall and accuracy at a fixed threshold."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(y).alias("n_positive"),
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(hit == y).alias("right"),
    )
    return agg.select(
        *keys, "n_rows", "n_positive",
        F.coalesce(E.ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
        F.coalesce(E.ratio(F.col("tp"), F.col("n_positive")), F.lit(0.0)).alias("recall"),
        E.ratio(F.col("right"), F.col("n_rows")).alias("accuracy"),
    )


def fold_role(fold: Column, screen: int, validation: int) -> Column:
    """What a fold was to a screened model."""
    return F.when(fold == screen, "unseen").when(fold == validation, "stopping rule").otherwise("learned from")


def with_prediction(scored: DataFrame, thresholds: DataFrame, score: str) -> DataFrame:
    """Thresholded prediction; ``thresholds`` holds one row per fold."""
    t = F.broadcast(thresholds.select("fold", F.col("best_threshold").alias("_t")))
    return scored.join(t, "fold").withColumn("y_pred", (F.col(score) >= F.col("_t")).cast("int")).drop("_t")


def decile_metrics(scored: DataFrame, score: str, label: str, dist: str, edges: Column, n_edges: int = 9) -> DataFrame:
    """Precision and recall per fold and distance bin at each fold's own best-F1 threshold; undefined is null."""
    best = best_f1(score_curve(scored, ["fold"], score, label), ["fold"])
    tagged = with_prediction(scored, best, score).withColumn("decile", E.digitize(F.col(dist), edges, n_edges))
    hit, y = F.col("y_pred") == 1, F.col(label) == 1
    agg = tagged.groupBy("fold", "decile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("n_pos"),
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
    )
    grid = (
        scored.select("fold").distinct()
        .withColumn("decile", F.explode(F.sequence(F.lit(0), F.lit(n_edges))))
    )
    zero = F.lit(0).cast("bigint")
    full = grid.join(agg, ["fold", "decile"], "left").select(
        "fold", "decile", *[F.coalesce(c, zero).alias(c) for c in ("n", "n_pos", "tp", "fp")]
    )
    return full.select(
        "fold", "decile", "n", "n_pos",
        E.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        E.ratio(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def spatial_outcomes(sample: DataFrame, thresholds: DataFrame, score: str, mult: float) -> DataFrame:
    """Calibrated score, prediction and confusion outcome of a map sample (thresholds on the calibrated scale)."""
    cal = sample.withColumn("score", E.unboost(F.col(score), mult)).withColumn("label_bin", (F.col("label") == 1).cast("int"))
    out = with_prediction(cal, thresholds, "score")
    return out.select(
        "x", "y", "fold", "label", "label_bin", "score", "y_pred",
        E.confusion_tag(F.col("label_bin"), F.col("y_pred")).alias("outcome"),
    )


def log_scale_clip(df: DataFrame, score: str, floor: float = 1e-5) -> DataFrame:
    """Score lifted to the smallest positive score (at least ``floor``) for display on a log scale."""
    low = df.agg(F.greatest(F.min(F.when(F.col(score) > 0, F.col(score))), F.lit(floor)).alias("v")).scalar()
    return df.withColumn("score_clipped", F.greatest(F.col(score), low))


def mean_logloss(df: DataFrame, keys: list[str], logit: str, label: str, weight: str) -> DataFrame:
    loss = E.weighted_logloss(F.col(logit), F.col(label)) * F.col(weight)
    return df.groupBy(*keys).agg(E.ratio(F.sum(loss), F.sum(weight)).alias("logloss"))


def best_group(metrics: DataFrame, key: str, metric: str) -> DataFrame:
    """Group with the best metric; the smaller key on ties."""
    top = metrics.agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col(key)).alias("k"))).alias("t"))
    return top.select((-F.col("t.k")).cast("int").alias(key), F.col("t.m").alias(metric))
