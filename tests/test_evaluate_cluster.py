"""Metrics and clustering measures against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrashift.config import ClusterSpec
from terrashift.operators import cluster as cl
from terrashift.operators import evaluate as V


@pytest.fixture(scope="module")
def scored():
    rng = np.random.default_rng(9)
    y = (rng.random(600) < 0.2).astype(int)
    s = np.where(rng.random(600) < 0.35, 0.25, (0.4 * y + rng.random(600) * 0.6).round(2))
    return pd.DataFrame({"id": range(600), "fold": np.arange(600) % 2, "label": y, "y_score": s, "dist_m": rng.random(600) * 100})


def direct(part):
    y, s = part["label"].to_numpy(), part["y_score"].to_numpy()
    t = np.unique(s)[::-1]
    tp = np.array([((s >= v) & (y == 1)).sum() for v in t], float)
    fp = np.array([((s >= v) & (y == 0)).sum() for v in t], float)
    p, r = tp / (tp + fp), tp / y.sum()
    ap = np.sum(np.diff(np.r_[0, r]) * p)
    tr = np.sum(np.diff(np.r_[0, r]) * (p + np.r_[1, p[:-1]]) / 2)
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    auc = ((pos > neg) + 0.5 * (pos == neg)).mean()
    f1 = 2 * p * r / np.maximum(p + r, 1e-300)
    best = np.flatnonzero(f1 == f1.max())[-1]
    return ap, tr, auc, t[best], f1[best]


def test_rank_metrics_with_ties(spark, scored):
    curve = V.score_curve(spark.createDataFrame(scored), ["fold"], "y_score", "label")
    m = V.rank_metrics(curve, ["fold"]).join(V.best_f1(curve, ["fold"]), "fold").collect()
    for r in m:
        ap, tr, auc, t, f1 = direct(scored[scored.fold == r["fold"]])
        assert (r["avg_precision"], r["pr_auc"], r["roc_auc"]) == pytest.approx((ap, tr, auc))
        assert (r["best_threshold"], r["f1"]) == pytest.approx((t, f1))
        assert 0 <= r["roc_auc"] <= 1


def test_reliability_bins(spark, scored):
    r = V.reliability(spark.createDataFrame(scored), ["fold"], "y_score", "label", ["id"], 10).toPandas()
    assert (r["n"] == 30).all() and len(r) == 20
    assert (r.sort_values(["fold", "bin"]).groupby("fold")["pred_mean"].diff().dropna() >= 0).all()
    assert r["obs_rate"].mul(r["n"]).sum() == pytest.approx(scored["label"].sum())


def test_unboost_inverts_a_prior_shift(spark):
    from terrashift.functions.expressions import unboost

    df = spark.createDataFrame([(p,) for p in (0.001, 0.2, 0.9)], "p double")
    boosted = df.withColumn("b", F.col("p") * 355 / (F.col("p") * 355 + 1 - F.col("p")))
    for r in boosted.withColumn("u", unboost(F.col("b"), 355.0)).collect():
        assert r["u"] == pytest.approx(r["p"])


def test_decile_metrics_report_undefined_as_null(spark, scored):
    edges = F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40, 50, 60, 70, 80, 200)])
    out = V.decile_metrics(spark.createDataFrame(scored), "y_score", "label", "dist_m", edges).toPandas()
    assert len(out) == 20 and out["n"].sum() == 600
    last = out[out.decile == 9]
    assert (last["n"] == 0).all() and last["precision"].isna().all()


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3 + 1) % 3, (i * 7 // 5) % 2) for i in range(60)], "i int, a int, b int, c int")
    assert cl.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)
    assert abs(cl.adjusted_rand(df, "a", "c").first()[0]) < 0.2


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.random((70, 5))
    lab = rng.integers(0, 3, 70)
    lab[0] = 9
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    sil = []
    for i in range(70):
        own = lab == lab[i]
        if own.sum() == 1:
            sil.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(lab) - {lab[i]})
        sil.append((b - a) / max(a, b))
    df = spark.createDataFrame([(f"k{i}", int(lab[i]), [float(v) for v in x[i]]) for i in range(70)], "key0 string, l int, v array<double>")
    for chunk in (16, 1000):
        assert cl.silhouette(df, "key0", "l", "v", chunk).first()[0] == pytest.approx(np.mean(sil))


def test_clusters_are_numbered_near_to_far(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = [50.0, 500.0, 5000.0][i % 3]
        q = np.sort(base * np.exp(rng.normal(0, 0.2, 39)))
        rows.append((f"b{i:04d}_0000", 10 if i < 3 else 1000, [float(v) for v in q]))
    p = spark.createDataFrame(rows, "block_id string, n bigint, q array<double>")
    out = cl.cluster_blocks(p, ClusterSpec(k=3, n_init=3)).toPandas()
    assert len(out) == 60 and out["is_small"].sum() == 3
    assert (out["cluster"] == out["block_id"].str[1:5].astype(int) % 3).all()
    shares = cl.variance_shares(cl.log_profiles(p)).first()
    assert shares["level_share"] + shares["shape_share"] + shares["cross_share"] == pytest.approx(1.0)
