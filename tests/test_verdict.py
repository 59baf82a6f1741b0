"""Deliveries, fold search, silhouettes, calibration and the distance transform's cost."""

import time
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.operators import cluster as cl
from terrashift.operators import folds as fo
from terrashift.operators import models as M
from terrashift.operators import raster as R
from terrashift.session import scratch_path
from terrashift.streaming.pickup import pick_up_new_tiles


def test_a_tile_in_two_deliveries_stays_whole(spark):
    inbox, sink, ck = (scratch_path(spark, n) for n in ("inbox", "sink", "ck"))
    schema = "tile_id string, v int"
    for part in ([("a", i) for i in range(10)], [("a", i) for i in range(10, 20)] + [("b", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(inbox)
        pick_up_new_tiles(spark, inbox, spark.createDataFrame(part, schema).schema, lambda b: b, sink, ck).awaitTermination()
    got = {(r.tile_id, r.n) for r in spark.read.parquet(sink).groupBy("tile_id").agg(F.count_distinct("v").alias("n")).collect()}
    assert got == {("a", 20), ("b", 1)}


def test_swaps_come_near_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{i:04d}_0000", int(rng.integers(50, 900)), int(rng.integers(0, 40)), int(rng.integers(0, 60))) for i in range(40)]
    spec = C.FoldSpec(k=4, seed=1)
    blocks = spark.createDataFrame(rows, "block_id string, n bigint, n1 bigint, n2 bigint")
    draft = {r.block_id: r.fold for r in fo.snake_folds(blocks, spec).collect()}
    value = {b: {"n": n, "n1": p, "n2": q} for b, n, p, q in rows}

    def cost(folds):
        t = {f: {c: float(sum(v[c] for b, v in value.items() if folds[b] == f)) for c in ("n", "n1", "n2")} for f in range(4)}
        return fo.imbalance(t, spec)

    best, now = dict(draft), cost(draft)
    while True:
        trial = min(((cost({**best, a: best[b], b: best[a]}), a, b) for a, b in combinations(best, 2) if best[a] != best[b]))
        if trial[0] >= now - 1e-12:
            break
        now, a, b = trial
        best[a], best[b] = best[b], best[a]
    got = {r.block_id: r.fold for r in fo.balanced_folds(blocks, spec).collect()}
    assert cost(got) <= 4 * now + 1e-4 and cost(got) <= 0.1 * cost(draft)


def test_silhouettes_can_be_counted(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (30, 3)) for c in (0, 4, 9)])
    label = np.repeat([0, 1, 2], 30)
    df = spark.createDataFrame([(f"k{i}", int(l), [float(v) for v in r]) for i, (l, r) in enumerate(zip(label, x))], "k string, l int, v array<double>")
    for square in (False, True):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        d = d if square else np.sqrt(d)
        mean = np.stack([d[:, label == c].sum(1) / ((label == c).sum() - (label == c)) for c in range(3)], 1)
        a = mean[np.arange(90), label]
        b = np.where(np.arange(3)[None] == label[:, None], np.inf, mean).min(1)
        want = ((b - a) / np.maximum(a, b)).mean()
        s = cl.squared_silhouette(df, "k", "l", "v", 3) if square else cl.silhouette(df, "k", "l", "v", chunk=16)
        assert s.count() == 1 and abs(s.first()[0] - want) < 1e-9


def test_isotonic_is_the_weighted_monotone_fit(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"y_score": rng.integers(0, 30, 400) / 30, "sample_weight": rng.integers(1, 4, 400) * 1.0})
    pdf["label_bin"] = (rng.random(400) < pdf["y_score"]).astype(int)
    pdf["label"] = 0
    df = spark.createDataFrame(pdf)
    got = M.apply_isotonic(M.fit_isotonic(df, 1.0), df).select("y_score", "p_isotonic").distinct().orderBy("y_score").toPandas()
    g = pdf.groupby("y_score").apply(lambda d: pd.Series({"w": d.sample_weight.sum(), "s": (d.sample_weight * d.label_bin).sum()}))
    w, s = g["w"].to_numpy(), g["s"].to_numpy()
    n = len(w)
    want = [max(min(s[i : j + 1].sum() / w[i : j + 1].sum() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert np.allclose(got["p_isotonic"], want, atol=1e-9)


def test_models_of_every_fold_score_every_sample(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"row": range(600), "col": 0, "fold": np.arange(600) % 3, "dist_m": rng.uniform(30, 5000, 600)})
    pdf["label"] = (rng.random(600) < np.exp(-pdf["dist_m"] / 1500)).astype(int)
    pdf["label_bin"], pdf["sample_weight"] = pdf["label"], 1.0
    df = spark.createDataFrame(pdf)
    exp = C.Experiment("d", C.DIST_ONLY, learner="logistic", params={"maxIter": 20})
    out = M.out_of_fold(df, df, exp, 1.0, "dist_m", 3).toPandas()
    assert len(out) == 600 and out["fold"].value_counts().to_dict() == {0: 200, 1: 200, 2: 200}
    assert out["y_score"].between(0, 1).all() and out["p_isotonic"].between(0, 1).all()
    assert out.loc[out["label"] == 1, "y_score"].mean() > out.loc[out["label"] == 0, "y_score"].mean() + 0.1
    assert len({str(g) for g in map(sorted, map(dict.items, M.grid(C.EXPERIMENTS["extended"])))}) == 32


def test_sweep_and_clusters_run_on_profiles(spark):
    rng = np.random.default_rng(11)
    rows = [(f"b{i:04d}_0001", 500, i, 1, [float(v) for v in np.sort(10 ** rng.normal(2 + i % 2, 0.2, 39))]) for i in range(40)]
    p = spark.createDataFrame(rows, "block_id string, n bigint, block_row int, block_col int, q array<double>")
    spec = C.ClusterSpec(k=2, min_pixels=100, n_init=3, k_range=(2, 3), runs=3)
    got = {r.block_id: r for r in cl.cluster_blocks(p, spec).collect()}
    assert all(got[r[0]].cluster == r[2] % 2 for r in rows)
    s = {r.k: r for r in cl.sweep(p, spec).collect()}
    assert s[2].silhouette > 0.8 and s[2].ari_mean == 1.0 and s[3].inertia < s[2].inertia


def test_row_minimum_is_exact_and_not_quadratic():
    rng = np.random.default_rng(13)
    for _ in range(200):
        near = np.where(rng.random(40) < 0.3, rng.integers(0, 12, 40), -1)
        if (near < 0).all():
            continue
        row, asked = int(rng.integers(0, 12)), np.unique(rng.integers(0, 40, 9))
        got = R._row_minimum(near, row, asked)
        for c, g in zip(asked, got):
            assert g == min((j for j in range(40) if near[j] >= 0), key=lambda j: ((near[j] - row) ** 2 + (j - c) ** 2, near[j], j))
    took = []
    for width in (50_000, 200_000):
        near = np.full(width, -1)
        near[0] = 5
        near[rng.integers(0, width, width // 50)] = 3
        start = time.perf_counter()
        R._row_minimum(near, 0, np.arange(width))
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5
