"""Batched k-means, distributed isotonic regression, chunk gather, run store, bounded fold search, file paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.operators import cluster as cl
from terrashift.operators import folds as fo
from terrashift.operators import isotonic as iso
from terrashift.operators import lloyd
from terrashift.operators import models as M
from terrashift.operators import runs as rn
from terrashift.operators import summaries as S
from terrashift.operators import tiles as ti
from terrashift.session import scratch_path
from terrashift.sources import tables as T


def vectors(spark, x, runs=None):
    rows = [(f"b{i}", [float(v) for v in r], [0] if runs is None else [int(k) for k in runs[i]]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id string, x array<double>, runs array<int>").select("x", "runs", F.xxhash64("id").alias("h"))


def lloyd_alone(x, start, iterations=100, tol=1e-6):
    """Plain k-means from a start: centres and cost."""
    c = start.copy()
    for _ in range(iterations):
        label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
        moved, c = ((new - c) ** 2).sum(1).max(), new
        if moved <= tol**2:
            break
    return c, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_every_model_of_a_batch_is_plain_kmeans(spark):
    """Same starts, same centres and cost as one model after the other, on all rows and on subsamples."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 1.0, (60, 5)) for m in (0, 4, 9)])
    inside = [[0, *np.flatnonzero(rng.random(3) < 0.7) + 1] for _ in x]
    plan = lloyd.Plan((2, 3, 5), subsamples=4, starts=3)
    start = {k: rng.normal(4, 4, (4, 3, k, 5)) for k in plan.ks}
    got = lloyd.fit(vectors(spark, x, inside).repartition(3), plan, start)
    for k in plan.ks:
        for r in range(4):
            rows = x[[r in m for m in inside]]
            for s in range(3):
                centers, cost = lloyd_alone(rows, start[k][r, s])
                assert np.allclose(got.centers[k][r, s], centers, atol=1e-8) and got.cost[k][r, s] == pytest.approx(cost)


def test_a_model_costs_what_sparks_own_kmeans_costs(spark):
    from pyspark.mllib.clustering import KMeans, KMeansModel

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1.2, (80, 4)) for m in (0, 3, 7, 12)])
    start = x[[0, 5, 100, 310]]
    own = KMeans.train(spark.sparkContext.parallelize(x.tolist(), 2), 4, 100, initialModel=KMeansModel(start.tolist()), epsilon=1e-6)
    got = lloyd.fit(vectors(spark, x), lloyd.Plan((4,), starts=1), {4: start[None, None]})
    assert got.cost[4][0, 0] == pytest.approx(own.computeCost(spark.sparkContext.parallelize(x.tolist())), rel=1e-9)


def test_starts_are_spread_and_do_not_hang_on_the_partitioning(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.01, (40, 2)) for m in (0, 50, 100, 150, 200)])
    plan = lloyd.Plan((2, 5), starts=8, iterations=0)
    a = lloyd.fit(vectors(spark, x).repartition(5), plan)
    b = lloyd.fit(vectors(spark, x).repartition(2), plan)
    assert np.allclose(a.centers[5], b.centers[5]) and np.allclose(a.centers[2], a.centers[5][:, :, :2])
    hit = [len({round(float(c[0]) / 50) for c in s}) for s in a.centers[5][0]]
    assert min(hit) == 5 and len({tuple(map(tuple, s.round(6))) for s in a.centers[5][0]}) == 8
    same = lloyd.fit(vectors(spark, np.ones((6, 2))), lloyd.Plan((3,), starts=2))
    assert np.allclose(same.best(3), 1.0) and same.cost[3].max() == 0


def test_sweep_equals_quality_by_hand(spark):
    rng = np.random.default_rng(11)
    rows = [(f"b{i:04d}_0001", 500, i, 1, [float(v) for v in np.sort(10 ** rng.normal(2 + i % 3, 0.15, 39))]) for i in range(45)]
    p = spark.createDataFrame(rows, "block_id string, n bigint, block_row int, block_col int, q array<double>")
    spec = C.ClusterSpec(k=3, min_pixels=100, n_init=4, k_range=(2, 3, 4), runs=3)
    got = {r.k: r for r in cl.sweep(p, spec).collect()}
    labels = {r.block_id: r.cluster for r in cl.cluster_blocks(p, spec).collect()}
    assert all(labels[r[0]] == r[2] % 3 for r in rows)
    x, y = np.log10(np.array([r[4] for r in rows])), np.array([labels[r[0]] for r in rows])
    df = spark.createDataFrame([(f"k{i}", int(y[i]), [float(v) for v in x[i]]) for i in range(45)], "id string, l int, v array<double>")
    ch = cl.calinski_harabasz(df, "l", "v", 39).first()
    assert got[3].inertia == pytest.approx(ch[0]) and got[3].calinski_harabasz == pytest.approx(ch[1])
    assert got[3].silhouette == pytest.approx(cl.squared_silhouette(df, "id", "l", "v", 39).first()[0])
    assert got[3].ari_mean == 1.0 and got[3].ari_std == 0.0 and got[4].inertia < got[3].inertia < got[2].inertia


def test_exact_silhouette_refuses_what_it_cannot_do(spark, monkeypatch):
    rows = [(f"k{i}", i % 2, [float(i % 2 * 9 + i / 10), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, l int, v array<double>")
    whole = cl.silhouette(df, "id", "l", "v", 1000).first()[0]
    assert whole > 0.5 and cl.silhouette(df, "id", "l", "v", 4).first()[0] == pytest.approx(whole)
    monkeypatch.setattr(cl, "MOST_EXACT", 29)
    with pytest.raises(ValueError, match="squared_silhouette"):
        cl.silhouette(df, "id", "l", "v")


def pava(x, y, w):
    """Values of the monotone fit at the sorted distinct scores."""
    t = pd.DataFrame({"x": x, "y": y, "w": w}).assign(s=lambda d: d.y * d.w).groupby("x")[["s", "w"]].sum()
    blocks = []
    for v in t.itertuples():
        blocks.append([v.s, v.w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + n]
    return t.index.to_numpy(), np.repeat([s / c for s, c, _ in blocks], [n for _, _, n in blocks])


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "ties", "waves"])
@pytest.mark.parametrize("per_task", [7, 60, 10_000])
def test_isotonic_steps_do_not_hang_on_the_ranges(spark, kind, per_task):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.random(n) if kind != "ties" else rng.integers(0, 25, n) / 25
    p = {"noise": 0.3 + 0 * x, "rising": x, "falling": 1 - x, "ties": x, "waves": 0.5 + 0.5 * np.sin(14 * x)}[kind]
    y, w = (rng.random(n) < p).astype(float) if kind != "rising" else p, rng.uniform(0.1, 3, n)
    df = spark.createDataFrame(pd.DataFrame({"y_score": x, "y": y, "w": w})).repartition(4)
    steps = iso.fit_isotonic_blocks(df, "y_score", F.col("y"), F.col("w"), rows_per_task=per_task)
    at, want = pava(x, y, w)
    asked = np.concatenate([at, rng.uniform(-0.2, 1.2, 300)])
    got = iso.apply_isotonic_blocks(steps, spark.createDataFrame(pd.DataFrame({"y_score": asked}))).toPandas()
    expect = np.interp(got["y_score"], at, want)
    assert len(got) == len(asked) and np.allclose(got["p_isotonic"], expect, atol=1e-9)


def test_isotonic_of_odd_rows(spark):
    schema = "y_score double, y double, w double"
    rows = [(0.5, 1.0, 1.0), (None, 1.0, 1.0), (0.2, None, 1.0), (0.9, 0.0, 0.0), (float("nan"), None, 1.0)]
    steps = iso.fit_isotonic_blocks(spark.createDataFrame(rows, schema), "y_score", F.col("y"), F.col("w"))
    assert [tuple(r) for r in steps.collect()] == [(0.5, 0.5, 1.0)]
    got = {str(r.y_score): r.p_isotonic for r in iso.apply_isotonic_blocks(steps, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"0.5": 1.0, "None": None, "0.2": 1.0, "0.9": 1.0, "nan": None}
    none = iso.fit_isotonic_blocks(spark.createDataFrame([], schema), "y_score", F.col("y"), F.col("w"))
    assert none.count() == 0 and iso.apply_isotonic_blocks(none, spark.createDataFrame(rows, schema)).where("p_isotonic is not null").count() == 0


def test_chunks_give_what_pixel_rows_give(spark):
    rng = np.random.default_rng(7)
    years, size, part = (2017, 2018), 8, 4
    pixels, chunks = [], []
    for tile in ("r000_c000", "r000_c001"):
        for year in years:
            values = rng.integers(0, 256, (size * size, 3))
            values[rng.random(size * size) < 0.2] = 0
            for i, v in enumerate(values.tolist()):
                pixels.append((tile, i // size, i % size, year, v))
            # The last chunk of the second tile is missing in one year, the first one of the other is short.
            for row0 in range(0, size, part):
                if (tile, year, row0) == ("r000_c001", 2018, 4):
                    pixels = [p for p in pixels if not (p[0] == tile and p[3] == year and p[1] >= 4)]
                    continue
                chunks.append((tile, year, row0, values[row0 * size : (row0 + part) * size].tolist()))
    tiles = spark.createDataFrame(pixels, "tile_id string, tile_row int, tile_col int, year int, bands array<smallint>")
    packed = spark.createDataFrame(chunks, "tile_id string, year int, row0 int, values array<array<smallint>>")
    asked = [(i, int(r), t, int(r), int(c), i * 2) for i, (t, r, c) in enumerate(zip(rng.choice(["r000_c000", "r000_c001", "r009_c009"], 120), rng.integers(-1, 9, 120), rng.integers(0, 9, 120)))]
    samples = spark.createDataFrame(asked, "row int, col int, tile_id string, tile_row int, tile_col int, label int")
    as_set = lambda df, cols: sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    one = ["row", "col", "tile_id", "year", "label", "bands"]
    assert as_set(ti.gather(samples, packed, size, part, ("label",)), one) == as_set(ti.extract(samples, tiles, size, ("label",)), one)
    both = ["row", "col", "tile_id", "bands_2017", "bands_2018"]
    plan = ti.gather_years(samples, packed, years, size, part, ("label",))
    assert as_set(plan, both) == as_set(ti.assemble(ti.extract(samples, tiles, size), years), both)
    assert ti.gather(samples.limit(0), packed, size, part).count() == 0 and ti.gather(samples, packed.limit(0), size, part).count() == 0


def test_runs_are_stored_resumed_and_fail_alone(spark):
    store = rn.RunStore(spark, scratch_path(spark, "runs"))
    assert store.read().count() == 0 and store.finished("e", "grid_run") == set()
    calls = []

    def work(i, params):
        calls.append(i)
        if params["x"] == 3:
            raise ValueError("bad combination")
        return {"trees": i, "avg_precision": params["x"] / 10}

    runs = {i: {"x": i} for i in range(6)}
    assert rn.run_all(store, "e", "grid_run", {i: runs[i] for i in (0, 1)}, work) == [0, 1]
    assert rn.run_all(store, "e", "grid_run", runs, work, at_once=3) == [2, 3, 4, 5] and sorted(calls) == list(range(6))
    table = rn.ranked(store, "e").collect()
    assert [r.run_id for r in table] == [5, 4, 2, 1, 0, 3] and table[-1].state == "failed" and "bad combination" in table[-1].error
    assert rn.run_all(store, "e", "grid_run", runs, work) == []
    assert rn.run_all(store, "e", "grid_run", runs, work, retry_failed=True) == [3]
    assert rn.run_all(store, "e", "grid_run", {1: {"x": 9}}, work, force=True) == [1] and rn.ranked(store, "e").first().run_id == 1
    got = {(r.experiment, r.kind): (r.done, r.failed, r.expected) for r in rn.status(store, rn.expected_runs(spark, {("e", "grid_run"): 8, ("e", "fold_model"): 5})).collect()}
    assert got == {("e", "grid_run"): (5, 1, 8), ("e", "fold_model"): (0, 0, 5)}
    with pytest.raises(KeyError):
        rn.side_by_side(lambda i: {}[i], [1, 2])


def model_rows(spark, n=900):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"row": range(n), "col": 0, "fold": np.arange(n) % 3, "dist_m": rng.uniform(30, 5000, n)})
    pdf["label"] = (rng.random(n) < np.exp(-pdf["dist_m"] / 1500)).astype(int)
    pdf["label_bin"], pdf["sample_weight"] = pdf["label"], 1.0
    return spark.createDataFrame(pdf)


def test_stored_fold_models_give_the_best_folds_importances(spark):
    df = model_rows(spark)
    store = rn.RunStore(spark, scratch_path(spark, "runs"))
    exp = C.Experiment("t", C.DIST_ONLY, params={"maxIter": 4, "maxDepth": 2})
    out = M.out_of_fold(df, df, exp, 1.0, "dist_m", 3, store=store, at_once=3)
    assert out.count() == 900 and store.finished("t", "fold_model") == {0, 1, 2}
    fold, table = M.best_fold_importances(store, exp, df, "dist_m")
    best = max(store.read().collect(), key=lambda r: r.avg_precision)
    assert fold == best.run_id and [tuple(r) for r in table.collect()] == [("dist_z", 1.0)]
    with pytest.raises(ValueError):
        M.best_fold_importances(store, C.EXPERIMENTS["linear"], df, "dist_m")


def test_a_search_goes_on_where_it_stopped(spark):
    df = model_rows(spark)
    store = rn.RunStore(spark, scratch_path(spark, "runs"))
    exp = C.Experiment("s", C.DIST_ONLY, learner="logistic", grid={"maxIter": [5, 9], "regParam": [0.0, 0.1]})
    M.grid_search(df, df, exp, 1.0, "dist_m", 3, store, {0: {"maxIter": 5, "regParam": 0.0}, 7: {"maxIter": -4}}, val_rows=100)
    first = store.read().where("run_id = 0").first()
    out = {r.run_id: r for r in M.grid_search(df, df, exp, 1.0, "dist_m", 3, store, val_rows=100).collect()}
    assert set(out) == {0, 1, 2, 3, 7} and out[7].state == "failed" and out[0].avg_precision == first.avg_precision
    assert all(0 < out[i].avg_precision <= 1 for i in range(4))


def test_fold_search_moves_a_bounded_number_of_blocks(spark):
    """Twenty thousand blocks: quotas stay exact, totals come within the tolerance, few blocks leave the draft."""
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"block_id": [f"b{i:06d}" for i in range(n)], "n": rng.integers(50, 900, n), "n1": rng.poisson(0.4, n) * 30, "n2": rng.integers(0, 60, n)})
    blocks = spark.createDataFrame(pdf)
    spec = C.FoldSpec()
    draft = {r.block_id: r.fold for r in fo.snake_folds(blocks, spec).collect()}
    best = fo.balanced_folds(blocks, spec)
    moved = sum(draft[r.block_id] != r.fold for r in best.collect())
    assert moved <= 2 * 10 * fo._PER_PAIR * spec.max_rounds
    assert fo.accept(S.fold_summary(best), 1.0).first()["accepted"]


def test_tile_and_year_come_from_paths_of_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([("r001_c002_2017.parquet", 1), ("r001_c002_2018.parquet", 2), ("notes_2017.parquet", 3)], "file string, v int")
    T.write_named(rows, str(tmp_path / "x"), "file")
    got = {tuple(r) for r in ti.tile_years_from_names(T.read_with_paths(spark, str(tmp_path / "x")), keep=("v",)).collect()}
    assert got == {("r001_c002", 2017, 1), ("r001_c002", 2018, 2)}
    names = spark.createDataFrame([("a/b/r100_c001_2019.parquet",), ("r1_c1_2019.parquet",), ("xr001_c001_2019.parquet",), ("r001_c001_2019.parquet.tmp",)], "file_name string")
    assert [tuple(r) for r in ti.tile_years_from_names(names).collect()] == [("r100_c001", 2019)]
