"""Folds, draws and samples: quotas, weights, determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.config import FoldSpec, PoolSpec
from terrashift.operators import folds as fo
from terrashift.operators import pool as po
from terrashift.operators import summaries as S


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(4)
    n = rng.lognormal(6, 1.5, 123).astype(int) + 1
    n1 = np.where(rng.random(123) < 0.4, 0, rng.binomial(n, 0.01))
    n2 = rng.binomial(n, 0.02)
    return spark.createDataFrame([(f"b{i:04d}_0000", int(a), int(b), int(c)) for i, (a, b, c) in enumerate(zip(n, n1, n2))], "block_id string, n bigint, n1 bigint, n2 bigint")


def cost(df, spec):
    t = {r["fold"]: {c: float(r[c]) for c in ("n", "n1", "n2")} for r in df.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).collect()}
    return fo.imbalance(t, spec)


def test_quotas_are_exact_and_swaps_improve(spark, blocks):
    spec = FoldSpec(max_rounds=4)
    snake, best = fo.snake_folds(blocks, spec), fo.balanced_folds(blocks, spec)
    for df in (snake, best):
        sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
        assert sizes == {0: 25, 1: 25, 2: 25, 3: 24, 4: 24}
        assert df.select("block_id").distinct().count() == 123
    assert cost(best, spec) < 0.5 * cost(snake, spec)
    again = fo.balanced_folds(blocks.repartition(7), spec)
    assert best.exceptAll(again).count() == 0


def test_acceptance(spark, blocks):
    v = fo.accept(S.fold_summary(fo.snake_folds(blocks)), 0.01).first()
    assert v["quota_spread"] == 1 and not v["accepted"]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(20000).select(
        F.floor(F.col("id") / 200).cast("int").alias("row"), (F.col("id") % 200).cast("int").alias("col"),
        (F.col("id") % 5).cast("int").alias("fold"),
        F.when(F.col("id") % 97 == 0, 1).when(F.col("id") % 89 == 0, 2).otherwise(0).cast("int").alias("label"),
        (30.0 + F.pmod(F.xxhash64("id"), F.lit(4000))).alias("dist_m"),
    )


def test_draw_meets_budget_and_reconstructs_population(spark, samples):
    spec = PoolSpec(tau_m=1000.0, dup=3)
    cal = po.fold_calibration(samples, "dist_m", spec, 900)
    assert [r["verdict"] for r in cal.collect()] == ["ok"] * 5
    pool = po.draw(samples, cal, "dist_m", spec).cache()
    per = {r["fold"]: r["count"] for r in pool.groupBy("fold").count().collect()}
    assert all(abs(n - 900) < 120 for n in per.values())
    assert abs(pool.where("label = 0").agg(F.sum("sample_weight")).first()[0] / samples.where("label = 0").count() - 1) < 0.05
    assert pool.where("label = 1").count() == 3 * samples.where("label = 1").count()
    assert pool.where("is_dup").count() == 2 * samples.where("label = 1").count()
    pos, neg = (pool.where(c).agg(F.sum("sample_weight")).first()[0] for c in ("label = 1", "label <> 1"))
    assert abs(pos / neg - 1) < 0.05
    again = po.draw(samples.repartition(11), cal, "dist_m", spec)
    assert pool.select("row", "col", "is_dup").exceptAll(again.select("row", "col", "is_dup")).count() == 0


def test_infeasible_budgets_are_named(spark, samples):
    spec = PoolSpec(tau_m=1000.0)
    word = lambda rows: {r["verdict"] for r in po.fold_calibration(samples, "dist_m", spec, rows).collect()}
    assert word(20) == {"rare classes exceed the budget"}
    assert word(130) == {"floor exceeds the budget"}
    assert word(3950) == {"keep rate saturates"}
    with pytest.raises(ValueError):
        PoolSpec(dup=0)
    with pytest.raises(ValueError):
        FoldSpec(k=1)


def test_pool_integrity_checks_find_faults(spark, samples):
    spec = PoolSpec(tau_m=1000.0)
    s = samples.withColumn("block_id", F.concat(F.lit("b"), F.col("fold").cast("string")))
    folds = s.select("block_id", "fold").distinct()
    pool = po.draw(s, po.fold_calibration(s, "dist_m", spec, 1500), "dist_m", spec, 10.0)
    assert po.misplaced_blocks(pool, folds).count() == 0
    assert po.misplaced_blocks(pool, folds.withColumn("fold", (F.col("fold") + 1) % 5)).count() == 5
    assert po.positive_weight_errors(pool, F.lit(5.0)).first()["wrong_weight"] == 0
    assert po.positive_weight_errors(pool, F.lit(4.0)).first()["wrong_weight"] > 0


def test_leave_out_normaliser_matches_direct(spark, samples):
    pdf = samples.toPandas()
    for extra in (None, 1):
        for r in S.leave_out_normaliser(S.fold_moments(samples, "dist_m"), 5, extra).collect():
            out = [r["held_out"]] + ([(r["held_out"] + extra) % 5] if extra else [])
            z = np.log1p(pdf.loc[~pdf["fold"].isin(out), "dist_m"])
            assert r["log_mean"] == pytest.approx(z.mean()) and r["log_std"] == pytest.approx(z.std(ddof=1))


def test_batches_have_fixed_composition(spark, samples):
    s = samples.withColumn("stratum", F.when(F.col("label") == 1, "positive").when(F.col("dist_m") < 500, "near").otherwise("other"))
    b = po.stratified_batches(s, ["row", "col"], 20, 50, {"positive": 0.1, "near": 0.2}, "other", 1)
    got = {(r["batch"], r["stratum"]): r["count"] for r in b.groupBy("batch", "stratum").count().collect()}
    assert len(got) == 60 and all(n == {"positive": 5, "near": 10, "other": 35}[k] for (_, k), n in got.items())
    right = b.join(s.select("row", "col", F.col("stratum").alias("s2")), ["row", "col"])
    assert right.where("stratum <> s2").count() == 0


def test_subsample_runs(spark, blocks):
    r = po.subsample_runs(blocks.select("block_id"), "block_id", 4, 0.8, 0)
    assert {x["count"] for x in r.groupBy("run").count().collect()} == {98}
    assert r.distinct().count() == r.count()
