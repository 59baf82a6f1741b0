"""Work that is spread over all cores, and figures that follow from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.config import ClusterSpec
from terrashift.operators import cluster as cl
from terrashift.operators import evaluate as V
from terrashift.operators import lloyd
from terrashift.operators import models as M
from terrashift.session import spread


def profiles(spark, n):
    """Quantile functions of ``n`` blocks in one file, as a small table is found."""
    q = F.transform(F.sequence(F.lit(1), F.lit(39)), lambda i: (i + F.col("id") % 97) * 1.5)
    return spark.range(n).coalesce(1).select(F.format_string("b%06d", "id").alias("block_id"), F.lit(200).cast("bigint").alias("n"), q.alias("q"))


def test_the_fit_has_a_task_for_each_core(spark, monkeypatch):
    """Profiles are a small table for much work: its size alone would give one task."""
    seen, fit = [], lloyd.fit

    def noted(rows, *args):
        seen.append((rows.rdd.getNumPartitions(), rows.count()))
        return fit(rows, *args)

    monkeypatch.setattr(lloyd, "fit", noted)
    spec = ClusterSpec(k_range=(2, 3), runs=2, n_init=2, min_pixels=100)
    cl.sweep(profiles(spark, 2000), spec)
    cl.cluster_blocks(profiles(spark, 2000), spec)
    assert seen == [(8, 2000), (8, 2000)]


@pytest.mark.parametrize("same", [False, True])
def test_sums_are_those_of_the_nearest_centre(same):
    """Of equally near centres the first one takes the row."""
    rng = np.random.default_rng(4)
    x, centers = rng.integers(0, 3, (50, 4)).astype(float), rng.integers(0, 3, (6, 3, 4)).astype(float)
    if same:
        centers[:, 1] = centers[:, 0]
    wide = np.column_stack([np.ones(50), (x * x).sum(1), x])
    got = lloyd._sums(wide, centers)
    for c, sums in zip(centers, got):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        assert np.allclose(sums, [wide[label == j].sum(0) for j in range(3)])


def test_rows_are_scored_once_for_all_metrics(spark):
    """A model is applied to each row once, and the metrics are those of the whole report of a fold."""
    scored = spark.range(3000, numPartitions=3).select(
        F.when(F.col("id") % 7 == 0, 1).otherwise(F.col("id") % 2 * 2).cast("int").alias("label"), (F.col("id") % 101 / 101).alias("y_score")
    )
    calls = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    got = M._metrics(scored.mapInPandas(count, scored.schema), 10.0)
    assert calls.value == 3000
    one = scored.select(F.lit(0).alias("g"), "y_score", (F.col("label") == 1).cast("int").alias("y"))
    want = V.fold_metrics(one, ["g"], "y_score", "y", 10.0).first()
    assert got == pytest.approx({n: want[n] for n in got})


def test_a_table_for_much_work_has_a_task_for_each_core(spark):
    """Rows that a search fits on again and again are not left to as few tasks as their size gives."""
    df = spark.range(1000).coalesce(1)
    assert [spread(df, "t", n).rdd.getNumPartitions() for n in (50, 400, 1000)] == [8, 3, 1]
    assert sorted(r[0] for r in spread(df, "t", 50).collect()) == list(range(1000))
