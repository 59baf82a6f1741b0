"""What must not grow with the tables: broadcasts of samples, tasks of whole chunks, copies, files and moved bytes."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrashift.operators import cluster as cl
from terrashift.operators import raster as R
from terrashift.operators import tiles as ti
from terrashift.plans import fixtures
from terrashift.sources import tables as src

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
def test_chunks_are_packed_by_many_tasks_and_keep_their_places(spark, tmp_path, monkeypatch):
    """Tasks follow from the number of cells; a cell without a vector leaves the places of the others as they are."""
    monkeypatch.setattr(fixtures, "CELLS_A_TASK", 1000, raising=False)
    spark.read.parquet(f"{DIR}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    e.where("vec_id <> 5").write.parquet(f"{tmp_path}/embeddings.parquet")
    fx = fixtures.Fixtures(spark, str(tmp_path))
    assert {r[0] for r in fx.chunks.select(F.size("values")).distinct().collect()} <= {512, 32 * 8}
    assert fx.chunks.where(F.exists("values", lambda v: v.isNull())).count() > 0
    tasks = len([f for f in fx.chunks.inputFiles()])
    assert tasks > 1


def test_samples_meet_chunks_without_a_broadcast(spark, tmp_path):
    """The estimate of the lists is small, the lists are not."""
    samples = spark.createDataFrame([(0, 0, "r000_c000", 0, 0)], "row int, col int, tile_id string, tile_row int, tile_col int")
    chunks = spark.createDataFrame([("r000_c000", 2019, 0, [[1, 2]])], "tile_id string, year int, row0 int, values array<array<smallint>>")
    samples.write.parquet(f"{tmp_path}/s")
    chunks.write.parquet(f"{tmp_path}/c")
    samples, chunks = (spark.read.parquet(f"{tmp_path}/{n}") for n in "sc")
    for df in (ti.gather(samples, chunks, 32, 16), ti.gather_years(samples, chunks, [2019], 32, 16)):
        assert "Broadcast" not in plan(df)
        assert df.count() == 1


def test_silhouette_chunks_grow_with_the_table():
    """Copies of a row are as many as chunks."""
    assert cl._chunks(211_000, 32) <= 64 and cl._chunks(600, 32) == 17 and cl._chunks(1, 32) == 1


def test_distances_of_near_and_equal_rows_are_exact():
    """Far from the origin, a matrix product alone would lose small distances."""
    rng = np.random.default_rng(0)
    a = 1000 + rng.normal(size=(200, 39))
    a[1], a[2] = a[0], a[0] + 1e-9
    b = np.concatenate([a, a + 1e-6])
    got = np.concatenate(list(cl._pair_distances(a, b)))
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert got[0, 0] == got[0, 1] == 0 and np.allclose(got, want, rtol=1e-9, atol=1e-11)


def test_a_small_tile_is_one_file(spark, tmp_path):
    rows = spark.range(2048).select(
        F.floor(F.col("id") / 32).cast("int").alias("row"), (F.col("id") % 32).cast("int").alias("col"), F.concat(F.lit("t"), F.floor(F.col("id") / 1024)).alias("tile_id")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        src.write_by_tile(rows, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tile in ("t0", "t1"):
        assert len([f for f in os.listdir(f"{tmp_path}/t/tile_id={tile}") if f.endswith(".parquet")]) == 1


def test_mean_reduce_moves_bytes_not_sums(spark):
    cells = spark.createDataFrame([(0, 0, 1, [1, 0]), (1, 1, 1, [3, 0]), (3, 0, 1, [7, 8])], "row int, col int, year int, bands array<smallint>")
    out = R.mean_reduce(cells, ["year"], "bands", 2)
    exchange = plan(out).split("Exchange hashpartitioning")
    assert "HashAggregate" not in exchange[-1]
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, [2.0, None]), (1, 1, 0, [7.0, 8.0])]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_a_scan_of_chunks_holds_few_of_them(spark):
    """A batch of a scan is at most a row group, which is a part of a file of many chunks."""
    files = fixtures.Fixtures(spark, "/root/testdata/sf0.1").chunks.inputFiles()
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert sum(m.num_rows for m in metas) == 21 * 14 * 3 and max(m.num_rows for m in metas) > 200
    assert max(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)) <= 128


def test_lists_of_samples_are_not_hashed(spark):
    """A hash table of lists can't be spilled; a sort can."""
    samples = spark.createDataFrame([(0, 0, "r000_c000", 0, 0)], "row int, col int, tile_id string, tile_row int, tile_col int")
    chunks = spark.createDataFrame([("r000_c000", 2019, 0, [[1, 2]])], "tile_id string, year int, row0 int, values array<array<smallint>>")
    for df in (ti.gather(samples, chunks, 32, 16), ti.gather_years(samples, chunks, [2019], 32, 16)):
        assert "SortMergeJoin" in plan(df) and "ShuffledHashJoin" not in plan(df)
