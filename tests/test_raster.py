"""Raster operators against brute force on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import raster as R


def cells(spark, mask):
    r, c = np.nonzero(mask)
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(r, c)], "row int, col int")


def every(spark, shape):
    return spark.range(shape[0] * shape[1]).select(
        F.floor(F.col("id") / shape[1]).cast("int").alias("row"), (F.col("id") % shape[1]).cast("int").alias("col")
    )


def brute_nearest(mask):
    marked = [tuple(map(int, p)) for p in np.argwhere(mask)]
    out = {}
    for r in range(mask.shape[0]):
        for c in range(mask.shape[1]):
            out[r, c] = min(((a - r) ** 2 + (b - c) ** 2, a, b) for a, b in marked)
    return out


def border(shape, at):
    m = np.zeros(shape, dtype=bool)
    m[at] = True
    return m


RNG = np.random.default_rng(3)
MASKS = {
    "random": RNG.random((40, 55)) < 0.02,
    "row": border((1, 30), (0, 7)),
    "column": border((30, 1), (29, 0)),
    "one": border((1, 1), (0, 0)),
    "two": border((9, 9), (4, [0, 8])),
    "corner": border((20, 20), (0, 19)),
    "full": np.ones((6, 7), dtype=bool),
}


@pytest.mark.parametrize("name", MASKS)
def test_nearest_marked_is_exact(spark, name):
    mask = MASKS[name]
    ext = R.Extent(0, mask.shape[0] - 1, 0, mask.shape[1] - 1)
    got = R.nearest_marked(cells(spark, mask), every(spark, mask.shape), ext, 30.0, strip=16, band=8).collect()
    want = brute_nearest(mask)
    assert len(got) == mask.size
    for g in got:
        d2, r, c = want[g["row"], g["col"]]
        assert (g["near_row"], g["near_col"]) == (r, c)
        assert g["dist_m"] == pytest.approx(30 * d2**0.5)


def test_nothing_marked_gives_nulls(spark):
    mask = np.zeros((4, 5), dtype=bool)
    got = R.nearest_marked(cells(spark, mask), every(spark, mask.shape), R.Extent(0, 3, 0, 4)).collect()
    assert len(got) == 20 and all(g["dist_m"] is None and g["near_row"] is None for g in got)


def brute_box(mask, r):
    p = np.pad(mask.astype(float), r, mode="edge")
    n = 2 * r + 1
    return np.array([[p[i : i + n, j : j + n].mean() for j in range(mask.shape[1])] for i in range(mask.shape[0])])


@pytest.mark.parametrize("shape,window", [((40, 55), 16), ((40, 55), 512), ((1, 12), 8), ((12, 1), 8)])
def test_box_means_replicate_borders(spark, shape, window):
    mask = np.random.default_rng(5).random(shape) < 0.2
    mask[0, 0] = True
    ext = R.Extent(0, shape[0] - 1, 0, shape[1] - 1)
    marked = cells(spark, mask).withColumn("layer", F.lit("m"))
    got = R.box_means(marked, every(spark, shape), ext, {"a": ("m", 3), "b": ("m", 17)}, window).toPandas()
    assert len(got) == mask.size
    for col, r in (("a", 3), ("b", 17)):
        want = brute_box(mask, r)
        assert np.allclose(got[col], want[got["row"], got["col"]])


def test_window_offset_does_not_change_results(spark):
    mask = np.random.default_rng(8).random((20, 20)) < 0.1
    shift = lambda df: df.select((F.col("row") + 100).alias("row"), (F.col("col") - 50).alias("col"))
    a = R.nearest_marked(cells(spark, mask), every(spark, mask.shape), R.Extent(0, 19, 0, 19)).orderBy("row", "col").toPandas()
    b = R.nearest_marked(shift(cells(spark, mask)), shift(every(spark, mask.shape)), R.Extent(100, 119, -50, -31)).orderBy("row", "col").toPandas()
    assert np.allclose(a["dist_m"], b["dist_m"]) and (a["near_row"] + 100 == b["near_row"]).all()


def test_morphology(spark):
    mask = np.random.default_rng(2).random((15, 18)) < 0.6
    ext = R.Extent(0, 14, 0, 17)
    p = np.pad(mask, 1)
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    dil, ero = np.logical_or.reduce(parts), np.logical_and.reduce(parts)
    for fn, want in ((R.dilate, dil), (R.erode, ero), (R.edge_cells, dil & ~ero)):
        got = {(g["row"], g["col"]) for g in fn(cells(spark, mask), ext).collect()}
        assert got == {tuple(map(int, x)) for x in np.argwhere(want)}


def test_block_max_trims_and_stride_keeps(spark):
    grid = every(spark, (45, 45)).withColumn("v", F.col("row") * 100 + F.col("col"))
    ext = R.Extent(0, 44, 0, 44)
    got = {(g["row"], g["col"]): g["v"] for g in R.block_max(grid, "v", ext, 20).collect()}
    assert got == {(r, c): (r * 20 + 19) * 100 + c * 20 + 19 for r in range(2) for c in range(2)}
    assert R.stride(grid, ext, 20).count() == 9


def test_mosaic_takes_last_with_data_and_clips(spark):
    g = spark.createDataFrame(
        [(0, 0, 1, [5, 6]), (0, 0, 2, [0, 0]), (0, 1, 1, [1, 2]), (0, 1, 2, [3, 4]), (0, 2, 1, [0, 0])],
        "row int, col int, ord int, bands array<smallint>",
    )
    out = {(r["row"], r["col"]): r["bands"] for r in R.mosaic(g, "ord", "bands").collect()}
    assert out == {(0, 0): [5, 6], (0, 1): [3, 4], (0, 2): None}
    inside = spark.createDataFrame([(0, 0)], "row int, col int")
    clipped = {(r["row"], r["col"]): r["bands"] for r in R.mosaic(g, "ord", "bands", inside).collect()}
    assert clipped == {(0, 0): [5, 6], (0, 1): None, (0, 2): None}
