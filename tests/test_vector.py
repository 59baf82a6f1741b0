"""Polygon rasterisation and tile selection against brute force."""

import numpy as np

from terrashift.config import Lattice
from terrashift.operators import vector as V

LAT = Lattice(0.0, 100.0, 10.0)


def rings(spark, rings_):
    rows = [(1, r, i, float(x), float(y)) for r, ring in enumerate(rings_) for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "poly_id int, ring_id int, seq int, x double, y double")


L_SHAPE = [(3, 97), (3, 12), (88, 12), (88, 47), (41, 47), (41, 97)]
HOLE = [(12, 40), (31, 40), (31, 22), (12, 22)]
ON_CENTRE = [(15, 85), (65, 45), (25, 5)]


def brute(rings_):
    out = set()
    for r in range(10):
        for c in range(10):
            x, y = c * 10 + 5, 100 - (r * 10 + 5)
            odd = 0
            for ring in rings_:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x:
                        odd ^= 1
            if odd:
                out.add((r, c))
    return out


def test_cells_inside_with_hole_and_vertex_on_row_centre(spark):
    for shape in ([L_SHAPE], [L_SHAPE, HOLE], [ON_CENTRE]):
        got = {(g["row"], g["col"]) for g in V.cells_inside(V.edges(rings(spark, shape)), LAT).collect()}
        assert got == brute(shape)


def test_edges_close_every_ring(spark):
    e = V.edges(rings(spark, [L_SHAPE, HOLE])).collect()
    assert len(e) == len(L_SHAPE) + len(HOLE)
    closing = [x for x in e if x["ring_id"] == 0 and x["seq"] == len(L_SHAPE) - 1][0]
    assert (closing["x2"], closing["y2"]) == L_SHAPE[0]


def test_tiles_meeting_covers_interior_and_buffer(spark):
    e = V.edges(rings(spark, [[(15, 85), (85, 85), (85, 15), (15, 15)]]))
    plain = {(g["row"], g["col"]) for g in V.tiles_meeting(e, LAT, 0.0).collect()}
    assert plain == {(r, c) for r in range(1, 9) for c in range(1, 9)}
    wide = {(g["row"], g["col"]) for g in V.tiles_meeting(e, LAT, 6.0).collect()}
    assert wide >= {(r, c) for r in range(10) for c in range(1, 9)} and (0, 0) not in wide


def test_one_polygon_needs_exactly_one(spark):
    import pytest
    from pyspark.sql import functions as F

    v = rings(spark, [L_SHAPE]).withColumn("name", F.lit("a"))
    assert V.one_polygon(v, "a").count() == len(L_SHAPE)
    with pytest.raises(ValueError):
        V.one_polygon(v, "b")


def test_albers_keeps_areas(spark):
    from pyspark.sql import functions as F

    from terrashift.functions.projection import albers_forward

    d = 1e-3
    pts = [(lon, lat) for lon in (-100.0, -82.0) for lat in (25.0, 30.0)]
    df = spark.createDataFrame([(i, a + dx * d, b + dy * d) for i, (a, b) in enumerate(pts) for dx, dy in ((0, 0), (1, 0), (0, 1))], "i int, lon double, lat double")
    x, y = albers_forward(F.col("lon"), F.col("lat"))
    out = df.select("i", x.alias("x"), y.alias("y")).toPandas()
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    for i, (_, lat) in enumerate(pts):
        p = out[out.i == i][["x", "y"]].to_numpy()
        (ax, ay), (bx, by) = p[1] - p[0], p[2] - p[0]
        area = abs(ax * by - ay * bx)
        phi = np.radians(lat + d / 2)
        w = 1 - e2 * np.sin(phi) ** 2
        true = 6378137.0**2 * (1 - e2) * np.cos(phi) / w**2 * np.radians(d) ** 2
        assert abs(area / true - 1) < 1e-3
