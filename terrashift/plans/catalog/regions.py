"""Polygon, tile-grid and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.functions import lattice as L
from terrashift.functions.projection import Albers, albers_forward
from terrashift.operators import vector as vec
from terrashift.plans.fixtures import LAT, Fixtures
from terrashift.plans.registry import register

LOT = LAT.coarser(20)

# Even-odd test by counting crossings of a ray, written without spans.
_INSIDE = """ins AS (SELECT p.row, p.col, e.poly_id FROM px p JOIN edg e ON least(e.y1, e.y2) <= p.y AND p.y < greatest(e.y1, e.y2)
      WHERE e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) <= p.x GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)"""


@register("polygon_edges", "G2", "SELECT poly_id, ring_id, seq, x1, y1, x2, y2 FROM edg")
def polygon_edges(fx: Fixtures):
    return vec.edges(fx.vertices)


@register("pixels_in_polygons", "G2 J14", f"{_INSIDE} SELECT row, col, poly_id FROM ins")
def pixels_in_polygons(fx: Fixtures):
    return vec.pixels_inside(fx.pixels.select("row", "col"), vec.edges(fx.vertices), LAT).select("row", "col", "poly_id")


@register("cover_inside_polygons", "J14 G18", f"{_INSIDE} SELECT i.poly_id, p.lc_2019, COUNT(*) AS n FROM ins i JOIN px p ON p.row = i.row AND p.col = i.col GROUP BY 1, 2")
def cover_inside_polygons(fx: Fixtures):
    inside = vec.pixels_inside(fx.pixels.select("row", "col", "lc_2019"), vec.edges(fx.vertices), LAT)
    return inside.groupBy("poly_id", "lc_2019").agg(F.count(F.lit(1)).alias("n"))


@register("buffered_bounds", "G3 S5", "SELECT poly_id, min(x) - 100 AS minx, min(y) - 100 AS miny, max(x) + 100 AS maxx, max(y) + 100 AS maxy FROM vtx GROUP BY 1")
def buffered_bounds(fx: Fixtures):
    return vec.bounds(fx.vertices, ["poly_id"], 100.0)


_TILES = """rng AS (SELECT poly_id, CAST(floor((3314805 - max(y) - 50) / 600) AS INTEGER) AS r0, CAST(floor((3314805 - min(y) + 50) / 600) AS INTEGER) AS r1, CAST(floor((min(x) - 50 + 2415585) / 600) AS INTEGER) AS c0, CAST(floor((max(x) + 50 + 2415585) / 600) AS INTEGER) AS c1 FROM vtx GROUP BY 1),
    cand AS (SELECT poly_id, row, unnest(range(c0, c1 + 1)) AS col FROM (SELECT *, unnest(range(r0, r1 + 1)) AS row FROM rng)),
    tb AS (SELECT *, -2415585.0::DOUBLE + col * 600.0::DOUBLE AS minx, 3314805.0::DOUBLE - row * 600.0::DOUBLE AS maxy, -2415585.0::DOUBLE + col * 600.0::DOUBLE + 600 AS maxx, 3314805.0::DOUBLE - row * 600.0::DOUBLE - 600 AS miny FROM cand),
    ed AS (SELECT poly_id, x1, y1, x2, y2, x2 - x1 AS dx, y2 - y1 AS dy FROM edg),
    te AS (SELECT t.*, x1, y1, x2, y2, dx, dy, dx * dx + dy * dy AS l2 FROM tb t JOIN ed USING (poly_id)),
    cor AS (SELECT *, unnest([minx, minx, maxx, maxx]) AS cx, unnest([miny, maxy, miny, maxy]) AS cy FROM te),
    cd AS (SELECT poly_id, row, col, minx, miny, maxx, maxy, x1, y1, x2, y2, min(sqrt(pow(x1 + k * dx - cx, 2) + pow(y1 + k * dy - cy, 2))) AS dc, min(dx * (cy - y1) - dy * (cx - x1)) AS smin, max(dx * (cy - y1) - dy * (cx - x1)) AS smax
      FROM (SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0, least(1, ((cx - x1) * dx + (cy - y1) * dy) / l2)) END AS k FROM cor) GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    hit AS (SELECT DISTINCT poly_id, row, col FROM cd WHERE least(dc, sqrt(pow(greatest(minx - x1, 0, x1 - maxx), 2) + pow(greatest(miny - y1, 0, y1 - maxy), 2)), sqrt(pow(greatest(minx - x2, 0, x2 - maxx), 2) + pow(greatest(miny - y2, 0, y2 - maxy), 2))) <= 50
      OR (least(x1, x2) <= maxx AND greatest(x1, x2) >= minx AND least(y1, y2) <= maxy AND greatest(y1, y2) >= miny AND smin <= 0 AND smax >= 0)),
    mid AS (SELECT t.poly_id, t.row, t.col FROM tb t JOIN ed e ON e.poly_id = t.poly_id AND least(e.y1, e.y2) <= t.maxy - 300 AND t.maxy - 300 < greatest(e.y1, e.y2)
      WHERE e.x1 + (t.maxy - 300 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) <= t.minx + 300 GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1),
    til_hit AS (SELECT * FROM hit UNION SELECT * FROM mid)"""


@register("tiles_near_polygons", "G1 J13 J12 X15", f"""{_TILES}
    SELECT h.poly_id, printf('r%03d_c%03d', h.row, h.col) AS tile_id, CAST(h.row AS INTEGER) AS row, CAST(h.col AS INTEGER) AS col, minx, miny, maxx, maxy FROM til_hit h JOIN tb USING (poly_id, row, col)""")
def tiles_near_polygons(fx: Fixtures):
    """Tiles of 20 x 20 cells within 50 m of each polygon."""
    return vec.tiles_meeting(vec.edges(fx.vertices), LOT, 50.0)


@register("tile_grid", "G1 X5 X15", """
    SELECT printf('r%03d_c%03d', row // 32, col // 32) AS tile_id, CAST(row // 32 AS INTEGER) AS row, CAST(col // 32 AS INTEGER) AS col, -2415585.0::DOUBLE + (col // 32) * 960.0::DOUBLE AS minx,
      3314805.0::DOUBLE - (row // 32) * 960.0::DOUBLE - 960 AS miny, -2415585.0::DOUBLE + (col // 32) * 960.0::DOUBLE + 960 AS maxx, 3314805.0::DOUBLE - (row // 32) * 960.0::DOUBLE AS maxy FROM px GROUP BY ALL""")
def tile_grid(fx: Fixtures):
    from terrashift.plans.fixtures import TILE

    cells = fx.pixels.select(L.cell_row(F.col("y"), TILE).alias("row"), L.cell_col(F.col("x"), TILE).alias("col")).distinct()
    return vec.tile_boxes(cells, TILE)


@register("nearest_tile", "J16 T4", """
    t AS (SELECT DISTINCT tile_id, -2415585.0::DOUBLE + (col // 32) * 960.0::DOUBLE AS minx, 3314805.0::DOUBLE - (row // 32) * 960.0::DOUBLE AS maxy FROM smp)
    SELECT tile_id, round(d, 6) AS dist_m FROM (SELECT tile_id, sqrt(pow(greatest(minx - -2416000.0, 0, -2416000.0 - minx - 960), 2) + pow(greatest(maxy - 960 - 3313000.0, 0, 3313000.0 - maxy), 2)) AS d FROM t) ORDER BY d, tile_id LIMIT 1""")
def nearest_tile(fx: Fixtures):
    from terrashift.plans.fixtures import TILE

    r, c = L.parse_tile_id(F.col("tile_id"))
    tiles = vec.tile_boxes(fx.samples.select("tile_id").distinct().select(r.alias("row"), c.alias("col")), TILE)
    return vec.nearest_tile(tiles, -2416000.0, 3313000.0).withColumn("dist_m", F.round("dist_m", 6))


def _albers_sql() -> str:
    p = Albers()
    k = p.constants()
    e, e2, n, c, rho0 = k["e"], p.e2, k["n"], k["c"], k["rho0"]
    return f"""
    g AS (SELECT c_custkey, -88.0::DOUBLE + (c_custkey % 997) / 100.0::DOUBLE AS lon, 24.0::DOUBLE + (c_acctbal + 1000) / 1000.0::DOUBLE AS lat FROM customer),
    s AS (SELECT *, sin(radians(lat)) AS s FROM g),
    q AS (SELECT *, (1 - {e2!r}::DOUBLE) * (s / (1 - {e2!r}::DOUBLE * s * s) - ln((1 - {e!r}::DOUBLE * s) / (1 + {e!r}::DOUBLE * s)) / (2 * {e!r}::DOUBLE)) AS q FROM s),
    r AS (SELECT *, sqrt({c!r}::DOUBLE - {n!r}::DOUBLE * q) * {p.a / n!r}::DOUBLE AS rho, radians(lon + 96) * {n!r}::DOUBLE AS th FROM q)
    SELECT c_custkey, round(rho * sin(th), 2) AS x, round({rho0!r}::DOUBLE - rho * cos(th), 2) AS y FROM r"""


@register("albers_projection", "X14", _albers_sql())
def albers_projection(fx: Fixtures):
    cust = fx.table("customer").select(
        "c_custkey", (F.lit(-88.0) + F.col("c_custkey") % 997 / F.lit(100.0)).alias("lon"), (F.lit(24.0) + (F.col("c_acctbal") + 1000) / F.lit(1000.0)).alias("lat")
    )
    x, y = albers_forward(F.col("lon"), F.col("lat"))
    return cust.select("c_custkey", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))
