"""Raster neighbourhood queries on the pixel grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.operators import audit as A
from terrashift.operators import raster as R
from terrashift.operators import tiles as ti
from terrashift.plans.fixtures import DIST, Fixtures, LAT
from terrashift.plans.registry import register

_DEV = "dev AS (SELECT row, col, CAST(lc_2019 BETWEEN 21 AND 24 AS INTEGER) AS m FROM px), dim AS (SELECT max(row) AS r1, max(col) AS c1 FROM px)"
_PLUS = f"""{_DEV}, nb AS (SELECT d.row, d.col, d.m AS own, (SELECT 1) AS one,
      d.m + coalesce(u.m, 0) + coalesce(b.m, 0) + coalesce(l.m, 0) + coalesce(r.m, 0) AS k
      FROM dev d LEFT JOIN dev u ON u.row = d.row - 1 AND u.col = d.col LEFT JOIN dev b ON b.row = d.row + 1 AND b.col = d.col
      LEFT JOIN dev l ON l.row = d.row AND l.col = d.col - 1 LEFT JOIN dev r ON r.row = d.row AND r.col = d.col + 1)"""


def _marked(fx: Fixtures):
    return fx.pixels.where(F.col("lc_2019").isin(*C.DEVELOPED_CODES)).select("row", "col")


def _box(mask: str, r: int) -> str:
    """Mean of ``mask`` over a clamped box, as sums along rows and then along columns."""
    return f"""h{r}_{mask} AS (SELECT a.row, a.col, SUM(b.m) AS s FROM (SELECT row, col, unnest(range(-{r}, {r} + 1)) AS o FROM {mask}) a, dim, {mask} b
        WHERE b.row = a.row AND b.col = greatest(0, least(c1, a.col + a.o)) GROUP BY 1, 2),
      v{r}_{mask} AS (SELECT a.row, a.col, SUM(b.s)::DOUBLE / {(2 * r + 1) ** 2} AS f FROM (SELECT row, col, unnest(range(-{r}, {r} + 1)) AS o FROM smp) a, dim, h{r}_{mask} b
        WHERE b.col = a.col AND b.row = greatest(0, least(r1, a.row + a.o)) GROUP BY 1, 2)"""


@register("dilated_development", "W1", f"{_PLUS} SELECT row, col FROM nb WHERE k >= 1")
def dilated_development(fx: Fixtures):
    return R.dilate(_marked(fx), R.Extent.of(fx.pixels))


@register("eroded_wetland", "W1", f"""
    wet AS (SELECT row, col FROM px WHERE lc_2019 IN (90, 95)), o AS (SELECT unnest([0, -1, 1, 0, 0]) AS dr, unnest([0, 0, 0, -1, 1]) AS dc)
    SELECT w.row, w.col FROM wet w, o JOIN wet n ON n.row = w.row + o.dr AND n.col = w.col + o.dc GROUP BY 1, 2 HAVING COUNT(*) = 5""")
def eroded_wetland(fx: Fixtures):
    wet = fx.pixels.where(F.col("lc_2019").isin(*C.WETLAND_CODES)).select("row", "col")
    return R.erode(wet, R.Extent.of(fx.pixels))


@register("development_edges", "G8 W1", f"{_PLUS} SELECT row, col FROM nb WHERE k >= 1 AND k < 5")
def development_edges(fx: Fixtures):
    return R.edge_cells(_marked(fx), R.Extent.of(fx.pixels))


@register("local_density", "G7 W2", f"""{_DEV}, {_box('dev', 3)}, {_box('dev', 10)}, {_box('dev', 17)}
    SELECT row, col, round(a.f, 7) AS frac_dev_100m, round(b.f, 7) AS frac_dev_300m, round(c.f, 7) AS frac_dev_500m FROM v3_dev a JOIN v10_dev b USING (row, col) JOIN v17_dev c USING (row, col)""")
def local_density(fx: Fixtures):
    ext = R.Extent.of(fx.pixels)
    layers = {n: ("developed", R.radius_px(r)) for n, r in C.DENSITY_RADII_M.items()}
    out = R.box_means(_marked(fx).withColumn("layer", F.lit("developed")), fx.stored, ext, layers)
    return out.withColumns({n: F.round(n, 7) for n in layers})


@register("edge_density", "G8 W2", f"""{_PLUS}, edge AS (SELECT row, col, CAST(k BETWEEN 1 AND 4 AS INTEGER) AS m FROM nb), {_box('edge', 10)}
    SELECT row, col, round(f, 7) AS edge_density_300m FROM v10_edge""")
def edge_density(fx: Fixtures):
    ext = R.Extent.of(fx.pixels)
    edges = R.edge_cells(_marked(fx), ext).withColumn("layer", F.lit("edge"))
    out = R.box_means(edges, fx.stored, ext, {"edge_density_300m": ("edge", 10)}, window=64)
    return out.withColumn("edge_density_300m", F.round("edge_density_300m", 7))


@register("nearest_in_column", "W3", f"""
    d AS (SELECT row, col FROM px WHERE lc_2019 BETWEEN 21 AND 24)
    SELECT s.row, s.col, CAST(arg_min(d.row, (abs(d.row - s.row), d.row)) AS INTEGER) AS near_row FROM smp s JOIN d USING (col) GROUP BY 1, 2""")
def nearest_in_column(fx: Fixtures):
    """Nearest developed row within each column."""
    return R.column_nearest(_marked(fx), fx.stored, R.Extent.of(fx.pixels), strip=16, slab=64)


_NEAR = """d AS (SELECT row, col FROM px WHERE lc_2019 BETWEEN 21 AND 24),
    n AS (SELECT s.row, s.col, min(((d.row - s.row) * (d.row - s.row) + (d.col - s.col) * (d.col - s.col)) * 100000000::BIGINT + d.row * 10000 + d.col) AS k FROM smp s, d GROUP BY 1, 2),
    near AS (SELECT row, col, k // 100000000 AS d2, CAST((k % 100000000) // 10000 AS INTEGER) AS near_row, CAST(k % 10000 AS INTEGER) AS near_col FROM n)"""


@register("distance_to_development", "G6 J15", f"{_NEAR} SELECT row, col, near_row, near_col, round(sqrt(d2) * 30, 5) AS dist_m FROM near")
def distance_to_development(fx: Fixtures):
    near = R.nearest_marked(_marked(fx), fx.stored, R.Extent.of(fx.pixels))
    return near.withColumn("dist_m", F.round("dist_m", 5))


@register("direction_to_development", "G9 X2", f"""{_NEAR}
    SELECT row, col, round(sin(atan2((near_row - row) * -30.0::DOUBLE, (near_col - col) * 30.0::DOUBLE)), 7) AS dev_dir_sin, round(cos(atan2((near_row - row) * -30.0::DOUBLE, (near_col - col) * 30.0::DOUBLE)), 7) AS dev_dir_cos FROM near""")
def direction_to_development(fx: Fixtures):
    near = R.nearest_marked(_marked(fx), fx.stored, R.Extent.of(fx.pixels))
    s, c = R.direction(F.col("row"), F.col("col"), F.col("near_row"), F.col("near_col"))
    return near.select("row", "col", F.round(s, 7).alias("dev_dir_sin"), F.round(c, 7).alias("dev_dir_cos"))


@register("neighbourhood_feature_table", "G10 J1 J4", f"""{_PLUS}, edge AS (SELECT row, col, CAST(k BETWEEN 1 AND 4 AS INTEGER) AS m FROM nb), {_box('dev', 3)}, {_box('dev', 10)}, {_box('dev', 17)}, {_box('edge', 10)}, {_NEAR}
    SELECT row, col, round(a.f, 5) AS frac_dev_100m, round(b.f, 5) AS frac_dev_300m, round(c.f, 5) AS frac_dev_500m, round(e.f, 5) AS edge_density_300m,
      round(sin(atan2((near_row - row) * -30.0::DOUBLE, (near_col - col) * 30.0::DOUBLE)), 5) AS dev_dir_sin, round(cos(atan2((near_row - row) * -30.0::DOUBLE, (near_col - col) * 30.0::DOUBLE)), 5) AS dev_dir_cos
    FROM v3_dev a JOIN v10_dev b USING (row, col) JOIN v17_dev c USING (row, col) JOIN v10_edge e USING (row, col) JOIN near USING (row, col)""")
def neighbourhood_feature_table(fx: Fixtures):
    nf = R.neighbourhood_features(fx.pixels, "lc_2019", fx.stored, R.Extent.of(fx.pixels))
    return nf.select("row", "col", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in C.NEIGHBOUR_COLS])


@register("block_max_downsample", "G11", """
    SELECT CAST(row // 20 AS INTEGER) AS row, CAST(col // 20 AS INTEGER) AS col, max(lc_2024) AS lc_2024 FROM px, (SELECT (max(row) + 1) // 20 * 20 AS h, (max(col) + 1) // 20 * 20 AS w FROM px) WHERE row < h AND col < w GROUP BY 1, 2""")
def block_max_downsample(fx: Fixtures):
    return R.block_max(fx.pixels, "lc_2024", R.Extent.of(fx.pixels), 20)


@register("stride_downsample", "G12", "SELECT CAST(row // 20 AS INTEGER) AS row, CAST(col // 20 AS INTEGER) AS col, dist_m FROM px WHERE row % 20 = 0 AND col % 20 = 0")
def stride_downsample(fx: Fixtures):
    return R.stride(fx.pixels.select("row", "col", DIST), R.Extent.of(fx.pixels), 20)


@register("conversion_overlays", "G13 P15", """
    SELECT CAST(CASE WHEN lc_2019 IN (90, 95) AND lc_2024 BETWEEN 21 AND 24 THEN 2 WHEN lc_2019 IN (90, 95) THEN 1 ELSE 0 END AS INTEGER) AS overlay,
      CAST(CASE WHEN lc_2019 NOT IN (90, 95) THEN -1 WHEN lc_2024 IN (90, 95) THEN 0 WHEN lc_2024 BETWEEN 21 AND 24 THEN 1 ELSE 2 END AS INTEGER) AS outcome, COUNT(*) AS n FROM px GROUP BY 1, 2""")
def conversion_overlays(fx: Fixtures):
    a, b = F.col("lc_2019"), F.col("lc_2024")
    return fx.pixels.groupBy(R.conversion_overlay(a, b).alias("overlay"), R.outcome_grid(a, b).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("mean_reduced_bands", "G14", """
    v AS (SELECT year, row // 3 AS row, col // 3 AS col, unnest(bands) AS b, generate_subscripts(bands, 1) AS i FROM til),
    m AS (SELECT year, row, col, i, avg(b) FILTER (b <> 0) AS a FROM v GROUP BY ALL)
    SELECT CAST(year AS INTEGER) AS year, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(max(a) FILTER (i = 1), 6) AS b0, round(max(a) FILTER (i = 64), 6) AS b63,
      round(coalesce(SUM(a), 0), 5) AS total, COUNT(a) AS bands_with_data FROM m GROUP BY ALL""")
def mean_reduced_bands(fx: Fixtures):
    m = R.mean_reduce(fx.tiles, ["year"], "bands", 64)
    total = F.aggregate("bands", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return m.select(
        "year", "row", "col", F.round(F.element_at("bands", 1), 6).alias("b0"), F.round(F.element_at("bands", 64), 6).alias("b63"),
        F.round(total, 5).alias("total"), F.size(F.filter("bands", lambda v: v.isNotNull())).cast("bigint").alias("bands_with_data"),
    )


@register("granule_mosaic", "G15", """
    g AS (SELECT row, col, max(year) FILTER (list_max(bands) > 0) AS year FROM til GROUP BY 1, 2)
    SELECT g.row, g.col, CAST(g.year AS INTEGER) AS year, coalesce(CAST(t.bands[1] AS INTEGER), 0) AS b0, CAST(coalesce(list_sum([t.bands[i] * i for i in range(1, 65)]), 0) AS BIGINT) AS code_sum FROM g LEFT JOIN til t ON t.row = g.row AND t.col = g.col AND t.year = g.year""")
def granule_mosaic(fx: Fixtures):
    """Yearly tiles as overlapping granules: the newest one with data wins, gaps are filled with nodata."""
    m = R.mosaic(fx.tiles.select("row", "col", "year", "bands"), "year", "bands")
    weighed = F.aggregate(F.transform("bands", lambda v, i: v.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return m.select(
        "row", "col", "year", F.coalesce(F.element_at("bands", 1).cast("int"), F.lit(0)).alias("b0"), F.coalesce(weighed, F.lit(0)).alias("code_sum")
    )


@register("before_after_extents", "G18 A28", """
    e AS (SELECT lc_2019 IN (90, 95) AS wb, lc_2024 IN (90, 95) AS wt, lc_2019 BETWEEN 21 AND 24 AS db, lc_2024 BETWEEN 21 AND 24 AS dt, lc_2024 <> 250 AS ok FROM px),
    c AS (SELECT unnest(['wetland_base', 'wetland_target', 'developed_base', 'developed_target', 'wetland_to_developed', 'wetland_to_other']) AS extent,
      unnest([COUNT(*) FILTER (wb), COUNT(*) FILTER (wt), COUNT(*) FILTER (db), COUNT(*) FILTER (dt), COUNT(*) FILTER (wb AND dt), COUNT(*) FILTER (wb AND NOT wt AND NOT dt AND ok)]) AS pixels FROM e)
    SELECT extent, pixels, round(pixels * 900 / 1e6, 6) AS area_km2 FROM c""")
def before_after_extents(fx: Fixtures):
    e = R.extent_counts(fx.pixels, "lc_2019", "lc_2024")
    return e.withColumn("area_km2", F.round("area_km2", 6))


@register("cover_transitions", "G18", "SELECT lc_2019, lc_2024, COUNT(*) AS n FROM px GROUP BY 1, 2")
def cover_transitions(fx: Fixtures):
    return R.transitions(fx.pixels, "lc_2019", "lc_2024")


@register("raster_validation", "G19 A30 A31 X11", """
    s AS (SELECT tile_id, min(x.lo) AS lo, max(x.hi) AS hi, bool_and(x.a = x.b) AS same FROM (
      SELECT a.tile_id, list_min([v for v in a.bands if v <> 0]) AS lo, list_max([v for v in a.bands if v <> 0]) AS hi, a.bands AS a, b.bands AS b FROM til a JOIN til b ON a.row = b.row AND a.col = b.col AND b.year = 2018 WHERE a.year = 2019) x GROUP BY 1)
    SELECT tile_id, CASE WHEN NOT ((lo - 128) / 127.0 >= -1.01 AND (hi - 128) / 127.0 <= 1.01) THEN 'FAILED' WHEN same THEN 'VALID' WHEN CAST(substr(tile_id, 7) AS INTEGER) % 2 = 0 THEN 'FAILED' ELSE 'INCONCLUSIVE' END AS verdict FROM s""")
def raster_validation(fx: Fixtures):
    """Check a year of every tile against another year; odd tile columns count as covered by two granules."""
    from terrashift.functions import lattice as L

    a = fx.tiles.where("year = 2019").select("row", "col", "tile_id", "bands")
    b = fx.tiles.where("year = 2018").select("row", "col", F.col("bands").alias("other"))
    covered = F.filter("bands", lambda v: v != C.BAND_NODATA)
    corner = (L.center_x(F.col("col"), LAT) - LAT.pixel_m / 2, L.center_y(F.col("row"), LAT) + LAT.pixel_m / 2)
    on_lattice = L.is_aligned(*corner, LAT)
    g = a.join(b, ["row", "col"]).groupBy("tile_id").agg(
        E.decode_band(F.min(F.array_min(covered))).alias("lo"), E.decode_band(F.max(F.array_max(covered))).alias("hi"),
        F.bool_and(F.col("bands") == F.col("other")).alias("same"), F.bool_and(on_lattice).alias("aligned"),
    )
    n = F.when(L.parse_tile_id(F.col("tile_id"))[1] % 2 == 0, 1).otherwise(2)
    verdict = A.validation_verdict(A.range_ok(F.col("lo"), F.col("hi")), F.col("aligned"), F.col("same"), n)
    return g.select("tile_id", verdict.alias("verdict"))


@register("patch_center_pixels", "T4 X18", """
    v AS (SELECT tile_id, tile_row, tile_col, (tile_row - 16) * (tile_row - 16) + (tile_col - 16) * (tile_col - 16) AS d FROM til WHERE year = 2019 AND list_max(bands) > 0)
    SELECT tile_id, d::DOUBLE AS d2, tile_row, tile_col, CAST(greatest(0, least(tile_row - 4, 24)) AS INTEGER) AS row_off, CAST(greatest(0, least(tile_col - 4, 24)) AS INTEGER) AS col_off
    FROM v QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY d, tile_row, tile_col) = 1""")
def patch_center_pixels(fx: Fixtures):
    """Covered pixel nearest to the middle of each tile and the patch around it that stays inside."""
    from terrashift.functions import lattice as L

    c = A.nearest_valid(fx.tiles.where("year = 2019"), ["tile_id"], E.has_coverage(F.col("bands")), 16.0)
    return c.withColumns({"row_off": L.clamp_offset(F.col("tile_row"), 8, 32), "col_off": L.clamp_offset(F.col("tile_col"), 8, 32)})


@register("label_table", "G4 G5 G6 P4 J14 S8", f"""{_NEAR}
    SELECT s.row, s.col, s.x, s.y, s.lc_2019, s.lc_2024, round(sqrt(d2) * 30, 5) AS dist_m, s.label, s.label_name, s.block_id FROM smp s JOIN near n ON s.row = n.row AND s.col = n.col""")
def label_table(fx: Fixtures):
    """The label table end to end: masks, distance transform, transition labels, block ids."""
    p = fx.pixels.drop(DIST)
    near = R.nearest_marked(_marked(fx), p.where(F.col("lc_2019").isin(*C.WETLAND_CODES)), R.Extent.of(fx.pixels))
    s = ti.labelled_sample(p, "lc_2019", "lc_2024").join(near.select("row", "col", F.round("dist_m", 5).alias(DIST)), ["row", "col"])
    from terrashift.plans.fixtures import BLOCK

    return ti.with_block_id(s, BLOCK).select("row", "col", "x", "y", "lc_2019", "lc_2024", DIST, "label", "label_name", "block_id")
