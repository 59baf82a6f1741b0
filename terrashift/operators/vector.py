"""Polygon operators on vertex tables (poly_id, ring_id, seq, x, y), without a geometry library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.config import Lattice
from terrashift.functions import lattice as L

RING = ["poly_id", "ring_id"]


def edges(vertices: DataFrame) -> DataFrame:
    """Closed-ring edges (poly_id, ring_id, seq, x1, y1, x2, y2); ``seq`` counts without gaps inside a ring.

    A vertex meets its successor through an equi-join on the position, so a coastline with most of all vertices is
    spread like any other ring; the closing edge comes from an aggregate.
    """
    succ = vertices.select(*RING, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    here = vertices.select(*RING, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    open_edges = here.join(succ, [*RING, "seq"])
    ends = vertices.groupBy(*RING).agg(
        F.max(F.struct("seq", "x", "y")).alias("e"), F.min(F.struct("seq", "x", "y")).alias("s")
    )
    closing = ends.select(*RING, "e.seq", F.col("e.x").alias("x1"), F.col("e.y").alias("y1"), F.col("s.x").alias("x2"), F.col("s.y").alias("y2"))
    return open_edges.unionByName(closing)


def bounds(vertices: DataFrame, keys: list[str], buffer_m: float = 0.0) -> DataFrame:
    b = F.lit(buffer_m)
    return vertices.groupBy(*keys).agg(
        (F.min("x") - b).alias("minx"), (F.min("y") - b).alias("miny"),
        (F.max("x") + b).alias("maxx"), (F.max("y") + b).alias("maxy"),
    )


def one_polygon(vertices: DataFrame, name: str) -> DataFrame:
    """The polygon with a name; fails unless exactly one matches."""
    found = vertices.where(F.col("name") == name)
    n = found.agg(F.count_distinct("poly_id")).first()[0]
    if n != 1:
        raise ValueError(f"expected exactly one polygon named {name}, found {n}")
    return found


def _crossings(edge: DataFrame, lat: Lattice) -> DataFrame:
    """Where edges cross the centre lines of lattice rows; an edge owns its lower end and not its upper one."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    half = F.lit(0.5)
    first = F.floor((F.lit(lat.origin_y) - hi) / F.lit(lat.pixel_m) - half).cast("int")
    last = F.ceil((F.lit(lat.origin_y) - lo) / F.lit(lat.pixel_m) - half).cast("int")
    yc = L.center_y(F.col("row"), lat)
    x = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return (
        edge.where("y1 <> y2")
        .withColumn("row", F.explode(F.sequence(first, last)))
        .where((lo <= yc) & (yc < hi))
        .select("poly_id", "row", x.alias("xc"))
    )


def spans(edge: DataFrame, lat: Lattice) -> DataFrame:
    """Even-odd spans (poly_id, row, x_from, x_to) along row centre lines; holes are gaps between spans.

    A window holds the crossings of one polygon with one row, so its size is the complexity of an outline, not the
    number of pixels.
    """
    w = Window.partitionBy("poly_id", "row").orderBy("xc")
    paired = _crossings(edge, lat).select(
        "poly_id", "row", F.col("xc").alias("x_from"), F.lead("xc").over(w).alias("x_to"),
        F.row_number().over(w).alias("i"),
    )
    return paired.where("i % 2 = 1 and x_to is not null").drop("i")


def cell_runs(edge: DataFrame, lat: Lattice) -> DataFrame:
    """Runs (poly_id, row, a, b) of cells whose centre is inside: x_from <= centre < x_to."""
    def first_at_or_after(x: str) -> Column:
        return F.ceil((F.col(x) - F.lit(lat.origin_x)) / F.lit(lat.pixel_m) - F.lit(0.5)).cast("int")

    s = spans(edge, lat).select("poly_id", "row", first_at_or_after("x_from").alias("a"), (first_at_or_after("x_to") - 1).alias("b"))
    return s.where("a <= b")


def cells_inside(edge: DataFrame, lat: Lattice) -> DataFrame:
    """The same as single cells (poly_id, row, col)."""
    return cell_runs(edge, lat).select("poly_id", "row", F.explode(F.sequence("a", "b")).alias("col"))


def pixels_inside(pixels: DataFrame, edge: DataFrame, lat: Lattice, chunk: int = 256) -> DataFrame:
    """Pixels with the polygons they lie in. Runs are cut into chunks of columns and joined on (row, chunk), so what moves
    is a row for each run and chunk, not for each cell, and a long raster row is spread."""
    def part(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(float(chunk)))

    runs = cell_runs(edge, lat).withColumn("_part", F.explode(F.sequence(part("a"), part("b"))))
    return pixels.withColumn("_part", part("col")).join(runs, ["row", "_part"]).where("col between a and b").drop("_part", "a", "b")


def segment_box_distance(x1, y1, x2, y2, minx, miny, maxx, maxy) -> Column:
    """Distance between a segment and an axis-parallel box, zero where they touch."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy

    def point_box(px, py):
        ox = F.greatest(minx - px, F.lit(0.0), px - maxx)
        oy = F.greatest(miny - py, F.lit(0.0), py - maxy)
        return F.sqrt(ox * ox + oy * oy)

    def corner(px, py):
        t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, len2), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        ex, ey = x1 + t * dx - px, y1 + t * dy - py
        return F.sqrt(ex * ex + ey * ey)

    # A segment meets the box when both projections overlap and the corners are not all on one side of its line.
    sides = [dx * (cy - y1) - dy * (cx - x1) for cx in (minx, maxx) for cy in (miny, maxy)]
    meets = (
        (F.least(x1, x2) <= maxx) & (F.greatest(x1, x2) >= minx)
        & (F.least(y1, y2) <= maxy) & (F.greatest(y1, y2) >= miny)
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )
    gap = F.least(point_box(x1, y1), point_box(x2, y2), *[corner(cx, cy) for cx in (minx, maxx) for cy in (miny, maxy)])
    return F.when(meets, F.lit(0.0)).otherwise(gap)


def tiles_meeting(edge: DataFrame, lat: Lattice, buffer_m: float) -> DataFrame:
    """Tiles (poly_id, row, col, tile_id, box) of a grid within ``buffer_m`` of a polygon.

    Each edge is sent to the few tiles around it and tested exactly; tiles without a near edge are wholly inside or
    outside, which their centre decides. No tile is ever paired with all edges.
    """
    b = F.lit(buffer_m)
    r0 = L.cell_row(F.greatest("y1", "y2") + b, lat)
    r1 = L.cell_row(F.least("y1", "y2") - b, lat)
    c0 = L.cell_col(F.least("x1", "x2") - b, lat)
    c1 = L.cell_col(F.greatest("x1", "x2") + b, lat)
    near = (
        edge.withColumn("row", F.explode(F.sequence(r0, r1)))
        .withColumn("col", F.explode(F.sequence(c0, c1)))
    )
    box = L.cell_box(F.col("row"), F.col("col"), lat)
    gap = segment_box_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), **box)
    touched = near.where(gap <= buffer_m).select("poly_id", "row", "col")
    tiles = touched.unionByName(cells_inside(edge, lat)).distinct()
    return tiles.select(
        "poly_id", L.tile_id(F.col("row"), F.col("col")).alias("tile_id"), "row", "col",
        *[e.alias(n) for n, e in box.items()],
    )


def nearest_tile(tiles: DataFrame, x: float, y: float) -> DataFrame:
    """Tile with the smallest box distance to a point; ties go to the smaller id."""
    ox = F.greatest(F.col("minx") - x, F.lit(0.0), F.lit(x) - F.col("maxx"))
    oy = F.greatest(F.col("miny") - y, F.lit(0.0), F.lit(y) - F.col("maxy"))
    d = F.sqrt(ox * ox + oy * oy)
    return tiles.agg(F.min(F.struct(d.alias("dist_m"), "tile_id")).alias("t")).select("t.tile_id", "t.dist_m")


def tile_boxes(rows: DataFrame, lat: Lattice) -> DataFrame:
    return rows.select(
        "row", "col", L.tile_id(F.col("row"), F.col("col")).alias("tile_id"),
        *[e.alias(n) for n, e in L.cell_box(F.col("row"), F.col("col"), lat).items()],
    )


def overlapping(granules: DataFrame, box: dict[str, float]) -> DataFrame:
    """Granules whose outline overlaps a box."""
    return granules.where(
        (F.col("minx") < box["maxx"]) & (F.col("maxx") > box["minx"])
        & (F.col("miny") < box["maxy"]) & (F.col("maxy") > box["miny"])
    )
