"""Column expressions on a square lattice: indices, ids, centres, boxes, snapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrashift.config import Lattice


def cell_row(y: Column, lat: Lattice) -> Column:
    return F.floor((F.lit(lat.origin_y) - y.cast("double")) / F.lit(lat.pixel_m)).cast("int")


def cell_col(x: Column, lat: Lattice) -> Column:
    return F.floor((x.cast("double") - F.lit(lat.origin_x)) / F.lit(lat.pixel_m)).cast("int")


def center_x(col: Column, lat: Lattice) -> Column:
    return F.lit(lat.origin_x) + (col + F.lit(0.5)) * F.lit(lat.pixel_m)


def center_y(row: Column, lat: Lattice) -> Column:
    return F.lit(lat.origin_y) - (row + F.lit(0.5)) * F.lit(lat.pixel_m)


def _padded(v: Column, width: int) -> Column:
    """Zero-padded number; longer numbers keep all digits. Padding stays inside generated code, formatting does not."""
    digits = F.abs(v).cast("string")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(width) - F.length(sign)), F.lit("0")))


def tile_id(row: Column, col: Column) -> Column:
    return F.concat(F.lit("r"), _padded(row, 3), F.lit("_c"), _padded(col, 3))


def block_id(row: Column, col: Column) -> Column:
    return F.concat(F.lit("b"), _padded(row, 4), F.lit("_"), _padded(col, 4))


def parse_tile_id(ident: Column) -> tuple[Column, Column]:
    pattern = r"^r(-?\d+)_c(-?\d+)$"
    return (F.regexp_extract(ident, pattern, 1).cast("int"), F.regexp_extract(ident, pattern, 2).cast("int"))


def parse_block_id(ident: Column) -> tuple[Column, Column]:
    pattern = r"^b(-?\d+)_(-?\d+)$"
    return (F.regexp_extract(ident, pattern, 1).cast("int"), F.regexp_extract(ident, pattern, 2).cast("int"))


def cell_box(row: Column, col: Column, lat: Lattice) -> dict[str, Column]:
    """Outline of a cell; (minx, maxy) with the pixel size is also its affine transform."""
    minx = F.lit(lat.origin_x) + col * F.lit(lat.pixel_m)
    maxy = F.lit(lat.origin_y) - row * F.lit(lat.pixel_m)
    return {"minx": minx, "miny": maxy - F.lit(lat.pixel_m), "maxx": minx + F.lit(lat.pixel_m), "maxy": maxy}


def is_aligned(x: Column, y: Column, lat: Lattice, tol: float = 1e-6) -> Column:
    """True where a corner sits on the lattice within ``tol`` of a pixel."""
    dx = (x - F.lit(lat.origin_x)) / F.lit(lat.pixel_m)
    dy = (y - F.lit(lat.origin_y)) / F.lit(lat.pixel_m)
    return (F.abs(dx - F.round(dx)) < tol) & (F.abs(dy - F.round(dy)) < tol)


def snap(x: Column, y: Column, lat: Lattice) -> tuple[Column, Column]:
    """Nearest lattice corner as (row, col); halves go up, as everywhere in SQL."""
    return (
        F.round((F.lit(lat.origin_y) - y) / F.lit(lat.pixel_m)).cast("int"),
        F.round((x - F.lit(lat.origin_x)) / F.lit(lat.pixel_m)).cast("int"),
    )


def clamp_offset(center: Column, patch: int, size: int) -> Column:
    """First index of a patch around ``center`` that stays inside [0, size)."""
    return F.greatest(F.lit(0), F.least(center - F.lit(patch // 2), F.lit(size - patch))).cast("int")
