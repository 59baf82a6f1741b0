"""Neighbourhood operators on pixel tables (row, col, ...).

The shuffles are sparse: only marked cells and the cells that are asked about move, never the full grid. Work is
cut into square windows with a halo (box means), column strips and row bands (distance), whose size is fixed by
parameters; only the last pass of the distance transform has a whole band of rows, as wide as the raster, in one group.
No group depends on how values are spread, so there is nothing to skew.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift import config as C


@dataclass(frozen=True)
class Extent:
    """Inclusive row and column range of a raster; one small record, not data."""

    row0: int
    row1: int
    col0: int
    col1: int

    @staticmethod
    def of(df: DataFrame) -> "Extent":
        r = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
        return Extent(*[int(v) for v in r])

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(self.row0, self.row1) & col.between(self.col0, self.col1)


def radius_px(radius_m: float, pixel_m: float = 30.0) -> int:
    return max(1, round(radius_m / pixel_m))


def _neighbour_counts(marked: DataFrame, extent: Extent) -> DataFrame:
    """For every cell of the plus-shaped neighbourhood of a marked cell, how many of its five cells are marked."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    spread = marked.select("row", "col", F.explode(offsets).alias("o")).select(
        (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")
    )
    return spread.where(extent.contains(F.col("row"), F.col("col"))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("k"))


def dilate(marked: DataFrame, extent: Extent) -> DataFrame:
    return _neighbour_counts(marked, extent).select("row", "col")


def erode(marked: DataFrame, extent: Extent) -> DataFrame:
    """Cells whose whole plus-shaped neighbourhood is marked; beyond the raster counts as not marked."""
    return _neighbour_counts(marked, extent).where("k = 5").select("row", "col")


def edge_cells(marked: DataFrame, extent: Extent) -> DataFrame:
    """Dilation without erosion, from one neighbour count."""
    return _neighbour_counts(marked, extent).where("k < 5").select("row", "col")


def _box_sums(mask: np.ndarray, r: int) -> np.ndarray:
    s = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), dtype=np.int64)
    np.cumsum(np.cumsum(mask, axis=0, dtype=np.int64), axis=1, out=s[1:, 1:])
    n = 2 * r + 1
    return s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]


def box_means(
    cells: DataFrame, wanted: DataFrame, extent: Extent, layers: dict[str, tuple[str, int]], window: int = 512
) -> DataFrame:
    """Square box means at the wanted cells, borders replicated.

    ``cells`` has (row, col, layer) for marked cells; ``layers`` maps an output column to (layer, radius in px).
    A marked cell is sent to its window and to the few windows whose halo it lies in: one shuffle of sparse rows.
    """
    halo = max(r for _, r in layers.values())
    names = list(layers)
    codes = {name: i + 1 for i, name in enumerate(sorted({lay for lay, _ in layers.values()}))}
    plan = [(codes[layers[n][0]], layers[n][1]) for n in names]

    code = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in codes.items()]).cast("tinyint")

    def win(c: Column, start: int) -> Column:
        return F.floor((c - F.lit(start)) / F.lit(float(window))).cast("int")

    sent = (
        cells.where(F.col("layer").isin(*codes))
        .select("row", "col", code.alias("kind"))
        .withColumn("wr", F.explode(F.sequence(win(F.col("row") - halo, extent.row0), win(F.col("row") + halo, extent.row0))))
        .withColumn("wc", F.explode(F.sequence(win(F.col("col") - halo, extent.col0), win(F.col("col") + halo, extent.col0))))
    )
    asked = wanted.select(
        "row", "col", F.lit(0).cast("tinyint").alias("kind"),
        win(F.col("row"), extent.row0).alias("wr"), win(F.col("col"), extent.col0).alias("wc"),
    )
    ext = extent

    def one_window(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf[pdf["kind"] == 0]
        if ask.empty:
            return pd.DataFrame({"row": [], "col": [], **{n: [] for n in names}})
        r0 = ext.row0 + int(key[0]) * window
        c0 = ext.col0 + int(key[1]) * window
        ra, rb = max(ext.row0, r0 - halo), min(ext.row1, r0 + window - 1 + halo)
        ca, cb = max(ext.col0, c0 - halo), min(ext.col1, c0 + window - 1 + halo)
        out = {"row": ask["row"].to_numpy(), "col": ask["col"].to_numpy()}
        grids = {}
        for k in {k for k, _ in plan}:
            g = np.zeros((rb - ra + 1, cb - ca + 1), dtype=np.uint8)
            m = pdf[pdf["kind"] == k]
            rr, cc = m["row"].to_numpy(), m["col"].to_numpy()
            ok = (rr >= ra) & (rr <= rb) & (cc >= ca) & (cc <= cb)
            g[rr[ok] - ra, cc[ok] - ca] = 1
            grids[k] = g
        for n, (k, r) in zip(names, plan):
            sums = _box_sums(np.pad(grids[k], r, mode="edge"), r)
            out[n] = sums[out["row"] - ra, out["col"] - ca] / float((2 * r + 1) ** 2)
        return pd.DataFrame(out)

    schema = "row int, col int, " + ", ".join(f"{n} double" for n in names)
    return sent.unionByName(asked).groupBy("wr", "wc").applyInPandas(one_window, schema)


def column_carries(marked: DataFrame, extent: Extent, strip: int, slab: int) -> DataFrame:
    """Nearest marked rows beyond a slab, per column: (strip, slab, col, above, below), null where there is none.

    First and last marked row of each (column, slab) come with map-side combine; a column then is one row for each slab of
    thousands of raster rows, which is all that the window sees.
    """
    ext = extent
    slabs = (ext.row1 - ext.row0) // slab + 1
    at = F.floor((F.col("row") - ext.row0) / F.lit(float(slab))).cast("int")
    ends = marked.groupBy("col", at.alias("slab")).agg(F.min("row").alias("first"), F.max("row").alias("last"))
    full = ends.select("col").distinct().withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
    w = Window.partitionBy("col").orderBy("slab")
    return (
        full.join(ends, ["col", "slab"], "left")
        .select(
            F.floor((F.col("col") - ext.col0) / F.lit(float(strip))).cast("int").alias("strip"), "slab", "col",
            F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
            F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("below"),
        )
        .where("above is not null or below is not null")
    )


def column_bounds(
    marked: DataFrame, bands: DataFrame, extent: Extent, strip: int = 64, band: int = 32, slab: int = 4096
) -> DataFrame:
    """For every wanted band of rows and every strip of columns: the nearest marked rows above and below the band.

    ``bands`` has the wanted band numbers. The payload is two little-endian int32 rows of strip width, -1 where there is
    none: 8 bytes a column and band, not an entry for every cell. A group holds one strip of one slab, so no group grows
    with the raster.
    """
    ext = extent
    at = F.floor((F.col("row") - ext.row0) / F.lit(float(slab))).cast("int")
    lane = F.floor((F.col("col") - ext.col0) / F.lit(float(strip))).cast("int")
    cells = marked.select(lane.alias("strip"), at.alias("slab"), "col", F.col("row").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0).alias("kind"))
    carry = column_carries(marked, extent, strip, slab).select("strip", "slab", "col", F.col("above").alias("a"), F.col("below").alias("b"), F.lit(1).alias("kind"))
    lanes = marked.select(lane.alias("strip")).distinct()
    asked = bands.withColumn("slab", F.floor(F.col("band") * band / F.lit(float(slab))).cast("int")).join(lanes)
    asked = asked.select("strip", "slab", F.lit(0).alias("col"), F.col("band").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(2).alias("kind"))

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        c0 = ext.col0 + int(key[0]) * strip
        width = min(strip, ext.col1 - c0 + 1)
        kind, col = pdf["kind"].to_numpy(), pdf["col"].to_numpy() - c0
        a, b = pdf["a"].fillna(-1).to_numpy(np.int64), pdf["b"].fillna(-1).to_numpy(np.int64)
        wanted = np.unique(a[kind == 2])
        top, bottom = np.full(width, -1, np.int64), np.full(width, -1, np.int64)
        own = kind == 1
        top[col[own]] = np.where(a[own] >= 0, a[own] - ext.row0, -1)
        bottom[col[own]] = np.where(b[own] >= 0, b[own] - ext.row0, -1)
        rows, cols = a[kind == 0] - ext.row0, col[kind == 0]
        up, down = np.tile(top, (len(wanted), 1)), np.tile(bottom, (len(wanted), 1))
        for c in np.unique(cols):
            r = np.sort(rows[cols == c])
            before, after = np.searchsorted(r, wanted * band), np.searchsorted(r, (wanted + 1) * band)
            up[:, c] = np.where(before > 0, r[np.maximum(before - 1, 0)], top[c])
            down[:, c] = np.where(after < len(r), r[np.minimum(after, len(r) - 1)], bottom[c])
        both = np.stack([up, down], 1).astype("<i4")
        return pd.DataFrame({"band": wanted, "strip": int(key[0]), "payload": [x.tobytes() for x in both]})

    return cells.union(carry).union(asked).groupBy("strip", "slab").applyInPandas(one, "band int, strip int, payload binary")


def column_nearest(marked: DataFrame, wanted: DataFrame, extent: Extent, strip: int = 64, slab: int = 4096) -> DataFrame:
    """(row, col, near_row): nearest marked row in the same column, the upper one of two; cells whose column has none drop.

    Groups are strips of columns within slabs of rows, with what lies beyond the slab carried in.
    """
    ext = extent
    at = F.floor((F.col("row") - ext.row0) / F.lit(float(slab))).cast("int")
    lane = F.floor((F.col("col") - ext.col0) / F.lit(float(strip))).cast("int")
    none = F.lit(None).cast("int")
    marks = marked.select(lane.alias("strip"), at.alias("slab"), "col", F.col("row").alias("a"), none.alias("b"), F.lit(0).alias("kind"))
    carry = column_carries(marked, extent, strip, slab).select("strip", "slab", "col", F.col("above").alias("a"), F.col("below").alias("b"), F.lit(1).alias("kind"))
    asked = wanted.select(lane.alias("strip"), at.alias("slab"), "col", F.col("row").alias("a"), none.alias("b"), F.lit(2).alias("kind"))

    def one(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, g in pdf.groupby("col"):
            kind = g["kind"].to_numpy()
            ask = g["a"][kind == 2].to_numpy(np.int64)
            known = np.unique(np.concatenate([g["a"][kind < 2].dropna(), g["b"][kind == 1].dropna()]).astype(np.int64))
            if len(ask) and len(known):
                after = np.searchsorted(known, ask)
                up, down = known[np.maximum(after - 1, 0)], known[np.minimum(after, len(known) - 1)]
                lower = (after > 0) & ((after == len(known)) | (ask - up <= down - ask))
                out.append(pd.DataFrame({"row": ask, "col": c, "near_row": np.where(lower, up, down)}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "col": [], "near_row": []})

    return marks.union(carry).union(asked).groupBy("strip", "slab").applyInPandas(one, "row int, col int, near_row int")


def _nearest_rows(up: np.ndarray, down: np.ndarray, rows: np.ndarray, cols: np.ndarray, first: int, height: int) -> np.ndarray:
    """Nearest marked row of every cell of a band, -1 where the column has none; of two equally near the upper one."""
    width = len(up)
    above, below = np.full((height, width), -1, np.int64), np.full((height, width), 2**40, np.int64)
    above[rows - first, cols] = rows
    below[rows - first, cols] = rows
    above[0] = np.maximum(above[0], up)
    below[-1] = np.minimum(below[-1], np.where(down >= 0, down, 2**40))
    above = np.maximum.accumulate(above, 0)
    below = np.minimum.accumulate(below[::-1], 0)[::-1]
    at = first + np.arange(height)[:, None]
    use = (above >= 0) & (at - above <= below - at)
    return np.where(use, above, np.where(below < 2**40, below, -1))


def _row_minimum(near: np.ndarray, row: int, asked: np.ndarray) -> np.ndarray:
    """Column of the nearest marked cell for the sorted, distinct columns ``asked`` of one row.

    The squared distance to column j's cell, plus a term for ties, is a parabola of one shape for every j, so the best j
    never goes back as the asked column goes on: the middle one halves the range of all others. Every level looks at each
    column about once, hence time in proportion to width times the logarithm of the number asked. Ties go to the smaller
    row, then to the smaller column.
    """
    live = np.flatnonzero(near >= 0)
    order = np.lexsort((live, near[live]))
    rank = np.empty(len(live), np.int64)
    rank[order] = np.arange(len(live))
    scale = len(live) + 1
    height = (near[live] - row) ** 2 * scale + rank
    best = np.full(len(asked), -1, np.int64)
    lo, hi = np.array([0]), np.array([len(asked) - 1])  # spans of asked columns
    left, right = np.array([0]), np.array([len(live) - 1])  # and of candidates
    while len(lo):
        mid = (lo + hi) // 2
        sizes = right - left + 1
        start = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(lo)), sizes)
        j = np.arange(sizes.sum()) - start[owner] + left[owner]
        cost = (live[j] - asked[mid][owner]) ** 2 * scale + height[j]
        least = np.minimum.reduceat(cost, start)
        won = j[np.flatnonzero(cost == least[owner])]  # ranks make every minimum unique
        best[mid] = won
        keep_l, keep_r = lo < mid, mid < hi
        lo, hi, left, right = (
            np.concatenate([lo[keep_l], mid[keep_r] + 1]), np.concatenate([mid[keep_l] - 1, hi[keep_r]]),
            np.concatenate([left[keep_l], won[keep_r]]), np.concatenate([won[keep_l], right[keep_r]]),
        )
    return live[best]


def nearest_marked(
    marked: DataFrame, wanted: DataFrame, extent: Extent, pixel_m: float = 30.0, strip: int = 64, band: int = 32
) -> DataFrame:
    """Exact Euclidean distance transform at the wanted cells, with the identity of the nearest marked cell.

    Two separable passes: nearest marked rows within every column (by strips and slabs), then the lowest parabola along
    each row (by row band). Gives (row, col, near_row, near_col, dist_m); nulls where nothing is marked.
    """
    ext = extent
    in_band = F.floor((F.col("row") - ext.row0) / F.lit(float(band))).cast("int").alias("band")
    asked = wanted.select("row", "col", in_band)
    bounds = column_bounds(marked, asked.select("band").distinct(), extent, strip, band)
    none = F.lit(None).cast("int")
    sides = bounds.select("band", "strip", "payload", none.alias("row"), none.alias("col")).union(
        marked.select(in_band, none, F.lit(None).cast("binary"), "row", "col")
    )

    def one_band(key: tuple[Any, ...], sides: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * band
        height, width = min(band, ext.row1 - ext.row0 + 1 - first), ext.col1 - ext.col0 + 1
        rows, cols = cells["row"].to_numpy(np.int64) - ext.row0, cells["col"].to_numpy(np.int64) - ext.col0
        nr, nc = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
        if len(cells):
            up, down = np.full(width, -1, np.int64), np.full(width, -1, np.int64)
            packed = sides["strip"].notna().to_numpy()
            for s, payload in zip(sides["strip"][packed].astype(int), sides["payload"][packed]):
                block = np.frombuffer(payload, "<i4").reshape(2, -1)
                up[s * strip : s * strip + block.shape[1]], down[s * strip : s * strip + block.shape[1]] = block
            inside = sides[~packed]
            near = _nearest_rows(up, down, inside["row"].to_numpy(np.int64) - ext.row0, inside["col"].to_numpy(np.int64) - ext.col0, first, height)
            for r in np.unique(rows):
                line = near[r - first]
                if (line >= 0).any():
                    mine = np.flatnonzero(rows == r)
                    columns, back = np.unique(cols[mine], return_inverse=True)
                    nc[mine] = _row_minimum(line, int(r), columns)[back]
                    nr[mine] = line[nc[mine]]
        hit = nr >= 0
        d2 = np.where(hit, (nr - rows) ** 2 + (nc - cols) ** 2, 0)
        return pd.DataFrame(
            {
                "row": cells["row"].to_numpy(),
                "col": cells["col"].to_numpy(),
                "near_row": pd.array(np.where(hit, nr + ext.row0, 0), dtype="Int32").copy(),
                "near_col": pd.array(np.where(hit, nc + ext.col0, 0), dtype="Int32").copy(),
                "dist_m": np.where(hit, np.sqrt(d2.astype(float)) * pixel_m, np.nan),
            }
        )

    found = (
        sides.groupBy("band")
        .cogroup(asked.groupBy("band"))
        .applyInPandas(one_band, "row int, col int, near_row int, near_col int, dist_m double")
    )
    known = F.col("dist_m").isNotNull() & ~F.isnan("dist_m")
    return found.select(
        "row", "col", *[F.when(known, F.col(c)).alias(c) for c in ("near_row", "near_col", "dist_m")]
    )


def direction(row: Column, col: Column, near_row: Column, near_col: Column, pixel_m: float = 30.0) -> tuple[Column, Column]:
    """Sine and cosine of the angle towards the nearest cell, counter-clockwise from east (north is up)."""
    theta = F.atan2((near_row - row) * F.lit(-pixel_m), (near_col - col) * F.lit(pixel_m))
    return F.sin(theta), F.cos(theta)


def neighbourhood_features(
    pixels: DataFrame, code: str, wanted: DataFrame, extent: Extent, pixel_m: float = 30.0, codes=C.DEVELOPED_CODES
) -> DataFrame:
    """Local development density at three radii, edge density and direction to development for the wanted cells."""
    marked = pixels.where(F.col(code).isin(*codes)).select("row", "col")
    cells = marked.withColumn("layer", F.lit("developed")).unionByName(
        edge_cells(marked, extent).withColumn("layer", F.lit("edge"))
    )
    layers = {n: ("developed", radius_px(r, pixel_m)) for n, r in C.DENSITY_RADII_M.items()}
    layers["edge_density_300m"] = ("edge", radius_px(C.EDGE_RADIUS_M, pixel_m))
    means = box_means(cells, wanted, extent, layers)
    near = nearest_marked(marked, wanted, extent, pixel_m)
    sin, cos = direction(F.col("row"), F.col("col"), F.col("near_row"), F.col("near_col"), pixel_m)
    toward = near.select("row", "col", sin.alias("dev_dir_sin"), cos.alias("dev_dir_cos"))
    return means.join(toward, ["row", "col"]).select(
        "row", "col", *[F.col(c).cast("float").alias(c) for c in C.NEIGHBOUR_COLS]
    )


def block_max(pixels: DataFrame, value: str, extent: Extent, factor: int) -> DataFrame:
    """Maximum per factor x factor block; incomplete blocks at the far ends are left out."""
    height = (extent.row1 - extent.row0 + 1) // factor * factor
    width = (extent.col1 - extent.col0 + 1) // factor * factor
    r, c = F.col("row") - extent.row0, F.col("col") - extent.col0
    return (
        pixels.where((r < height) & (c < width))
        .groupBy(F.floor(r / F.lit(float(factor))).cast("int").alias("row"), F.floor(c / F.lit(float(factor))).cast("int").alias("col"))
        .agg(F.max(value).alias(value))
    )


def stride(pixels: DataFrame, extent: Extent, factor: int) -> DataFrame:
    r, c = F.col("row") - extent.row0, F.col("col") - extent.col0
    return pixels.where((r % factor == 0) & (c % factor == 0)).select(
        (r / F.lit(factor)).cast("int").alias("row"), (c / F.lit(factor)).cast("int").alias("col"),
        *[x for x in pixels.columns if x not in ("row", "col")],
    )


def conversion_overlay(base: Column, target: Column) -> Column:
    """0 elsewhere, 1 base-year wetland, 2 base-year wetland that is developed in the target year."""
    wet = base.isin(*C.WETLAND_CODES)
    return F.when(wet & target.isin(*C.DEVELOPED_CODES), 2).when(wet, 1).otherwise(0).cast("int")


def outcome_grid(base: Column, target: Column) -> Column:
    """-1 outside the base-year wetland, otherwise 0 wetland, 1 developed, 2 neither in the target year."""
    return (
        F.when(~base.isin(*C.WETLAND_CODES), -1)
        .when(target.isin(*C.WETLAND_CODES), 0)
        .when(target.isin(*C.DEVELOPED_CODES), 1)
        .otherwise(2)
        .cast("int")
    )


def extent_counts(pixels: DataFrame, base: str, target: str) -> DataFrame:
    """Wetland and developed pixels before and after, in one pass."""
    wet, dev = (lambda c: F.col(c).isin(*C.WETLAND_CODES)), (lambda c: F.col(c).isin(*C.DEVELOPED_CODES))
    agg = pixels.agg(
        F.count_if(wet(base)).alias("wetland_base"),
        F.count_if(wet(target)).alias("wetland_target"),
        F.count_if(dev(base)).alias("developed_base"),
        F.count_if(dev(target)).alias("developed_target"),
        F.count_if(wet(base) & dev(target)).alias("wetland_to_developed"),
        F.count_if(wet(base) & ~wet(target) & ~dev(target) & (F.col(target) != C.NODATA_CODE)).alias("wetland_to_other"),
    )
    long = agg.unpivot([], agg.columns, "extent", "pixels")
    return long.withColumn("area_km2", F.col("pixels") * C.PIXEL_KM2)


def transitions(pixels: DataFrame, base: str, target: str) -> DataFrame:
    return pixels.groupBy(base, target).agg(F.count(F.lit(1)).alias("n"))


def mean_reduce(pixels: DataFrame, keys: list[str], bands: str, n_bands: int, factor: int = 3) -> DataFrame:
    """Mean over factor x factor cells per band, nodata bytes ignored; a band without data gives null.

    The bytes of a cell are moved, not the sums and counts of its bands, which are many times as large.
    """
    vals = [F.element_at(bands, i + 1) for i in range(n_bands)]
    coarse = pixels.select(
        *keys,
        F.floor(F.col("row") / F.lit(float(factor))).cast("int").alias("row"),
        F.floor(F.col("col") / F.lit(float(factor))).cast("int").alias("col"),
        bands,
    ).repartition(*keys, "row", "col")
    agg = coarse.groupBy(*keys, "row", "col").agg(*[F.avg(F.when(v != C.BAND_NODATA, v)).alias(f"b{i}") for i, v in enumerate(vals)])
    return agg.select(*keys, "row", "col", F.array(*[f"b{i}" for i in range(n_bands)]).alias(bands))


def mosaic(granules: DataFrame, order: str, bands: str, inside: DataFrame | None = None) -> DataFrame:
    """One value per pixel from overlapping granules: the last one in ``order`` that has data.

    Pixels outside ``inside`` (row, col), where given, and pixels without any data become null.
    """
    top = granules.groupBy("row", "col").agg(
        F.max(F.when(F.exists(bands, lambda v: v != C.BAND_NODATA), F.struct(order, bands))).alias("t")
    )
    out = top.select("row", "col", F.col(f"t.{order}").alias(order), F.col(f"t.{bands}").alias(bands))
    if inside is None:
        return out
    flagged = inside.select("row", "col", F.lit(True).alias("_in"))
    return out.join(flagged, ["row", "col"], "left").select(
        "row", "col", F.when(F.col("_in"), F.col(order)).alias(order), F.when(F.col("_in"), F.col(bands)).alias(bands)
    )


def window_of(extent_box: dict[str, float], lat: C.Lattice, buffer_m: float = 0.0) -> Extent:
    """Pixel window of a bounding box with a buffer: the offset is floored, the length is ceiled."""
    minx, maxx = extent_box["minx"] - buffer_m, extent_box["maxx"] + buffer_m
    miny, maxy = extent_box["miny"] - buffer_m, extent_box["maxy"] + buffer_m
    col0 = int(np.floor((minx - lat.origin_x) / lat.pixel_m))
    row0 = int(np.floor((lat.origin_y - maxy) / lat.pixel_m))
    width = int(np.ceil((maxx - minx) / lat.pixel_m))
    height = int(np.ceil((maxy - miny) / lat.pixel_m))
    return Extent(row0, row0 + height - 1, col0, col0 + width - 1)


def read_window(pixels: DataFrame, window: Extent) -> DataFrame:
    """Rows of a window, re-based to its corner; the range predicates reach the scan."""
    return pixels.where(window.contains(F.col("row"), F.col("col"))).withColumns(
        {"row": F.col("row") - window.row0, "col": F.col("col") - window.col0}
    )
