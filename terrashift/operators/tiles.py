"""Labels on tiles: sample assembly, tile extraction, multi-year assembly, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.functions import lattice as L

LABEL_COLS = ["row", "col", "x", "y", "dist_m", "label", "label_name", "tile_row", "tile_col"]


def labelled_sample(pixels: DataFrame, base: str, target: str, keep_unlabelled: bool = False) -> DataFrame:
    """Base-year wetland pixels with label and name; pixels without a target observation are dropped.

    Both filters are on stored codes rather than on the derived label, so they reach the scan.
    """
    wet = pixels.where(F.col(base).isin(*C.WETLAND_CODES))
    if not keep_unlabelled:
        wet = wet.where(F.col(target) != C.NODATA_CODE)
    return wet.withColumn("label", E.transition_label(F.col(target))).withColumn(
        "label_name", E.code_name(F.col("label"), C.LABEL_NAMES))


def with_tile_index(samples: DataFrame, lat: C.Lattice, size: int) -> DataFrame:
    """Tile of a sample and its pixel offset inside the tile, from coordinates alone; tiles are ``size`` pixels wide."""
    n = F.lit(float(size))
    pr, pc = L.cell_row(F.col("y"), lat), L.cell_col(F.col("x"), lat)
    return (
        samples.withColumns({"_pr": pr, "_pc": pc})
        .withColumns(
            {
                "grid_row": F.floor(F.col("_pr") / n).cast("int"),
                "grid_col": F.floor(F.col("_pc") / n).cast("int"),
                "tile_row": F.pmod("_pr", F.lit(size)),
                "tile_col": F.pmod("_pc", F.lit(size)),
            }
        )
        .withColumn("tile_id", L.tile_id(F.col("grid_row"), F.col("grid_col")))
        .drop("_pr", "_pc")
    )


def with_block_id(samples: DataFrame, block: C.Lattice) -> DataFrame:
    """Block id on the absolute origin, so a block that straddles two tiles has one id."""
    return samples.withColumn("block_id", L.block_id(L.cell_row(F.col("y"), block), L.cell_col(F.col("x"), block)))


def in_tile(height: int, width: int):
    return F.col("tile_row").between(0, height - 1) & F.col("tile_col").between(0, width - 1)


def extract(samples: DataFrame, tiles: DataFrame, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Decoded bands of every sample per year: equi-join on tile, year-free offset; uncovered pixels drop out.

    ``carry`` names sample columns to take along, so the samples need not be joined again for them.
    """
    keys = ["tile_id", "tile_row", "tile_col"]
    slim = samples.where(in_tile(size, size)).select("row", "col", *keys, *carry)
    return (
        slim.join(tiles.select(*keys, "year", "bands"), keys)
        .where(E.has_coverage(F.col("bands")))
        .select("row", "col", *keys, *carry, "year", E.decode_bands(F.col("bands")).alias("bands"))
    )


def chunk_of(tile_row: Column, chunk_rows: int) -> Column:
    """First tile row of the chunk that a tile row lies in."""
    return (tile_row - tile_row % chunk_rows).cast("int")


def chunks_with_years(chunks: DataFrame, years) -> DataFrame:
    """One row per tile chunk with ``values_<year>``: the chunk's pixels, row by row, each an array of band codes.

    ``chunks`` has one row per tile, year and ``row0``, as tile files are read. What moves is whole chunks.
    """
    return chunks.where(F.col("year").isin(*years)).groupBy("tile_id", "row0").agg(
        *[F.first(F.when(F.col("year") == y, F.col("values")), ignorenulls=True).alias(f"values_{y}") for y in years]
    )


def _wanted(samples: DataFrame, size: int, chunk_rows: int, carry: tuple[str, ...]) -> DataFrame:
    """Per tile chunk the places of the samples in it, 1-based, with what they carry.

    Keys and carried columns move, never bands. A chunk that very many samples name is met in slices of bounded length.
    The lists grow with the samples, but their estimate is that of a few packed columns, so both sides are shuffled and no
    list goes through the driver. They are sorted, since a hash table of a partition's lists could not be spilled.
    """
    row0 = chunk_of(F.col("tile_row"), chunk_rows)
    place = ((F.col("tile_row") - row0) * size + F.col("tile_col") + 1).cast("int")
    slim = samples.where(in_tile(size, size)).select("tile_id", row0.alias("row0"), F.struct(place.alias("at"), "row", "col", *carry).alias("w"))
    # A pixel is asked for once as a rule; the hash keeps repeated ones apart.
    part = F.pmod(F.xxhash64("w"), F.lit(4))
    return slim.groupBy("tile_id", "row0", part.alias("_part")).agg(F.collect_list("w").alias("wanted")).drop("_part").hint("merge")


def _covered(values: Column) -> Column:
    return F.coalesce(F.array_max(values) != C.BAND_NODATA, F.lit(False))


def gather(samples: DataFrame, chunks: DataFrame, size: int, chunk_rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``extract`` for chunk rows: decoded bands of every sample per year, picked out of the chunk by offset.

    Samples meet chunks by (tile, first row of the chunk); a pixel that the chunk does not have, or that is not covered,
    drops out.
    """
    met = _wanted(samples, size, chunk_rows, carry).join(chunks.select("tile_id", "year", "row0", "values"), ["tile_id", "row0"])
    picked = F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get(F.col("values"), w["at"] - 1).alias("v")))
    rows = met.select("tile_id", "year", F.explode(picked).alias("p")).where(_covered(F.col("p.v")))
    return rows.select(
        "p.w.row", "p.w.col", "tile_id", "year", *[F.col(f"p.w.{c}") for c in carry], E.decode_bands(F.col("p.v")).alias("bands")
    )


def gather_years(samples: DataFrame, chunks: DataFrame, years, size: int, chunk_rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``assemble`` for chunk rows: one row per sample with ``bands_<year>``; a pixel that misses a year drops out.

    All years of a chunk meet in one row before pixels are picked, so no pixel is shuffled with its bands.
    """
    met = _wanted(samples, size, chunk_rows, carry).join(chunks_with_years(chunks, years), ["tile_id", "row0"])
    pick = lambda w: F.struct(w.alias("w"), *[F.get(F.col(f"values_{y}"), w["at"] - 1).alias(f"v{y}") for y in years])
    rows = met.select("tile_id", F.explode(F.transform("wanted", pick)).alias("p"))
    for y in years:
        rows = rows.where(_covered(F.col(f"p.v{y}")))
    return rows.select(
        "p.w.row", "p.w.col", "tile_id", *[F.col(f"p.w.{c}") for c in carry], *[E.decode_bands(F.col(f"p.v{y}")).alias(f"bands_{y}") for y in years]
    )


def ready_tiles(extracted: DataFrame, years) -> DataFrame:
    """Tiles that have every required year."""
    seen = extracted.groupBy("tile_id").agg(F.sort_array(F.collect_set("year")).alias("years"))
    need = F.array(*[F.lit(y) for y in years])
    return seen.where(F.size(F.array_except(need, "years")) == 0)


def assemble(extracted: DataFrame, years) -> DataFrame:
    """One row per pixel with ``bands_<year>`` arrays; a pixel that misses a year drops out.

    One aggregation replaces a chain of joins between years: pixels shuffle once, whatever the number of years.
    """
    per = extracted.where(F.col("year").isin(*years)).groupBy("tile_id", "row", "col").agg(
        *[F.first(F.when(F.col("year") == y, F.col("bands")), ignorenulls=True).alias(f"bands_{y}") for y in years],
    )
    full = None
    for y in years:
        c = F.col(f"bands_{y}").isNotNull()
        full = c if full is None else full & c
    return per.where(full)


def widen(df: DataFrame, years, n_bands: int = C.N_BANDS, keep: list[str] | None = None) -> DataFrame:
    """Band arrays as one named column per band and year."""
    keep = keep if keep is not None else [c for c in df.columns if not c.startswith("bands_")]
    return df.select(
        *keep,
        *[F.element_at(f"bands_{y}", b + 1).alias(f"A{b:02d}_{y}") for y in years for b in range(n_bands)],
    )


def feature_table(samples: DataFrame, assembled: DataFrame) -> DataFrame:
    """Leak-free label columns with block id and bands; outcome-year columns never enter."""
    return samples.select(*LABEL_COLS, "tile_id", "block_id").join(
        assembled.drop("tile_id"), ["row", "col"]
    )


def tile_status(raw: DataFrame, extracted: DataFrame, assembled: DataFrame) -> DataFrame:
    """Per tile: raw years, extracted years, assembled or not."""
    def years(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tile_id").agg(F.sort_array(F.collect_set("year")).alias(name))

    done = assembled.select("tile_id").distinct().withColumn("_done", F.lit(True))
    return (
        years(raw, "raw_years")
        .join(years(extracted, "extracted_years"), "tile_id", "full_outer")
        .join(done, "tile_id", "full_outer")
        .select(
            "tile_id",
            F.array_join(F.coalesce("raw_years", F.array().cast("array<int>")), ",").alias("raw_years"),
            F.array_join(F.coalesce("extracted_years", F.array().cast("array<int>")), ",").alias("extracted_years"),
            F.coalesce("_done", F.lit(False)).alias("assembled"),
        )
    )


def explode_chunks(chunks: DataFrame, value: str = "values") -> DataFrame:
    """Chunk rows (tile_id, year, row0, col0, width, values[]) to pixels; the position gives row and column."""
    return chunks.select(
        "tile_id", "year", "row0", "col0", "width", F.posexplode(value).alias("pos", value)
    ).select(
        "tile_id", "year",
        (F.col("row0") + F.floor(F.col("pos") / F.col("width")).cast("int")).alias("tile_row"),
        (F.col("col0") + F.col("pos") % F.col("width")).alias("tile_col"),
        value,
    )


def tile_years_from_names(files: DataFrame, path: str = "file_name", keep: tuple[str, ...] = ()) -> DataFrame:
    """(tile_id, year) out of file paths with a part like ``<tile>_<year>.parquet``; others are ignored.

    A writer may have made a folder of that name or a partition value of it, so the part is looked for in the whole path.
    """
    pattern = r"(?:^|[/=])(r\d{3,}_c\d{3,})_(\d{4})\.parquet(?:/|$)"
    return files.select(
        F.regexp_extract(path, pattern, 1).alias("tile_id"), F.regexp_extract(path, pattern, 2).alias("_y"), *keep
    ).where("tile_id <> ''").select("tile_id", F.col("_y").cast("int").alias("year"), *keep)
