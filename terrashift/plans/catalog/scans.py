"""Scans, sinks, projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.functions import lattice as L
from terrashift.operators import audit as A
from terrashift.operators import raster as R
from terrashift.operators import summaries as S
from terrashift.operators import tiles as ti
from terrashift.plans.fixtures import DIST, LAT, TILE, Fixtures
from terrashift.plans.registry import register
from terrashift.session import scratch_path
from terrashift.sources import tables as src
from terrashift.streaming.pickup import pick_up_new_tiles


@register("sample_view_scan", "S1 S2 S11 J2", """
    SELECT block_id, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS label_sum FROM smp GROUP BY block_id""")
def sample_view_scan(fx: Fixtures):
    """Parquet files of a glob under a view's name; the query reads two of their columns."""
    path = scratch_path(fx.spark, "sample-files")
    src.write_once(fx.samples, path)
    src.write_once(fx.samples.where("false"), path)  # an output that is there stays as it is
    src.read_view(fx.spark, f"{path}/*.parquet", "terrashift_samples")
    return fx.spark.sql("SELECT block_id, COUNT(*) AS n, SUM(label) AS label_sum FROM terrashift_samples GROUP BY block_id")


@register("partitioned_sink_roundtrip", "S8 S9 S10 S11 S2", """
    SELECT tile_id, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS label_sum, round(SUM(dist_m), 2) AS dist_sum FROM smp GROUP BY tile_id""")
def partitioned_sink_roundtrip(fx: Fixtures):
    """Write tiles, rewrite some of them, skip the finished ones, and read the result back."""
    path = scratch_path(fx.spark, "tiles")
    rows = fx.stored.select("row", "col", "tile_id", "label", DIST)
    first = rows.where(F.xxhash64("tile_id") % 2 == 0)
    src.write_by_tile(first, path)
    src.write_by_tile(first, path)
    src.write_missing_tiles(rows, path)
    back = src.read_columns(fx.spark, path, ["tile_id", "label", DIST])
    return back.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"), F.round(F.sum(DIST), 2).alias("dist_sum")
    )


@register("streaming_tile_pickup", "S16", "SELECT tile_id, COUNT(*) AS n, CAST(SUM(label) AS BIGINT) AS label_sum FROM smp GROUP BY tile_id")
def streaming_tile_pickup(fx: Fixtures):
    """Every tile arrives in two deliveries; a run of the stream is set off by new files only and leaves whole tiles."""
    spark = fx.spark
    inbox, sink, ck = (scratch_path(spark, n) for n in ("inbox", "picked", "progress"))
    rows = fx.stored.select("row", "col", "tile_id", "label")
    early = F.xxhash64("row", "col") % 2 == 0
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(inbox)
        pick_up_new_tiles(spark, inbox, rows.schema, lambda b: b, sink, ck).awaitTermination()
    return spark.read.parquet(sink).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("label_sum"))


@register("tile_years_from_file_names", "S3 X12", """
    SELECT regexp_extract(f, '(r[0-9]{3,}_c[0-9]{3,})_([0-9]{4}).parquet$', 1) AS tile_id, COUNT(*) AS n, CAST(MIN(y) AS INTEGER) AS first_year, CAST(MAX(y) AS INTEGER) AS last_year
    FROM (SELECT CASE WHEN status = 'FAILED' THEN 'notes.txt' ELSE tile_id || '_' || year || '.parquet' END AS f, year AS y FROM man) WHERE f <> 'notes.txt' GROUP BY 1""")
def tile_years_from_file_names(fx: Fixtures):
    names = fx.manifest.select(
        F.when(F.col("status") == "FAILED", F.lit("inbox/notes.txt"))
        .otherwise(F.concat_ws("", F.lit("inbox/"), "tile_id", F.lit("_"), "year", F.lit(".parquet"))).alias("file_name")
    )
    return ti.tile_years_from_names(names).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


@register("tile_years_from_scan", "S3 X12", """
    SELECT tile_id, COUNT(DISTINCT year) AS n, CAST(MIN(year) AS INTEGER) AS first_year, CAST(MAX(year) AS INTEGER) AS last_year, COUNT(*) AS pixels
    FROM (SELECT printf('r%03d_c%03d', row // 32, col // 32) AS tile_id, y.year FROM px, (SELECT unnest([2017, 2018, 2019]) AS year) y) GROUP BY 1""")
def tile_years_from_scan(fx: Fixtures):
    """Files named by tile and year beside a foreign one; tile and year come from the scan's file paths, nothing else."""
    path = scratch_path(fx.spark, "by_name")
    name = F.concat("tile_id", F.lit("_"), F.col("year").cast("string"), F.lit(".parquet"))
    src.write_named(fx.chunks.select("row0", "values", name.alias("file")), path, "file")
    src.write_named(fx.chunks.limit(1).select("row0", "values", F.lit("notes_2017.parquet").alias("file")), path, "file", append=True)
    files = src.read_with_paths(fx.spark, path)
    pixels = files.select("file_name", F.size("values").alias("px"))
    known = ti.tile_years_from_names(pixels, keep=("px",))
    return known.groupBy("tile_id").agg(
        F.count_distinct("year").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("px").alias("pixels")
    )


@register("raster_chunks_to_pixels", "S4", """
    SELECT row, col, CAST(lc_2019 AS INTEGER) AS lc FROM px""")
def raster_chunks_to_pixels(fx: Fixtures):
    """Pack pixels into 16-row chunks per tile column and explode them again."""
    p = fx.pixels.select(
        L.tile_id(F.floor(F.col("row") / F.lit(32.0)).cast("int"), F.floor(F.col("col") / F.lit(32.0)).cast("int")).alias("tile_id"),
        (F.floor(F.col("row") / F.lit(16.0)) * 16).cast("int").alias("row0"), (F.floor(F.col("col") / F.lit(32.0)) * 32).cast("int").alias("col0"),
        "row", "col", "lc_2019",
    )
    packed = p.groupBy("tile_id", "row0", "col0").agg(
        F.array_sort(F.collect_list(F.struct("row", "col", "lc_2019"))).alias("a")
    ).select("tile_id", "row0", "col0", F.lit(2019).alias("year"), F.lit(32).alias("width"), F.transform("a", lambda s: s["lc_2019"]).alias("values"))
    return ti.explode_chunks(packed).select(F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), F.col("values").alias("lc"))


@register("windowed_raster_read", "S5 G3", """
    w AS (SELECT MIN(x) - 100 AS minx, MAX(x) + 100 AS maxx, MIN(y) - 100 AS miny, MAX(y) + 100 AS maxy FROM vtx WHERE name = 'P00000'),
    o AS (SELECT CAST(floor((minx + 2415585) / 30) AS INTEGER) AS c0, CAST(floor((3314805 - maxy) / 30) AS INTEGER) AS r0,
          CAST(ceil((maxx - minx) / 30) AS INTEGER) AS wd, CAST(ceil((maxy - miny) / 30) AS INTEGER) AS ht FROM w)
    SELECT CAST(row - r0 AS INTEGER) AS row, CAST(col - c0 AS INTEGER) AS col, lc_2019 FROM px, o WHERE row >= r0 AND row < r0 + ht AND col >= c0 AND col < c0 + wd""")
def windowed_raster_read(fx: Fixtures):
    from terrashift.operators import vector as vec

    box = vec.bounds(vec.one_polygon(fx.vertices, "P00000"), ["poly_id"]).first().asDict()
    return R.read_window(fx.pixels.select("row", "col", "lc_2019"), R.window_of(box, LAT, 100.0))


@register("polygon_attribute_scan", "S6", "SELECT name, COUNT(*) AS n_vertices, COUNT(DISTINCT poly_id) AS n_polygons FROM vtx WHERE name = 'P00000' GROUP BY name")
def polygon_attribute_scan(fx: Fixtures):
    from terrashift.operators import vector as vec

    return vec.one_polygon(fx.vertices, "P00000").groupBy("name").agg(
        F.count(F.lit(1)).alias("n_vertices"), F.count_distinct("poly_id").alias("n_polygons")
    )


@register("manifest_csv_roundtrip", "S7 S13", "SELECT status, COUNT(*) AS n, COUNT(DISTINCT tile_id) AS tiles FROM man GROUP BY status")
def manifest_csv_roundtrip(fx: Fixtures):
    """Append the manifest in two parts, read it with its schema, rewrite it, and summarise."""
    path, again = scratch_path(fx.spark, "manifest"), scratch_path(fx.spark, "manifest")
    for y in (0, 1):
        src.append_manifest(fx.manifest.where(F.col("year") % 2 == y), path)
    src.rewrite_manifest(src.read_manifest(fx.spark, path), again)
    out = src.read_manifest(fx.spark, again).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tile_id").alias("tiles"))
    summary = scratch_path(fx.spark, "summary")
    src.write_csv_summary(out, summary)
    return fx.spark.read.schema("status string, n bigint, tiles bigint").option("header", True).csv(summary)


@register("run_config_merge", "S12 X16", """
    a AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1)
    SELECT 'run_' || coalesce(a.k, b.k) AS name, CAST(CASE WHEN b.k IS NULL THEN a.n ELSE b.n END AS VARCHAR) AS rows, CASE WHEN a.k IS NULL THEN NULL ELSE 'kept' END AS stage_one, CASE WHEN b.k IS NULL THEN NULL ELSE 'added' END AS stage_two
    FROM a FULL OUTER JOIN b ON a.k = b.k""")
def run_config_merge(fx: Fixtures):
    """Two stages contribute constants to the same runs; the later one wins on a shared key."""
    def part(table: str, key: str, extra: str, word: str):
        g = fx.table(table).groupBy(F.concat(F.lit("run_"), F.col(key)).alias("name")).agg(F.count(F.lit(1)).cast("string").alias("n"))
        return g.select("name", F.create_map(F.lit("rows"), "n", F.lit(extra), F.lit(word)).alias("params"))

    merged = src.merge_config(part("customer", "c_nationkey", "stage_one", "kept"), part("supplier", "s_nationkey", "stage_two", "added"))
    back = src.config_from_json(src.config_json(merged))
    return back.select("name", *[F.try_element_at("params", F.lit(k)).alias(k) for k in ("rows", "stage_one", "stage_two")])


@register("small_dimension_lookup", "S14 J17 P5", """
    SELECT lc_2019 AS code, CASE lc_2019 WHEN 90 THEN 'Woody Wetlands' ELSE 'Emergent Herbaceous Wetlands' END AS name, COUNT(*) AS n FROM smp GROUP BY lc_2019""")
def small_dimension_lookup(fx: Fixtures):
    dim = fx.spark.createDataFrame(list(C.WETLAND_NAMES.items()), "lc_2019 int, name string")
    n = fx.samples.groupBy("lc_2019").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(dim), "lc_2019").select(F.col("lc_2019").alias("code"), "name", "n")


@register("batched_scoring", "S15", "SELECT row, col, round(1 / (1 + exp(dist_m / 500)), 6) AS y_score FROM smp")
def batched_scoring(fx: Fixtures):
    """Any Python callable scores Arrow batches on the executors."""
    from terrashift.operators.models import score_with

    def score(pdf):
        import numpy as np

        return 1.0 / (1.0 + np.exp(pdf[DIST] / 500.0))

    out = score_with(score, fx.samples.select("row", "col", DIST), ["row", "col"])
    return out.select("row", "col", F.round("y_score", 6).alias("y_score"))


@register("granules_of_year", "S17", """
    SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2025-01-01' AND value < 50 AND value + 10 > 5 GROUP BY event_type""")
def granules_of_year(fx: Fixtures):
    """Half-open year and box overlap on a granule table."""
    from terrashift.operators.vector import overlapping

    g = src.year_granules(fx.table("events"), "ts", 2024).withColumns(
        {"minx": F.col("value"), "maxx": F.col("value") + 10, "miny": F.lit(0.0), "maxy": F.lit(1.0)}
    )
    box = {"minx": 5.0, "maxx": 50.0, "miny": 0.5, "maxy": 2.0}
    return overlapping(g, box).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("tile_completeness", "S18 U4", """
    r AS (SELECT tile_id, string_agg(DISTINCT year, ',' ORDER BY year) AS y FROM man GROUP BY 1),
    e AS (SELECT tile_id, string_agg(DISTINCT year, ',' ORDER BY year) AS y FROM man WHERE status <> 'FAILED' GROUP BY 1),
    d AS (SELECT tile_id FROM man WHERE status = 'COMPLETED' GROUP BY 1 HAVING COUNT(*) > 1)
    SELECT tile_id, coalesce(r.y, '') AS raw_years, coalesce(e.y, '') AS extracted_years, d.tile_id IS NOT NULL AS assembled
    FROM r FULL JOIN e USING (tile_id) LEFT JOIN d USING (tile_id)""")
def tile_completeness(fx: Fixtures):
    m = fx.manifest
    done = m.where("status = 'COMPLETED'").groupBy("tile_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ti.tile_status(m, m.where("status <> 'FAILED'"), done)


@register("manifest_status", "S19", """
    SELECT CASE WHEN year = 2019 THEN 'last_year' ELSE 'earlier_year' END AS kind, COUNT(*) FILTER (status = 'COMPLETED') AS done, COUNT(*) AS expected FROM expd LEFT JOIN man USING (tile_id, year) GROUP BY 1""")
def manifest_status(fx: Fixtures):
    """Finished of expected exports, by kind of year. ``run_status`` counts stored model runs."""
    kind = F.when(F.col("year") == 2019, "last_year").otherwise("earlier_year")
    art = fx.manifest.where("status = 'COMPLETED'").withColumn("kind", kind)
    return A.run_status(fx.expected.withColumn("kind", kind), art, ["tile_id", "year"])


@register("columns_except_keys", "P1 J1", """
    SELECT s.row, s.col, s.label, CAST(f.n AS BIGINT) AS n_around FROM smp s LEFT JOIN (SELECT row, col, lc_2024 AS n FROM px WHERE lc_2024 = 90) f ON s.row = f.row AND s.col = f.col""")
def columns_except_keys(fx: Fixtures):
    """Left join on the pixel key; keys appear once and unmatched pixels keep nulls."""
    side = fx.pixels.where("lc_2024 = 90").select("row", "col", F.col("lc_2024").cast("bigint").alias("n_around"))
    return src.attach_neighbourhood(fx.samples.select("row", "col", "label"), side)


@register("wide_band_columns", "P2 P10 P11 A13", """
    SELECT year, COUNT(*) AS n, round(SUM(CASE WHEN bands[1] <> 0 THEN (bands[1] - 128) / 127.0::DOUBLE END), 3) AS a00, round(SUM(CASE WHEN bands[64] <> 0 THEN (bands[64] - 128) / 127.0::DOUBLE END), 3) AS a63
    FROM til GROUP BY year""")
def wide_band_columns(fx: Fixtures):
    t = fx.tiles.select("row", "col", "year", E.decode_bands(F.col("bands")).alias("b"))
    wide = ti.widen(t.withColumnRenamed("b", "bands_0"), [0], keep=["year"]).withColumnsRenamed({"A00_0": "A00", "A63_0": "A63"})
    return wide.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("A00").cast("double")), 3).alias("a00"), F.round(F.sum(F.col("A63").cast("double")), 3).alias("a63")
    )


@register("class_masks", "P3", """
    SELECT lc_2019 IN (90, 95) AS wetland, lc_2019 BETWEEN 21 AND 24 AS developed, COUNT(*) AS n FROM px GROUP BY 1, 2""")
def class_masks(fx: Fixtures):
    lc = F.col("lc_2019")
    return fx.pixels.groupBy(
        E.in_codes(lc, C.WETLAND_CODES).alias("wetland"), E.in_codes(lc, C.DEVELOPED_CODES).alias("developed")
    ).agg(F.count(F.lit(1)).alias("n"))


@register("transition_labels", "P4 P5 P6", "SELECT label, label_name, COUNT(*) AS n, COUNT(*) FILTER (label = -1) AS dropped FROM smp_all GROUP BY 1, 2")
def transition_labels(fx: Fixtures):
    return fx.all_samples.groupBy("label", "label_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == -1).alias("dropped"))


@register("in_bounds_guard", "P7", "SELECT tile_id, COUNT(*) AS n, COUNT(*) FILTER (tile_row >= 30 OR tile_col >= 30) AS dropped FROM smp GROUP BY tile_id")
def in_bounds_guard(fx: Fixtures):
    return fx.samples.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ti.in_tile(30, 30)).alias("dropped"))


@register("coverage_predicate", "P8", "SELECT year, COUNT(*) AS n, COUNT(*) FILTER (list_max(bands) > 0) AS covered FROM til GROUP BY year")
def coverage_predicate(fx: Fixtures):
    return fx.tiles.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(E.has_coverage(F.col("bands"))).alias("covered"))


@register("fold_predicates", "P9 P14", """
    SELECT COUNT(*) FILTER (fold = 0) AS held, COUNT(*) FILTER (fold <> 0) AS rest, COUNT(*) FILTER (fold NOT IN (0, 1)) AS inner_rows, COUNT(*) FILTER (label = 1) AS positives FROM sf""")
def fold_predicates(fx: Fixtures):
    f = F.col("fold")
    return fx.samples_fold.agg(
        F.count_if(f == 0).alias("held"), F.count_if(f != 0).alias("rest"), F.count_if(~f.isin(0, 1)).alias("inner_rows"),
        F.count_if(F.col("label") == 1).alias("positives"),
    )


@register("leak_free_columns", "P12", "SELECT row, col, x, y, dist_m, label, label_name, tile_row, tile_col FROM smp")
def leak_free_columns(fx: Fixtures):
    return fx.samples.select(*ti.LABEL_COLS)


@register("indicator_weights", "P15 D14", """
    m AS (SELECT fold, avg(sample_weight) AS m FROM pool GROUP BY fold)
    SELECT fold, round(SUM(CASE WHEN label = 1 THEN sample_weight ELSE 0 END), 4) AS pos_w, round(SUM(sample_weight / m.m), 4) AS norm_sum, COUNT(*) AS n FROM pool JOIN m USING (fold) GROUP BY fold""")
def indicator_weights(fx: Fixtures):
    from terrashift.operators.pool import mean_normalised

    p = mean_normalised(fx.pool, "sample_weight", ["fold"])
    return p.groupBy("fold").agg(
        F.round(F.sum(F.when(F.col("label") == 1, F.col("sample_weight")).otherwise(0.0)), 4).alias("pos_w"),
        F.round(F.sum("weight_norm"), 4).alias("norm_sum"), F.count(F.lit(1)).alias("n"),
    )


@register("small_group_flag", "P17", "SELECT block_id, n, n < 100 AS is_small FROM blk")
def small_group_flag(fx: Fixtures):
    return fx.blocks.select("block_id", "n", (F.col("n") < 100).alias("is_small"))


@register("tile_gather", "J4 G16 X7", """
    SELECT t.year, COUNT(*) AS n, round(SUM((bands[7] - 128) / 127.0::DOUBLE), 3) AS b6, CAST(SUM(s.label) AS BIGINT) AS label_sum,
      CAST(SUM(list_sum([bands[i] * i for i in range(1, 65)])) AS BIGINT) AS code_sum
    FROM smp s JOIN til t ON s.row = t.row AND s.col = t.col WHERE list_max(bands) > 0 GROUP BY t.year""")
def tile_gather(fx: Fixtures):
    """Sample lookup in tiles by integer offset, uncovered pixels dropped, bytes decoded."""
    got = ti.gather(fx.stored, fx.chunks, 32, 16, carry=("label",))
    codes = F.aggregate(F.transform("bands", lambda v, i: E.encode_band(v.cast("double")).cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return got.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("bands", 7).cast("double")), 3).alias("b6"), F.sum("label").alias("label_sum"),
        F.sum(codes).alias("code_sum"),
    )


@register("multi_year_assembly", "J5 G17", """
    c AS (SELECT row, col, tile_id, COUNT(*) AS k, SUM(bands[1] * (year - 2016)) AS s FROM til WHERE list_max(bands) > 0 GROUP BY 1, 2, 3 HAVING COUNT(*) = 3)
    SELECT s.block_id, c.tile_id, COUNT(*) AS n, CAST(SUM(c.s) AS BIGINT) AS code_sum FROM c JOIN smp s ON s.row = c.row AND s.col = c.col GROUP BY 1, 2""")
def multi_year_assembly(fx: Fixtures):
    """Pixels with every year, tiles with every year, block id stamped, outcome columns left behind."""
    table = ti.gather_years(fx.stored, fx.chunks, C.YEARS, 32, 16, carry=("block_id",))
    code = lambda y: E.encode_band(F.element_at(f"bands_{y}", 1).cast("double")) * (y - 2016)
    return table.groupBy("block_id", "tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(code(2017) + code(2018) + code(2019)).alias("code_sum")
    )


@register("wide_feature_table", "P2 P10 P11 J4 J5 G16 G17 S9 P12", """
    k AS (SELECT row, col FROM til WHERE list_max(bands) > 0 GROUP BY 1, 2 HAVING COUNT(*) = 3),
    v AS (SELECT t.year, unnest(t.bands) AS b, generate_subscripts(t.bands, 1) AS i FROM til t JOIN k ON t.row = k.row AND t.col = k.col)
    SELECT printf('A%02d_%d', i - 1, year) AS band, COUNT(*) FILTER (b <> 0) AS n, CAST(SUM(b) FILTER (b <> 0) AS BIGINT) AS code_sum FROM v GROUP BY 1""")
def wide_feature_table(fx: Fixtures):
    """Extract, assemble, widen to 192 named columns, write one partition per tile, and read every column back."""
    path = scratch_path(fx.spark, "wide")
    table = ti.gather_years(fx.stored, fx.chunks, C.YEARS, 32, 16, carry=("x", "y", "dist_m", "label", "label_name", "tile_row", "tile_col", "block_id"))
    # Pixels of a tile lie in the tasks of its chunks already.
    src.write_by_tile(ti.widen(table, C.YEARS), path, spread=False)
    names = C.band_names()
    back = src.read_columns(fx.spark, path, names)
    sums = back.agg(*[F.struct(F.count(n).alias("n"), F.sum(E.encode_band(F.col(n).cast("double"))).alias("s")).alias(n) for n in names])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("v")) for n in names])).alias("e"))
    return long.select("e.band", "e.v.n", F.col("e.v.s").cast("bigint").alias("code_sum"))


@register("ready_tiles", "J6", """
    SELECT tile_id, string_agg(year, ',' ORDER BY year) AS years FROM (SELECT DISTINCT tile_id, year FROM man) GROUP BY tile_id HAVING COUNT(*) = 3""")
def ready_tiles(fx: Fixtures):
    return ti.ready_tiles(fx.manifest, C.YEARS).select("tile_id", F.array_join("years", ",").alias("years"))


@register("table_reconciliation", "J7", """
    SELECT COUNT(*) FILTER (a.block_id IS NOT NULL AND b.block_id IS NOT NULL) AS matched, COUNT(*) FILTER (b.block_id IS NULL) AS left_only, COUNT(*) FILTER (a.block_id IS NULL) AS right_only,
      COUNT(*) FILTER (a.n <> b.n) AS n_differs, COUNT(*) FILTER (a.n1 <> b.n1) AS n1_differs
    FROM blk a FULL JOIN (SELECT block_id, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS n1 FROM smp_all GROUP BY 1) b ON a.block_id = b.block_id""")
def table_reconciliation(fx: Fixtures):
    return A.reconcile(fx.blocks, S.class_counts(fx.all_samples, ["block_id"]), "block_id", ["n", "n1"])


@register("pool_fold_integrity", "J8 A27", """
    SELECT COUNT(*) AS pairs, COUNT(*) FILTER (f.block_id IS NULL) AS misplaced FROM (SELECT DISTINCT block_id, fold FROM pool) p LEFT JOIN fld f ON p.block_id = f.block_id AND p.fold = f.fold""")
def pool_fold_integrity(fx: Fixtures):
    from terrashift.operators.pool import misplaced_blocks

    pairs = fx.pool.select("block_id", "fold").distinct()
    bad = misplaced_blocks(fx.pool, fx.folds).agg(F.count(F.lit(1))).scalar()
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).withColumn("misplaced", bad)


@register("never_submitted", "J9 J12 U4", "SELECT tile_id, year FROM expd EXCEPT SELECT tile_id, year FROM man")
def never_submitted(fx: Fixtures):
    return A.never_submitted(fx.expected, fx.manifest)


@register("task_states", "J10 A26", """
    SELECT CASE WHEN status = 'CANCELLED' THEN 'UNKNOWN' ELSE status END AS status, COUNT(*) AS n FROM man GROUP BY 1""")
def task_states(fx: Fixtures):
    """The service no longer lists cancelled tasks, so their state is unknown."""
    listed = fx.manifest.where("status <> 'CANCELLED'").select("task_id", F.col("status").alias("state"))
    return A.state_counts(A.with_task_state(fx.manifest, listed), fx.expected)


@register("completed_without_file", "J11 X12", """
    f AS (SELECT description || '.tif' AS file_name FROM man JOIN events ON task_id = printf('T%08d', event_id) WHERE value >= 10)
    SELECT tile_id, year FROM man m WHERE status = 'COMPLETED' AND NOT EXISTS (SELECT 1 FROM f WHERE f.file_name = m.description || '.tif')""")
def completed_without_file(fx: Fixtures):
    """Exports of low value never reached the bucket."""
    sized = fx.table("events").select(F.format_string("T%08d", "event_id").alias("task_id"), "value")
    files = fx.manifest.join(sized.where("value >= 10"), "task_id").select(F.concat("description", F.lit(".tif")).alias("file_name"))
    return A.completed_without_file(fx.manifest, files).select("tile_id", "year")


@register("submission_limit", "T5", "SELECT tile_id, year FROM (SELECT tile_id, year FROM expd EXCEPT SELECT tile_id, year FROM man) ORDER BY tile_id, year LIMIT 20")
def submission_limit(fx: Fixtures):
    """The next submissions; the limit is the feature."""
    return A.never_submitted(fx.expected, fx.manifest).orderBy("tile_id", "year").limit(20)


@register("stacked_sets", "U2 U3", """
    SELECT 'base' AS year_set, lc_2019 AS code, COUNT(*) AS n FROM px GROUP BY 2 UNION ALL SELECT 'target', lc_2024, COUNT(*) FROM px GROUP BY 2""")
def stacked_sets(fx: Fixtures):
    """Tagged sets in one pass: both years come from one scan instead of a union of two."""
    both = F.explode(F.array(
        F.struct(F.lit("base").alias("s"), F.col("lc_2019").alias("c")), F.struct(F.lit("target").alias("s"), F.col("lc_2024").alias("c"))
    ))
    return fx.pixels.select(both.alias("p")).groupBy(F.col("p.s").alias("year_set"), F.col("p.c").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("tile_and_block_ids", "G4 G5 X4 X5 X6 X15", """
    SELECT tile_id, block_id, COUNT(*) AS n, CAST(SUM(tile_row * 100 + tile_col) AS BIGINT) AS offsets,
      -2415585.0::DOUBLE + (CAST(substr(block_id, 7) AS INTEGER) + 0.5::DOUBLE) * 480 AS x_center, 3314805.0::DOUBLE - CAST(substr(tile_id, 2, 3) AS INTEGER) * 960.0::DOUBLE AS maxy
    FROM smp GROUP BY tile_id, block_id""")
def tile_and_block_ids(fx: Fixtures):
    g = fx.samples.groupBy("tile_id", "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("tile_row") * 100 + F.col("tile_col")).alias("offsets")
    )
    from terrashift.plans.fixtures import BLOCK

    trow, tcol = L.parse_tile_id(F.col("tile_id"))
    return g.select(
        "*", L.center_x(L.parse_block_id(F.col("block_id"))[1], BLOCK).alias("x_center"), L.cell_box(trow, tcol, TILE)["maxy"].alias("maxy")
    )


@register("band_byte_code", "X7", """
    v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT vec_id, CAST(SUM(round(x * 127) + 128) AS BIGINT) AS code_sum, CAST(MIN(round(x * 127) + 128) AS INTEGER) AS code_min, CAST(MAX(round(x * 127) + 128) AS INTEGER) AS code_max,
      MAX(abs((round(x * 127)) / 127.0::DOUBLE - x)) <= 0.5::DOUBLE / 127 + 1e-6 AS close FROM v GROUP BY vec_id""")
def band_byte_code(fx: Fixtures):
    e = fx.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    c = e.withColumn("c", E.encode_bands(F.col("x")))
    err = F.array_max(F.zip_with(E.decode_bands(F.col("c")), "x", lambda a, b: F.abs(a.cast("double") - b)))
    return c.select(
        "vec_id", F.aggregate("c", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("code_sum"),
        F.array_min("c").cast("int").alias("code_min"), F.array_max("c").cast("int").alias("code_max"), (err <= 0.5 / 127 + 1e-6).alias("close"),
    )


@register("lattice_snap_and_align", "X11 X18", """
    SELECT poly_id, seq, CAST(round((3314805.0::DOUBLE - y) / 30) AS INTEGER) AS row, CAST(round((x + 2415585.0::DOUBLE) / 30) AS INTEGER) AS col,
      abs((x + 2415585.0::DOUBLE) / 30 - round((x + 2415585.0::DOUBLE) / 30)) < 1e-6 AND abs((y - 3314805.0::DOUBLE) / 30 - round((y - 3314805.0::DOUBLE) / 30)) < 1e-6 AS aligned,
      CAST(greatest(0, least(round((x + 2415585.0::DOUBLE) / 30) - 8, w - 16)) AS INTEGER) AS patch_col FROM vtx, grid WHERE ring_id = 0""")
def lattice_snap_and_align(fx: Fixtures):
    row, col = L.snap(F.col("x"), F.col("y"), LAT)
    return fx.vertices.where("ring_id = 0").select(
        "poly_id", "seq", row.alias("row"), col.alias("col"), L.is_aligned(F.col("x"), F.col("y"), LAT).alias("aligned"),
        L.clamp_offset(col, 16, fx.width).alias("patch_col"),
    )
