"""Pixels, samples, tiles, folds and predictions derived from the given tables, in Spark and in plain SQL.

The pixel grid covers every order: its width is the square root of the table rounded up to 64 cells, so both sides
grow with the data, and the open end of the last row is filled with nodata cells. Blocks are 16 x 16 and tiles
32 x 32 cells, because the production sizes would put a small grid into one cell.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.functions import expressions as E
from terrashift.functions import lattice as L
from terrashift.operators import folds as fo
from terrashift.operators import pool as po
from terrashift.operators import summaries as S
from terrashift.operators import tiles as ti
from terrashift.session import materialise

LAT = C.Lattice()
TILE = LAT.coarser(32)
BLOCK = LAT.coarser(16)
K = 5
DIST = "dist_m"
FOLDS = C.FoldSpec(k=K, seed=0)
# Small tables: a gentle decay and a budget that is a share of the rows.
POOL = C.PoolSpec(tau_m=2000.0, floor=0.01, dup=2, hash_method="md5")
BUDGET_SHARE = 0.5
# Cells of 64 bands that one task packs into chunks: about 30 MB.
CELLS_A_TASK = 200_000
# A scan decodes nested values by up to 4,096 rows of a row group, at 14 bytes and more for a band: with a file of 400
# chunks in one group that is several hundred MB a task. Groups of 2 MB hold some 60 chunks, whatever the file holds.
SMALL_GROUPS = {"parquet.block.size": 2 << 20, "parquet.page.size.row.check.min": 16}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_orders(self) -> int:
        """Counted from file footers once."""
        return self.table("orders").count()

    @cached_property
    def width(self) -> Column:
        """One number and a constant of every plan."""
        return F.lit(math.ceil(math.sqrt(self.n_orders) / 64) * 64).cast("bigint")

    @cached_property
    def pixels(self) -> DataFrame:
        o, w = self.table("orders"), self.width
        dev = (F.lit(21) + F.col("o_custkey") % 4).cast("int")
        mix = (F.col("o_orderkey") + F.col("o_custkey")) % 3
        prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
        base = o.select(
            F.floor(F.col("o_orderkey") / w).cast("int").alias("row"),
            (F.col("o_orderkey") % w).cast("int").alias("col"),
            F.when((prio == "1-URGENT") & (status == "F"), dev).when(mix == 0, 90).when(mix == 1, 95).otherwise(41).cast("int").alias("lc_2019"),
            dev.alias("_dev"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
        )
        lc24 = (
            F.when(~F.col("lc_2019").isin(90, 95), F.col("lc_2019"))
            .when((prio == "2-HIGH") & (status == "P"), F.col("_dev"))
            .when((prio == "5-LOW") & (status == "O"), F.element_at(F.array(*[F.lit(c) for c in C.OTHER_NAMES]), (F.col("o_custkey") % 9 + 1).cast("int")))
            .when((prio == "3-MEDIUM") & (F.col("o_custkey") % 50 == 0), 250)
            .otherwise(F.col("lc_2019"))
            .cast("int")
        )
        cells = base.select("row", "col", "lc_2019", lc24.alias("lc_2024"), F.greatest(F.lit(30.0), F.col("o_totalprice") / 100).alias(DIST))
        n = o.agg(F.count(F.lit(1)).alias("n"))
        fill = (
            n.select(F.floor(F.col("n") / w).cast("int").alias("row"), (F.col("n") % w).cast("int").alias("_used"), w.cast("int").alias("_w"))
            .where("_used > 0")
            .select("row", F.explode(F.sequence(F.col("_used"), F.col("_w") - 1)).alias("col"))
            .select("row", "col", F.lit(250).alias("lc_2019"), F.lit(250).alias("lc_2024"), F.lit(30.0).alias(DIST))
        )
        return cells.unionByName(fill).withColumns(
            {"x": L.center_x(F.col("col"), LAT), "y": L.center_y(F.col("row"), LAT)}
        )

    @cached_property
    def all_samples(self) -> DataFrame:
        """Base-year wetland pixels, also those without a target observation."""
        return self._placed(keep_unlabelled=True)

    def _placed(self, keep_unlabelled: bool) -> DataFrame:
        s = ti.labelled_sample(self.pixels, "lc_2019", "lc_2024", keep_unlabelled)
        return ti.with_block_id(ti.with_tile_index(s, LAT, 32), BLOCK)

    @cached_property
    def samples(self) -> DataFrame:
        return self._placed(keep_unlabelled=False)

    @cached_property
    def stored(self) -> DataFrame:
        """The label table as later stages find it: written once, read with column pruning."""
        return materialise(self.samples, "labels")

    @cached_property
    def blocks(self) -> DataFrame:
        return materialise(S.class_counts(self.stored, ["block_id"]), "blocks")

    @cached_property
    def folds(self) -> DataFrame:
        return materialise(fo.snake_folds(self.blocks, FOLDS, method="md5"), "folds")

    @cached_property
    def samples_fold(self) -> DataFrame:
        return fo.with_fold(self.stored, self.folds)

    @cached_property
    def tiles(self) -> DataFrame:
        """Byte-coded bands of every sample pixel and year; one pixel in 37 has no coverage."""
        e = self.table("embeddings")
        n = e.agg(F.count(F.lit(1))).scalar()
        key = (F.col("row") * self.width + F.col("col")) * 3 + (F.col("year") - 2017)
        years = F.explode(F.array(*[F.lit(y) for y in C.YEARS]))
        p = self.stored.select("row", "col", "tile_id", "tile_row", "tile_col", years.alias("year")).withColumn("vec_id", key % n)
        dark = (F.col("row") + F.col("col") + F.col("year")) % 37 == 0
        # Every vector is coded once, before it is spread over pixels.
        coded = e.select("vec_id", E.encode_bands(F.transform("embedding", lambda v: v.cast("double"))).alias("_code"))
        none = F.array(*[F.lit(C.BAND_NODATA).cast("smallint")] * C.N_BANDS)
        return p.join(coded, "vec_id").select(
            "row", "col", "tile_id", "tile_row", "tile_col", "year", F.when(dark, none).otherwise(F.col("_code")).alias("bands")
        )

    @cached_property
    def chunks(self) -> DataFrame:
        """The same bands as a raster source gives them: rows of whole chunks of 16 tile rows, every cell of the grid.

        Only the chunks' keys are grouped; codes are joined in place and gathered where they are.
        """
        return materialise(self._packed(), "chunks", **SMALL_GROUPS)

    def _packed(self) -> DataFrame:
        e = self.table("embeddings")
        n = e.agg(F.count(F.lit(1))).scalar()
        coded = e.select("vec_id", E.encode_bands(F.transform("embedding", lambda v: v.cast("double"))).alias("_code"))
        grid = self.pixels.groupBy(F.floor(F.col("row") / F.lit(16.0)).cast("int").alias("_r"), F.floor(F.col("col") / F.lit(32.0)).cast("int").alias("_c"))
        keys = grid.agg(F.max("row").alias("_last")).withColumn("year", F.explode(F.array(*[F.lit(y) for y in C.YEARS])))
        # The keys are few bytes and become whole chunks: left alone, they would all be merged into one task.
        keys = keys.repartition(math.ceil(self.n_orders * len(C.YEARS) / CELLS_A_TASK), "_r", "_c", "year")
        cells = keys.select("_r", "_c", "year", F.explode(F.sequence(F.lit(0), (F.col("_last") - F.col("_r") * 16 + 1) * 32 - 1)).alias("_i"))
        row, col = F.col("_r") * 16 + F.floor(F.col("_i") / F.lit(32.0)).cast("int"), F.col("_c") * 32 + F.col("_i") % 32
        cells = cells.withColumn("vec_id", ((row * self.width + col) * 3 + (F.col("year") - 2017)) % n)
        none = F.array(*[F.lit(C.BAND_NODATA).cast("smallint")] * C.N_BANDS)
        bands = F.when((row + col + F.col("year")) % 37 == 0, none).otherwise(F.col("_code"))
        # Sizes are guessed without the explode, so cells pass for small: an outer join can't send them to the driver, and
        # a cell without a vector keeps its place in the chunk.
        joined = cells.join(coded, "vec_id", "left")
        packed = joined.groupBy("_r", "_c", "year").agg(F.array_sort(F.collect_list(F.struct("_i", bands.alias("b")))).alias("a"))
        return packed.select(
            L.tile_id(F.floor(F.col("_r") / F.lit(2.0)).cast("int"), F.col("_c")).alias("tile_id"), "year",
            (F.col("_r") % 2 * 16).cast("int").alias("row0"), F.col("a.b").alias("values"),
        )

    @cached_property
    def budget(self) -> Column:
        """Rows every fold should contribute: a share of the average fold."""
        return self.stored.agg((F.count(F.lit(1)) * F.lit(BUDGET_SHARE) / K).cast("bigint")).scalar()

    @cached_property
    def calibration(self) -> DataFrame:
        return materialise(po.fold_calibration(self.samples_fold, DIST, POOL, self.budget), "calibration")

    @cached_property
    def pool(self) -> DataFrame:
        return materialise(po.draw(self.samples_fold, self.calibration, DIST, POOL), "pool")

    @cached_property
    def oof(self) -> DataFrame:
        """A stand-in for out-of-fold predictions: noisy, distance-driven, with ties."""
        u = E.uniform([F.col("row"), F.col("col")], 7, "md5")
        s = F.round(F.lit(0.5) * u + F.lit(0.5) * F.exp(-F.col(DIST) / F.lit(1000.0)), 4)
        return self.samples_fold.select(
            "row", "col", "x", "y", "fold", "label", (F.col("label") == 1).cast("int").alias("label_bin"), DIST, s.alias("y_score")
        )

    @cached_property
    def vertices(self) -> DataFrame:
        """Polygons of twenty suppliers each: a skyline from their balances, a base line and a triangular hole.

        Polygons are laid out on lots of 64 x 64 cells, so their total area grows with the grid.
        """
        side, lots = F.lit(2880.0), self.width / 64
        s = self.table("supplier").select(
            F.floor(F.col("s_suppkey") / F.lit(20.0)).cast("int").alias("poly_id"), (F.col("s_suppkey") % 20 + 1).cast("int").alias("i"), "s_acctbal"
        )
        pid = F.col("poly_id")
        x0 = F.lit(LAT.origin_x) + (pid % lots) * F.lit(1920.0) + (pid * 7 % 11) * F.lit(13.0)
        y0 = F.lit(LAT.origin_y) - (F.floor(pid / lots) % lots + 1) * F.lit(1920.0) + (pid * 5 % 7) * F.lit(13.0)
        top = s.select(
            "poly_id", F.lit(0).alias("ring_id"), F.col("i").alias("seq"),
            (x0 + F.col("i") * (side / 42.0)).alias("x"), (y0 + side / 8.0 + F.abs("s_acctbal") / 10000.0 * side / 2.0).alias("y"),
        )
        lot = F.array(
            *[
                F.struct(F.lit(r).alias("r"), F.lit(q).alias("s"), F.lit(fx).alias("fx"), F.lit(fy).alias("fy"))
                for r, q, fx, fy in ((0, 0, 0.0, 0.0), (0, -1, 0.5, 0.0), (1, 0, 0.15, 0.03), (1, 1, 0.35, 0.03), (1, 2, 0.25, 0.09))
            ]
        )
        fixed = s.select("poly_id").distinct().select("poly_id", F.explode(lot).alias("p")).select(
            "poly_id", F.col("p.r").alias("ring_id"), F.col("p.s").alias("seq"),
            (x0 + F.col("p.fx") * side).alias("x"), (y0 + F.col("p.fy") * side).alias("y"),
        )
        return fixed.unionByName(top).withColumn("name", F.format_string("P%05d", "poly_id"))

    @cached_property
    def manifest(self) -> DataFrame:
        """Export manifest over all events; sign-ups are entries that were never submitted."""
        ev = self.table("events").where("event_type <> 'signup'")
        t = F.floor(F.col("event_id") / F.lit(3.0)).cast("bigint")
        tile, year = _event_tile(t), (F.lit(2017) + F.col("event_id") % 3).cast("int")
        status = (
            F.when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED")
            .when(F.col("event_type") == "click", "RUNNING").otherwise("CANCELLED")
        )
        return ev.select(
            tile.alias("tile_id"), year.alias("year"), F.format_string("T%08d", F.col("event_id")).alias("task_id"),
            F.format_string("bands30m_%d_%s", year, tile).alias("description"), status.alias("status"),
        )

    @cached_property
    def expected(self) -> DataFrame:
        """Every tile of the manifest in every year."""
        from terrashift.operators.audit import expected_keys

        n = self.table("events").select(_event_tile(F.floor(F.col("event_id") / F.lit(3.0)).cast("bigint")).alias("tile_id")).distinct()
        return expected_keys(n, C.YEARS)

    @cached_property
    def profiles(self) -> DataFrame:
        return materialise(S.block_profiles(self.stored, DIST, BLOCK), "profiles")


def _event_tile(t: Column) -> Column:
    return L.tile_id(F.floor(t / F.lit(100.0)).cast("int"), (t % 100).cast("int"))


U = "(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_uniform(*keys: str, seed: int) -> str:
    return U.format(key="concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f", '{seed}')")


RELATIONS = {
    "grid": "SELECT CAST(64 * ceil(sqrt(COUNT(*)::DOUBLE) / 64) AS BIGINT) AS w, COUNT(*) AS n FROM orders",
    "cells": """SELECT CAST(o_orderkey // w AS INTEGER) AS row, CAST(o_orderkey % w AS INTEGER) AS col,
        CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 21 + o_custkey % 4
             WHEN (o_orderkey + o_custkey) % 3 = 0 THEN 90 WHEN (o_orderkey + o_custkey) % 3 = 1 THEN 95 ELSE 41 END AS INTEGER) AS lc_2019,
        o_orderpriority, o_orderstatus, o_custkey, o_totalprice FROM orders, grid""",
    "px0": """SELECT row, col, lc_2019,
        CAST(CASE WHEN lc_2019 NOT IN (90, 95) THEN lc_2019
             WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 21 + o_custkey % 4
             WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN ([11, 31, 41, 42, 43, 52, 71, 81, 82])[CAST(o_custkey % 9 + 1 AS INTEGER)]
             WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 50 = 0 THEN 250 ELSE lc_2019 END AS INTEGER) AS lc_2024,
        greatest(30.0::DOUBLE, o_totalprice / 100) AS dist_m FROM cells
        UNION ALL
        SELECT CAST(n // w AS INTEGER), CAST(i AS INTEGER), 250, 250, 30.0::DOUBLE
        FROM (SELECT n, w, unnest(range(n % w, w)) AS i FROM grid WHERE n % w > 0)""",
    "px": """SELECT row, col, -2415585 + (col + 0.5::DOUBLE) * 30 AS x, 3314805 - (row + 0.5::DOUBLE) * 30 AS y, lc_2019, lc_2024, dist_m FROM px0""",
    "smp_all": """SELECT *, CAST(CASE WHEN lc_2024 = 250 THEN -1 WHEN lc_2024 IN (90, 95) THEN 0 WHEN lc_2024 BETWEEN 21 AND 24 THEN 1 ELSE 2 END AS INTEGER) AS label,
        CASE WHEN lc_2024 = 250 THEN NULL WHEN lc_2024 IN (90, 95) THEN 'Remained wetland' WHEN lc_2024 BETWEEN 21 AND 24 THEN 'Converted to developed'
             ELSE 'Converted to other (not developed)' END AS label_name,
        printf('b%04d_%04d', row // 16, col // 16) AS block_id, printf('r%03d_c%03d', row // 32, col // 32) AS tile_id,
        CAST(row % 32 AS INTEGER) AS tile_row, CAST(col % 32 AS INTEGER) AS tile_col
        FROM px WHERE lc_2019 IN (90, 95)""",
    "smp": "SELECT * FROM smp_all WHERE label <> -1",
    "blk": "SELECT block_id, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS n1, COUNT(*) FILTER (label = 2) AS n2 FROM smp GROUP BY block_id",
    "tgt": "SELECT COUNT(*) AS b, SUM(n)::DOUBLE / 5 AS t, SUM(n1)::DOUBLE / 5 AS t1, SUM(n2)::DOUBLE / 5 AS t2 FROM blk",
    "dealt": f"""SELECT block_id, n, n1, n2, b, row_number() OVER (ORDER BY floor((n1 * 1.0::DOUBLE / t1 + n2 * 0.6::DOUBLE / t2 + n * 0.6::DOUBLE / t) * b::DOUBLE * 20.0::DOUBLE) DESC,
        {sql_uniform('block_id', seed=0)}, block_id) - 1 AS pos FROM blk, tgt""",
    "fld": """SELECT block_id, n, n1, n2, CAST(CASE WHEN (pos // 5) % 2 = 0 OR pos >= b - b % 5 THEN pos % 5 ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM dealt""",
    "sf": "SELECT s.*, f.fold FROM smp s JOIN fld f USING (block_id)",
    "emb": "SELECT vec_id, embedding, (SELECT COUNT(*) FROM embeddings) AS m FROM embeddings",
    "til": """SELECT s.row, s.col, s.tile_id, s.tile_row, s.tile_col, s.year,
        CASE WHEN (s.row + s.col + s.year) % 37 = 0 THEN [0 for v in e.embedding] ELSE [CAST(round(v::DOUBLE * 127) + 128 AS INTEGER) for v in e.embedding] END AS bands
        FROM (SELECT s0.*, y.year FROM smp s0, (SELECT unnest([2017, 2018, 2019]) AS year) y) s, grid g, emb e
        WHERE e.vec_id = ((s.row * g.w + s.col) * 3 + (s.year - 2017)) % e.m""",
    "cal0": """SELECT fold, COUNT(*) AS n, COUNT(*) FILTER (label = 1) AS n1, COUNT(*) FILTER (label = 2) AS n2, COUNT(*) FILTER (label = 0) AS n0,
        avg(exp(-dist_m / 2000.0::DOUBLE)) FILTER (label = 0) AS mean_decay FROM sf GROUP BY fold""",
    "cal": """SELECT *, (budget0::DOUBLE / n0 - 0.01::DOUBLE) / mean_decay AS a, 0.01::DOUBLE + (budget0::DOUBLE / n0 - 0.01::DOUBLE) / mean_decay * exp(-30.0::DOUBLE / 2000) AS p_max
        FROM (SELECT *, CAST(floor((SELECT COUNT(*) FROM smp) * 0.5::DOUBLE / 5) - 2 * n1 - n2 AS BIGINT) AS budget0 FROM cal0)""",
    "mul": "SELECT (SUM(n0) + SUM(n2))::DOUBLE / SUM(n1)::DOUBLE AS m FROM cal",
    "scr": f"""SELECT s.*, CASE WHEN label IN (1, 2) THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 0.01::DOUBLE + c.a * exp(-dist_m / 2000.0::DOUBLE)) END AS p_include,
        {sql_uniform('row', 'col', seed=42)} AS u FROM sf s JOIN cal c USING (fold)""",
    "pool": """SELECT s.*, CASE WHEN label = 1 THEN mul.m / 2 ELSE 1.0::DOUBLE / p_include END AS sample_weight, CAST(label = 1 AS INTEGER) AS label_bin, d.copy > 1 AS is_dup
        FROM scr s, mul, (SELECT unnest([1, 2]) AS copy) d WHERE s.u < s.p_include AND (d.copy = 1 OR s.label = 1)""",
    "oof": f"""SELECT row, col, x, y, fold, label, CAST(label = 1 AS INTEGER) AS label_bin, dist_m,
        round(0.5::DOUBLE * {sql_uniform('row', 'col', seed=7)} + 0.5::DOUBLE * exp(-dist_m / 1000.0::DOUBLE), 4) AS y_score FROM sf""",
    "sup": "SELECT CAST(s_suppkey // 20 AS INTEGER) AS poly_id, CAST(s_suppkey % 20 + 1 AS INTEGER) AS i, s_acctbal FROM supplier",
    "org": """SELECT DISTINCT poly_id, 2880.0::DOUBLE AS h, -2415585.0::DOUBLE + (poly_id % (w // 64)) * 1920.0::DOUBLE + (poly_id * 7 % 11) * 13.0::DOUBLE AS x0,
        3314805.0::DOUBLE - ((poly_id // (w // 64)) % (w // 64) + 1) * 1920.0::DOUBLE + (poly_id * 5 % 7) * 13.0::DOUBLE AS y0 FROM sup, grid""",
    "lot": "SELECT unnest([0, 0, 1, 1, 1]) AS r, unnest([0, -1, 0, 1, 2]) AS s, unnest([0.0, 0.5, 0.15, 0.35, 0.25])::DOUBLE AS fx, unnest([0.0, 0.0, 0.03, 0.03, 0.09])::DOUBLE AS fy",
    "vtx": """SELECT *, printf('P%05d', poly_id) AS name FROM (
        SELECT poly_id, CAST(0 AS INTEGER) AS ring_id, i AS seq, x0 + i * (h / 42) AS x, y0 + h / 8 + abs(s_acctbal) / 10000 * h / 2 AS y FROM sup JOIN org USING (poly_id)
        UNION ALL SELECT poly_id, CAST(r AS INTEGER), CAST(s AS INTEGER), x0 + fx * h, y0 + fy * h FROM org, lot)""",
    "edg": """SELECT poly_id, ring_id, seq, x AS x1, y AS y1,
        coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM vtx WINDOW w AS (PARTITION BY poly_id, ring_id ORDER BY seq)""",
    "man": """SELECT printf('r%03d_c%03d', (event_id // 3) // 100, (event_id // 3) % 100) AS tile_id, CAST(2017 + event_id % 3 AS INTEGER) AS year,
        printf('T%08d', event_id) AS task_id, printf('bands30m_%d_r%03d_c%03d', 2017 + event_id % 3, (event_id // 3) // 100, (event_id // 3) % 100) AS description,
        CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING' ELSE 'CANCELLED' END AS status
        FROM events WHERE event_type <> 'signup'""",
    "expd": """SELECT tile_id, y.year FROM (SELECT DISTINCT printf('r%03d_c%03d', (event_id // 3) // 100, (event_id // 3) % 100) AS tile_id FROM events), (SELECT unnest([2017, 2018, 2019]) AS year) y""",
}


def with_fixtures(sql: str) -> str:
    """Put the relations a statement uses, and those they use, in front of it."""
    body = sql.strip()
    own = body if body.upper().startswith("WITH ") else "WITH " + body if re.match(r"^\w+ AS \(", body) else body
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, rel in RELATIONS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(rel)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return own
    heads = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in needed)
    rest = own[5:] if own.upper().startswith("WITH ") else None
    return f"WITH {heads}, {rest}" if rest else f"WITH {heads} {own}"
