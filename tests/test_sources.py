"""Sinks, manifests, configuration, streaming."""

from pyspark.sql import functions as F

from terrashift.operators import audit as A
from terrashift.operators import tiles as ti
from terrashift.sources import tables as T
from terrashift.streaming.pickup import pick_up_new_tiles


def tile_rows(spark, tiles, v):
    return spark.createDataFrame([(r, c, t, v) for t in tiles for r in range(3) for c in range(2)], "row int, col int, tile_id string, v int")


def test_tile_sink_replaces_only_its_tiles(spark, tmp_path):
    p = str(tmp_path / "t")
    T.write_by_tile(tile_rows(spark, ["a", "b"], 1), p)
    T.write_by_tile(tile_rows(spark, ["b"], 2), p)
    T.write_missing_tiles(tile_rows(spark, ["a", "c"], 3), p)
    got = {(r["tile_id"], r["v"]): r["count"] for r in spark.read.parquet(p).groupBy("tile_id", "v").count().collect()}
    assert got == {("a", 1): 6, ("b", 2): 6, ("c", 3): 6}


def test_write_once(spark, tmp_path):
    p = str(tmp_path / "o")
    T.write_once(spark.range(3), p)
    T.write_once(spark.range(9), p)
    assert spark.read.parquet(p).count() == 3
    T.write_once(spark.range(9), p, force=True)
    assert spark.read.parquet(p).count() == 9


def test_manifest_append_and_rewrite(spark, tmp_path):
    p = str(tmp_path / "m")
    m = spark.createDataFrame([("r001_c001", 2017, "T1", "x_r001_c001", "SUBMITTED")], T.MANIFEST_SCHEMA)
    T.append_manifest(m, p)
    T.append_manifest(m.withColumn("year", F.lit(2018)), p)
    back = T.read_manifest(spark, p)
    assert back.count() == 2
    states = spark.createDataFrame([("T9", "COMPLETED")], "task_id string, state string")
    T.rewrite_manifest(A.with_task_state(back, states), str(tmp_path / "m2"))
    assert {r["status"] for r in T.read_manifest(spark, str(tmp_path / "m2")).collect()} == {"UNKNOWN"}


def test_config_merge_keeps_both_halves(spark):
    a = spark.createDataFrame([("v1", {"k": "5", "seed": "0"}), ("v0", {"k": "3"})], "name string, params map<string,string>")
    b = spark.createDataFrame([("v1", {"tau": "200", "seed": "7"})], "name string, params map<string,string>")
    got = {r["name"]: r["params"] for r in T.config_from_json(T.config_json(T.merge_config(a, b))).collect()}
    assert got == {"v1": {"k": "5", "seed": "7", "tau": "200"}, "v0": {"k": "3"}}


def test_stream_processes_each_file_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    seen = []

    def note(batch):
        seen.append(batch.count())
        return batch

    for tiles in (["a", "b"], ["c"]):
        tile_rows(spark, tiles, 1).coalesce(1).write.mode("append").parquet(src)
        pick_up_new_tiles(spark, src, tile_rows(spark, ["a"], 1).schema, note, sink, ck).awaitTermination()
    assert seen == [12, 6] and spark.read.parquet(sink).count() == 18


def test_cost_of_a_delivery_does_not_grow_with_the_history(spark, tmp_path):
    """Ten deliveries of new tiles, then one that adds to an old tile: what is read are the files of the tiles named."""
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema, files, rows = tile_rows(spark, ["a"], 1).schema, [], []

    def note(whole):
        files.append(len(whole.inputFiles()))
        rows.append(whole.count())
        return whole

    for i, tiles in enumerate([*([f"t{i}", f"u{i}"] for i in range(10)), ["t3", "new"]]):
        tile_rows(spark, tiles, 1).coalesce(1).write.mode("append").parquet(src)
        pick_up_new_tiles(spark, src, schema, note, sink, ck).awaitTermination()
    assert files == [1] * 10 + [2] and rows == [12] * 10 + [18]
    got = {r["tile_id"]: r["count"] for r in spark.read.parquet(sink).groupBy("tile_id").count().collect()}
    assert got == {f"{x}{i}": 6 for x in "tu" for i in range(10)} | {"t3": 12, "new": 6}


def test_a_repeated_batch_gives_the_same_tiles(spark, tmp_path):
    """The progress of the second delivery is lost after its tiles were written; it is processed again."""
    src, sink, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = tile_rows(spark, ["a"], 1).schema
    for tiles in (["a", "b"], ["b", "c"]):
        tile_rows(spark, tiles, 1).coalesce(1).write.mode("append").parquet(src)
        pick_up_new_tiles(spark, src, schema, lambda d: d, sink, ck).awaitTermination()
    once = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "ck" / name).unlink(missing_ok=True)
    pick_up_new_tiles(spark, src, schema, lambda d: d, sink, ck).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == once and len(once) == 24


def test_assembly_drops_uncovered_and_incomplete_pixels(spark):
    s = spark.createDataFrame([(0, 0, "r000_c000", 0, 0), (0, 1, "r000_c000", 0, 1), (0, 9, "r000_c000", 0, 9)], "row int, col int, tile_id string, tile_row int, tile_col int")
    t = spark.createDataFrame(
        [("r000_c000", 0, 0, 2017, [1, 255]), ("r000_c000", 0, 0, 2018, [128, 0]), ("r000_c000", 0, 1, 2017, [0, 0]), ("r000_c000", 0, 1, 2018, [5, 5])],
        "tile_id string, tile_row int, tile_col int, year int, bands array<smallint>",
    )
    ex = ti.extract(s, t, 4)
    assert ex.count() == 3
    out = ti.assemble(ex, [2017, 2018]).collect()
    assert [(r["row"], r["col"]) for r in out] == [(0, 0)]
    assert out[0]["bands_2017"] == [-1.0, 1.0] and out[0]["bands_2018"] == [0.0, None]
    assert {r["tile_id"] for r in ti.ready_tiles(ex, [2017, 2018]).collect()} == {"r000_c000"}
    assert ti.ready_tiles(ex, [2017, 2018, 2019]).count() == 0
    assert "A01_2018" in ti.widen(ti.assemble(ex, [2017, 2018]), [2017, 2018], 2).columns


def test_reconcile_and_files(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1)], "k string, n int")
    r = A.reconcile(a, b, "k", ["n"]).first()
    assert (r["matched"], r["left_only"], r["right_only"], r["n_differs"]) == (2, 1, 1, 1)
    m = spark.createDataFrame([("r001_c001", 2017, "T1", "x_r001_c001", "COMPLETED"), ("r001_c002", 2017, "T2", "x_r001_c002", "COMPLETED")], T.MANIFEST_SCHEMA)
    files = spark.createDataFrame([("x_r001_c001-0000.tif",)], "file_name string")
    assert [r["tile_id"] for r in A.completed_without_file(m, files).collect()] == ["r001_c002"]
