"""Readers and sinks: Parquet tables, per-tile partitions, CSV summaries, run configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the square of cells that one task writes for a tile.
SQUARE = 512

MANIFEST_SCHEMA = "tile_id string, year int, task_id string, description string, status string"


def read_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet files of a glob as a named view."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def exists(spark: SparkSession, path: str) -> bool:
    """True if a path is there; asks the file system once and lists nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Leave an existing output alone unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def write_by_tile(df: DataFrame, path: str, cells_per_file: int = 2_000_000, spread: bool = True) -> None:
    """One directory per tile; rerunning replaces only the tiles in ``df``.

    Rows are spread within a tile by squares of ``SQUARE`` cells before writing: a tile that holds a third of all rows is
    still written by many tasks and in files of bounded size, and a small tile is one file or a few. ``spread=False``
    leaves rows where they are, for those that few tasks hold for each tile anyway.
    """
    square = [F.floor(F.col(c) / F.lit(float(SQUARE))) for c in ("row", "col")]
    (
        (df.repartition("tile_id", *square) if spread else df)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", cells_per_file)
        .partitionBy("tile_id")
        .parquet(path)
    )


def write_named(df: DataFrame, path: str, name: str, append: bool = False) -> None:
    """One folder of files for each value of ``name``, which ends up in the files' paths and not in the files."""
    df.repartition(name).write.mode("append" if append else "errorifexists").partitionBy(name).parquet(path)


def read_with_paths(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files below ``path`` with the file that each comes from, as the scan itself reports it."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file_name"))


def write_missing_tiles(df: DataFrame, path: str) -> None:
    """Write only tiles the sink does not have yet."""
    spark = df.sparkSession
    if exists(spark, path):
        done = spark.read.parquet(path).select("tile_id").distinct()
        df = df.join(done, "tile_id", "left_anti")
    write_by_tile(df, path)


def write_csv_summary(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header.

    The report is computed by as many tasks as it takes; only its finished rows go to the one that writes.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.select("tile_id", "year", "task_id", "description", "status").write.mode("append").option("header", True).csv(path)


def rewrite_manifest(df: DataFrame, path: str) -> None:
    df.select("tile_id", "year", "task_id", "description", "status").write.mode("overwrite").option("header", True).csv(path)


def merge_config(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge run constants (name, params map) by name; later values win, other keys survive.

    Without relying on a session setting: keys that the update repeats are taken out of the old map first.
    """
    u = updates.select("name", F.col("params").alias("_u"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = F.coalesce("params", empty), F.coalesce("_u", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return current.join(u, "name", "full_outer").select("name", F.map_concat(kept, new).alias("params"))


def config_json(config: DataFrame) -> DataFrame:
    return config.select("name", F.to_json("params").alias("json"))


def config_from_json(rows: DataFrame) -> DataFrame:
    return rows.select("name", F.from_json("json", "map<string,string>").alias("params"))


def year_granules(granules: DataFrame, ts: str, year: int) -> DataFrame:
    """Half-open calendar year; a plain range predicate, so it reaches the scan."""
    return granules.where(
        (F.col(ts) >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp"))
        & (F.col(ts) < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp"))
    )


def attach_neighbourhood(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Samples with their neighbourhood features; samples without any keep nulls and all rows stay."""
    return samples.join(features, ["row", "col"], "left")
