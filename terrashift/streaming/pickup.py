"""Incremental pick-up of tiles as they arrive: only the files of tiles that a delivery names are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terrashift.sources.tables import exists

#: Folders of the file index; a batch reads those of its own tiles.
SLOTS = 64


def _slot(partition: str) -> Column:
    return F.pmod(F.xxhash64(partition), F.lit(SLOTS)).cast("int")


def _note_files(rows: DataFrame, index: str, batch_id: int, partition: str) -> None:
    """Enter which file of the batch holds which tile. A repeated batch replaces its own entries."""
    entries = rows.select(F.col("_file").alias("file"), partition).distinct()
    (
        entries.select("file", partition, _slot(partition).alias("slot"), F.lit(batch_id).alias("batch"))
        .repartition("slot")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slot", "batch")
        .parquet(index)
    )


def files_of(spark: SparkSession, index: str, tiles: DataFrame, partition: str) -> list[str]:
    """Source files that hold rows of ``tiles``. Like any file scan, the driver gets their names."""
    if not exists(spark, index):
        return []
    slots = [r[0] for r in tiles.select(_slot(partition)).distinct().collect()]
    known = spark.read.parquet(index).where(F.col("slot").isin(slots))
    return [r[0] for r in known.join(tiles.select(partition), partition, "left_semi").select("file").distinct().collect()]


def pick_up_new_tiles(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    partition: str = "tile_id",
    files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Process every file that arrived since the last run, then stop.

    The raw rows of a micro-batch name the tiles in ``partition``. An index beside the checkpoint tells which earlier
    files hold those tiles; they are read, with the filter on the tiles pushed into the scan, and the tiles are replaced
    in the sink. So a tile that arrives in several deliveries stays whole, the cost of a delivery follows from its own
    tiles and not from the history, and a batch that is repeated after a failure gives the same files. ``transform``
    works row by row or within a tile and keeps ``partition``; it is called once a batch, with all rows of its tiles.
    """
    index = f"{checkpoint.rstrip('/')}-files"

    def write(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(partition).distinct().persist()
        try:
            if touched.isEmpty():
                return
            _note_files(batch, index, batch_id, partition)
            files = files_of(spark, index, touched, partition)
            whole = spark.read.schema(schema).parquet(*files).join(touched, partition, "left_semi")
            (
                transform(whole)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(partition)
                .parquet(sink)
            )
        finally:
            touched.unpersist()

    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .select("*", F.col("_metadata.file_path").alias("_file"))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
