"""Session helpers: where shared intermediate tables live and how a stage hands its result over."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "terrashift") -> SparkSession:
    """Session for tests and the bench; on a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for shared intermediate data.

    Where none is set, one JVM gets a fresh local folder; on a cluster that is an error, since executors could not see
    each other's files.
    """
    sc = spark.sparkContext
    path = spark.conf.get(_DIR_KEY, None) or sc.getConf().get(_DIR_KEY, None) or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError(f"set {_DIR_KEY} to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-terrashift-", dir="/tmp"))
        path = sc.getCheckpointDir()
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Hand a stage result over as a table in the shared folder.

    Later stages read files instead of recomputing, so a lost executor costs a re-read only, and the planner knows
    the table's true size when it decides between a broadcast and a shuffle. ``options`` go to the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str, least: int = 50_000) -> DataFrame:
    """``materialise`` for a table that much work is done on: read by a task for each core where its size gives fewer.

    A task gets ``least`` rows or more.
    """
    out = materialise(df, name)
    cores = df.sparkSession.sparkContext.defaultParallelism
    now = out.rdd.getNumPartitions()
    tasks = min(cores, -(-out.count() // least)) if now < cores else now
    return out if tasks <= now else materialise(out.repartition(tasks), name)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="terrashift-ship-"), "terrashift")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SHIPPED.add(sc.applicationId)
