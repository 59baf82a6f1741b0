"""A store of model runs: one partition per experiment, kind and run, so that searches can stop, fail and go on.

A run is a row with its parameters, state, metrics or error text. It is written by its own commit the moment it ends;
a search that starts again takes over what is stored, tries failed runs again if so asked, and leaves the rest alone. Fits
are Spark jobs, so several of them share the cluster when they are submitted side by side.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.sources.tables import exists

METRICS = ("avg_precision", "pr_auc", "roc_auc", "precision", "recall", "f1", "accuracy", "best_threshold")
_SCHEMA = "params string, state string, trees int, error string, model string, " + ", ".join(f"{m} double" for m in METRICS)
_FULL = _SCHEMA + ", experiment string, kind string, run_id int"


@dataclass(frozen=True)
class RunStore:
    """Runs below ``path``. ``kind`` tells runs of a grid (``grid_run``) from models of a fold (``fold_model``)."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], _FULL)
        return self.spark.read.schema(_FULL).parquet(self.path)

    def finished(self, experiment: str, kind: str, retry_failed: bool = False) -> set[int]:
        """Numbers of the stored runs: as many as an experiment has combinations or folds."""
        mine = self.read().where((F.col("experiment") == experiment) & (F.col("kind") == kind))
        if retry_failed:
            mine = mine.where("state = 'done'")
        return {r[0] for r in mine.select("run_id").distinct().collect()}

    def put(self, experiment: str, kind: str, run_id: int, params: dict, result: dict) -> None:
        """Store a run in place of what was stored for it. Runs write to folders of their own, so they may end together."""
        row = (json.dumps(params, sort_keys=True), result["state"], result.get("trees"), result.get("error"), result.get("model"), *[
            None if result.get(m) is None else float(result[m]) for m in METRICS
        ])
        folder = f"{self.path}/experiment={experiment}/kind={kind}/run_id={run_id}"
        self.spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)


def run_all(
    store: RunStore, experiment: str, kind: str, runs: dict[int, dict], work: Callable[[int, dict], dict],
    force: bool = False, retry_failed: bool = False, at_once: int = 4,
) -> list[int]:
    """Do the runs that the store does not have, ``at_once`` of them side by side, and store each as it ends.

    ``work`` gets a run's number and parameters and gives its metrics. An error is stored with the run and does not end
    the others. Returns the numbers of the runs done now.
    """
    have = set() if force else store.finished(experiment, kind, retry_failed)
    todo = [(i, p) for i, p in runs.items() if i not in have]

    def one(job: tuple[int, dict]) -> None:
        run_id, params = job
        try:
            result = {"state": "done"} | work(run_id, params)
        except Exception as e:  # noqa: BLE001 - a failed combination must not end the search
            result = {"state": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
        store.put(experiment, kind, run_id, params, result)

    side_by_side(one, todo, at_once)
    return [i for i, _ in todo]


def side_by_side(fn: Callable, jobs: list, at_once: int = 4) -> list:
    """Results of ``fn`` for every job, in order. Each call has a thread that carries the session's properties along."""

    def call(job):
        out: list = []

        def run() -> None:
            try:
                out.append((fn(job), None))
            except Exception as e:  # noqa: BLE001 - handed to the caller below
                out.append((None, e))

        t = InheritableThread(target=run)
        t.start()
        t.join()
        value, error = out[0]
        if error is not None:
            raise error
        return value

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(call, jobs))


def ranked(store: RunStore, experiment: str, kind: str = "grid_run") -> DataFrame:
    """Stored runs, the best average precision first; failed ones last."""
    mine = store.read().where((F.col("experiment") == experiment) & (F.col("kind") == kind))
    return mine.select("run_id", "params", "state", "trees", "error", *METRICS).orderBy(F.desc_nulls_last("avg_precision"), "run_id")


def status(store: RunStore, expected: DataFrame) -> DataFrame:
    """Per experiment and kind: finished, failed and expected runs. ``expected`` has experiment, kind, run_id."""
    have = store.read().select("experiment", "kind", "run_id", "state").distinct()
    return (
        expected.join(have, ["experiment", "kind", "run_id"], "left").groupBy("experiment", "kind")
        .agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count(F.lit(1)).alias("expected"))
    )


def expected_runs(spark: SparkSession, sizes: dict[tuple[str, str], int]) -> DataFrame:
    """(experiment, kind, run_id) of ``sizes[experiment, kind]`` runs each."""
    rows = [(e, k, i) for (e, k), n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "experiment string, kind string, run_id int")
