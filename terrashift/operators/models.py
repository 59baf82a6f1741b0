"""Per-fold models on Spark ML: weighted trees and logistic regression, nested calibration, screening grids."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift import config as C
from terrashift.config import Experiment
from terrashift.functions import expressions as E
from terrashift.operators import evaluate as V
from terrashift.operators import summaries as S
from terrashift.operators.isotonic import apply_isotonic_blocks, fit_isotonic_blocks
from terrashift.operators.pool import fold_sample
from terrashift.operators.runs import METRICS, RunStore, ranked, run_all, side_by_side
from terrashift.session import materialise, spread


def with_features(df: DataFrame, experiment: Experiment) -> DataFrame:
    """Add the feature vector; array columns are turned into vectors first."""
    arrays = {c for c, t in df.dtypes if t.startswith("array") and c in experiment.features}
    out, cols = df, []
    for c in experiment.features:
        if c in arrays:
            out = out.withColumn(f"_v_{c}", array_to_vector(F.transform(c, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))))
            out = VectorSizeHint(inputCol=f"_v_{c}", size=C.N_BANDS, handleInvalid="optimistic").transform(out)
            cols.append(f"_v_{c}")
        else:
            cols.append(c)
    out = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(out)
    return out.drop(*[f"_v_{c}" for c in arrays])


def learner(experiment: Experiment, **overrides):
    """A fresh weighted classifier for an experiment."""
    params = {**experiment.params, **overrides}
    common = dict(featuresCol="features", labelCol="label_bin", weightCol="weight_norm")
    if experiment.learner == "boosted_trees":
        return GBTClassifier(**{**common, "maxIter": 20, "seed": 0, **params})
    if experiment.learner == "logistic":
        return LogisticRegression(**{**common, "maxIter": 50, **params})
    raise ValueError(f"unknown learner {experiment.learner}")


def normalise_distance(df: DataFrame, dist: str, log_mean, log_std) -> DataFrame:
    return df.withColumn("dist_z", (F.log1p(F.col(dist)) - F.lit(log_mean)) / F.lit(log_std))


def score(model: PipelineModel, df: DataFrame, experiment: Experiment, name: str = "y_score") -> DataFrame:
    """Positive-class probability of every row, on the executors."""
    out = model.transform(with_features(df, experiment))
    return out.withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def score_with(fn: Callable[[pd.DataFrame], pd.Series], df: DataFrame, keep: list[str], name: str = "y_score") -> DataFrame:
    """Score with any callable frame -> scores, one Arrow batch at a time."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + f", `{name}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(**{name: fn(pdf)})

    return df.mapInPandas(run, schema)


def fit(train: DataFrame, experiment: Experiment, **overrides) -> PipelineModel:
    return _fit_weighted(mean_weighted(train), experiment, **overrides)


def mean_weighted(train: DataFrame) -> DataFrame:
    """Weights divided by their mean, which is one number."""
    mean = train.agg(F.avg("sample_weight")).scalar()
    return train.withColumn("weight_norm", F.col("sample_weight") / mean)


def fit_isotonic(scored: DataFrame, mult: float) -> DataFrame:
    """Steps of the monotone calibration, with the positive boost taken out of the weights."""
    w = E.natural_weight(F.col("sample_weight"), F.col("label"), F.lit(float(mult)))
    return fit_isotonic_blocks(scored, "y_score", F.col("label_bin"), w)


def apply_isotonic(steps: DataFrame, df: DataFrame) -> DataFrame:
    return apply_isotonic_blocks(steps, df, "y_score", "p_isotonic")


def out_of_fold(
    samples: DataFrame, pool: DataFrame, experiment: Experiment, mult: float, dist: str, k: int, calibrate: bool = True,
    store: RunStore | None = None, at_once: int = 4, **overrides,
) -> DataFrame:
    """Out-of-fold predictions of every sample.

    For each fold: the normaliser comes from the other folds (one scan serves all), the model from the other folds'
    pool, the calibrator from an inner model that leaves out one more fold and is fitted on that fold. Folds are worked
    on side by side. With a ``store`` each fold's model is saved, and its metrics on its own fold are entered as a run.
    """
    norm = {r["held_out"]: (r["log_mean"], r["log_std"]) for r in S.leave_out_normaliser(S.fold_moments(samples, dist), k).collect()}

    def one(f: int) -> DataFrame:
        mean, std = norm[f]
        train = normalise_distance(pool.where(F.col("fold") != f), dist, mean, std)
        test = normalise_distance(samples.where(F.col("fold") == f), dist, mean, std)
        model = fit(train, experiment, **overrides)
        scored = score(model, test, experiment)
        if store is not None:
            _store_fold(store, experiment, f, model, scored, mult, {"log_mean": mean, "log_std": std} | overrides)
        if calibrate:
            c = (f + 1) % k
            inner = fit(train.where(F.col("fold") != c), experiment, **overrides)
            iso = fit_isotonic(score(inner, train.where(F.col("fold") == c), experiment), mult)
            scored = apply_isotonic(iso, scored)
        else:
            scored = scored.withColumn("p_isotonic", F.lit(None).cast("double"))
        return scored.select(
            F.col("fold").cast("tinyint").alias("fold"), (F.col("label") == 1).cast("tinyint").alias("label"),
            F.col(dist).cast("float").alias(dist), F.col("y_score").cast("float").alias("y_score"),
            E.unboost(F.col("y_score"), mult).cast("float").alias("p_calibrated"),
            F.col("p_isotonic").cast("float").alias("p_isotonic"),
        )

    out = None
    for part in side_by_side(one, list(range(k)), at_once):
        out = part if out is None else out.unionByName(part)
    return out


def _metrics(scored: DataFrame, mult: float) -> dict:
    """Rank and best-F1 metrics of scored rows with a column ``label``.

    Rows are scored once: the counts of each distinct score are written, and the metrics are taken from these.
    """
    one = scored.select(F.lit(0).alias("g"), "y_score", (F.col("label") == 1).cast("int").alias("y"))
    curve = V.curve_of_counts(materialise(V.score_counts(one, ["g"], "y_score", "y"), "counts"), ["g"])
    best = V.best_f1(curve, ["g"]).withColumn("best_threshold", E.unboost(F.col("best_threshold"), mult))
    m = V.rank_metrics(curve, ["g"]).join(best, "g").first()
    return {n: m[n] for n in METRICS}


def _trees(model: PipelineModel) -> int | None:
    return getattr(model.stages[0], "getNumTrees", None)


def _store_fold(store: RunStore, experiment: Experiment, fold: int, model: PipelineModel, scored: DataFrame, mult: float, params: dict) -> None:
    path = f"{store.path.rstrip('/')}-models/{experiment.name}/fold={fold}"
    model.write().overwrite().save(path)
    store.put(experiment.name, "fold_model", fold, params, {"state": "done", "trees": _trees(model), "model": path} | _metrics(scored, mult))


def best_fold_importances(store: RunStore, experiment: Experiment, samples: DataFrame, dist: str, top: int = 20) -> tuple[int, DataFrame]:
    """The fold with the best average precision and the largest feature importances of its stored model."""
    row = ranked(store, experiment.name, "fold_model").where("state = 'done'").first()
    if row is None:
        raise ValueError(f"no stored fold model of {experiment.name}")
    path = f"{store.path.rstrip('/')}-models/{experiment.name}/fold={row['run_id']}"
    params = json.loads(row["params"])
    # An empty frame is enough for the names of the assembled inputs.
    named = with_features(normalise_distance(samples.limit(0), dist, params["log_mean"], params["log_std"]), experiment)
    return row["run_id"], importances(PipelineModel.load(path), named, top)


def grid(experiment: Experiment) -> list[dict]:
    if not experiment.grid:
        raise ValueError(f"experiment {experiment.name} has no grid")
    return [dict(zip(experiment.grid, combo)) for combo in product(*experiment.grid.values())]


def screening_split(samples: DataFrame, pool: DataFrame, dist: str, k: int, val_rows: int = 1_000_000, screen: int = 0):
    """Training pool, natural validation sample, natural test fold and the normaliser of a screening run."""
    val = (screen + 1) % k
    row = (
        S.leave_out_normaliser(S.fold_moments(samples, dist), k, extra_offset=1)
        .where(F.col("held_out") == screen).first()
    )
    norm = (row["log_mean"], row["log_std"])
    train = normalise_distance(pool.where(~F.col("fold").isin(screen, val)), dist, *norm)
    check = normalise_distance(fold_sample(samples.where(F.col("fold") == val), val_rows, 99), dist, *norm)
    test = normalise_distance(samples.where(F.col("fold") == screen), dist, *norm)
    return train, check.withColumn("label_bin", (F.col("label") == 1).cast("int")), test, norm


def _with_validation(train: DataFrame, check: DataFrame, experiment: Experiment) -> DataFrame:
    """Training and validation rows with a flag and weights of mean one."""
    cols = ["label_bin", "sample_weight", *experiment.features]
    both = train.select(*cols, F.lit(False).alias("is_validation")).unionByName(
        check.withColumn("sample_weight", F.lit(1.0)).select(*cols, F.lit(True).alias("is_validation"))
    )
    return mean_weighted(both)


def _fit_weighted(data: DataFrame, experiment: Experiment, **params) -> PipelineModel:
    """Fit on rows that have ``weight_norm``, and ``is_validation`` where trees are to stop by it."""
    est = learner(experiment, **params)
    if "is_validation" in data.columns:
        est = est.setValidationIndicatorCol("is_validation")
    return Pipeline(stages=[est]).fit(with_features(data, experiment))


def fit_with_validation(train: DataFrame, check: DataFrame, experiment: Experiment, **params) -> PipelineModel:
    """Boosted trees that stop when the validation rows no longer improve."""
    return _fit_weighted(_with_validation(train, check, experiment), experiment, **params)


def grid_search(
    samples: DataFrame, pool: DataFrame, experiment: Experiment, mult: float, dist: str, k: int, store: RunStore,
    runs: dict[int, dict] | None = None, val_rows: int = 1_000_000, at_once: int = 4, force: bool = False, retry_failed: bool = False,
) -> DataFrame:
    """Screen every combination on fold 0; runs that the store has are taken over, a failing one is stored with its error.

    ``runs`` (numbers and parameters) stands for a part of the grid; by default it is the whole grid. The rows to learn
    from, weighted, and those to score are written once, with the columns that are needed, spread over the cores, and read
    by every run; ``at_once`` runs are fitted side by side.
    """
    runs = runs if runs is not None else dict(enumerate(grid(experiment)))
    if not force and set(runs) <= store.finished(experiment.name, "grid_run", retry_failed):
        return ranked(store, experiment.name)
    train, check, test, _ = screening_split(samples, pool, dist, k, val_rows)
    trees = experiment.learner == "boosted_trees"
    learn = _with_validation(train, check, experiment) if trees else mean_weighted(train)
    learn = learn.select(*experiment.features, "label_bin", "weight_norm", *(["is_validation"] if trees else []))
    learn = spread(learn, "screen_learn")
    test = spread(test.select(*experiment.features, "label"), "screen_test")

    def work(_: int, params: dict) -> dict:
        model = _fit_weighted(learn, experiment, **params)
        return {"trees": _trees(model)} | _metrics(score(model, test, experiment), mult)

    run_all(store, experiment.name, "grid_run", runs, work, force, retry_failed, at_once)
    return ranked(store, experiment.name)


def refit_report(samples: DataFrame, pool: DataFrame, experiment: Experiment, params: dict, dist: str, k: int, val_rows: int = 1_000_000) -> DataFrame:
    """Refit one combination and report it on its own training rows and on every natural fold at threshold 0.5."""
    train, check, _, norm = screening_split(samples, pool, dist, k, val_rows)
    if experiment.learner == "boosted_trees":
        model = fit_with_validation(train, check, experiment, **params)
    else:
        model = fit(train, experiment, **params)
    own = V.threshold_metrics(score(model, train, experiment).withColumn("fold", F.lit(-1)), ["fold"], "y_score", "label_bin")
    nat = score(model, normalise_distance(samples, dist, *norm), experiment).withColumn("label_bin", (F.col("label") == 1).cast("int"))
    folds = V.threshold_metrics(nat, ["fold"], "y_score", "label_bin")
    role = F.when(F.col("fold") == -1, "pool rows learned from").otherwise(V.fold_role(F.col("fold"), 0, 1 % k))
    return own.unionByName(folds).withColumn("role", role)


def importances(model: PipelineModel, features_df: DataFrame, top: int = 20) -> DataFrame:
    """Largest feature importances with the names of the assembled inputs."""
    spark = features_df.sparkSession
    attrs = features_df.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", f"f{a['idx']}") for group in attrs.values() for a in group}
    imp = model.stages[0].featureImportances.toArray()
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
