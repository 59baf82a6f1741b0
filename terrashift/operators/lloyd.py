"""Batched k-means: all numbers of clusters, subsamples and starts advance together, one Spark job an iteration.

Rows are spread over all cores once and stay there. A task multiplies its rows with the centres of all models that still
move and returns, per model and cluster, the number and the sum of its rows; Spark adds these up in one shuffle. The centres are a small table whose
size follows from the parameters (models x clusters x knots), not from the rows; the driver moves it on. Starts are drawn by
squared distance (k-means++): a draw in proportion to weights is the row with the largest log weight plus a Gumbel deviate,
and deviates hang on hashes of row, model and step, so a start is one maximum over all rows and the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.session import materialise

#: Elements of a matrix of distances that a task holds at once.
_CELLS = 1 << 22
#: The same in a step, where the matrix is walked through several times: 2 MB stay in a core's cache.
_BLOCK = 1 << 18
#: Rows that are worth a task.
_LEAST_ROWS = 128
_U = np.uint64


@dataclass(frozen=True)
class Plan:
    """Models to fit: every k of ``ks`` for every subsample and start. Subsample 0 is meant to be all rows."""

    ks: tuple[int, ...]
    subsamples: int = 1
    starts: int = 20
    seed: int = 0
    iterations: int = 100
    tol: float = 1e-6


@dataclass
class Fitted:
    """Centres of every model: ``centers[k]`` has shape (subsamples, starts, k, knots), ``cost[k]`` (subsamples, starts)."""

    centers: dict[int, np.ndarray]
    cost: dict[int, np.ndarray] = field(default_factory=dict)

    def best(self, k: int, subsample: int = 0) -> np.ndarray:
        """Centres of the start with the smallest cost; of equal ones the first."""
        return self.centers[k][subsample, int(np.argmin(self.cost[k][subsample]))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centres."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.maximum(d, 0, out=d)


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, list, np.ndarray]:
    return np.stack(frame["x"].to_numpy()).astype(float), frame["runs"].tolist(), frame["h"].to_numpy().astype(np.int64).view(_U)


def _members(runs: list, subsamples: int) -> np.ndarray:
    """True where a row is in a subsample."""
    out = np.zeros((len(runs), subsamples), bool)
    for i, r in enumerate(runs):
        out[i, np.asarray(r, int)] = True
    return out


def _slices(frames: Iterator[pd.DataFrame], width: int, cells: int = _CELLS) -> Iterator[pd.DataFrame]:
    step = max(1, cells // max(1, width))
    for frame in frames:
        for at in range(0, len(frame), step):
            yield frame.iloc[at : at + step]


def _seeded(rows: DataFrame, plan: Plan, chosen: np.ndarray) -> np.ndarray:
    """The next centre of every (subsample, start); ``chosen`` has shape (sequences, steps so far, knots)."""
    n_seq, step, d = plan.subsamples * plan.starts, chosen.shape[1], chosen.shape[2]
    salt = _mix(np.arange(n_seq, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(plan.seed * 131 + step + 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, at = np.full(n_seq, -np.inf), np.full((n_seq, d), np.nan)
        for frame in _slices(frames, n_seq * max(1, step)):
            x, runs, h = _matrix(frame)
            inside = np.repeat(_members(runs, plan.subsamples), plan.starts, axis=1)
            u = (_mix(h[:, None] ^ salt[None, :]) >> _U(11)).astype(float)
            key = -np.log(-np.log((u + 0.5) / float(1 << 53)))
            if step:
                near = _distances(x, chosen.reshape(-1, d)).reshape(len(x), n_seq, step).min(2)
                # Where all rows coincide with a centre any of them will do.
                key = key + np.where(near > 0, np.log(np.maximum(near, 1e-300)), -1e6)
            key[~inside] = -np.inf
            i = key.argmax(0)
            top = key[i, np.arange(n_seq)]
            better = top > best
            best[better], at[better] = top[better], x[i[better]]
        held = np.flatnonzero(np.isfinite(best))
        if len(held):  # Arrow can't type an empty column of arrays
            yield pd.DataFrame({"s": held, "key": best[held], "x": list(at[held])})

    found = rows.mapInPandas(run, "s int, key double, x array<double>").groupBy("s").agg(F.max(F.struct("key", "x")).alias("m"))
    out = np.zeros((n_seq, d))
    for r in found.select("s", "m.x").collect():
        out[r["s"]] = r["x"]
    return out


def _sums(wide: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per model and cluster what the rows of ``wide`` (1, square, values) that are nearest to it add up to."""
    m, k, d = centers.shape
    c = centers.transpose(1, 0, 2).reshape(k * m, d)
    # The square of the row is the same for all centres and is left out; ones and squares sit in ``wide`` already.
    far = (np.column_stack([(c * c).sum(1), np.zeros(k * m), -2 * c]) @ wide.T).reshape(k, m, len(wide))
    hot = far == far.min(0)
    sums = (hot.reshape(k * m, -1).astype(float) @ wide).reshape(k, m, -1)
    if (sums[:, :, 0].sum(0) != len(wide)).any():  # equally near centres: the first one takes the row
        hot = far.argmin(0) == np.arange(k)[:, None, None]
        sums = (hot.reshape(k * m, -1).astype(float) @ wide).reshape(k, m, -1)
    return sums.transpose(1, 0, 2)


def _step(rows: DataFrame, moving: dict[int, tuple[np.ndarray, np.ndarray]], subsamples: int, d: int) -> pd.DataFrame:
    """Per model and cluster: rows, sum of squares, sum. ``moving[k]``: centres (models, k, knots), subsample of each."""
    models = [(k, r, np.flatnonzero(of == r)) for r in range(subsamples) for k, (_, of) in moving.items()]
    models = [m for m in models if len(m[2])]
    width = max(k * len(which) for k, _, which in models)
    names = ["n", "ss", *[f"s{i}" for i in range(d)]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((len(of), k, d + 2)) for k, (_, of) in moving.items()}
        for frame in _slices(frames, width, _BLOCK):
            x, runs, _ = _matrix(frame)
            inside = _members(runs, subsamples)
            wide = np.column_stack([np.ones(len(x)), (x * x).sum(1), x])
            own = [wide[inside[:, r]] for r in range(subsamples)]
            for k, r, which in models:
                if len(own[r]):
                    total[k][which] += _sums(own[r], moving[k][0][which])
        for k, t in total.items():
            t = t.reshape(-1, d + 2)
            at = np.flatnonzero(t[:, 0] > 0)
            if len(at):
                out = pd.DataFrame(t[at], columns=names)
                out.insert(0, "k", k)
                out.insert(1, "at", at)
                yield out

    schema = "k int, at int, " + ", ".join(f"{c} double" for c in names)
    return rows.mapInPandas(run, schema).groupBy("k", "at").agg(*[F.sum(c).alias(c) for c in names]).toPandas()


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a fit as a table with a file, hence a task, for each core, or fewer where they are few.

    The table is small for its work: by size alone a few tasks would do all of it. What a task returns follows from the
    number of models, so there are no more tasks than cores.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, -(-rows.count() // _LEAST_ROWS)))
    return materialise(rows.repartition(tasks, "h"), "spread")


def fit(rows: DataFrame, plan: Plan, start: dict[int, np.ndarray] | None = None) -> Fitted:
    """Fit all models of ``plan`` to ``rows`` (x array<double>, runs array<int>, h bigint: a hash of the row's key).

    Every model ends when no centre moves further than ``tol`` or after ``iterations``. An empty cluster keeps its centre.
    ``start`` gives the centres to begin with, in the shape of ``Fitted.centers``; without it they are drawn.
    """
    d = len(rows.select("x").first()[0])
    if start is None:
        chosen = np.zeros((plan.subsamples * plan.starts, 0, d))
        for _ in range(max(plan.ks)):
            chosen = np.concatenate([chosen, _seeded(rows, plan, chosen)[:, None, :]], axis=1)
        start = {k: chosen[:, :k].reshape(plan.subsamples, plan.starts, k, d).copy() for k in plan.ks}
    flat = {k: c.reshape(-1, k, d).copy() for k, c in start.items()}
    of = np.repeat(np.arange(plan.subsamples), plan.starts)
    active = {k: np.arange(len(of)) for k in plan.ks}
    for _ in range(plan.iterations):
        moving = {k: (flat[k][a], of[a]) for k, a in active.items() if len(a)}
        if not moving:
            break
        got = _step(rows, moving, plan.subsamples, d)
        for k, (old, _) in moving.items():
            new = old.reshape(-1, d).copy()
            mine = got[got["k"] == k]
            new[mine["at"].to_numpy()] = mine[[f"s{i}" for i in range(d)]].to_numpy() / mine["n"].to_numpy()[:, None]
            new = new.reshape(old.shape)
            flat[k][active[k]] = new
            moved = ((new - old) ** 2).sum(2).max(1) > plan.tol**2
            active[k] = active[k][moved]
    fitted = Fitted({k: c.reshape(plan.subsamples, plan.starts, k, d) for k, c in flat.items()})
    last = _step(rows, {k: (c, of) for k, c in flat.items()}, plan.subsamples, d)
    for k in plan.ks:
        mine = last[last["k"] == k]
        at, n = mine["at"].to_numpy(), mine["n"].to_numpy()
        c, s = flat[k].reshape(-1, d)[at], mine[[f"s{i}" for i in range(d)]].to_numpy()
        cost = np.bincount(at // k, mine["ss"].to_numpy() - 2 * (c * s).sum(1) + n * (c * c).sum(1), len(of))
        fitted.cost[k] = cost.reshape(plan.subsamples, plan.starts)
    return fitted


def _labelled(frames: Iterator[pd.DataFrame], centers: dict[tuple[int, int], np.ndarray]) -> Iterator[tuple[pd.DataFrame, np.ndarray, dict]]:
    width = sum(len(c) for c in centers.values())
    for frame in _slices(frames, width):
        x = np.stack(frame["x"].to_numpy()).astype(float)
        yield frame, x, {key: _distances(x, c).argmin(1) for key, c in centers.items()}


def contingency(rows: DataFrame, fitted: Fitted, plan: Plan) -> DataFrame:
    """(k, run, a, b, n): rows of each subsample by their cluster in the fit to all rows and in the subsample's own fit."""
    centers = {(k, r): fitted.best(k, r) for k in plan.ks for r in range(plan.subsamples)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {key: np.zeros(key[0] ** 2, np.int64) for key in centers if key[1]}
        for frame, _, labels in _labelled(frames, centers):
            inside = _members(frame["runs"].tolist(), plan.subsamples)
            for (k, r), t in total.items():
                m = inside[:, r]
                t += np.bincount(labels[k, 0][m] * k + labels[k, r][m], minlength=k * k)
        for (k, r), t in total.items():
            at = np.flatnonzero(t)
            yield pd.DataFrame({"k": k, "run": r, "a": at // k, "b": at % k, "n": t[at]})

    parts = rows.mapInPandas(run, "k int, run int, a int, b int, n bigint")
    return parts.groupBy("k", "run", "a", "b").agg(F.sum("n").alias("n"))


def quality(rows: DataFrame, fitted: Fitted, plan: Plan) -> pd.DataFrame:
    """Per k, for the best fit to all rows: inertia, Calinski-Harabasz, and the silhouette with squared distances.

    The mean squared distance from a row to a cluster follows from the cluster's size, sum and sum of squares, so one more
    pass over the rows gives all silhouettes. One row per k reaches the driver, and as much as the centres before that.
    """
    d = len(rows.select("x").first()[0])
    stats = _step(rows, {k: (fitted.best(k)[None], np.zeros(1, int)) for k in plan.ks}, plan.subsamples, d)
    knots = [f"s{i}" for i in range(d)]
    table = {k: (g["at"].to_numpy(), g["n"].to_numpy(), g["ss"].to_numpy(), g[knots].to_numpy()) for k, g in stats.groupby("k")}
    centers = {(k, 0): fitted.best(k) for k in plan.ks}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: 0.0 for k in table}
        for _, x, labels in _labelled(frames, centers):
            sq = (x * x).sum(1)
            for k, (at, n, ss, s) in table.items():
                away = np.maximum(sq[:, None] * n + ss - 2 * x @ s.T, 0)
                mine = labels[k, 0][:, None] == at
                size = (mine * n).sum(1)
                a = np.where(size > 1, (mine * away).sum(1) / np.maximum(size - 1, 1), np.nan)
                b = np.where(mine, np.inf, away / n).min(1)
                value = (b - a) / np.maximum(a, b)
                total[k] += float(np.where(np.isfinite(value), value, 0).sum())
        yield pd.DataFrame({"k": list(total), "s": list(total.values())})

    summed = rows.mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().set_index("k")["s"]
    out = []
    for k, (_, n, ss, s) in table.items():
        within, count = float((ss - (s * s).sum(1) / n).sum()), n.sum()
        grand = s.sum(0) / count
        between = float((n * ((s / n[:, None] - grand) ** 2).sum(1)).sum())
        used = len(n)
        ch = between * (count - used) / (within * (used - 1)) if used > 1 and within > 0 else 0.0
        out.append((int(k), within, float(summed[k]) / count, ch))
    return pd.DataFrame(out, columns=["k", "inertia", "silhouette", "calinski_harabasz"]).sort_values("k")
