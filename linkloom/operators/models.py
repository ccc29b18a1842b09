"""L2 logistic regression on standardised columns: folds, choice of strength, locking and scoring.

All fits of a search (every model and strength with every left-out fold) are
refined together: a Newton step of all of them is one pass over the rows, which
gives only sums of the size of the squared number of features.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import ranks
from linkloom.operators.explain import transformed
from linkloom.sources.files import ContractError

#: Strengths that are tried; the smaller one wins a tie.
GRID = (0.01, 0.1, 1.0, 10.0)
#: A 0/1 column with fewer ones than this in training is dropped.
LEAST_ONES = 2
#: Partial sums of tasks meet in this many parts first.
PARTS = 64


@dataclass(frozen=True)
class Model:
    """Everything that a score needs, as plain numbers."""

    name: str
    features: tuple[str, ...]
    logged: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    strength: float
    thresholds: tuple[tuple[str, float], ...] = ()

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()

    def score(self) -> Column:
        """The probability of label 1, as one column expression; nulls take the training median."""
        out = F.lit(self.intercept)
        for f, median, mean, deviation, weight in zip(self.features, self.medians, self.means, self.deviations, self.weights, strict=True):
            out = out + (transformed(F.coalesce(F.col(f).cast("double"), F.lit(median)), f, list(self.logged)) - mean) * (weight / deviation)
        return 1 / (1 + F.exp(-out))


def usable_features(train: DataFrame, features: list[str]) -> tuple[list[str], dict[str, str]]:
    """The features worth training on, and why others are not: one value only, or flags that hardly ever are 1."""
    found = train.agg(*(e for f in features for e in (F.min(f).alias(f"{f}__l"), F.max(f).alias(f"{f}__m"), F.sum(F.col(f).cast("double")).alias(f"{f}__s"), F.bool_and(F.col(f).isin(0, 1)).alias(f"{f}__b")))).first()
    dropped = {f: "zero variance" if found[f"{f}__l"] == found[f"{f}__m"] else "rare flag" for f in features if found[f"{f}__l"] == found[f"{f}__m"] or (found[f"{f}__b"] and found[f"{f}__s"] < LEAST_ONES)}
    return [f for f in features if f not in dropped], dropped


def prepared(train: DataFrame, features: list[str], logged: list[str], label: str, fold: str) -> tuple[DataFrame, list[float]]:
    """(x, y, fold): transformed values with nulls filled, and the medians that fill them."""
    long = train.select(*(F.col(f).cast("double").alias(f) for f in features)).unpivot([], features, "feature", "value")
    known = {r["feature"]: r["median"] for r in ranks.quantiles(long, ["feature"], "value", {"median": 0.5}).collect()}  # a row for each feature
    medians = [float(known.get(f, 0.0)) for f in features]
    x = F.array(*(transformed(F.coalesce(F.col(f).cast("double"), F.lit(m)), f, logged) for f, m in zip(features, medians, strict=True)))
    return train.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")), medians


def _summed(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """The sums of the arrays that tasks give for each number: within PARTS parts of the tasks, then over these."""
    parts = rows.mapInArrow(run, "job int, sums array<double>").withColumn("part", F.spark_partition_id() % PARTS)
    once = parts.groupBy("job", "part").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return {r["job"]: np.array(r["sums"]) for r in once.groupBy("job").agg(vector_to_array(Summarizer.sum(F.col("sums"))).alias("sums")).collect()}


def _blocks(batches):
    """(x, y, fold) of the rows of each batch."""
    for b in batches:
        if b.num_rows:
            y = b.column("y").to_numpy(zero_copy_only=False)
            yield b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y, b.column("fold").to_numpy(zero_copy_only=False)


def _sums(found: dict[int, np.ndarray]):
    if found:
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["job", "sums"])


def fold_moments(rows: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Of each fold: rows, sums and sums of squared differences from the overall mean of each feature (in this order, flat)."""
    mean = rows.agg(*(F.avg(F.col("x")[i]).alias(str(i)) for i in range(width))).first()
    centre = np.array([mean[i] or 0.0 for i in range(width)])

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for x, _, fold in _blocks(batches):
            for k in np.unique(fold).tolist():
                own = x[fold == k] - centre
                found[k] = found.get(k, 0) + np.r_[len(own), own.sum(0), (own**2).sum(0)]
        yield from _sums(found)

    out = _summed(rows, run)
    return {k: np.r_[v, centre] for k, v in out.items()}


def scaling(moments: dict[int, np.ndarray], left_out: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (1 for a constant) over all folds but one."""
    width = (len(next(iter(moments.values()))) - 1) // 3
    total = sum(v for k, v in moments.items() if k != left_out)
    n, first, second, centre = total[0], total[1 : width + 1], total[width + 1 : 2 * width + 1], next(iter(moments.values()))[2 * width + 1 :]
    spread = np.sqrt(np.maximum(0, second / n - (first / n) ** 2))
    return centre + first / n, np.where(spread < 1e-12, 1.0, spread)


@dataclass(frozen=True)
class Fit:
    """One fit of a search: the columns it takes, its strength and the fold that it leaves out."""

    columns: tuple[int, ...]
    strength: float
    left_out: int | None

    def scaling(self, moments: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        mean, deviation = scaling(moments, self.left_out)
        return mean[list(self.columns)], deviation[list(self.columns)]


def fitted(rows: DataFrame, fits: list[Fit], moments: dict[int, np.ndarray], steps: int = 40) -> list[np.ndarray]:
    """Weights and, last, the intercept of each fit: least sum of losses plus |weights|^2 / (2 strength), all by Newton steps together."""
    scales = [f.scaling(moments) for f in fits]
    weights = [np.zeros(len(f.columns) + 1) for f in fits]
    left = list(range(len(fits)))
    for _ in range(steps):
        now = {j: (weights[j], list(fits[j].columns), fits[j].left_out, *scales[j]) for j in left}

        def run(batches, now=now):
            found: dict[int, np.ndarray] = {}
            for x, y, fold in _blocks(batches):
                for j, (w, columns, out, mean, deviation) in now.items():
                    some = fold != (-1 if out is None else out)
                    z = np.c_[(x[some][:, columns] - mean) / deviation, np.ones(some.sum())]
                    p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
                    found[j] = found.get(j, 0) + np.r_[z.T @ (p - y[some]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()]
            yield from _sums(found)

        sums = _summed(rows, run)
        for j in list(left):
            width = len(fits[j].columns)
            ridge = np.r_[np.full(width, 1 / fits[j].strength), 0.0]
            gradient = sums[j][: width + 1] + ridge * weights[j]
            step = np.linalg.solve(sums[j][width + 1 :].reshape(width + 1, -1) + np.diag(ridge + 1e-12), gradient)
            weights[j] = weights[j] - step * min(1.0, 4.0 / max(1e-300, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                left.remove(j)
        if not left:
            break
    return weights


def fold_f1(rows: DataFrame, fits: list[Fit], weights: list[np.ndarray], moments: dict[int, np.ndarray]) -> list[float]:
    """F1 at 0.5 of each fit on the fold that it left out; 0 without positives."""
    scales = [f.scaling(moments) for f in fits]

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for x, y, fold in _blocks(batches):
            for j, (f, w, (mean, deviation)) in enumerate(zip(fits, weights, scales, strict=True)):
                own = fold == f.left_out
                said, right = ((x[own][:, list(f.columns)] - mean) / deviation) @ w[:-1] + w[-1] >= 0, y[own] == 1
                found[j] = found.get(j, 0) + np.array([(said & right).sum(), said.sum() + right.sum()], float)
        yield from _sums(found)

    sums = _summed(rows, run)
    return [float(2 * sums[j][0] / sums[j][1]) if sums[j][1] else 0.0 for j in range(len(fits))]


def train(rows: DataFrame, specs: dict[str, list[str]], logged: list[str], label: str, fold: str, grid: tuple[float, ...] = GRID) -> list[tuple[Model, dict[float, float], dict[str, str]]]:
    """Of each named list of features: the fitted model, the mean F1 of each strength over the folds, and the features that were dropped.

    The strength of best mean F1, rounded to 4 places, is taken (ties: the smaller).
    `rows` is read many times: hand over a stored table. Folds are numbered from 0.
    """
    every = list(dict.fromkeys(f for features in specs.values() for f in features))
    kept, dropped = usable_features(rows, every)
    if not kept:
        raise ContractError("no feature varies in training")
    ready, medians = prepared(rows, kept, logged, label, fold)
    moments = fold_moments(ready, len(kept))
    if len(moments) < 2:
        raise ContractError("training needs two folds or more")
    place = {f: i for i, f in enumerate(kept)}
    columns = {name: tuple(place[f] for f in features if f in place) for name, features in specs.items()}
    if not all(columns.values()):
        raise ContractError(f"no feature varies in training: {[n for n, c in columns.items() if not c]}")
    fits = [Fit(columns[name], c, out) for name in specs for c in grid for out in (*sorted(moments), None)]
    weights = dict(zip([(name, c, out) for name in specs for c in grid for out in (*sorted(moments), None)], fitted(ready, fits, moments), strict=True))
    trials = [k for k in weights if k[2] is not None]
    f1 = dict(zip(trials, fold_f1(ready, [Fit(columns[n], c, out) for n, c, out in trials], [weights[k] for k in trials], moments), strict=True))
    mean, deviation = scaling(moments, None)
    found = []
    for name, features in specs.items():
        means = {c: float(np.mean([f1[name, c, out] for out in moments])) for c in grid}
        strength = max(grid, key=lambda c: (round(means[c], 4), -c))
        w, own = weights[name, strength, None], list(columns[name])
        if not np.isfinite(w).all():
            raise ContractError(f"{name}: weights are not finite")
        names = tuple(kept[i] for i in own)
        model = Model(name, names, tuple(f for f in names if f in logged), tuple(medians[i] for i in own), tuple(mean[own].tolist()), tuple(deviation[own].tolist()), tuple(w[:-1].tolist()), float(w[-1]), strength)
        found.append((model, means, {f: dropped[f] for f in features if f in dropped}))
    return found


def lock(spark: SparkSession, model: Model, path: str) -> str:
    """Writes the model once, as text that any reader of Spark can open, and returns its SHA-256."""
    spark.createDataFrame([(model.text(),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return model.digest()


def load(spark: SparkSession, path: str, sha256: str) -> Model:
    """A locked model; one that differs from its digest is refused."""
    raw = spark.read.text(path).first()["value"]
    if hashlib.sha256(raw.encode()).hexdigest() != sha256:
        raise ContractError(f"{path} is not the model that was locked")
    return parsed(raw)


def parsed(text: str) -> Model:
    """The model of Model.text()."""
    got = json.loads(text)
    return Model(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in got.items()})
