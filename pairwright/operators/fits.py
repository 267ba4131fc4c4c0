"""Logistic fits of many replicates at once.

A replicate is a weighting of the same rows: a bootstrap draw of components, the training side of a fold with
one penalty, or all rows. Each row carries the replicates it is in, with weights. A Newton step of all replicates is
one aggregation by replicate: gradients and Gram matrices come to the driver, a few numbers for each replicate, which
solves them together and sends the coefficients back in a broadcast. Replicates that have converged leave. No rows are
gathered, whatever their number.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed_hash import hash_index
from ..sources.shared import stored
from .ranks import position

#: Replicates and features of a fit at most: their coefficients and Gram matrices are held by the driver.
MAX_REPLICATES, MAX_FEATURES = 20_000, 30
DRAWS = "array<struct<r:int,w:double>>"


@dataclass
class Fits:
    """Row r: mean and sd of each feature, coefficients (intercept first) of standardised features, total weight, rows of both labels, whether it converged."""

    features: list[str]
    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray
    total: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    converged: np.ndarray

    def table(self, spark: SparkSession, which: np.ndarray | None = None) -> DataFrame:
        """r, b (coefficients of the features as they are, intercept first) of replicates."""
        which = np.arange(len(self.beta)) if which is None else which
        slope = self.beta[:, 1:] / self.sd
        b = np.column_stack([self.beta[:, 0] - (slope * self.mean).sum(1), slope])
        return spark.createDataFrame([(int(r), b[r].tolist()) for r in which], "r int, b array<double>")

    def summary(self, spark: SparkSession) -> DataFrame:
        """r, intercept, slopes, total, zeros, ones, converged."""
        slope = self.beta[:, 1:] / self.sd
        rows = [(r, float(self.beta[r, 0] - (slope[r] * self.mean[r]).sum()), slope[r].tolist(), float(self.total[r]), int(self.zeros[r]), int(self.ones[r]), bool(self.converged[r])) for r in range(len(self.beta))]
        return spark.createDataFrame(rows, "r int, intercept double, slopes array<double>, total double, zeros bigint, ones bigint, converged boolean")


def _eta(features: list[str], b: str = "b") -> Column:
    eta = F.col(b)[0]
    for j, f in enumerate(features):
        eta = eta + F.col(b)[j + 1] * F.col(f)
    return F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))


def _sigmoid(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def newton(rows: DataFrame, features: list[str], label: str, draws: str, penalty: list[float], standardise: bool = False, firth: bool = False, steps: int = 50, tolerance: float = 1e-10) -> Fits:
    """Fits of len(penalty) replicates: mean loss + penalty / 2 * |slopes|^2; draws is an array of (r, w), each r once.

    standardise: by mean and deviation of a replicate's rows, so penalties are alike. firth: bias-reduced, unpenalised, rows of
    weight 1; then the intercept alone is fitted again, so that mean prediction and rate agree. A replicate with rows of one
    label only isn't fitted and hasn't converged."""
    reps, d = len(penalty), len(features)
    if reps > MAX_REPLICATES or d > MAX_FEATURES:
        raise ValueError("too many replicates or features")
    spark = rows.sparkSession
    names = [f"f{j}" for j in range(d)]
    x = stored(rows.select(*(F.col(f).cast("double").alias(n) for f, n in zip(features, names)), F.col(label).cast("double").alias("y"), F.col(draws).cast(DRAWS).alias("draws")))
    long = x.select(*names, "y", F.inline("draws")).where("w > 0")
    facts = [F.sum("w").alias("total"), F.count(F.when(F.col("y") == 0, 1)).alias("zeros"), F.count(F.when(F.col("y") == 1, 1)).alias("ones")]
    for n in names:
        facts += [F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}")]
    fits = Fits(features, np.zeros((reps, d)), np.ones((reps, d)), np.zeros((reps, d + 1)), np.zeros(reps), np.zeros(reps, int), np.zeros(reps, int), np.zeros(reps, bool))
    for row in long.groupBy("r").agg(*facts).collect():  # one row for each replicate
        fits.total[row.r], fits.zeros[row.r], fits.ones[row.r] = row.total, row.zeros, row.ones
        if standardise:
            fits.mean[row.r] = [row[f"m_{n}"] for n in names]
            sd = np.array([row[f"s_{n}"] for n in names])
            fits.sd[row.r] = np.where(sd > 1e-12, sd, 1.0)

    pairs = list(combinations_with_replacement(range(d + 1), 2))
    pen = np.asarray(penalty, float)[:, None] * np.array([0.0] + [1.0] * d)
    info: np.ndarray | None = None

    def pass_(active: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Gram matrix of the active replicates, in terms of standardised features."""
        known = [(int(r), fits.beta[r].tolist(), fits.mean[r].tolist(), fits.sd[r].tolist(), info[r].ravel().tolist() if firth and info is not None and not plain else []) for r in active]
        at = spark.createDataFrame(known, "r int, b array<double>, mean array<double>, sd array<double>, info array<double>")
        z = long.join(F.broadcast(at), "r").select("r", "y", "w", "b", "info", *(((F.col(n) - F.col("mean")[j]) / F.col("sd")[j]).alias(n) for j, n in enumerate(names)))
        z = z.withColumn("p", _sigmoid(_eta(names)))
        one = [F.lit(1.0), *map(F.col, names)]
        v = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-9))
        pull = F.col("p") - F.col("y")
        if firth and info is not None and not plain:
            lever = sum((F.col("info")[j * (d + 1) + k] * one[j] * one[k] for j in range(d + 1) for k in range(d + 1)), F.lit(0.0)) * v
            pull = pull - lever * (0.5 - F.col("p"))
        z = z.withColumn("pull", F.col("w") * pull).withColumn("v", F.col("w") * v)
        sums = [F.sum(F.col("pull") * one[j]).alias(f"g{j}") for j in range(d + 1)] + [F.sum(F.col("v") * one[j] * one[k]).alias(f"h{j}_{k}") for j, k in pairs]
        g, h = np.zeros((reps, d + 1)), np.zeros((reps, d + 1, d + 1))
        for row in z.groupBy("r").agg(*sums).collect():  # one row for each replicate
            g[row.r] = [row[f"g{j}"] for j in range(d + 1)]
            for j, k in pairs:
                h[row.r, j, k] = h[row.r, k, j] = row[f"h{j}_{k}"]
        return g, h

    able = (fits.zeros > 0) & (fits.ones > 0)
    active = np.flatnonzero(able)
    if firth and len(active):
        info = np.zeros((reps, d + 1, d + 1))
        info[active] = np.linalg.inv(pass_(active, plain=True)[1][active] + 1e-9 * np.eye(d + 1))
    for _ in range(steps if len(active) else 0):
        g, h = pass_(active)
        if firth:
            info[active] = np.linalg.inv(h[active] + 1e-9 * np.eye(d + 1))
            step = np.clip(np.einsum("rij,rj->ri", info[active], g[active]), -5, 5)
        else:
            w = fits.total[active][:, None]
            slope = g[active] / w + pen[active] * fits.beta[active]
            step = np.linalg.solve(h[active] / w[:, :, None] + np.einsum("ri,ij->rij", pen[active], np.eye(d + 1)) + 1e-12 * np.eye(d + 1), slope[:, :, None])[:, :, 0]
        fits.beta[active] -= step
        done = np.abs(step).max(1) < tolerance
        fits.converged[active[done]] = True
        active = active[~done]
        if not len(active):
            break
    active = np.flatnonzero(able) if firth else np.zeros(0, int)
    for _ in range(steps if len(active) else 0):
        g, h = pass_(active, plain=True)
        step = np.clip(g[active, 0] / h[active, 0, 0], -5, 5)
        fits.beta[active, 0] -= step
        active = active[np.abs(step) >= tolerance]
        if not len(active):
            break
    return fits


def predicted(rows: DataFrame, features: list[str], fits: Fits, r: str, out: str) -> DataFrame:
    """rows with the prediction of the replicate named in column r; null if it couldn't be fitted."""
    able = np.flatnonzero((fits.zeros > 0) & (fits.ones > 0))
    b = fits.table(rows.sparkSession, able).withColumnsRenamed({"r": "_r", "b": "_b"})
    return rows.join(F.broadcast(b), F.col(r) == F.col("_r"), "left").withColumn(out, _sigmoid(_eta(features, "_b"))).drop("_r", "_b")


def component_draws(df: DataFrame, component: str, reps: int, seed: str) -> DataFrame:
    """component, draws: how often each replicate, which draws as many components as there are with replacement, takes it."""
    units = position(df.select(component).distinct(), "_place", [F.col(component)], total="_n").withColumn("_place", F.col("_place") - 1)
    picks = units.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).select("r", hash_index(seed, F.col("_n"), F.col("r"), F.col("_place")).alias("_place"))
    times = picks.groupBy("_place", "r").agg(F.count(F.lit(1)).cast("double").alias("w"))
    taken = times.groupBy("_place").agg(F.collect_list(F.struct("r", "w")).alias("draws"))  # `reps` entries at most
    return units.select(component, "_place").join(taken, "_place", "left").select(component, F.coalesce("draws", F.array().cast(DRAWS)).alias("draws"))


def fold_draws(fold: Column, weight: Column, folds: list[int], models: int) -> Column:
    """Replicate number i * models + m is fold i of model m: the row is in all but those of its own fold."""
    each = [F.struct(F.lit(i * models + m).cast("int").alias("r"), F.when(fold == f, 0.0).otherwise(weight.cast("double")).alias("w")) for i, f in enumerate(folds) for m in range(models)]
    return F.filter(F.array(*each), lambda x: x["w"] > 0)
