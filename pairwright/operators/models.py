"""Small models: preprocessing in expressions, fits by Newton steps on aggregated data or by folds in grouped pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- preprocessing


def fit_preprocessor(train: DataFrame, numeric: list[str], categories: list[str]) -> dict:
    """Medians, population means and deviations after imputing, and levels; one small row to the driver, levels bounded by the caller's columns."""
    med = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in numeric]).first().asDict()
    med = {k: 0.0 if v is None else float(v) for k, v in med.items()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in numeric]
    row = train.agg(*[F.avg(x).alias(f"m_{c}") for c, x in zip(numeric, filled)], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in zip(numeric, filled)]).first()
    scale = {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] and row[f"s_{c}"] >= 1e-12 else 1.0) for c in numeric}
    levels = {}
    for c in categories:
        levels[c] = sorted(r[0] for r in train.select(F.coalesce(c, F.lit("__MISSING__")).alias(c)).distinct().limit(1001).collect())
        if len(levels[c]) > 1000:
            raise ValueError(f"{c} has more than 1000 levels")
    return {"median": med, "scale": scale, "levels": levels}


def apply_preprocessor(df: DataFrame, params: dict, keep: list[str]) -> DataFrame:
    """z-scores, missing flags, one-hot columns without the first level and with __UNKNOWN__."""
    out = []
    for c, m in params["median"].items():
        mean, sd = params["scale"][c]
        out += [((F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / sd).alias(f"z_{c}"), F.col(c).isNull().cast("int").alias(f"missing_{c}")]
    for c, levels in params["levels"].items():
        v = F.coalesce(c, F.lit("__MISSING__"))
        out += [(v == x).cast("int").alias(f"{c}_{x}") for x in levels[1:]]
        out.append((~v.isin(*levels)).cast("int").alias(f"{c}___UNKNOWN__"))
    return df.select(*keep, *out)


def spline_basis(x, lo: float, mid: float, hi: float):
    """Quadratic B-spline of one knot: four columns."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    k = (mid - lo) / (hi - lo)
    left = u < k
    b0 = F.when(left, F.pow((k - u) / k, F.lit(2))).otherwise(0.0)
    b1 = F.when(left, (u / k) * ((k - u) / k) + (1 - u) * u / k).otherwise(F.pow(1 - u, F.lit(2)) / (1 - k))
    b3 = F.when(left, 0.0).otherwise(F.pow((u - k) / (1 - k), F.lit(2)))
    return [b0, b1, 1 - b0 - b1 - b3, b3]


# ---------------------------------------------------------------- fits


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, lam: float, steps: int = 50) -> np.ndarray:
    """Weighted L2 logistic regression, intercept first and unpenalised: mean loss + lam / 2 * |beta|^2."""
    a = np.column_stack([np.ones(len(x)), x])
    w = w / w.sum()
    pen = np.diag([0.0] + [lam] * x.shape[1])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        g = a.T @ (w * (p - y)) + pen @ b
        h = (a * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + pen + 1e-12 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def descent_logistic(x: np.ndarray, y: np.ndarray, balanced: bool = False, epochs: int = 600, rate: float = 0.08, l2: float = 0.05) -> np.ndarray:
    """Batch gradient descent with fixed epochs; balanced: classes weigh alike."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    w = np.ones(len(y))
    if balanced and 0 < y.sum() < len(y):
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        g = a.T @ (w * (p - y)) / len(y)
        g[1:] += l2 * b[1:]
        b -= rate * g
    return b


def firth_logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Firth's bias-reduced fit, then the intercept alone refitted so that mean prediction and rate agree."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        info = np.linalg.inv((a * w[:, None]).T @ a + 1e-9 * np.eye(len(b)))
        lev = w * np.einsum("ij,jk,ik->i", a, info, a)
        step = info @ (a.T @ (y - p + lev * (0.5 - p)))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        rate = (1 / (1 + np.exp(-np.clip(a[:, 1:] @ b[1:] + mid, -35, 35)))).mean()
        lo, hi = (mid, hi) if rate < y.mean() else (lo, mid)
    b[0] = (lo + hi) / 2
    return b


def predict(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -35, 35)))


def calibration_line(df: DataFrame, p: str, label: str, weight: str, steps: int = 25) -> DataFrame:
    """Intercept and slope of the label's logit on the score's: each Newton step is one aggregation of the table, nothing is gathered."""
    spark = df.sparkSession
    eps = 1e-12
    z = F.log(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p))) / (1 - F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))))
    x = df.select(z.alias("z"), F.col(label).alias("y"), F.col(weight).cast("double").alias("w")).groupBy("z", "y").agg(F.sum("w").alias("w"))
    a, b = 0.0, 1.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
        e, v = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
        g0, g1, h00, h01, h11 = x.agg(F.sum(e), F.sum(e * F.col("z")), F.sum(v), F.sum(v * F.col("z")), F.sum(v * F.col("z") * F.col("z"))).first()
        det = h00 * h11 - h01 * h01
        if not det:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


def cross_validated(df: DataFrame, key: str, features: list[str], label: str, weight: str, fold: str, models: dict[str, tuple[str, float]]) -> DataFrame:
    """Out-of-fold predictions of each model (kind, lambda): key, model, fold, y, w, p.

    Kind newton is fitted by aggregation, all folds and models at once. Descent with fixed epochs (kinds descent, balanced) and
    bias-reduced fits (firth) go by fold and model in one task each, with the training rows as one group."""
    from . import fits as R

    folds = sorted(int(r[0]) for r in df.select(fold).distinct().limit(101).collect())
    if len(folds) > 100:
        raise ValueError("more than 100 folds")
    parts = []
    own = {m: lam for m, (k, lam) in models.items() if k == "newton"}
    if own:
        rows = df.withColumn("_draws", R.fold_draws(F.col(fold), F.col(weight), folds, len(own)))
        got = R.newton(rows, features, label, "_draws", list(own.values()) * len(folds), standardise=True)
        place = sum((F.when(F.col(fold) == f, i).otherwise(0) for i, f in enumerate(folds)), F.lit(0))
        name = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(i).alias("i")) for i, m in enumerate(own))))
        long = df.select(key, *features, label, weight, fold, name.alias("_m")).withColumn("_at", place * len(own) + F.col("_m.i"))
        out = R.predicted(long, features, got, "_at", "p")
        parts.append(out.select(key, F.col("_m.model").alias("model"), F.col(fold).cast("bigint").alias("fold"), F.col(label).cast("bigint").alias("y"), F.col(weight).cast("double").alias("w"), "p"))
    own = {m: x for m, x in models.items() if x[0] != "newton"}
    if own:
        parts.append(_descended(df, key, features, label, weight, fold, folds, own))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _descended(df: DataFrame, key: str, features: list[str], label: str, weight: str, fold: str, folds: list[int], models: dict[str, tuple[str, float]]) -> DataFrame:
    from itertools import product

    grid = df.sparkSession.createDataFrame([(f, m, k) for f, (m, (k, _)) in product(folds, models.items())], "held bigint, model string, kind string")
    x = df.select(key, *features, label, weight, fold).crossJoin(F.broadcast(grid))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        test = pdf[fold] == pdf["held"]
        tr, te = pdf[~test], pdf[test]
        mean, sd = tr[features].mean(), tr[features].std(ddof=0).where(lambda s: s > 1e-12, 1.0)
        a, b = ((tr[features] - mean) / sd).to_numpy(float), ((te[features] - mean) / sd).to_numpy(float)
        y, kind = tr[label].to_numpy(float), pdf["kind"].iloc[0]
        beta = firth_logistic(a, y) if kind == "firth" else descent_logistic(a, y, kind == "balanced")
        return pd.DataFrame({key: te[key], "model": pdf["model"].iloc[0], "fold": te[fold], "y": te[label], "w": te[weight].astype(float), "p": predict(beta, b)})

    t = dict(df.dtypes)
    return x.groupBy("held", "model").applyInPandas(run, f"{key} {t[key]}, model string, fold bigint, y bigint, w double, p double")


def _splines(train: np.ndarray, x: np.ndarray) -> np.ndarray:
    """spline_basis of each column with the knots of the training rows, standardised over them; constant columns give zeros."""
    parts = []
    for k in range(train.shape[1]):
        lo, mid, hi = train[:, k].min(), np.median(train[:, k]), train[:, k].max()
        both = []
        for v in (train[:, k], x[:, k]):
            if hi - lo < 1e-12:
                both.append(np.zeros((len(v), 4)))
                continue
            u, m = np.clip((v - lo) / (hi - lo), 0, 1), (mid - lo) / (hi - lo)
            left, m0, m1 = u < m, max(m, 1e-12), max(1 - m, 1e-12)
            b0 = np.where(left, ((m - u) / m0) ** 2, 0.0)
            b1 = np.where(left, u * (m - u) / m0**2 + (1 - u) * u / m0, (1 - u) ** 2 / m1)
            b3 = np.where(left, 0.0, ((u - m) / m1) ** 2) if m < 1 else (u == 1).astype(float)
            both.append(np.column_stack([b0, b1, 1 - b0 - b1 - b3, b3]))
        mean, sd = both[0].mean(0), both[0].std(0)
        parts.append((both[1] - mean) / np.where(sd < 1e-12, 1.0, sd))
    return np.column_stack(parts) if parts else np.zeros((len(x), 0))


def nested_cross_validated(df: DataFrame, key: str, label: str, weight: str, component: str, models: dict[str, tuple[str, list[str]]], lambdas: list[float], outer: int, inner: int) -> DataFrame:
    """Out-of-fold predictions of each model (kind, features; kind linear or splines) on component-disjoint folds: key, model, fold, lam, y, w, p.

    For each outer fold lambda is the largest of the grid whose mean weighted Brier score over the inner folds of the
    other components is within one standard error of the best; the model is then fitted to all of them. One task for each
    outer fold and model. A model without features has lambda 0.
    """
    from .graph import nested_folds

    spark = df.sparkSession
    vectors = df.groupBy(component).agg(F.sum(label).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    folds = nested_folds(vectors, component, ["_pos", "_n"], outer, inner)
    features = sorted({f for _, own in models.values() for f in own})
    grid = spark.createDataFrame([(m,) for m in models], "model string")
    rows = df.select(key, component, *features, label, weight).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    x = rows.join(folds, ["outer", component], "left").crossJoin(F.broadcast(grid))

    def fitted(tr: pd.DataFrame, te: pd.DataFrame, kind: str, own: list[str], lams: list[float]):
        mean, sd = tr[own].mean(), tr[own].std(ddof=0).where(lambda s: s > 1e-12, 1.0)
        a, b = ((tr[own] - mean) / sd).to_numpy(float), ((te[own] - mean) / sd).to_numpy(float)
        if kind == "splines":
            a, b = _splines(a, a), _splines(a, b)
        y, w = tr[label].to_numpy(float), tr[weight].to_numpy(float)
        return [predict(newton_logistic(a, y, w, lam), b) for lam in lams]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        kind, own = models[pdf["model"].iloc[0]]
        test = pdf["inner"].isna()
        tr, te = pdf[~test], pdf[test]
        lam = 0.0
        if own and len(te) and len(tr):
            loss = []
            for f in sorted(tr["inner"].unique()):
                held = tr["inner"] == f
                va = tr[held]
                loss.append([np.average((va[label] - p) ** 2, weights=va[weight]) for p in fitted(tr[~held], va, kind, own, lambdas)])
            mean, sd = np.mean(loss, axis=0), np.std(loss, axis=0, ddof=1) if len(loss) > 1 else np.zeros(len(lambdas))
            best = int(mean.argmin())
            lam = max(g for g, m in zip(lambdas, mean) if m <= mean[best] + sd[best] / math.sqrt(len(loss)))
        p = fitted(tr, te, kind, own, [lam])[0] if len(te) and len(tr) else np.full(len(te), np.nan)
        return pd.DataFrame({key: te[key], "model": te["model"], "fold": te["outer"], "lam": lam, "y": te[label], "w": te[weight].astype(float), "p": p})

    t = dict(df.dtypes)
    return x.groupBy("outer", "model").applyInPandas(run, f"{key} {t[key]}, model string, fold bigint, lam double, y bigint, w double, p double")


def one_se_lambda(losses: DataFrame, model: str, lam: str, fold: str, loss: str) -> DataFrame:
    """Per model the largest lambda whose mean loss is within one standard error of the best."""
    g = losses.groupBy(model, lam).agg(F.avg(loss).alias("m"), (F.stddev_samp(loss) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    best = g.groupBy(model).agg(F.min(F.struct("m", "se")).alias("b"))
    return g.join(best, model).where(F.col("m") <= F.col("b.m") + F.coalesce("b.se", F.lit(0.0))).groupBy(model).agg(F.max(lam).alias("lam"))


def tolerance_choice(scores: DataFrame, group: str, config: str, loss: str, cost: str, tolerance: float) -> DataFrame:
    """Per group the cheapest configuration within the tolerance of the least loss; ties by loss and name."""
    from pyspark.sql import Window

    lo = F.min(loss).over(Window.partitionBy(group))
    w = Window.partitionBy(group).orderBy(cost, loss, config)
    return scores.where("true").withColumn("_lo", lo).where(F.col(loss) <= F.col("_lo") + tolerance).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_lo")


def gauss_hermite(eta, sigma: float, nodes: int = 20):
    """Mean of sigmoid(eta + sigma * (u + v)) over two independent standard normal endpoint effects."""
    t, w = np.polynomial.hermite.hermgauss(nodes)
    scale = sigma * math.sqrt(2) * math.sqrt(2)  # the sum of two effects has variance 2 sigma^2
    pts = F.array(*[F.struct(F.lit(float(x * scale)).alias("x"), F.lit(float(v / math.sqrt(math.pi))).alias("w")) for x, v in zip(t, w)])
    return F.aggregate(pts, F.lit(0.0), lambda s, n: s + n["w"] / (1 + F.exp(-(eta + n["x"]))))


def intercept_for_rate(df: DataFrame, eta: str, rate: float, steps: int = 40) -> float:
    """Bisection for the intercept that gives the mean probability: one aggregation for each step."""
    lo, hi = -30.0, 30.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        m = df.agg(F.avg(1 / (1 + F.exp(-(F.col(eta) + mid))))).first()[0]
        lo, hi = (mid, hi) if m < rate else (lo, mid)
    return (lo + hi) / 2


def image_metrics(df: DataFrame, key: str, content: str, width: int) -> DataFrame:
    """Sharpness (Laplacian variance), clipped share, entropy and mean gradient of grey images held as bytes, row by row of `width`."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, b in zip(pdf[key], pdf[content]):
                g = np.frombuffer(b, np.uint8)[: len(b) // width * width].reshape(-1, width).astype(float)
                if g.shape[0] < 3 or g.shape[1] < 3:
                    rows.append((k, None, None, None, None))
                    continue
                lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
                h = np.bincount(g.astype(int).ravel(), minlength=256) / g.size
                gy, gx = np.gradient(g)
                rows.append((k, lap.var(), ((g <= 5) | (g >= 250)).mean(), -(h[h > 0] * np.log2(h[h > 0])).sum(), np.hypot(gx, gy).mean()))
            yield pd.DataFrame(rows, columns=[key, "sharpness", "clipped", "entropy", "gradient"])

    return df.select(key, content).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, sharpness double, clipped double, entropy double, gradient double")
