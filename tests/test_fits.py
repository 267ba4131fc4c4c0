"""Replicate-weighted fits against fits of each replicate by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import fits, models


def sample(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(int)
    return x, y, rng.integers(1, 4, n), rng.integers(0, 4, n), rng.integers(0, 30, n)


def frame(spark, x, y, w, fold, comp):
    return spark.createDataFrame([(i, *map(float, x[i]), int(y[i]), int(w[i]), int(fold[i]), int(comp[i])) for i in range(len(y))], "id long, a double, b double, c double, y long, w long, fold long, comp long")


@pytest.mark.parametrize("kind, lam", [("newton", 0.01), ("newton", 1.0), ("firth", 0.0)])
def test_folds_are_fits_of_the_other_rows(spark, kind, lam):
    x, y, w, fold, comp = sample()
    got = {r.id: r.p for r in models.cross_validated(frame(spark, x, y, w, fold, comp), "id", ["a", "b", "c"], "y", "w", "fold", {"m": (kind, lam)}).collect()}
    assert len(got) == len(y)
    for f in range(4):
        tr, te = fold != f, fold == f
        mean, sd = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - mean) / sd
        beta = models.newton_logistic(z, y[tr], w[tr].astype(float), lam) if kind == "newton" else models.firth_logistic(z, y[tr])
        assert np.allclose([got[i] for i in np.flatnonzero(te)], models.predict(beta, (x[te] - mean) / sd), atol=1e-6)


def test_component_draws_are_weights(spark):
    x, y, w, fold, comp = sample()
    df = frame(spark, x, y, w, fold, comp)
    draws = fits.component_draws(df, "comp", 50, "s")
    table = {r.comp: {d.r: d.w for d in r.draws} for r in draws.collect()}
    assert table.keys() == set(comp.tolist())
    assert all(sum(t.get(r, 0) for t in table.values()) == len(table) for r in range(50))
    got = {r.r: r for r in fits.newton(df.join(draws, "comp"), ["a", "b"], "y", "draws", [0.0] * 50).summary(spark).collect()}
    for r in (0, 7, 49):
        times = np.array([table[c].get(r, 0.0) for c in comp.tolist()])
        beta = models.newton_logistic(x[:, :2], y, times, 0.0)
        assert got[r].converged and np.allclose([got[r].intercept, *got[r].slopes], beta, atol=1e-6)
        assert (got[r].zeros, got[r].ones) == (((times > 0) & (y == 0)).sum(), ((times > 0) & (y == 1)).sum())


def test_one_label_no_rows_and_limits(spark):
    x, y, w, fold, comp = sample(40)
    df = frame(spark, x, np.ones_like(y), w, fold, comp).withColumn("draws", F.array(F.struct(F.lit(0).alias("r"), F.lit(1.0).alias("w"))))
    got = fits.newton(df, ["a"], "y", "draws", [0.0, 0.0])
    assert not got.converged.any() and got.ones.tolist() == [40, 0]
    assert fits.newton(df.limit(0), ["a"], "y", "draws", [0.0]).zeros.tolist() == [0]
    with pytest.raises(ValueError):
        fits.newton(df, ["a"], "y", "draws", [0.0] * (fits.MAX_REPLICATES + 1))


def test_no_rows_are_gathered(spark):
    x, y, w, fold, comp = sample(60)
    out = models.cross_validated(frame(spark, x, y, w, fold, comp), "id", ["a"], "y", "w", "fold", {"m": ("newton", 0.1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
