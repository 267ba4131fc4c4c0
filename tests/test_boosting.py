"""Monotone trees and additive shape functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import boosting


def sample(n, seed):
    rng = np.random.default_rng(seed)
    a, b, c = rng.uniform(-2, 2, n), rng.uniform(0, 1, n), rng.normal(size=n)
    eta = 1.5 * a + 0.8 * np.sin(6 * b) + 0.3 * c
    return [(i, float(a[i]) if i % 50 else None, float(b[i]), float(c[i]), int(rng.random() < 1 / (1 + np.exp(-eta[i])))) for i in range(n)]


SCHEMA = "id long, a double, b double, c double, y long"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(sample(1500, 1), SCHEMA).cache(), spark.createDataFrame(sample(1500, 2), SCHEMA).cache()


def loss(df):
    return df.agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("s")).otherwise(1 - F.col("s"))))).first()[0]


def sweep(spark, feature, model):
    """The prediction along a feature for several settings of the others."""
    at = {"a": np.linspace(-3, 3, 60), "b": np.linspace(-0.2, 1.2, 60), "c": np.linspace(-3, 3, 60)}
    rows = []
    for k in range(8):
        rest = {f: float(at[f][(7 * k + 3) % 60]) for f in at}
        rows += [(k, i, *({**rest, feature: float(x)}[f] for f in "abc")) for i, x in enumerate(at[feature])]
    df = model.scored(spark.createDataFrame(rows, "k int, i int, a double, b double, c double"), "s")
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r.k, []).append(r.s)
    return np.array(list(out.values()))


def test_predictions_keep_the_order_and_lose_little(spark, data):
    train, held = data
    free = boosting.monotone_trees(train, ["a", "b", "c"], "y", trees=8)
    bound = boosting.monotone_trees(train, ["a", "b", "c"], "y", monotone={"a": 1, "c": 1}, trees=8)
    assert (np.diff(sweep(spark, "a", bound), axis=1) >= -1e-12).all() and (np.diff(sweep(spark, "c", bound), axis=1) >= -1e-12).all()
    assert (np.diff(sweep(spark, "c", free), axis=1) < 0).any()
    assert np.ptp(sweep(spark, "b", bound), axis=1).max() > 0.1
    l_free, l_bound = loss(free.scored(held, "s")), loss(bound.scored(held, "s"))
    assert l_bound <= 1.02 * l_free and l_bound < 0.8 * loss(held.withColumn("s", F.lit(0.5)))
    falling = boosting.monotone_trees(train, ["a", "c"], "y", monotone={"a": -1}, trees=2)
    assert (np.diff(sweep(spark, "a", falling), axis=1) <= 1e-12).all()


def test_first_split_is_the_best_of_all(spark, data):
    train, _ = data
    m = boosting.monotone_trees(train, ["a", "b"], "y", trees=1, depth=1, rate=1.0, bins=8)
    rows = m.binned(train).select("_b0", "_b1", "y").collect()
    y = np.array([r.y for r in rows], float)
    p = y.mean()
    best = max(((lambda l, r: (l.sum() - p * len(l)) ** 2 / (p * (1 - p) * len(l) + 1) + (r.sum() - p * len(r)) ** 2 / (p * (1 - p) * len(r) + 1))(y[b <= c], y[b > c]), -j, -c) for j, b in enumerate((np.array([r._b0 for r in rows]), np.array([r._b1 for r in rows]))) for c in range(0, b.max()))
    root = m.trees[0]
    assert (root.feature, root.cut) == (-best[1], -best[2])
    left = y[np.array([r[f"_b{root.feature}"] for r in rows]) <= root.cut]
    assert abs(root.left.value - (left.sum() - p * len(left)) / (p * (1 - p) * len(left) + 1)) < 1e-9


def test_shape_functions_sum_to_the_score(spark, data):
    train, held = data
    m = boosting.additive(train, ["a", "b", "c"], "y", cycles=6)
    table = {(r.feature, r.bin): r.value for r in m.shapes(spark).collect()}
    got = m.scored(held.select("*", *(boosting.bin_of(f, m.cuts[f]).alias(f"bin_{f}") for f in "abc")), "s").limit(200).collect()
    for r in got:
        eta = m.start + sum(table[f, r[f"bin_{f}"]] for f in "abc")
        assert abs(r.s - 1 / (1 + np.exp(-eta))) < 1e-9
    assert loss(m.scored(held, "s")) < 0.8 * loss(held.withColumn("s", F.lit(0.5)))
    a = [table["a", b] for b in range(1, len(m.cuts["a"]) + 2)]
    assert np.corrcoef(a, np.arange(len(a)))[0, 1] > 0.9


def test_one_label_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, 1)], "id long, a double, y long")
    m = boosting.monotone_trees(df, ["a"], "y", trees=2)
    assert m.scored(df, "s").where("s > 0.9").count() == 2
    none = df.limit(0)
    assert boosting.monotone_trees(none, ["a"], "y", trees=2).scored(df, "s").where("s = 0.5").count() == 2
    assert boosting.additive(none, ["a"], "y", cycles=1).scored(df, "s").where("s = 0.5").count() == 2
    with pytest.raises(ValueError):
        boosting.monotone_trees(df, ["a"], "y", bins=1000)
