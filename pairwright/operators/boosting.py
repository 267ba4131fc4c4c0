"""Boosting by histograms: trees with monotone bounds, and additive shape functions.

Features are cut into bins once. What a tree's level needs is the sum of gradients and curvatures for each node, feature
and bin: one aggregation of the table, whose result is small and comes to the driver, where splits are chosen. Scores
are expressions of the bins, so no rows are gathered; after some trees they are written down, to keep plans short.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Bins of a feature at most; nodes of a level at most: together they bound what comes to the driver.
MAX_BINS, MAX_DEPTH = 256, 8
#: Trees between two tables of scores.
STORE_EVERY = 5


def cut_points(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """For each feature up to bins - 1 rising values; bin i holds what is over i of them. Nulls are a bin of their own, number 0, below all."""
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"2 to {MAX_BINS} bins")
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*(F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f) for f in features)).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def bin_of(feature: str, cuts: list[float]) -> Column:
    x = F.col(feature).cast("double")
    n = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: x > c)) if cuts else F.lit(0)
    return F.when(x.isNull(), 0).otherwise(n + 1).cast("int")


@dataclass
class Node:
    """A split of feature number `feature` (bins <= `cut` go left), or a leaf with a value."""

    low: float = -np.inf
    high: float = np.inf
    value: float = 0.0
    feature: int | None = None
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def expression(self, names: list[str]) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(names[self.feature]) <= self.cut, self.left.expression(names)).otherwise(self.right.expression(names))


@dataclass
class Boosted:
    features: list[str]
    cuts: dict[str, list[float]]
    start: float
    trees: list[Node] = field(default_factory=list)

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_b{j}": bin_of(f, self.cuts[f]) for j, f in enumerate(self.features)})

    def names(self) -> list[str]:
        return [f"_b{j}" for j in range(len(self.features))]

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        """df with the probability of label 1."""
        eta = F.lit(float(self.start))
        for tree in self.trees:
            eta = eta + tree.expression(self.names())
        return self.binned(df).withColumn(out, 1 / (1 + F.exp(-eta))).drop(*self.names())


def _best_split(g: np.ndarray, h: np.ndarray, node: Node, signs: list[int], l2: float, least: float):
    """(gain, feature, cut, left value, right value) of the best allowed split of a node; g, h: features x bins."""

    def value(gs, hs):
        return np.clip(-gs / (hs + l2), node.low, node.high)

    def loss(gs, hs, v):
        return gs * v + 0.5 * (hs + l2) * v * v

    best = None
    for j, sign in enumerate(signs):
        gl, hl = np.cumsum(g[j])[:-1], np.cumsum(h[j])[:-1]
        gr, hr = g[j].sum() - gl, h[j].sum() - hl
        vl, vr = value(gl, hl), value(gr, hr)
        whole = value(g[j].sum(), h[j].sum())
        gain = loss(g[j].sum(), h[j].sum(), whole) - loss(gl, hl, vl) - loss(gr, hr, vr)
        ok = (hl >= least) & (hr >= least) & (sign * (vr - vl) >= 0)
        if ok.any():
            i = int(np.where(ok, gain, -np.inf).argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0] + 1e-12):
                best = float(gain[i]), j, i, float(vl[i]), float(vr[i])
    return best


def _histograms(rows: DataFrame, names: list[str], where: Column, nodes: int, bins: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradient and curvature by node, feature and bin: one aggregation with partial sums."""
    each = F.inline(F.array(*(F.struct(F.lit(j).alias("f"), F.col(n).alias("bin")) for j, n in enumerate(names))))
    long = rows.withColumn("node", where).where("node is not null").select("node", "g", "h", each)
    g, h = np.zeros((2, nodes, len(names), max(bins)))
    for r in long.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        g[r.node, r.f, r.bin], h[r.node, r.f, r.bin] = r.g, r.h
    return g, h


def _number(tree: Node, names: list[str], open_: list[Node]) -> Column:
    """Which of the open nodes a row is in; null in a leaf."""
    if tree.feature is None:
        at = next((i for i, n in enumerate(open_) if n is tree), None)
        return F.lit(at).cast("int")
    return F.when(F.col(names[tree.feature]) <= tree.cut, _number(tree.left, names, open_)).otherwise(_number(tree.right, names, open_))


def monotone_trees(df: DataFrame, features: list[str], label: str, weight: str | None = None, monotone: dict[str, int] | None = None, trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Boosted trees for a 0/1 label. monotone: feature -> 1 (the prediction never falls along it) or -1 (never rises).

    A split along a constrained feature needs values in its order, and children keep to their side of the middle of both
    values, so no deeper split breaks the order. Nulls lie below all values. Ties go to the first feature and the lowest cut."""
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth 1 to {MAX_DEPTH}")
    signs = [(monotone or {}).get(f, 0) for f in features]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.where(F.col(label).isNotNull())
    ones, total = own.agg(F.sum(w * F.col(label)), F.sum(w)).first()
    share = min(max((ones or 0.0) / total if total else 0.5, 1e-6), 1 - 1e-6)
    model = Boosted(features, cut_points(own, features, bins), float(np.log(share / (1 - share))))
    names = model.names()
    rows = stored(model.binned(own.select(*features, F.col(label).cast("double").alias("_y"), w.alias("_w"))).select(*names, "_y", "_w").withColumn("_eta", F.lit(model.start)))
    sizes = [len(model.cuts[f]) + 2 for f in features]
    fresh: list[Node] = []
    for t in range(trees):
        eta = F.col("_eta")
        for done in fresh:
            eta = eta + done.expression(names)
        p = 1 / (1 + F.exp(-eta))
        level = rows.select(*names, (F.col("_w") * (p - F.col("_y"))).alias("g"), (F.col("_w") * p * (1 - p)).alias("h"))
        root = Node()
        open_ = [root]
        for _ in range(depth):
            g, h = _histograms(level, names, _number(root, names, open_), len(open_), sizes)
            if not h.any():
                break
            after = []
            for node, gs, hs in zip(open_, g, h):
                if node is root:
                    node.value = float(np.clip(-gs[0].sum() / (hs[0].sum() + l2), node.low, node.high))
                best = _best_split(gs, hs, node, signs, l2, least)
                if best is None:
                    continue
                _, j, cut, vl, vr = best
                middle = (vl + vr) / 2
                node.feature, node.cut = j, cut
                node.left, node.right = Node(node.low, node.high, vl), Node(node.low, node.high, vr)
                if signs[j] > 0:
                    node.left.high = node.right.low = middle
                elif signs[j] < 0:
                    node.left.low = node.right.high = middle
                after += [node.left, node.right]
            open_ = after
            if not open_:
                break
        _shrink(root, rate)
        model.trees.append(root)
        fresh.append(root)
        if len(fresh) == STORE_EVERY and t + 1 < trees:
            for done in fresh:
                rows = rows.withColumn("_eta", F.col("_eta") + done.expression(names))
            rows, fresh = stored(rows), []
    return model


def _shrink(node: Node, rate: float) -> None:
    node.value *= rate
    for kid in (node.left, node.right):
        if kid is not None:
            _shrink(kid, rate)


# ---------------------------------------------------------------- additive model


@dataclass
class Additive:
    """start + one table for each feature: what a bin adds to the logit."""

    features: list[str]
    cuts: dict[str, list[float]]
    start: float
    tables: list[np.ndarray]

    def eta(self, bins: list[Column]) -> Column:
        eta = F.lit(float(self.start))
        for b, table in zip(bins, self.tables):
            eta = eta + F.get(F.array(*(F.lit(float(v)) for v in table)), b)
        return eta

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, 1 / (1 + F.exp(-self.eta([bin_of(f, self.cuts[f]) for f in self.features]))))

    def shapes(self, spark) -> DataFrame:
        """feature, bin, over (the bin's values are larger; null for the lowest and for nulls), value: rows that sum to the score."""
        rows = [(f, b, float(self.cuts[f][b - 2]) if b > 1 else None, float(v)) for f, table in zip(self.features, self.tables) for b, v in enumerate(table)]
        return spark.createDataFrame(rows, "feature string, bin int, over double, value double")


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values of bins: a step function of up to `leaves` levels that lowers the loss most, one split after another."""
    cuts: list[int] = []
    total = lambda a, b: (g[a:b].sum(), h[a:b].sum())
    gain_of = lambda s: s[0] ** 2 / (s[1] + l2)
    while len(cuts) < leaves - 1:
        best = None
        for i in range(1, len(g)):
            k = bisect_left(cuts, i)
            if k < len(cuts) and cuts[k] == i:
                continue
            a, b = (cuts[k - 1] if k else 0), (cuts[k] if k < len(cuts) else len(g))
            gain = gain_of(total(a, i)) + gain_of(total(i, b)) - gain_of(total(a, b))
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = gain, i
        if best is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip([0, *cuts], [*cuts, len(g)]):
        s = total(a, b)
        out[a:b] = -s[0] / (s[1] + l2)
    return out


def additive(df: DataFrame, features: list[str], label: str, weight: str | None = None, cycles: int = 20, rate: float = 0.3, bins: int = 32, leaves: int = 3, l2: float = 1.0) -> Additive:
    """An additive model by cyclic boosting: each feature in turn gets a small step function of its own, fitted to what all others leave.

    One aggregation of the table by the feature's bins for each turn; tables are centred, so the start holds the mean."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    own = df.where(F.col(label).isNotNull())
    ones, total = own.agg(F.sum(w * F.col(label)), F.sum(w)).first()
    share = min(max((ones or 0.0) / total if total else 0.5, 1e-6), 1 - 1e-6)
    cuts = cut_points(own, features, bins)
    model = Additive(features, cuts, float(np.log(share / (1 - share))), [np.zeros(len(cuts[f]) + 2) for f in features])
    names = [f"_b{j}" for j in range(len(features))]
    # rows of the same bins and label are one, with their weight
    rows = stored(own.select(*(bin_of(f, cuts[f]).alias(n) for f, n in zip(features, names)), F.col(label).cast("double").alias("y"), w.alias("w")).groupBy(*names, "y").agg(F.sum("w").alias("w")))
    mass = [np.zeros(len(t)) for t in model.tables]
    for _ in range(cycles):
        for j, n in enumerate(names):
            p = 1 / (1 + F.exp(-model.eta([F.col(x) for x in names])))
            g, h = np.zeros((2, len(model.tables[j])))
            for r in rows.groupBy(n).agg(F.sum(F.col("w") * (p - F.col("y"))).alias("g"), F.sum(F.col("w") * p * (1 - p)).alias("h"), F.sum("w").alias("w")).collect():
                g[r[n]], h[r[n]], mass[j][r[n]] = r.g, r.h, r.w
            model.tables[j] = model.tables[j] + rate * _steps(g, h, leaves, l2)
    for j, table in enumerate(model.tables):
        if mass[j].sum():
            mean = float((table * mass[j]).sum() / mass[j].sum())
            model.tables[j], model.start = table - mean, model.start + mean
    return model
