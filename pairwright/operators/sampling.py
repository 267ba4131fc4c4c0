"""Quotas, seeded draws and prefixes."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import position


def _capacity(cells: DataFrame, cap: str, target: int) -> int:
    total = cells.agg(F.sum(cap)).first()[0] or 0
    if target < 0 or total < target:
        raise ValueError(f"INSUFFICIENT_FRAME_CAPACITY: target={target}, capacity={total}")
    return total


def waterfill(cells: DataFrame, cell: str, cap: str, target: int, tie: Column) -> DataFrame:
    """cell, quota: one unit to each cell in turn until the target is met. Units (cell, i) up to the target are ordered, not looped over."""
    _capacity(cells, cap, target)
    units = cells.where(F.col(cap) > 0).select(cell, tie.alias("_t"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col(cap), F.lit(max(target, 1)).cast("bigint")))).alias("_i"))
    return units.orderBy("_i", "_t", cell).limit(target).groupBy(cell).agg(F.count(F.lit(1)).alias("quota"))


def hamilton(cells: DataFrame, cell: str, cap: str, target: int, tie: Column, minimum_one: bool = True) -> DataFrame:
    """cell, cap, quota: largest remainders within capacities, at least one each. Cells are few: the loop runs on the driver."""
    total = _capacity(cells, cap, target)
    rows = cells.where(F.col(cap) > 0).select(F.col(cell).alias("c"), F.col(cap).alias("n"), tie.alias("t")).collect()  # one row for each cell
    low = 1 if minimum_one else 0
    if minimum_one and target < len(rows):
        raise ValueError("INSUFFICIENT_FRAME_CAPACITY: the target cannot give every cell one row")
    ideal = {r.c: divmod(target * r.n, total) for r in rows}
    quota = {r.c: min(r.n, max(low, ideal[r.c][0])) for r in rows}
    short = target - sum(quota.values())
    up = sorted(rows, key=lambda r: (-ideal[r.c][1], r.t, r.c))
    while short > 0:
        r = next(r for r in up if quota[r.c] < r.n)
        full = [x for x in up if quota[x.c] < x.n and ideal[x.c][1] == ideal[r.c][1]]
        quota[full[0].c] += 1
        up.remove(full[0])  # one more round only when all had theirs
        up = up or sorted(rows, key=lambda r: (-ideal[r.c][1], r.t, r.c))
        short -= 1
    down = sorted(rows, key=lambda r: (ideal[r.c][1], r.t, r.c))
    while short < 0:
        r = next((r for r in down if quota[r.c] > low), None)
        if r is None:
            raise ValueError("INSUFFICIENT_FRAME_CAPACITY: the least allocation exceeds the target")
        quota[r.c] -= 1
        short += 1
    spark = cells.sparkSession
    kind = dict(cells.dtypes)
    return spark.createDataFrame([(r.c, r.n, int(quota[r.c])) for r in rows], f"{cell} {kind[cell]}, {cap} {kind[cap]}, quota bigint")


def equal_base(cells: DataFrame, cell: str, cap: str, target: int) -> DataFrame:
    """The same base for each cell, then one unit at a time to cells in the order of their slack."""
    rows = sorted(((r[0], r[1]) for r in cells.where(F.col(cap) > 0).select(cell, cap).collect()))
    base = target // len(rows) if rows else 0
    quota = {k: min(base, n) for k, n in rows}
    left = target - sum(quota.values())
    order = sorted(rows, key=lambda r: (-(r[1] - quota[r[0]]), r[0]))
    while left > 0 and any(quota[k] < n for k, n in order):
        for k, n in order:
            if left and quota[k] < n:
                quota[k] += 1
                left -= 1
    return cells.sparkSession.createDataFrame(list(quota.items()), f"{cell} {dict(cells.dtypes)[cell]}, quota bigint")


def role_quotas(cells: DataFrame, cell: str, cap: str, shares: dict[str, float]) -> DataFrame:
    """cell, role, quota: whole units to the role that is furthest behind its share over all cells so far."""
    rows = sorted((r[0], r[1]) for r in cells.select(cell, cap).collect())
    given, seen, out = dict.fromkeys(shares, 0), 0, []
    for k, n in rows:
        own = {r: int(n * s) for r, s in shares.items()}
        for r in own:
            given[r] += own[r]
        seen += n
        for _ in range(n - sum(own.values())):
            r = max(shares, key=lambda x: (shares[x] * seen - given[x], x))
            own[r] += 1
            given[r] += 1
        out += [(k, r, q) for r, q in own.items()]
    return cells.sparkSession.createDataFrame(out, f"{cell} {dict(cells.dtypes)[cell]}, role string, quota bigint")


def stratified_draw(frame: DataFrame, cell: str, key: str, quota: Column, digest: Column) -> DataFrame:
    """The first `quota` rows of each cell in digest order, with cap, quota and inclusion probability pi (12 decimals)."""
    x = position(frame.withColumn("_d", digest), "_rn", [F.col("_d"), F.col(key)], [cell], "cap").withColumn("quota", quota.cast("bigint"))
    return x.where("_rn <= quota").withColumn("pi", F.round(F.least("quota", "cap") / F.col("cap"), 12)).drop("_rn", "_d")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return position(df, "_rn", order, group).where(F.col("_rn") <= n).drop("_rn")


def with_top_up(df: DataFrame, group: list[str], order: list[Column], each: int, n: int) -> DataFrame:
    """The first `each` rows of each group; what they lack of n rows comes from the other rows, in the same order."""
    return position(df, "_rn", order, group).orderBy(F.col("_rn") > each, *order).limit(n).drop("_rn")


def round_robin(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """Strata take turns; place from 1. No stratum can give more than n rows."""
    x = position(df, "_rn", order, [stratum]).where(F.col("_rn") <= n)
    return position(x.orderBy("_rn", stratum).limit(n), "place", [F.col("_rn"), F.col(stratum)]).drop("_rn")


def round_robin_minimum(df: DataFrame, group: str, key: str, order: list[Column], least: int, n: int) -> DataFrame:
    """Groups with at least `least` rows; their first rows come before any group's further rows."""
    x = position(df, "_rn", order, [group], "_n").where((F.col("_n") >= least) & (F.col("_rn") <= n))
    return x.orderBy(F.col("_rn") > least, "_rn", group).limit(n).drop("_rn", "_n")


def capped_pick(df: DataFrame, group: list[str], order: list[Column], cap: int, n: int) -> DataFrame:
    """A greedy pick in one order with at most `cap` of a group equals the cap first and the limit after it."""
    return first_per_group(df, group, order, cap).orderBy(*order).limit(n)


def evenly_spaced(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows at round(i * (n - 1) / (k - 1)), half to even."""
    x = position(df, "_rn", order, group, "_n")
    i = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    sizes = x.select(*group, "_n").distinct().select(*group, "_n", i.alias("_i")).select(*group, (F.bround(F.col("_i") * (F.col("_n") - 1) / float(k - 1)) + 1).cast("bigint").alias("_rn")).distinct()
    return x.join(sizes, [*group, "_rn"], "left_semi").drop("_rn", "_n")


def exclusion_register(keys: list[str], reasons: dict[str, DataFrame]) -> DataFrame:
    parts = [d.select(*keys).distinct().withColumn("_r", F.lit(r)) for r, d in reasons.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_r")), ";").alias("reasons"))


def prefix_for_retention(df: DataFrame, group: list[str], order: list[Column], positive: str, targets: list[float]) -> DataFrame:
    """Smallest prefix that keeps ceil(target * positives) positives."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.select(*group, F.row_number().over(w).cast("bigint").alias("k"), F.sum(positive).over(run).alias("_c"), F.sum(positive).over(Window.partitionBy(*group)).alias("_p"))
    x = x.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    return x.where(F.col("_c") >= F.ceil(F.col("_p") * F.col("target"))).groupBy(*group, "target").agg(F.min("k").alias("k"))


def risk_constrained_prefix(df: DataFrame, group: list[str], order: list[Column], gain: str, loss: str, alpha: float, budget: int) -> DataFrame:
    """Prefix with the largest gain whose mean loss is at most alpha, within the budget; of equal gains the longer one."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.select(*group, F.row_number().over(w).cast("bigint").alias("k"), F.sum(gain).over(run).alias("admission"), F.avg(loss).over(run).alias("_r"))
    best = x.where((F.col("_r") <= alpha) & (F.col("k") <= budget)).groupBy(*group).agg(F.max(F.struct("admission", "k")).alias("_b"))
    return best.select(*group, "_b.k", "_b.admission")


def assign_reviewers(packets: DataFrame, packet: str, reviewers: list[str], seed: str) -> DataFrame:
    """Two reviewers and a possible third for each packet, by running loads: sequential over the packets, in seeded order."""

    def run(pdf):
        from itertools import combinations

        import pandas as pd

        rank = lambda *x: hashlib.sha256("|".join([seed, *map(str, x)]).encode()).hexdigest()
        load, pair_load, out = dict.fromkeys(reviewers, 0), {}, []
        for p in sorted(pdf[packet].tolist(), key=rank):
            a, b = min(combinations(reviewers, 2), key=lambda e: (max(load[e[0]], load[e[1]]), load[e[0]] + load[e[1]], pair_load.get(e, 0), rank(p, *e), e))
            load[a] += 1
            load[b] += 1
            pair_load[a, b] = pair_load.get((a, b), 0) + 1
            third = min((r for r in reviewers if r not in (a, b)), key=lambda r: (load[r], rank(p, r)), default=None)
            out.append((p, a, b, third))
        return pd.DataFrame(out, columns=[packet, "first", "second", "adjudicator"])

    return packets.select(packet).groupBy(F.lit(0).alias("_one")).applyInPandas(run, f"{packet} {dict(packets.dtypes)[packet]}, first string, second string, adjudicator string")
