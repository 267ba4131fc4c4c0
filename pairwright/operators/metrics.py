"""Evaluation metrics, intervals and resampling as aggregates.

Scores that tie are handled by value counts: windows run over distinct scores, never over
pairs of rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed_hash import hash_index


def _w(group: list[str], *order):
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    return w.orderBy(*order) if order else w


def auroc(df: DataFrame, score: str, label: str, group: list[str] | None = None, weight: str | None = None, out: str = "auroc") -> DataFrame:
    """Weighted (or plain) area under the ROC curve, ties count half; NULL without both classes."""
    group = group or []
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*group, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))
    g = g.withColumn("below", F.coalesce(F.sum("neg").over(_w(group, score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("pos") * F.sum("neg")
    value = F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)), total)
    return g.groupBy(*group).agg(value.alias(out)) if group else g.agg(value.alias(out))


def average_precision(df: DataFrame, order: list[Column], label: str, group: list[str] | None = None, weight: str | None = None, out: str = "ap") -> DataFrame:
    """Mean precision at the positives, in the given order; weights count instead of rows if there are any."""
    group = group or []
    w = F.col(weight) if weight else F.lit(1.0)
    run = _w(group, *order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.select(*group, (F.col(label) * w).alias("_h"), F.sum(F.col(label) * w).over(run).alias("_c"), F.sum(w).over(run).alias("_n"))
    value = F.try_divide(F.sum(F.col("_h") * F.col("_c") / F.col("_n")), F.sum("_h"))
    return x.groupBy(*group).agg(value.alias(out)) if group else x.agg(value.alias(out))


def retrieval(df: DataFrame, group: list[str], query: str, rank: str, hit: str, k: int, ready: Column | None = None) -> DataFrame:
    """Per group: mean AP@k (hits within k), MRR, top-1, share of queries with a hit, misses and ready pairs within k."""
    top = df.where(F.col(rank) <= k)
    w = Window.partitionBy(*group, query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    h = F.col(hit).cast("int")
    x = top.withColumn("_p", F.when(F.col(hit), F.sum(h).over(w) / F.col(rank)))
    q = x.groupBy(*group, query).agg(
        F.coalesce(F.avg("_p"), F.lit(0.0)).alias("ap"),
        F.coalesce(1.0 / F.min(F.when(F.col(hit), F.col(rank))), F.lit(0.0)).alias("rr"),
        F.max(F.when(F.col(rank) == 1, h).otherwise(0)).alias("top1"),
        F.max(h).alias("any"),
        F.sum(1 - h).alias("false_k"),
        F.sum((ready if ready is not None else F.lit(False)).cast("int")).alias("ready_k"),
    )
    mean = lambda c, a: F.round(F.avg(c), 6).alias(a)
    return q.groupBy(*group).agg(F.count(F.lit(1)).alias("queries"), mean("ap", "map_at_k"), mean("rr", "mrr_at_k"), mean("top1", "top1"), mean("any", "positive_at_k"), mean("false_k", "false_at_k"), mean("ready_k", "ready_at_k"))


def reliability_bins(df: DataFrame, p: str, label: str, bins: int, group: list[str] | None = None) -> DataFrame:
    """One row for each bin, empty ones too; the last bin holds 1.0."""
    group = group or []
    spark = df.sparkSession
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")
    got = df.groupBy(*group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate"))
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    if group:
        grid = df.select(*group).distinct().crossJoin(F.broadcast(grid))
    return grid.join(got, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, p: str, label: str, bins: int, group: list[str] | None = None) -> DataFrame:
    r = reliability_bins(df, p, label, bins, group).where("n > 0")
    value = (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece")
    return r.groupBy(*group).agg(value) if group else r.agg(value)


def hoeffding_upper(risk: Column, n: Column, delta: float) -> Column:
    return F.least(F.lit(1.0), risk + F.sqrt(F.lit(math.log(1 / delta)) / (2 * n)))


def risk_coverage(df: DataFrame, risk: str, loss: str, group: list[str] | None = None) -> DataFrame:
    """For each distinct threshold tau: n accepted (risk <= tau), coverage and mean loss of the accepted."""
    group = group or []
    g = df.groupBy(*group, F.col(risk).alias("tau")).agg(F.count(F.lit(1)).alias("_n"), F.sum(loss).alias("_l"))
    run = _w(group, "tau").rowsBetween(Window.unboundedPreceding, 0)
    x = g.withColumn("n", F.sum("_n").over(run)).withColumn("_s", F.sum("_l").over(run)).withColumn("_t", F.sum("_n").over(_w(group)))
    return x.select(*group, "tau", "n", (F.col("n") / F.col("_t")).alias("coverage"), (F.col("_s") / F.col("n")).alias("selective_risk"))


def choose_threshold(curve: DataFrame, alphas: list[float], group: list[str] | None = None, sentinel: float = -1.0) -> DataFrame:
    """For each alpha the threshold of the largest coverage whose risk is at most alpha, or the sentinel with n = 0."""
    group = group or []
    spark = curve.sparkSession
    grid = spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    if group:
        grid = curve.select(*group).distinct().crossJoin(F.broadcast(grid))
    ok = curve.crossJoin(F.broadcast(spark.createDataFrame([(float(a),) for a in alphas], "alpha double"))).where(F.col("selective_risk") <= F.col("alpha"))
    best = ok.groupBy(*group, "alpha").agg(F.max(F.struct("n", "tau", "selective_risk")).alias("b"))
    j = grid.join(best, [*group, "alpha"], "left")
    return j.select(
        *group, "alpha", F.coalesce("b.tau", F.lit(sentinel)).alias("tau"), F.coalesce("b.n", F.lit(0)).alias("n"), F.coalesce("b.selective_risk", F.lit(0.0)).alias("selective_risk"),
        F.when(F.col("b").isNull(), "no_admission").otherwise("admitted").alias("status"),
    )


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high)."""
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))


def kappa(df: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """n, agreement, kappa (1 where expected agreement is 1)."""
    group = group or []
    j = df.groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("_n"))
    n = j.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("_n")).otherwise(0)).alias("_same"))
    ma = j.groupBy(*group, F.col(a).alias("_k")).agg(F.sum("_n").alias("_a"))
    mb = j.groupBy(*group, F.col(b).alias("_k")).agg(F.sum("_n").alias("_b"))
    e = ma.join(mb, [*group, "_k"]).groupBy(*group).agg(F.sum(F.col("_a") * F.col("_b")).alias("_e"))
    x = n.join(e, group, "left") if group else n.crossJoin(F.broadcast(e))
    po, pe = F.col("_same") / F.col("n"), F.coalesce(F.col("_e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return x.select(*group, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / F.when(pe == 1, F.lit(None)).otherwise(1 - pe)).alias("kappa"))


def linear_kappa(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Linearly weighted kappa of two ordinal ratings 0..levels-1."""
    j = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    obs = j.agg((F.sum(F.col("_n") * F.abs(F.col(a) - F.col(b))) / F.sum("_n") / (levels - 1)).alias("_o"))
    ma = j.groupBy(F.col(a).alias("_i")).agg(F.sum("_n").alias("_a"))
    mb = j.groupBy(F.col(b).alias("_j")).agg(F.sum("_n").alias("_b"))
    # at most levels x levels rows
    exp = ma.crossJoin(F.broadcast(mb)).agg((F.sum(F.col("_a") * F.col("_b") * F.abs(F.col("_i") - F.col("_j"))) / F.sum(F.col("_a") * F.col("_b")) / (levels - 1)).alias("_e"))
    return obs.crossJoin(exp).select(F.when(F.col("_e") == 0, 1.0).otherwise(1 - F.col("_o") / F.col("_e")).alias("kappa"))


def icc_a1(df: DataFrame, subject: str, raters: list[str]) -> DataFrame:
    """Two-way random, absolute agreement, single rater, from mean squares."""
    k = len(raters)
    s = df.select(subject, *raters).dropna()
    row = sum((F.col(r) for r in raters), F.lit(0.0)) / k
    agg = s.withColumn("_m", row).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_m").alias("vr"), F.avg("_m").alias("g"),
        *[F.avg(r).alias(f"c{i}") for i, r in enumerate(raters)],
        F.sum(sum((F.pow(F.col(r) - F.col("_m"), F.lit(2)) for r in raters), F.lit(0.0))).alias("within"),
    )
    n, g = F.col("n"), F.col("g")
    msr = k * F.col("vr") * n / (n - 1)
    ssc = n * sum((F.pow(F.col(f"c{i}") - g, F.lit(2)) for i in range(k)), F.lit(0.0))
    msc, mse = ssc / (k - 1), (F.col("within") - ssc) / ((n - 1) * (k - 1))
    return agg.select("n", ((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)).alias("icc"))


def odds_ratio(a: Column, b: Column, c: Column, d: Column, z: float = 1.959963984540054) -> Column:
    """struct(odds_ratio, low, high) of a 2x2 table, 0.5 added to each cell."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    lo = F.log(a * d / (b * c))
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.struct(F.exp(lo).alias("odds_ratio"), F.exp(lo - z * se).alias("low"), F.exp(lo + z * se).alias("high"))


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds p_value: two-sided, the sum of all tables that are no likelier than the one seen. One small vector per row."""
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(a, b, c, d):
            r, k, n = a + b, a + c, a + b + c + d
            lg = math.lgamma

            def logp(x):
                return lg(r + 1) - lg(x + 1) - lg(r - x + 1) + lg(n - r + 1) - lg(k - x + 1) - lg(n - r - k + x + 1) - lg(n + 1) + lg(k + 1) + lg(n - k + 1)

            seen = logp(a)
            return min(1.0, sum(math.exp(v) for x in range(max(0, k - (n - r)), min(r, k) + 1) if (v := logp(x)) <= seen + 1e-9))

        return pd.Series([one(*map(int, t)) for t in zip(a, b, c, d)])

    return df.withColumn("p_value", p(a, b, c, d))


def dyadic_interval(df: DataFrame, a: str, b: str, value: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean of value over pairs with a dyadic cluster-robust interval: Var = (sum over nodes of (sum of u)^2 - sum of u^2) / n^2."""
    m = df.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    u = df.crossJoin(F.broadcast(m)).withColumn("u", F.col(value) - F.col("mean"))
    nodes = u.select(F.explode(F.array(a, b)).alias("node"), "u").groupBy("node").agg(F.sum("u").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    sq = u.agg(F.sum(F.col("u") * F.col("u")).alias("uu"))
    j = m.crossJoin(nodes).crossJoin(sq)
    var = F.greatest(F.col("ss") - F.col("uu"), F.lit(0.0)) / (F.col("n") * F.col("n"))
    return j.select("n", "mean", F.sqrt(var).alias("se"), (F.col("mean") - z * F.sqrt(var)).alias("low"), (F.col("mean") + z * F.sqrt(var)).alias("high"))


# ---------------------------------------------------------------- resampling


def _indexed(df: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(F.lit(1))
    return df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))


def draws(spark, n: Column | int, reps: int, seed: str, slots: DataFrame) -> DataFrame:
    """(rep, slot, pick): hashed indices; the same on any engine."""
    return slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("pick", hash_index(seed, n, F.col("rep"), F.col("slot")))


def bootstrap(df: DataFrame, order: list[Column], value: Column, reps: int, seed: str) -> DataFrame:
    """(rep, value): the aggregate of each resample of the rows of df (a small table of units: queries, clusters, splits)."""
    x = _indexed(df, order)
    # few bytes, but reps times as many draws: dealt to all cores before they are made
    slots = x.select(F.col("_i").alias("slot"), "_n").repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    d = slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_i", hash_index(seed, F.col("_n"), F.col("rep"), F.col("slot"))).groupBy("rep", "_i").agg(F.count(F.lit(1)).alias("times"))
    return d.join(x.drop("_n"), "_i").groupBy("rep").agg(value.alias("value"))


def percentile_interval(values: DataFrame, *group: str) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*group).agg(F.count(F.lit(1)).alias("reps"), F.avg("value").alias("mean"), q.alias("q")).select(*group, "reps", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
