"""Rank, percentile and binning conventions, each under its own name.

Ranks over a whole table sort it by range, not in one task: a row's place is the weight of the ranges before its own
and of the rows before it in its range. The ranges are stored, so a lost executor can't move their bounds. Ranks within
groups are windows: a group is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


_BEFORE = (Window.unboundedPreceding, -1)


def running(df: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """Adds _below, the weight of the rows before a row in a full order, and _total, that of all rows."""
    x = stored(df.withColumn("_w", weight.cast("bigint")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = x.groupBy("_part").agg(F.sum("_w").alias("_p"))  # one row for each range
    every = Window.partitionBy(F.lit(1))
    parts = parts.select("_part", F.coalesce(F.sum("_p").over(every.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_first"), F.sum("_p").over(every).alias("_total"))
    here = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))
    return x.join(F.broadcast(parts), "_part").withColumn("_below", F.col("_first") + here).drop("_part", "_first", "_w")


def value_counts(df: DataFrame, value: str, partition: list[str] | None = None) -> DataFrame:
    """One row per distinct value: n (ties), below (rows with a smaller value), total. Pre-aggregates, so windows see distinct values only."""
    partition = partition or []
    g = df.where(F.col(value).isNotNull()).groupBy(*partition, value).agg(F.count(F.lit(1)).alias("n"))
    if not partition:
        return running(g, [F.col(value)], F.col("n")).withColumnsRenamed({"_below": "below", "_total": "total"})
    w = Window.partitionBy(*partition)
    return g.withColumn("below", F.coalesce(F.sum("n").over(w.orderBy(value).rowsBetween(*_BEFORE)), F.lit(0))).withColumn("total", F.sum("n").over(w))


def _back(df: DataFrame, counts: DataFrame, value: str, partition: list[str]) -> DataFrame:
    return df.join(counts, [*partition, value], "left")


def midrank(df: DataFrame, value: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """(below + n / 2) / total."""
    if df.where(F.isnan(F.col(value).cast("double"))).limit(1).count():
        raise ValueError("values must be finite")
    k = value_counts(df, value, partition).withColumn(out, (F.col("below") + F.col("n") / 2.0) / F.col("total"))
    return _back(df, k.drop("n", "below", "total"), value, partition or [])


def average_rank(df: DataFrame, value: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """Mean rank of ties, from 1."""
    k = value_counts(df, value, partition).withColumn(out, F.col("below") + (F.col("n") + 1) / 2.0)
    return _back(df, k.drop("n", "below", "total"), value, partition or [])


def average_percentile(df: DataFrame, value: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """Mean rank / total; NULL gives 0."""
    k = value_counts(df, value, partition).withColumn(out, (F.col("below") + (F.col("n") + 1) / 2.0) / F.col("total"))
    return _back(df, k.drop("n", "below", "total"), value, partition or []).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(out, F.lit(0.0)))))


def average_percentile_within(df: DataFrame, values: DataFrame, value: str, out: str, group: str) -> DataFrame:
    """Mean rank / total within few large groups, for values without NULL: distinct values are ranked by ranges, so no group is one task."""
    g = values.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    totals = g.groupBy(group).agg(F.sum("n").alias("_in"))
    first = totals.alias("a").join(F.broadcast(totals.select(F.col(group).alias("_other"), F.col("_in").alias("_less"))), F.col("_other") < F.col(group), "left")
    first = first.groupBy(group, "_in").agg(F.coalesce(F.sum("_less"), F.lit(0)).alias("_first"))
    k = running(g, [F.col(group), F.col(value)], F.col("n")).join(F.broadcast(first), group)
    pct = (F.col("_below") - F.col("_first") + (F.col("n") + 1) / 2.0) / F.col("_in")
    return df.join(k.select(group, value, pct.alias(out)), [group, value])


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with exact interpolated quantiles as an array, q. Values are counted first, so the last task gets distinct values once."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.percentile(value, F.array(*[F.lit(x) for x in shares]), F.col("_n")).alias("q"))


def position(df: DataFrame, out: str, order: list[Column], partition: list[str] | None = None, total: str | None = None) -> DataFrame:
    """row_number from 1 in a full order (and the partition's size)."""
    if not partition:
        x = running(df, order, F.lit(1)).withColumn(out, F.col("_below") + 1).drop("_below")
        return x.withColumnRenamed("_total", total) if total else x.drop("_total")
    w = Window.partitionBy(*partition)
    df = df.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("bigint"))
    return df.withColumn(total, F.count(F.lit(1)).over(w)) if total else df


def equal_frequency(rn: Column, n: Column, groups: int) -> Column:
    """min(groups, (rn - 1) * groups // n + 1): not ntile()."""
    return F.least(F.lit(groups), F.floor((rn - 1) * groups / n) + 1).cast("bigint")


def rank_quantile_bin(rn: Column, n: Column, bins: int) -> Column:
    """Bin i (from 0) holds the places i * n // bins up to (i + 1) * n // bins."""
    edges = [F.floor(F.lit(i) * n / bins) for i in range(1, bins)]
    return sum((F.when(rn - 1 >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("bigint")


def minmax(value: str, partition: list[str]) -> Column:
    w = Window.partitionBy(*partition)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)


def tie_aware_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """value, n, bin: equal values are never split; a bin closes when it holds ceil(total / bins) rows. Works on distinct values."""
    k = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    size = -(-total // bins)

    def fill(pdf):
        pdf = pdf.sort_values(value)
        out, now, held = [], 0, 0
        for n in pdf["n"]:
            if held >= size and now < bins - 1:
                now, held = now + 1, 0
            out.append(now)
            held += n
        return pdf.assign(bin=out)

    kind = dict(df.dtypes)[value]
    return k.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda pdf: fill(pdf)[[value, "n", "bin"]], f"`{value}` {kind}, n bigint, bin bigint")


def ecdf(df: DataFrame, value: str, reference: DataFrame, ref_value: str, out: str) -> DataFrame:
    """Share of reference values <= value: a union with running counts instead of a range join."""
    ref = reference.select(F.col(ref_value).alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    vals = df.select(F.col(value).alias("_v")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = ref.unionByName(vals).groupBy("_v").agg(F.sum("_n").alias("_n"))
    run = running(both, [F.col("_v")], F.col("_n"))
    return df.join(run.select(F.col("_v").alias(value), ((F.col("_below") + F.col("_n")) / F.col("_total")).alias(out)), value)
