"""Checked and shaped joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sets import duplicate_keys

#: Rows of a block of a group, on average; blocks of a group at most, as a row is sent once for each; tasks for each core that blocks meet in.
BLOCK, BLOCKS, TASKS = 1024, 32, 8


def _unique(df: DataFrame, keys: list[str], what: str) -> None:
    if not duplicate_keys(df, keys).limit(1).isEmpty():
        raise ValueError(f"{what}: keys {keys} are not unique")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    _unique(left, keys, "left")
    _unique(right, keys, "right")
    return left.join(right, keys, how)


def full_with_suffixes(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    def marked(df, s):
        return df.select(*keys, *[F.col(c).alias(c + s) for c in df.columns if c not in keys])

    return marked(left, suffixes[0]).join(marked(right, suffixes[1]), keys, "full")


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str], out: str = "_merge") -> DataFrame:
    """Full join with left_only, right_only or both."""
    j = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full")
    return j.withColumn(out, F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")).drop("_l", "_r")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join whose missing keys stop the query when rows are read."""
    j = left.join(right.select(*keys, *columns, F.lit(True).alias("_found")), keys, "left")
    return j.withColumn("_found", F.coalesce("_found", F.raise_error(F.lit(f"no match for {keys}")).cast("boolean"))).where("_found").drop("_found")


def endpoints(pairs: DataFrame, nodes: DataFrame, key: str, prefixes: dict[str, str]) -> DataFrame:
    """Both ends of each pair with the node table's columns, prefixed."""
    for end, prefix in prefixes.items():
        side = nodes.select(F.col(key).alias(end), *[F.col(c).alias(prefix + c) for c in nodes.columns if c != key])
        pairs = pairs.join(side, end)
    return pairs


def blocked(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds _blocks, how many blocks a row's group is cut into, and _block, the row's own by the hash of its key. Rows without group are in no pair and go."""
    size = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(size, group).withColumn("_blocks", F.least(F.ceil(F.col("_n") / BLOCK), F.lit(BLOCKS)).cast("int"))
    # never null by type, so keys that are made of it are of one type
    return out.withColumn("_block", F.coalesce(F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"), F.lit(0))).drop("_n")


def pairs_of_blocks(df: DataFrame, group: list[str], key: str, carry: list[str]) -> DataFrame:
    """Unordered pairs a < b of what blocked() gives. Two blocks of a group meet once, in a task that the group and both blocks choose."""
    parts = TASKS * df.sparkSession.sparkContext.defaultParallelism

    def side(name, i, j):
        s = df.withColumn("_i", i).withColumn("_j", j).withColumn("_apart", F.col("_i") < F.col("_j"))
        # one key, as a group that is a constant would leave a join by several, which then deals its rows anew
        s = s.select(F.struct(*group, "_i", "_j").alias("_meet"), *[F.col(c).alias(f"_{name}_{c}") for c in dict.fromkeys(["_apart", key, *carry])])
        return s.repartition(parts, "_meet")  # a number that is given is kept, however few bytes there are

    x = side("x", F.col("_block"), F.explode(F.sequence("_block", F.col("_blocks") - 1)))
    y = side("y", F.explode(F.sequence(F.lit(0), "_block")), F.col("_block"))
    # equal keys are in one block, so those of two blocks stand either way round
    up, down = F.col(f"_x_{key}") < F.col(f"_y_{key}"), F.col(f"_x_{key}") > F.col(f"_y_{key}")
    j = x.join(y.hint("merge"), "_meet").where(up | F.col("_x__apart") & down)

    def end(name, first):
        return [F.when(first, F.col(f"_x_{c}")).otherwise(F.col(f"_y_{c}")).alias(out) for c, out in ((key, name), *[(c, f"{name}_{c}") for c in carry])]

    return j.select(*[F.col(f"_meet.{g}").alias(g) for g in group], *end("a", up), *end("b", down))


def pairs_within(df: DataFrame, group: list[str], key: str, carry: list[str] | None = None) -> DataFrame:
    """Unordered pairs a < b of keys in a group."""
    return pairs_of_blocks(blocked(df.select(*group, key, *[c for c in carry or [] if c not in (key, *group)]), group, key), group, key, carry or [])


def pareto(df: DataFrame, group: list[str], scores: list[str]) -> DataFrame:
    """Rows that no other row of the group dominates."""
    o = df.select(*[F.col(g).alias(f"_{g}") for g in group], *[F.col(s).alias(f"_{s}") for s in scores])
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    at_least = [F.col(f"_{s}") >= F.col(s) for s in scores]
    more = F.lit(False)
    for s in scores:
        more = more | (F.col(f"_{s}") > F.col(s))
    return df.join(o, [*same, *at_least, more], "left_anti")


def grid(spark: SparkSession, axes: dict[str, list], schema: str) -> DataFrame:
    """Product of parameter lists: made on the driver, it never depends on data."""
    return spark.createDataFrame(list(product(*axes.values())), schema)


def greedy_match(high: DataFrame, low: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Each high row, in the order of value and key, takes the nearest low row that is still free: sequential within a group."""

    def match(k, a, b):
        import numpy as np
        import pandas as pd

        a, b = a.sort_values([value, key]), b.sort_values([value, key])
        keys, vals, free = b[key].tolist(), b[value].to_numpy(float), np.ones(len(b), bool)
        out = []
        for i, v in zip(a[key].tolist(), a[value].tolist()):
            if not free.any():
                break
            gap = np.where(free, np.abs(vals - v), np.inf)
            j = int(gap.argmin())
            free[j] = False
            out.append((k[0], i, keys[j], float(gap[j])))
        return pd.DataFrame(out, columns=[group, "high", "low", "gap"])

    schema = f"{group} {dict(high.dtypes)[group]}, high {dict(high.dtypes)[key]}, low {dict(low.dtypes)[key]}, gap double"
    low = low.select(*[F.col(c).alias(c) for c in low.columns])  # sides of one table need attributes of their own
    return high.groupBy(group).cogroup(low.groupBy(group)).applyInPandas(match, schema)


def strided(df: DataFrame, key: str, place: str, total: str, stride: int, count: int, group: list[str] | None = None) -> DataFrame:
    """Each row with the rows stride, 2 * stride, ... places further on, around the end: a, b, j and the other row's columns."""
    group = group or []
    left = df.withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint"))))
    left = left.withColumn("_to", F.pmod(F.col(place) + stride * F.col("j"), F.col(total))).withColumnRenamed(key, "a").drop(place, total)
    other = df.select(*group, F.col(key).alias("b"), F.col(place).alias("_to"), *[F.col(c).alias(f"other_{c}") for c in df.columns if c not in (key, place, total, *group)])
    return left.join(other, [*group, "_to"]).drop("_to")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of left that right lacks (missing), and the other way round (unexpected)."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(1)), right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, keys, "full").agg(F.count(F.when(F.col("_r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_l").isNull(), 1)).alias("unexpected"))


