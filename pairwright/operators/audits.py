"""Validation as data: every check gives issue rows or a one-row verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def assert_exact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    return df


def assert_no_forbidden_columns(df: DataFrame, tokens: list[str], allow: tuple[str, ...] = ()) -> DataFrame:
    bad = [c for c in df.columns if c not in allow and any(t in c.lower() for t in tokens)]
    if bad:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def issues(df: DataFrame, key: Column, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """code, message, row_id of every violated rule; the table is read once. A rule that is NULL is violated."""
    found = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"))) for code, (ok, text) in rules.items()]
    return df.select(key.cast("string").alias("row_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.code", "i.message", "row_id")


def verdict(counts: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """status, failures and counts from a one-row table: limits name a column, a comparison and a bound."""
    tests = {"==": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    fails = F.array_compact(F.array(*[F.when(~F.coalesce(tests[op](F.col(c), F.lit(b)), F.lit(False)), F.lit(f"{c} {op} {b:g}")) for c, (op, b) in limits.items()]))
    return counts.select(F.when(F.size(fails) == 0, "PASS").otherwise("FAIL").alias("status"), F.array_join(fails, ";").alias("failures"), *counts.columns)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only a has and that only b has, counting repeats."""
    only_a, only_b = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_first")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_second"))
    return only_a.crossJoin(only_b)


def incomplete_shards(df: DataFrame, keys: list[str], value: str, wanted: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("_s"), F.count(F.lit(1)).alias("n")).where((F.col("_s") != F.array(*[F.lit(x) for x in sorted(wanted)])) | (F.col("n") != len(wanted))).drop("_s")


def feature_audit(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """feature, missing, below, above, n."""
    parts = []
    for c, (lo, hi) in bounds.items():
        parts.append(F.struct(F.lit(c).alias("feature"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"), F.count(F.when(F.col(c) < lo, 1)).alias("below"), F.count(F.when(F.col(c) > hi, 1)).alias("above"), F.count(F.lit(1)).alias("n")))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def stage_views(features: DataFrame, outcomes: DataFrame, key: str, stage: str, open_stages: list[str], commitment: DataFrame) -> DataFrame:
    """Outcomes are joined for open stages only; rows of locked stages carry the commitment digest of their outcomes instead."""
    is_open = F.col(stage).isin(*open_stages)
    o = outcomes.select(key, *[c for c in outcomes.columns if c != key])
    names = [c for c in outcomes.columns if c != key]
    j = features.join(o, key, "left").join(F.broadcast(commitment), stage, "left")
    return j.select(key, stage, *[F.when(is_open, F.col(c)).alias(c) for c in names], F.when(~is_open, F.col("digest")).alias("commitment"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
