"""Keys, duplicates, unions and review-log consolidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Log compaction: an aggregation with map-side combine, no sort of the whole log."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_s"))
    return best.select(*keys, "_s.*")


def majority(votes: DataFrame, packet: str, reviewer: str, decision: str) -> DataFrame:
    """Most frequent decision; ties go to the one that the first reviewer gave. Also the votes in reviewer order and unanimity."""
    k = votes.groupBy(packet, decision).agg(F.count(F.lit(1)).alias("n"), F.min(reviewer).alias("first"))
    top = k.groupBy(packet).agg(F.max_by(decision, F.struct("n", -F.col("first"))).alias("majority"), (F.count(F.lit(1)) == 1).alias("unanimous"))
    text = votes.groupBy(packet).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(reviewer, decision))), lambda x: x[decision]), ";").alias("votes"))
    return top.join(text, packet).select(packet, "majority", "votes", "unanimous")


def conservative(votes: DataFrame, packet: str, decision: str, ready: str) -> DataFrame:
    """Ready only if both reviews say so; unknown until there are two."""
    two = F.count(F.lit(1)) == 2
    return votes.groupBy(packet).agg(two.alias("complete"), F.when(two, F.min(F.col(decision) == ready)).alias("ready"))


def adjudicated(votes: DataFrame, packet: str, reviewer: str, decision: str, pair: tuple, judge) -> DataFrame:
    def of(r):
        return F.max(F.when(F.col(reviewer) == r, F.col(decision)))

    two = votes.groupBy(packet).agg(of(pair[0]).alias("d0"), of(pair[1]).alias("d1"), of(judge).alias("d2")).where("d0 is not null and d1 is not null")
    same = F.col("d0") == F.col("d1")
    return two.select(packet, F.when(same, F.col("d0")).otherwise(F.col("d2")).alias("label"), F.when(same, "agreement").when(F.col("d2").isNotNull(), "adjudication").otherwise("open").alias("label_source"))


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a = left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti").select(F.lit("missing").alias("side"), *keys)
    return a.unionByName(right.select(*keys).distinct().join(left.select(*keys), keys, "left_anti").select(F.lit("unexpected").alias("side"), *keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def overlaps(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that occur in more than one stage."""
    parts = [d.select(key).distinct().withColumn("_stage", F.lit(s)) for s, d in stages.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(F.countDistinct("_stage").alias("_n")).where("_n > 1").select(key)


def assert_disjoint(stages: dict[str, DataFrame], key: str) -> None:
    if not overlaps(stages, key).limit(1).isEmpty():
        raise ValueError("samples overlap")


def role_overlap(df: DataFrame, role: str, key: str) -> DataFrame:
    r = df.select(role, key).distinct()
    return r.select(F.col(role).alias("role_a"), key).join(r.select(F.col(role).alias("role_b"), key), key).groupBy("role_a", "role_b").agg(F.count(F.lit(1)).alias("n"))


def content_dedup(left: DataFrame, right: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """Rows of left by how many rows of right hold the same content; sizes are compared before anything is hashed."""
    shared = left.select(size).distinct().join(right.select(size).distinct(), size)
    hashed = lambda d: d.join(shared, size, "left_semi").select(key, F.sha2(content, 256).alias("h"))
    k = hashed(right).groupBy("h").agg(F.count(F.lit(1)).alias("matches"))
    found = hashed(left).join(k, "h").select(key, "matches")
    m = F.coalesce("matches", F.lit(0))
    return left.select(key).join(found, key, "left").select(key, m.alias("matches"), F.when(m == 0, "keep_unmatched").when(m == 1, "drop_duplicate").otherwise("keep_ambiguous").alias("decision"))
