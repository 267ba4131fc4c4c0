"""Ranks over whole tables: many ranges, nulls, falling orders, empty tables."""

import pytest
from pyspark.sql import functions as F

from pairwright.operators import ranks, sampling


@pytest.fixture
def rows(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 11 != 0, F.col("id") * 7919 % 37).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_places_follow_the_full_order(rows):
    got = ranks.position(rows, "place", [F.desc("v"), F.col("id")], total="n").collect()
    want = sorted(rows.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.id))
    assert {r.id: r.place for r in got} == {r.id: i for i, r in enumerate(want, 1)}
    assert {r.n for r in got} == {5000}
    assert got[0].asDict().keys() == {"id", "v", "place", "n"}


def test_counts_below_a_value(rows):
    values = [r.v for r in rows.collect() if r.v is not None]
    got = {r.v: (r.n, r.below, r.total) for r in ranks.value_counts(rows, "v").collect()}
    assert got == {v: (values.count(v), sum(x < v for x in values), len(values)) for v in set(values)}


def test_one_value_only(spark):
    got = ranks.position(spark.range(100).withColumn("v", F.lit(1)), "place", [F.col("v"), F.col("id")]).collect()
    assert sorted((r.place, r.id) for r in got) == [(i + 1, i) for i in range(100)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, v double")
    assert ranks.position(none, "place", [F.col("v"), F.col("id")], total="n").count() == 0
    assert ranks.value_counts(none, "v").count() == 0
    assert sampling.with_top_up(none, ["v"], [F.col("id")], 2, 10).count() == 0


def test_top_up_fills_short_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 100)], "g string, id bigint")
    got = {(r.g, r.id) for r in sampling.with_top_up(df, ["g"], [F.col("id")], 2, 6).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 100), ("a", 2), ("a", 3), ("a", 4)}


def test_percentiles_within_groups_are_not_one_task_for_each_group(spark):
    rows = [(g, (i * 7 % n) / 4) for g, n in (("a", 5), ("b", 90), ("c", 1)) for i in range(n * 2)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ranks.average_percentile_within(df, df, "v", "pct", "g")
    from pyspark.sql import Window

    by, ties = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g", "v")
    want = df.withColumn("pct", (F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert sorted(map(tuple, got.select("g", "v", "pct").collect())) == sorted(map(tuple, want.collect()))


def test_scored_evidence_searches_once_and_ranks_by_ranges(spark):
    from pairwright.plans.q_scalar import scored

    plan = scored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(descriptor" not in plan


def test_quantiles_count_values_first(spark):
    df = spark.range(0, 1001, 1, 5).select(F.when(F.col("id") % 10 != 0, F.col("id") * 7 % 83 / 8.0).alias("v"))
    got = ranks.quantiles(df, "v", [0.8, 0.4, 0.0, 1.0])
    assert got.collect()[0].q == df.agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.8, 0.4, 0.0, 1.0)])).alias("q")).collect()[0].q
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert ranks.quantiles(df.where("v > 1e9"), "v", [0.5]).collect()[0].q is None


def test_draws_are_not_made_in_one_task(spark):
    from pairwright.operators import metrics

    x = spark.range(0, 300).select("id", (F.col("id") % 7).cast("double").alias("v"))
    got = metrics.bootstrap(x, [F.col("id")], F.sum(F.col("v") * F.col("times")) / F.sum("times"), 20, "s")
    before = spark.sparkContext.defaultParallelism * 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {before}, true" in plan
    assert got.count() == 20
