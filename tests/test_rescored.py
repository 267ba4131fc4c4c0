"""Candidates are ranked for each policy within their query's row."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.plans.q_scalar import policies, scored
from pairwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_are_not_repeated_for_each_policy_before_they_are_ranked(spark):
    got = QUERIES["ST6_top_k_after_rescoring"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.index("Generate") < plan.index("Aggregate")
    assert plan.count("bround(") < 10, "no score is computed anew in a filter"
    w = Window.partitionBy("policy", "query").orderBy(F.desc("score"), "candidate")
    want = policies(scored(spark, SF).where("descriptor = 'mega' and route <> 'non_comparable'")).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("policy", "query", "candidate")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
