"""Policies meet the combinations of what they see of a row, not the rows."""

from pairwright.plans.queries import QUERIES


def test_rows_are_counted_before_they_meet_the_grid(spark):
    df = QUERIES["CND18_policy_assignment"](spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert "Aggregate" in lines[join + 1]
