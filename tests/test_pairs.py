"""Pairs drawn by number against lists of all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import pairs

SCHEMA = "g string, id long, who long"


@pytest.mark.parametrize("same", [False, True])
def test_all_pairs_are_numbered(spark, same):
    g = random.Random(1)
    rows = [(s, i, g.choice([1, 1, 1, 2, 3, 9, None])) for s, n in (("x", 14), ("y", 3), ("z", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and None not in (a[2], b[2]) and (a[2] == b[2]) == same}
    got = [tuple(r) for r in pairs.sampled_pairs(df, "g", "id", "who", 1000, "s", same).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("same", [False, True])
def test_a_sample_is_different_pairs_and_repeats(spark, same):
    rows = [("x", i, i % 7) for i in range(200)] + [("y", i, 0) for i in range(5)] + [("y", 9, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda d, n: sorted(map(tuple, pairs.sampled_pairs(d, "g", "id", "who", n, "s", same).collect()))
    got = run(df, 40)
    who = {(g, i): w for g, i, w in rows}
    assert all(a < b and (who[g, a] == who[g, b]) == same for g, a, b in got) and len(set(got)) == len(got)
    assert sum(g == "x" for g, _, _ in got) == 40 and sum(g == "y" for g, _, _ in got) == (10 if same else 5)
    assert got == run(df.repartition(7), 40)
    assert {p for p in run(df, 20) if p[0] == "x"} <= set(got)


def test_pairs_are_drawn_alike(spark):
    df = spark.createDataFrame([("x", i, i % 4) for i in range(12)], SCHEMA)
    seen = {}
    for s in range(12):
        for _, a, b in pairs.sampled_pairs(df, "g", "id", "who", 9, f"seed{s}").collect():
            seen[a, b] = seen.get((a, b), 0) + 1
    assert len(seen) > 40 and max(seen.values()) <= 7


def test_a_million_members_and_no_self_join(spark):
    df = spark.range(1_000_000).select(F.lit("x").alias("g"), "id", (F.col("id") % 1000).alias("who"))
    out = pairs.sampled_pairs(df, "g", "id", "who", 100, "s")
    assert out.count() == 100 and out.where("a % 1000 = b % 1000").isEmpty()
    empty = df.limit(0)
    assert pairs.sampled_pairs(empty, "g", "id", "who", 5, "s").count() == 0
