"""Pairs formed by pairs of blocks against lists of all pairs, and how they are dealt to tasks."""

import itertools
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pairwright.operators import joins, pairs

SCHEMA = "g string, id long, who long"


def some_rows(seed):
    r = random.Random(seed)
    rows = [(s, r.randrange(-50, 400), r.choice([1, 2, 3, None])) for s, n in (("x", 90), ("y", 17), ("z", 1), (None, 5)) for _ in range(n)]
    return [*rows, ("x", None, 1), ("x", 7, 1), ("x", 7, 2), ("x", 7, 2)]


def listed(rows):
    both = [(x, y) for x, y in itertools.permutations(rows, 2) if None not in (x[0], x[1], y[0], y[1]) and x[0] == y[0] and x[1] < y[1]]
    return [(x[0], x[1], x[2], y[1], y[2]) for x, y in both]


@pytest.mark.parametrize("block,blocks", [(1024, 32), (10, 32), (1, 5)])
def test_blocks_give_every_pair_once(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "BLOCKS", blocks)
    rows = some_rows(3)
    got = joins.pairs_within(spark.createDataFrame(rows, SCHEMA), ["g"], "id", ["who"]).select("g", "a", "a_who", "b", "b_who").collect()
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=order) == sorted(listed(rows), key=order)


def test_one_group_is_dealt_to_many_tasks(spark):
    df = spark.range(6000).select(F.lit("x").alias("g"), "id")
    n = [r["count"] for r in joins.pairs_within(df, ["g"], "id").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 6000 * 5999 // 2 and len(n) >= 8 and max(n) < sum(n) / 4


@pytest.mark.parametrize("block", [1024, 10, 1])
@pytest.mark.parametrize("want", [5, 50, 100_000])
def test_least_hashed_are_the_least_of_all(spark, monkeypatch, block, want):
    monkeypatch.setattr(joins, "BLOCK", block)
    rows = some_rows(5)
    hashed = sorted((sha256(f"s|{a}|{b}".encode()).hexdigest(), a, b) for _, a, v, b, w in listed(rows) if None not in (v, w) and v != w)
    got = pairs.least_hashed(spark.createDataFrame(rows, SCHEMA), "g", "id", "who", want, "s").collect()
    assert list(map(tuple, got)) == [(a, b) for _, a, b in hashed[:want]]


def test_least_hashed_where_first_blocks_have_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 10)
    df = spark.createDataFrame([("x", i, 1) for i in range(60)] + [("y", 1, 1), ("y", 2, 2), ("y", 3, None)], SCHEMA)
    assert list(map(tuple, pairs.least_hashed(df, "g", "id", "who", 5, "s").collect())) == [(1, 2)]
    assert pairs.least_hashed(df.limit(0), "g", "id", "who", 5, "s").count() == 0
