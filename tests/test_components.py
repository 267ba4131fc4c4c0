"""Components by contraction: shapes that are hard for label spreading, and the shared folder."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from pairwright.operators import graph


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def labels(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    return {r.node: r.comp for r in graph.components(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    g = random.Random(seed)
    n = g.choice([5, 60, 400])
    edges = [(g.randrange(n), g.randrange(n)) for _ in range(n)] + [(3, 3)]
    edges += edges[: n // 3] + [(b, a) for a, b in edges[: n // 4]]
    assert labels(spark, edges) == union_find(edges)


def test_no_edges_loops_and_nulls(spark):
    assert labels(spark, []) == {}
    assert labels(spark, [(4, 4), (None, 2), (2, None)]) == {4: 4}


def test_long_path_takes_few_rounds(spark, monkeypatch):
    """100,000 nodes in a row, with shuffled ids: a round less than halves them, whatever the order."""
    n = 100_000
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    path = spark.createDataFrame(list(zip(ids, ids[1:])), "a bigint, b bigint")
    rounds = []
    real = graph.give_way
    monkeypatch.setattr(graph, "give_way", lambda e, k: (rounds.append(e.count()), real(e, k))[1])
    out = graph.components(path)
    assert out.count() == n and out.where("comp <> 0").isEmpty()
    assert len(rounds) <= 17 and all(b <= 0.6 * a for a, b in zip(rounds, rounds[1:]) if a > 100)


@pytest.mark.parametrize("centre", [0, 2_000_000])
def test_star_of_a_million(spark, centre, monkeypatch):
    """A centre's edges meet its label in a broadcast, not in one task; no edge is joined after its ends are one."""
    star = spark.range(1, 1_000_001).select(F.lit(centre).alias("a"), F.col("id").alias("b"))
    rounds = []
    real = graph.give_way
    monkeypatch.setattr(graph, "give_way", lambda e, k: (rounds.append(e.count()), real(e, k))[1])
    out = graph.components(star)
    least = min(1, centre)
    assert out.count() == 1_000_001 and out.where(F.col("comp") != least).isEmpty()
    assert rounds[0] == 1_000_000 and sum(rounds[1:]) <= 1_000_000


def test_two_rounds_join_fewer_edges(spark, monkeypatch):
    """Finished components leave: of many small ones and a long chain only the chain is seen again."""
    g = random.Random(4)
    chain = list(range(10_000, 10_400))
    g.shuffle(chain)
    edges = [(3 * i, 3 * i + 1) for i in range(2000)] + list(zip(chain, chain[1:]))
    seen = []
    real = graph.give_way
    monkeypatch.setattr(graph, "give_way", lambda e, k: (seen.append(e.count()), real(e, k))[1])
    assert labels(spark, edges) == union_find(edges)
    assert seen[0] == len(edges) and seen[1] < len(chain)


def test_without_a_named_folder_tables_go_to_the_warehouse(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(sys.path[0])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "house")!r}).getOrCreate()
from pairwright.sources.shared import stored
assert stored(spark.range(3)).count() == 3
"""
    (tmp_path / "run.py").write_text(code)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list((tmp_path / "house" / "_scratch").glob("table-*/*.parquet"))
