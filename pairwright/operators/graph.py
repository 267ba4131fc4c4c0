"""Pair graphs: components, degrees, folds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ranks import position


#: A key with more than one HOT-th of all rows is looked up in a broadcast, which has HOT rows at most.
HOT = 256
#: Rows that one task takes whatever their keys.
FEW = 10_000


def follow(rows: DataFrame, key: str, to: DataFrame) -> DataFrame:
    """rows with `key` replaced by its root where to (node, root) has one. Rows of a key that very many share aren't gathered."""
    to = to.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    if (number := rows.count()) <= FEW:  # no key has many rows
        return rows.join(to, F.col(key) == F.col("_node"), "left").withColumn(key, F.coalesce("_root", key)).drop("_node", "_root")
    often = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > number // HOT)
    often = stored(often.join(to, F.col("_key") == F.col("_node"), "left").select("_key", F.coalesce("_root", "_key").alias("_hot")))
    rows = rows.join(F.broadcast(often), F.col(key) == F.col("_key"), "left")
    other = rows.where(F.col("_key").isNull()).join(to, F.col(key) == F.col("_node"), "left").withColumn("_hot", F.coalesce("_root", key)).drop("_node", "_root")
    return rows.where(F.col("_key").isNotNull()).unionByName(other).withColumn(key, F.col("_hot")).drop("_key", "_hot")


def give_way(edges: DataFrame, number: int) -> DataFrame:
    """node, root of the nodes that give way in a round: each to its least neighbour, that one to its own, and so on.

    The least is the smallest id, so a star is done in two rounds and a chain in the order of its ids in one; in each third
    round it is the smallest hash, so half of the nodes give way, whatever the graph."""
    salt = F.lit(number)
    rank = lambda x: F.struct((F.xxhash64(x, salt) if number % 3 == 2 else F.lit(0).cast("bigint")).alias("h"), F.col(x).alias("id"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(rank("b")).alias("low")).where(F.col("low") < rank("a"))
    to = stored(least.select(F.col("a").alias("node"), F.col("low.id").alias("root")))
    # ways grow twice as long each time
    while not to.join(to.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
        to = stored(follow(to, "root", to))
    return to


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node id) of all ends of edges (a, b).

    Contraction: in each round nodes give way to others and edges go between those that are left; an edge whose ends have
    become one leaves, and so does a finished component. Then the rounds are followed back, the last first."""
    first = stored(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, rounds = first.where("a <> b"), []
    while not left.isEmpty():
        to = give_way(left, len(rounds))
        rounds.append(to)
        moved = follow(stored(follow(left, "a", to)), "b", to).where("a <> b")
        left = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if not rounds:
        return stored(ends.withColumn("comp", F.col("node")))
    whole = rounds[-1]
    for to in rounds[-2::-1]:
        whole = stored(follow(to, "root", whole).unionByName(whole))
    roots = stored(ends.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # only hashed rounds lead to others than the smallest id
    least = whole.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("comp")).where("comp <> root")
    return stored(follow(roots, "root", least.select(F.col("root").alias("node"), F.col("comp").alias("root"))).select("node", F.col("root").alias("comp")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def inventory(edges: DataFrame, comps: DataFrame) -> DataFrame:
    nodes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("n_nodes"))
    links = edges.join(comps, edges["a"] == comps["node"]).groupBy("comp").agg(F.count(F.lit(1)).alias("n_edges"))
    placed = position(nodes.join(links, "comp"), "_place", [F.col("comp")])
    return placed.select(F.concat(F.lit("component_"), F.lpad(F.col("_place").cast("string"), 6, "0")).alias("component_id"), "comp", "n_nodes", "n_edges")


def hashed_components(edges: DataFrame, comps: DataFrame, facts: DataFrame) -> DataFrame:
    """Id from the sorted members; size, largest degree and number of failed members."""
    members = F.array_join(F.array_sort(F.collect_list(F.col("node").cast("string"))), ",")
    return (
        comps.join(degrees(edges), "node").join(facts, "node").groupBy("comp")
        .agg(F.concat(F.lit("cmp_"), F.substring(F.sha2(members, 256), 1, 16)).alias("component_id"), F.count(F.lit(1)).alias("n"), F.max("degree").alias("max_degree"), F.count(F.when(F.col("failed"), 1)).alias("failures"))
        .drop("comp")
    )


def endpoint_leakage(df: DataFrame, a: str, b: str, fold: str) -> DataFrame:
    """Endpoints that occur in more than one fold."""
    return df.select(F.explode(F.array(a, b)).alias("node"), fold).groupBy("node").agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def disjoint_trees(edges: DataFrame, group: str, size: int, seed: str) -> DataFrame:
    """Trees of `size` edges that share no vertex, grown in seeded order within each group: sequential."""

    def grow(pdf):
        import pandas as pd

        rank = lambda *x: hashlib.sha256("|".join([seed, *map(str, x)]).encode()).hexdigest()
        rows = sorted(zip(pdf["a"].tolist(), pdf["b"].tolist()), key=lambda e: rank(*e))
        near: dict = {}
        for x, y in rows:
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        used, out, tree = set(), [], 0
        for x, y in rows:
            if x in used or y in used:
                continue
            nodes, links = [x, y], [(x, y)]
            i = 0
            while i < len(nodes) and len(links) < size:
                for z in sorted(near[nodes[i]], key=rank):
                    if z not in used and z not in nodes and len(links) < size:
                        nodes.append(z)
                        links.append((nodes[i], z))
                i += 1
            if len(links) == size:
                used.update(nodes)
                out += [(pdf[group].iloc[0], tree, *link) for link in links]
                tree += 1
        return pd.DataFrame(out, columns=[group, "tree", "a", "b"])

    t = dict(edges.dtypes)
    return edges.groupBy(group).applyInPandas(grow, f"{group} {t[group]}, tree bigint, a {t['a']}, b {t['b']}")


def _assign(rows, measures, folds, seed):
    """Greedy by size, then up to 50 passes of moves that lower the squared imbalance."""
    import numpy as np

    x = np.array([[float(r[m]) for m in measures] for r in rows]).reshape(len(rows), len(measures))
    share = np.maximum(x.sum(0) / folds, 1e-12)
    order = sorted(range(len(rows)), key=lambda i: (-x[i].sum(), hashlib.sha256(f"{seed}|{rows[i]['key']}".encode()).hexdigest()))
    load, fold = np.zeros((folds, len(measures))), [0] * len(rows)

    def cost(v):
        return (((v - share) / share) ** 2).sum()

    for i in order:
        fold[i] = min(range(folds), key=lambda f: (cost(load[f] + x[i]) - cost(load[f]), f))
        load[fold[i]] += x[i]
    for _ in range(50):
        moved = False
        for i in order:
            here = fold[i]
            gains = [(cost(load[here] - x[i]) + cost(load[f] + x[i]) - cost(load[here]) - cost(load[f]), f) for f in range(folds) if f != here]
            best = min(gains)
            if best[0] < -1e-12:
                load[here] -= x[i]
                load[best[1]] += x[i]
                fold[i], moved = best[1], True
        if not moved:
            break
    return fold


def balanced_folds(vectors: DataFrame, key: str, measures: list[str], folds: int, seed: str = "fold") -> DataFrame:
    """key, fold: whole components go to folds of like totals. One row for each component; sequential."""

    def run(pdf):
        pdf = pdf.sort_values(key)
        rows = pdf.rename(columns={key: "key"}).to_dict("records")
        return pdf[[key]].assign(fold=_assign(rows, measures, folds, seed))

    return vectors.select(key, *measures).groupBy(F.lit(0).alias("_one")).applyInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, fold bigint")


def nested_folds(vectors: DataFrame, key: str, measures: list[str], outer: int, inner: int) -> DataFrame:
    """For each outer fold the inner folds of the other components."""
    o = balanced_folds(vectors, key, measures, outer).withColumnRenamed("fold", "own")
    rest = vectors.join(o, key).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(outer - 1)))).where("outer <> own")

    def run(pdf):
        pdf = pdf.sort_values(key)
        rows = pdf.rename(columns={key: "key"}).to_dict("records")
        return pdf[["outer", key]].assign(inner=_assign(rows, measures, inner, f"inner{pdf['outer'].iloc[0]}"))

    return rest.groupBy("outer").applyInPandas(run, f"outer int, {key} {dict(vectors.dtypes)[key]}, inner bigint")
