"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies r = target / size of
the source. floor(r) copies are certain. The fraction is rounded by the pivotal method
on words: two units meet, words of probability mass move from one to the other at random
until one is integral, and the other goes on to meet the next; a source's very last unit is
rounded to the nearer copy. Words expected are the
same before and after each meeting, so a source's words miss its target by half a document at
most. Units meet within blocks of bounded size; what is left of a block is one unit of
the next level, up to a single unit for each source: a reduction tree.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of
its own, last in order; a source without words has target 0; no rows give no rows. Rows
with the same id and size are interchangeable. Within a block the longest units meet first, so
that the one that is left at the end is likely a short one. Random numbers come from hashes of ids and
sizes, so a rerun gives the same mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, kept, numbered, stored, text_of, unit

#: Units that meet one after another in one task's array.
BLOCK = 128
UNIT = "struct<rid:bigint,id:bigint,size:bigint,p:double>"


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Giving the excess of capped sources to the others by weight, again and again, ends at
    target = min(cap, level * weight); the level follows from running sums over the sources
    in the order of cap / weight. One row for each source takes part, not one for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _meet(a: Column, x: Column, seed: int) -> Column:
    """Units a and x (p in (0, 1)) meet: array of two structs (rid, id, size, p), one of them with p 0 or 1."""
    give = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # a to x
    take = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # x to a
    gives = unit(a["id"], a["size"], x["id"], x["size"], seed=seed) * (give + take) < take

    def made(u: Column, p: Column) -> Column:
        return F.struct(u["rid"].alias("rid"), u["id"].alias("id"), u["size"].alias("size"), p.alias("p"))

    a_p = F.when(gives, F.when(a["p"] * a["size"] <= (1 - x["p"]) * x["size"], F.lit(0.0)).otherwise(a["p"] - give / a["size"])).otherwise(
        F.when((1 - a["p"]) * a["size"] <= x["p"] * x["size"], F.lit(1.0)).otherwise(a["p"] + take / a["size"])
    )
    x_p = F.when(gives, F.when(a["p"] * a["size"] >= (1 - x["p"]) * x["size"], F.lit(1.0)).otherwise(x["p"] + give / x["size"])).otherwise(
        F.when((1 - a["p"]) * a["size"] >= x["p"] * x["size"], F.lit(0.0)).otherwise(x["p"] - take / x["size"])
    )
    return F.array(made(a, a_p), made(x, x_p))


def _level(units: DataFrame, level: int, seed: int, spread: DataFrame) -> DataFrame:
    """One level of the tree. units: source, u. spread: source, buckets. Returns source, done (array), rest (array of 0 or 1)."""
    known = units.join(spread, units["source"].eqNullSafe(spread["_source"]), "inner")
    h = F.xxhash64(F.lit(seed + 7 * level), F.col("u.id"), F.col("u.size"))
    known = known.withColumn("h", h).withColumn("bucket", F.pmod("h", "buckets"))
    rn = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", F.col("u.id"), F.col("u.size"), F.col("u.rid")))
    known = known.withColumn("block", F.floor((rn - 1) / F.lit(BLOCK)))
    sets = known.groupBy("source", "bucket", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("u.size")).alias("down"), F.col("h"), F.col("u")))).alias("us"))
    fraction = lambda u: (u["p"] > 0) & (u["p"] < 1)
    start = F.expr(f"named_struct('done', cast(array() as array<{UNIT}>), 'rest', cast(array() as array<{UNIT}>))")

    def step(acc: Column, hu: Column) -> Column:
        x = hu["u"]
        met = F.transform(acc["rest"], lambda a: _meet(a, x, seed + 13 * level))
        both = F.when(F.size(acc["rest"]) == 0, F.array(x)).otherwise(F.element_at(met, 1))
        # let both be evaluated once: a one-element array carries it through transform()
        return F.element_at(
            F.transform(F.array(both), lambda b: F.struct(F.concat(acc["done"], F.filter(b, lambda u: ~fraction(u))).alias("done"), F.filter(b, fraction).alias("rest"))),
            1,
        )

    return sets.select("source", F.aggregate("us", start, step).alias("r")).select("source", "r.done", "r.rest")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 11) -> DataFrame:
    """One row for each document: rid, doc_id, source, size, source_size, target, copies. Needs doc_id, source and text."""
    units = kept(numbered(docs, F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count().alias("size")), "mix-units")
    stats = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    goal = kept(targets(stats.select("source", "source_size"), weights, most).join(stats.select(F.col("source").alias("_s"), "n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    g = goal.withColumnRenamed("source", "_source")
    all_ = units.join(g, units["source"].eqNullSafe(g["_source"])).drop("_source")
    now = all_.where((F.col("size") > 0) & (F.col("p") > 0)).select("source", F.struct("rid", F.col("doc_id").alias("id"), "size", "p").alias("u"))
    rows = goal.agg(F.max("n")).first()[0] or 0
    done, level, counts = [], 0, goal.select(F.col("source").alias("_source"), "n")
    while True:
        spread = counts.select("_source", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK))).cast("bigint").alias("buckets"))
        got = kept(_level(now, level, seed, spread), "mix-level")
        done.append(got.select(F.explode("done").alias("u")).select("u.rid", F.col("u.p").cast("bigint").alias("more")))
        now = got.where(F.size("rest") > 0).select("source", F.element_at("rest", 1).alias("u"))
        if rows <= BLOCK:
            last = now.select("u.rid", (F.col("u.p") >= 0.5).cast("bigint").alias("more"))
            done.append(last)
            break
        counts = now.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("n"))
        rows, level = counts.agg(F.max("n")).first()[0] or 0, level + 1
    more = done[0]
    for d in done[1:]:
        more = more.unionByName(d)
    return all_.join(more, "rid", "left").select(
        "rid", "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("base") + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("copies"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The rows of docs that the mix takes, with mix_copies, mix_size and mix_target, which replace columns of these names."""
    rid = f"_rid_{uuid.uuid4().hex}"
    docs = stored(docs.drop("mix_copies", "mix_size", "mix_target"))
    m = mix(docs.select("doc_id", "source", "text"), weights, most).where("copies > 0")
    took = m.select(F.col("rid").alias(rid), F.col("copies").alias("mix_copies"), F.col("size").alias("mix_size"), F.col("target").alias("mix_target"))
    return numbered(docs, "*", name=rid).join(took, rid).drop(rid)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
