"""Sampling pairs within groups without listing them.

All pairs of a group that have different identities (or the same one) get numbers: members are put in the order of
their identities, and each identity's block holds as many numbers as it has such pairs with the members before it
(or within itself). A number is turned back into two places by arithmetic, so a sample costs as many rows as it
has pairs, whatever the group's size, and none is drawn in vain.

The least hashes of all pairs can't be had so: each pair is hashed (`least_hashed`), on all cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed_hash import hash_order
from ..sources.shared import stored
from .joins import blocked, pairs_of_blocks

#: Groups with fewer than SPARE times as many pairs as wanted take the pairs of the least hashes instead of draws.
SPARE = 4


def wide_index(seed: str, n: Column, *parts: Column) -> Column:
    """A number in 0..n-1 from the first 15 hex digits."""
    return F.conv(F.substring(hash_order(seed, *parts), 1, 15), 16, 10).cast("bigint") % n


def blocks(df: DataFrame, group: str, identity: str, same: bool) -> DataFrame:
    """group, identity, size, before (members of the identities before), first (the block's first number), pairs (the group's)."""
    size = df.where(F.col(identity).isNotNull()).groupBy(group, identity).agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy(group).orderBy(identity)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    own = (F.col("size") * (F.col("size") - 1) / 2).cast("bigint") if same else F.col("size") * F.col("before")
    size = size.withColumn("own", own)
    return size.withColumn("first", F.coalesce(F.sum("own").over(earlier), F.lit(0))).withColumn("pairs", F.sum("own").over(Window.partitionBy(group)))


def numbers(groups: DataFrame, group: str, want: int, seed: str) -> DataFrame:
    """group, m: `want` different pair numbers of each group (group, pairs), or all if it has no more."""
    few = F.col("pairs") < SPARE * want
    tries = SPARE * want
    while True:
        t = F.when(few, F.col("pairs")).otherwise(F.lit(tries))
        drawn = groups.where("pairs > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), t - 1)))
        m = F.when(few, F.col("t")).otherwise(wide_index(seed, F.col("pairs"), F.col(group), F.col("t")))
        rank = F.when(few, hash_order(seed, F.col(group), F.col("t"))).otherwise(F.lpad(F.col("t").cast("string"), 20, "0"))
        first = drawn.select(group, "pairs", m.alias("m"), rank.alias("rank")).groupBy(group, "pairs", "m").agg(F.min("rank").alias("rank"))
        place = F.row_number().over(Window.partitionBy(group).orderBy("rank", "m"))
        out = stored(first.withColumn("place", place).where(F.col("place") <= want))
        # draws may meet; the first ones stay the same however many are made
        if out.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max("pairs").alias("pairs")).where(F.col("n") < F.least(F.lit(want), F.col("pairs"))).isEmpty():
            return out.select(group, "m")
        tries *= 2


def sampled_pairs(df: DataFrame, group: str, key: str, identity: str, want: int, seed: str, same: bool = False) -> DataFrame:
    """group, a, b (a < b): `want` pairs of each group with different identities (same: with one identity), drawn without
    replacement by hash, or all if there are no more. Rows without identity are in no pair; keys are unique within a group."""
    own = df.select(group, key, identity).where(F.col(identity).isNotNull())
    b = stored(blocks(own, group, identity, same))
    m = numbers(b.select(group, "pairs").distinct(), group, want, seed)
    # each number's block: the last one that begins at it or before, among blocks that have pairs
    marks = b.where("own > 0").select(group, F.col("first").alias("at"), F.lit(0).alias("kind"), F.struct("first", "before", "size").alias("block"))
    asked = m.select(group, F.col("m").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["block"].dataType).alias("block"))
    w = Window.partitionBy(group).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asked).withColumn("block", F.last("block", ignorenulls=True).over(w)).where("kind = 1")
    r, before = F.col("at") - F.col("block.first"), F.col("block.before")
    if same:
        # j (j - 1) / 2 <= r < j (j + 1) / 2; the root may be off by one
        j = F.floor((1 + F.sqrt(8 * r.cast("double") + 1)) / 2).cast("bigint")
        found = found.withColumn("r", r).withColumn("j", j)
        low = F.col("j") * (F.col("j") - 1) / 2 > F.col("r")
        high = F.col("j") * (F.col("j") + 1) / 2 <= F.col("r")
        found = found.withColumn("j", F.col("j") + F.when(low, -1).when(high, 1).otherwise(0))
        places = found.select(group, (before + F.col("r") - (F.col("j") * (F.col("j") - 1) / 2).cast("bigint")).alias("i"), (before + F.col("j")).alias("j"))
    else:
        places = found.select(group, (r % before).alias("i"), (before + F.floor(r / before)).alias("j"))
    member = own.select(F.col(group).alias("_group"), F.col(key).alias("_key"), (F.row_number().over(Window.partitionBy(group).orderBy(identity, key)) - 1).cast("bigint").alias("_place"))
    member = stored(member)
    for side in ("i", "j"):
        places = places.join(member.withColumnRenamed("_key", f"_{side}"), (F.col(group) == F.col("_group")) & (F.col(side) == F.col("_place"))).drop("_group", "_place")
    return places.select(group, F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"))


def least_hashed(df: DataFrame, group: str, key: str, identity: str, want: int, seed: str) -> DataFrame:
    """a, b (a < b): the `want` pairs of all groups' pairs with different identities that come first by hash, a and b, in that order.
    Of groups with several blocks the first blocks' own pairs are hashed before the others: no hash above their `want`-th is among
    the least of all, so hardly any pair but those wanted is sorted."""
    x = blocked(df.select(group, key, identity, F.col(key).cast("string").alias("text")), [group], key)

    def hashed(rows):
        p = pairs_of_blocks(rows, [group], key, [identity, "text"]).where(F.col(f"a_{identity}") != F.col(f"b_{identity}"))
        return p.select(hash_order(seed, F.col("a_text"), F.col("b_text")).alias("h"), "a", "b")

    few = hashed(x.where("_block = 0 and _blocks > 1").withColumn("_blocks", F.lit(1))).select("h").orderBy("h").limit(want)
    bound = few.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h")).first()
    p = hashed(x)
    if bound.n == want:
        p = p.where(F.col("h") <= bound.h)
    return p.orderBy("h", "a", "b").limit(want).select("a", "b")
