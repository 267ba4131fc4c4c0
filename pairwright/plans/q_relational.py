"""Joins, aggregates, sorts and sets (JN, AG, ST, SO)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keyed_hash as H
from ..operators import joins as J
from ..operators import knn, ranks
from ..operators import pairs as P
from ..operators import sets as S
from . import tables as T
from .q_scalar import policies, scored
from .registry import query

c, t = F.col, T.table


def r6(x):
    return F.round(x, 6)


def n_():
    return F.count(F.lit(1))


# ---------------------------------------------------------------- joins


@query("JN1_inner_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jn1(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).groupBy("n_name").agg(n_().alias("n"))


@query("JN2_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def jn2(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return t(spark, sf, "customer").join(o, c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("JN3_full_join", "SELECT coalesce(m.query, d.query) AS q, coalesce(m.candidate, d.candidate) AS k, m.similarity AS similarity_mega, d.similarity AS similarity_dino FROM (SELECT * FROM memberships WHERE descriptor = 'mega') m FULL JOIN (SELECT * FROM memberships WHERE descriptor = 'dino') d ON m.query = d.query AND m.candidate = d.candidate", "memberships")
def jn3(spark, sf):
    m = T.memberships(spark, sf)
    return J.full_with_suffixes(m.where("descriptor = 'mega'").select(c("query").alias("q"), c("candidate").alias("k"), "similarity"), m.where("descriptor = 'dino'").select(c("query").alias("q"), c("candidate").alias("k"), "similarity"), ["q", "k"], ("_mega", "_dino"))


@query("JN4_checked_join", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def jn4(spark, sf):
    return J.one_to_one(t(spark, sf, "labels").select("doc_id", "quality"), t(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"])


@query("JN5_match_indicator", "SELECT CASE WHEN l.doc_id IS NULL THEN 'right_only' WHEN d.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT -5) l FULL JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1")
def jn5(spark, sf):
    left = t(spark, sf, "labels").select("doc_id").union(spark.range(-5, -4).toDF("doc_id"))
    return J.with_indicator(left, t(spark, sf, "documents").select("doc_id"), ["doc_id"], "side").groupBy("side").agg(n_().alias("n"))


@query("JN6_lookup_missing_fatal", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def jn6(spark, sf):
    left = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", c("l_suppkey").alias("s_suppkey"))
    return J.lookup(left, t(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], ["s_name"]).select("l_orderkey", "l_linenumber", "s_name")


@query("JN7_composite_key", "SELECT s.descriptor, s.query, s.candidate, m.rank, s.route FROM scored s JOIN memberships m ON s.descriptor = m.descriptor AND s.query = m.query AND s.candidate = m.candidate", "scored")
def jn7(spark, sf):
    members = T.memberships(spark, sf)
    m = members.select("descriptor", "query", "candidate", "rank")
    return scored(spark, sf, members).select("descriptor", "query", "candidate", "route").join(m, ["descriptor", "query", "candidate"]).select("descriptor", "query", "candidate", "rank", "route")


@query("JN8_endpoint_double_join", "SELECT a, b, x.site AS a_site, y.site AS b_site, x.sharp AS a_sharp, y.sharp AS b_sharp FROM pairs JOIN images x ON a = x.image_id JOIN images y ON b = y.image_id", "pairs", "images")
def jn8(spark, sf):
    im = T.images(spark, sf).select("image_id", "site", "sharp")
    return J.endpoints(T.pairs(spark, sf).select("a", "b"), im, "image_id", {"a": "a_", "b": "b_"})


@query("JN9_both_direction_lookup", "SELECT m.query, m.candidate, p.n_members FROM memberships m JOIN pairs p ON least(m.query, m.candidate) = p.a AND greatest(m.query, m.candidate) = p.b WHERE m.descriptor = 'mega'", "pairs")
def jn9(spark, sf):
    members = T.memberships(spark, sf)
    m = members.where("descriptor = 'mega'").select("query", "candidate")
    p = T.pairs(spark, sf, members).select("a", "b", "n_members")
    return m.withColumn("a", F.least("query", "candidate")).withColumn("b", F.greatest("query", "candidate")).join(p, ["a", "b"]).select("query", "candidate", "n_members")


@query("JN10_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn10(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'"), c("o_custkey") == c("c_custkey"), "left_semi").select("o_orderkey")


@query("JN11_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def jn11(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("JN12_pairs_within_group", "SELECT x.identity, x.site, x.image_id AS a, y.image_id AS b FROM images x JOIN images y ON x.identity = y.identity AND x.site = y.site AND x.image_id < y.image_id", "images")
def jn12(spark, sf):
    return J.pairs_within(T.images(spark, sf).select("identity", "site", "image_id"), ["identity", "site"], "image_id")


@query("JN13_knn_join", "SELECT query, candidate, similarity, rank FROM memberships WHERE descriptor = 'mega'", "memberships")
def jn13(spark, sf):
    return knn.knn(T.vectors(spark, sf), 20)


@query("JN14_knn_normalised", "SELECT query, candidate, similarity, rank FROM memberships WHERE descriptor = 'dino' AND rank <= 5", "memberships")
def jn14(spark, sf):
    return knn.knn(T.halves(spark, sf), 5, block=128, unit=True)


@query("JN15_pos_neg_pairs", "SELECT count(*) AS n_pairs, count(*) FILTER (x.p > z.p) AS wins, count(*) FILTER (x.p = z.p) AS ties FROM outcomes x JOIN outcomes z ON x.y = 1 AND z.y = 0", "outcomes")
def jn15(spark, sf):
    """Counts of the positive-negative pairs from value counts: no pair is formed."""
    g = T.outcomes(spark, sf).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - c("y")).alias("neg"))
    g = ranks.running(g, [c("p")], c("neg")).withColumnRenamed("_below", "below")
    return g.agg((F.sum("pos") * F.sum("neg")).alias("n_pairs"), F.sum(c("pos") * c("below")).alias("wins"), F.sum(c("pos") * c("neg")).alias("ties"))


@query("JN16_pareto", "WITH e AS (SELECT fold, lang, avg(p) AS u, avg(p2) AS v FROM outcomes GROUP BY 1, 2) SELECT fold, lang FROM e x WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.fold = x.fold AND o.u >= x.u AND o.v >= x.v AND (o.u > x.u OR o.v > x.v))", "outcomes")
def jn16(spark, sf):
    e = T.outcomes(spark, sf).groupBy("fold", "lang").agg(F.avg("p").alias("u"), F.avg("p2").alias("v"))
    return J.pareto(e, ["fold"], ["u", "v"]).select("fold", "lang")


@query("JN17_threshold_grid", "SELECT k / 20.0::DOUBLE AS tau, count(*) FILTER (p >= k / 20.0) AS kept, coalesce(sum(y) FILTER (p >= k / 20.0), 0)::BIGINT AS pos FROM outcomes, range(21) g(k) GROUP BY 1", "outcomes")
def jn17(spark, sf):
    g = spark.range(21).select((c("id") / 20.0).alias("tau"))
    ok = c("p") >= c("tau")
    return T.outcomes(spark, sf).crossJoin(F.broadcast(g)).groupBy("tau").agg(F.count(F.when(ok, 1)).alias("kept"), F.coalesce(F.sum(F.when(ok, c("y"))), F.lit(0)).alias("pos"))


@query("JN18_parameter_grid", "SELECT a.a, b.b, c.c FROM (VALUES (1), (2), (3)) a(a), (VALUES ('x'), ('y')) b(b), (VALUES (true), (false)) c(c)")
def jn18(spark, sf):
    return J.grid(spark, {"a": [1, 2, 3], "b": ["x", "y"], "c": [True, False]}, "a int, b string, c boolean")


@query("JN19_greedy_nearest_match")
def jn19(spark, sf):
    o = T.outcomes(spark, sf)
    return J.greedy_match(o.where("y = 1").select("lang", "id", "p"), o.where("y = 0").select("lang", "id", "p"), "lang", "id", "p")


@query("JN20_ecdf_lookup", "SELECT x.id, round(count(z.id) FILTER (z.p2 <= x.p) / count(z.id)::DOUBLE, 6) AS ecdf FROM outcomes x, outcomes z GROUP BY 1", "outcomes")
def jn20(spark, sf):
    o = T.outcomes(spark, sf)
    return ranks.ecdf(o.select("id", "p"), "p", o, "p2", "ecdf").select("id", r6(c("ecdf")).alias("ecdf"))


@query(
    "JN21_strided_negatives",
    "WITH g AS (SELECT image_id, identity, row_number() OVER (ORDER BY image_id) - 1 AS i, count(*) OVER () AS n FROM images) SELECT x.image_id AS a, y.image_id AS b, j.j FROM g x, range(1, 4) j(j), g y WHERE y.i = (x.i + 37 * j.j) % x.n AND x.identity <> y.identity",
    "images",
)
def jn21(spark, sf):
    im = ranks.position(T.images(spark, sf).select("image_id", "identity"), "i", [c("image_id")], total="n").withColumn("i", c("i") - 1)
    return J.strided(im, "image_id", "i", "n", 37, 3).where(c("identity") != c("other_identity")).select("a", "b", "j")


@query("JN22_circular_neighbours", "WITH g AS (SELECT image_id, row_number() OVER (PARTITION BY identity ORDER BY image_id) - 1 AS i, count(*) OVER (PARTITION BY identity) AS n, identity FROM images) SELECT x.image_id AS a, y.image_id AS b, k.k AS j FROM g x, range(1, 3) k(k), g y WHERE x.identity = y.identity AND y.i = (x.i + k.k) % x.n AND x.image_id <> y.image_id", "images")
def jn22(spark, sf):
    im = ranks.position(T.images(spark, sf).select("image_id", "identity"), "i", [c("image_id")], ["identity"], "n").withColumn("i", c("i") - 1)
    return J.strided(im, "image_id", "i", "n", 1, 2, ["identity"]).where("a <> b").select("a", "b", "j")


@query(
    "JN23_cross_scope_strided",
    "WITH w AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM images WHERE domain = 'wild'), u AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i, count(*) OVER () AS n FROM images WHERE domain = 'urban') SELECT w.image_id AS a, u.image_id AS b FROM w JOIN u ON u.i = (w.i + 17 * 2) % u.n",
    "images",
)
def jn23(spark, sf):
    im = T.images(spark, sf).select("image_id", "domain")
    w = ranks.position(im.where("domain = 'wild'"), "i", [c("image_id")]).select(c("image_id").alias("a"), (c("i") - 1).alias("i"))
    u = ranks.position(im.where("domain = 'urban'"), "k", [c("image_id")], total="n").select(c("image_id").alias("b"), (c("k") - 1).alias("k"), "n")
    n = u.agg(F.max("n").alias("m"))
    return w.crossJoin(F.broadcast(n)).withColumn("k", (c("i") + 34) % c("m")).join(u.drop("n"), "k").select("a", "b")


@query("JN24_hash_ordered_pairs", "SELECT a, b FROM (SELECT x.image_id AS a, y.image_id AS b, sha256('neg|' || x.image_id::VARCHAR || '|' || y.image_id::VARCHAR) AS h FROM images x JOIN images y ON x.site = y.site AND x.image_id < y.image_id AND x.identity <> y.identity) ORDER BY h, a, b LIMIT 50", "images")
def jn24(spark, sf):
    return P.least_hashed(T.images(spark, sf).select("site", "image_id", "identity"), "site", "image_id", "identity", 50, "neg")


#: Numbers of pairs with different identities by blocks of identities, draws of 40 of each site, places by number.
_SAMPLED = """WITH b AS (SELECT site, identity, count(*) AS size FROM images WHERE identity IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, coalesce(sum(size) OVER w, 0)::BIGINT AS before FROM b WINDOW w AS (PARTITION BY site ORDER BY identity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, coalesce(sum(size * before) OVER w, 0)::BIGINT AS first, (sum(size * before) OVER (PARTITION BY site))::BIGINT AS pairs FROM c WINDOW w AS (PARTITION BY site ORDER BY identity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT site, pairs, x.t, sha256('neg|' || site || '|' || x.t::VARCHAR) AS h FROM (SELECT DISTINCT site, pairs FROM d), range(640) x(t) WHERE x.t < CASE WHEN pairs < 160 THEN pairs ELSE 640 END),
m AS (SELECT site, CASE WHEN pairs < 160 THEN t ELSE ('0x' || substr(h, 1, 15))::BIGINT % pairs END AS m, min(CASE WHEN pairs < 160 THEN h ELSE lpad(t::VARCHAR, 20, '0') END) AS rank FROM t GROUP BY 1, 2),
k AS (SELECT site, m FROM m QUALIFY row_number() OVER (PARTITION BY site ORDER BY rank, m) <= 40),
p AS (SELECT k.site, (m - first) % before AS i, before + (m - first) // before AS j FROM k JOIN d ON k.site = d.site AND m >= first AND m < first + size * before),
r AS (SELECT site, image_id, row_number() OVER (PARTITION BY site ORDER BY identity, image_id) - 1 AS place FROM images WHERE identity IS NOT NULL)
SELECT p.site, least(x.image_id, y.image_id) AS a, greatest(x.image_id, y.image_id) AS b FROM p JOIN r x ON x.site = p.site AND x.place = i JOIN r y ON y.site = p.site AND y.place = j"""


@query("JN24_sampled_pairs", _SAMPLED, "images")
def jn24_sampled(spark, sf):
    return P.sampled_pairs(T.images(spark, sf).select("site", "image_id", "identity"), "site", "image_id", "identity", 40, "neg")


@query("JN25_coverage_check", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS missing, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unexpected")
def jn25(spark, sf):
    return J.coverage(t(spark, sf, "labels"), t(spark, sf, "documents"), ["doc_id"])


@query("JN26_consensus_intersection", "SELECT least(m.query, m.candidate) AS a, greatest(m.query, m.candidate) AS b, count(*) AS directions, max(greatest(m.rank, d.rank)) AS worst FROM memberships m JOIN memberships d ON m.query = d.query AND m.candidate = d.candidate AND m.descriptor = 'mega' AND d.descriptor = 'dino' GROUP BY 1, 2", "memberships")
def jn26(spark, sf):
    m = T.memberships(spark, sf)
    j = m.where("descriptor = 'mega'").select("query", "candidate", c("rank").alias("r1")).join(m.where("descriptor = 'dino'").select("query", "candidate", c("rank").alias("r2")), ["query", "candidate"])
    return j.groupBy(F.least("query", "candidate").alias("a"), F.greatest("query", "candidate").alias("b")).agg(n_().alias("directions"), F.max(F.greatest("r1", "r2")).alias("worst"))


@query("JN27_linkage_chain", "SELECT r_name, count(DISTINCT o_orderkey) AS orders, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def jn27(spark, sf):
    small = t(spark, sf, "customer").join(t(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey")).join(t(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")).select("c_custkey", "r_name")
    o = t(spark, sf, "orders").join(small, c("o_custkey") == c("c_custkey")).select("o_orderkey", "r_name")
    return t(spark, sf, "lineitem").select("l_orderkey").join(o, c("l_orderkey") == c("o_orderkey")).groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("orders"), n_().alias("lines"))


# ---------------------------------------------------------------- aggregates


@query("AG1_group_mean_sum", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2")
def ag1(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(n_().alias("n"), r6(F.avg("l_quantity")).alias("mean_qty"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("AG2_named_agg_first", "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, arg_min(lang, doc_id) AS first_lang FROM documents GROUP BY 1")
def ag2(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(n_().alias("n"), r6(F.avg("n_chars")).alias("mean"), F.min_by("lang", "doc_id").alias("first_lang"))


@query("AG3_conditional_rate", "SELECT descriptor, query, count(*) AS n, count(*) FILTER (same) AS hits, round(avg(same::INT), 6) AS rate FROM evidence GROUP BY 1, 2", "evidence")
def ag3(spark, sf):
    return T.evidence(spark, sf).groupBy("descriptor", "query").agg(n_().alias("n"), F.count(F.when(c("same"), 1)).alias("hits"), r6(F.avg(c("same").cast("int"))).alias("rate"))


@query("AG4_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def ag4(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("AG5_two_level", "SELECT descriptor, round(avg(f), 6) AS mean_false, count(*) AS queries FROM (SELECT descriptor, query, count(*) FILTER (NOT same AND rank <= 5) AS f FROM evidence GROUP BY 1, 2) GROUP BY 1", "evidence")
def ag5(spark, sf):
    q = T.evidence(spark, sf).groupBy("descriptor", "query").agg(F.count(F.when(~c("same") & (c("rank") <= 5), 1)).alias("f"))
    return q.groupBy("descriptor").agg(r6(F.avg("f")).alias("mean_false"), n_().alias("queries"))


@query("AG6_frequency_table", "SELECT n_members, count(*) AS n FROM pairs GROUP BY 1", "pairs")
def ag6(spark, sf):
    return T.pairs(spark, sf).groupBy("n_members").agg(n_().alias("n"))


@query("AG7_set_category", "SELECT category, count(*) AS n FROM (SELECT CASE WHEN count(DISTINCT descriptor) = 2 THEN 'both' WHEN min(descriptor) = 'mega' THEN 'megadescriptor_only' ELSE 'dinov2_only' END AS category FROM memberships GROUP BY least(query, candidate), greatest(query, candidate)) GROUP BY 1", "memberships")
def ag7(spark, sf):
    m = T.memberships(spark, sf)
    s = m.groupBy(F.least("query", "candidate").alias("a"), F.greatest("query", "candidate").alias("b")).agg(F.collect_set("descriptor").alias("s"))
    cat = F.when(F.size("s") == 2, "both").when(F.array_contains("s", "mega"), "megadescriptor_only").otherwise("dinov2_only")
    return s.groupBy(cat.alias("category")).agg(n_().alias("n"))


@query("AG8_max_keep_best", "SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order FROM orders GROUP BY 1")
def ag8(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", F.struct("o_totalprice", -c("o_orderkey"))).alias("best_order"))


@query("AG9_argmax_row", "SELECT descriptor, query, candidate, review FROM (SELECT *, row_number() OVER (PARTITION BY descriptor, query ORDER BY review DESC, candidate) AS rn FROM scored) WHERE rn = 1", "scored")
def ag9(spark, sf):
    return S.keep_first(scored(spark, sf), ["descriptor", "query"], [F.desc("review"), c("candidate")]).select("descriptor", "query", "candidate", "review")


@query("AG10_weighted_mean", "SELECT fold, round(sum(w * p) / sum(w), 6) AS m FROM outcomes GROUP BY 1", "outcomes")
def ag10(spark, sf):
    return T.outcomes(spark, sf).groupBy("fold").agg(r6(F.sum(c("w") * c("p")) / F.sum("w")).alias("m"))


@query("AG11_quantiles", "SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def ag11(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), r6(F.percentile("l_extendedprice", F.lit(0.5))).alias("median"), r6(F.percentile("l_extendedprice", F.lit(0.9))).alias("q90"))


@query("AG12_group_stats", "SELECT lang, count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, round(stddev_samp(p) / sqrt(count(*)), 6) AS se FROM outcomes GROUP BY 1", "outcomes")
def ag12(spark, sf):
    return T.outcomes(spark, sf).groupBy("lang").agg(n_().alias("n"), r6(F.avg("p")).alias("mean"), r6(F.stddev_samp("p")).alias("sd"), r6(F.stddev_samp("p") / F.sqrt(n_())).alias("se"))


@query("AG13_crosstab", "SELECT lang, count(*) FILTER (y = 0) AS y0, count(*) FILTER (y = 1) AS y1 FROM outcomes GROUP BY 1", "outcomes")
def ag13(spark, sf):
    return T.outcomes(spark, sf).groupBy("lang").pivot("y", [0, 1]).count().fillna(0).select("lang", c("0").alias("y0"), c("1").alias("y1"))


@query("AG14_pivot_long_wide", "SELECT query, max(similarity) FILTER (descriptor = 'mega') AS mega, max(similarity) FILTER (descriptor = 'dino') AS dino FROM memberships WHERE rank = 1 GROUP BY 1", "memberships")
def ag14(spark, sf):
    return T.memberships(spark, sf).where("rank = 1").groupBy("query").pivot("descriptor", ["mega", "dino"]).agg(F.first("similarity"))


@query("AG15_pivot_mean", "SELECT l_shipmode_year, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS r FROM (SELECT *, year(l_shipdate) AS l_shipmode_year FROM lineitem) GROUP BY 1")
def ag15(spark, sf):
    x = t(spark, sf, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("l_shipmode_year"), "l_returnflag", "l_quantity")
    return x.groupBy("l_shipmode_year").pivot("l_returnflag", ["A", "N", "R"]).agg(r6(F.avg("l_quantity"))).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("AG16_size_unstack", "SELECT status, count(*) FILTER (priority = '1-URGENT') AS urgent, count(*) FILTER (priority = '5-LOW') AS low FROM frame GROUP BY 1", "frame")
def ag16(spark, sf):
    return T.frame(spark, sf).groupBy("status").pivot("priority", ["1-URGENT", "5-LOW"]).count().fillna(0).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("AG17_wide_to_long", "SELECT image_id, 'sharp' AS rating, sharp AS value FROM images UNION ALL SELECT image_id, 'visible', visible FROM images UNION ALL SELECT image_id, 'clip', clip FROM images", "images")
def ag17(spark, sf):
    return T.images(spark, sf).unpivot("image_id", ["sharp", "visible", "clip"], "rating", "value")


@query("AG18_grouping_sets", "SELECT lang, source, fold, count(*) AS n, round(avg(p), 6) AS m FROM outcomes GROUP BY GROUPING SETS ((), (lang), (source), (fold))", "outcomes")
def ag18(spark, sf):
    return T.outcomes(spark, sf).groupingSets([[], ["lang"], ["source"], ["fold"]], "lang", "source", "fold").agg(n_().alias("n"), r6(F.avg("p")).alias("m"))


@query("AG19_rollup_all", "SELECT coalesce(lang, 'all') AS axis, count(*) AS n, round(avg(y), 6) AS rate FROM outcomes GROUP BY ROLLUP (lang)", "outcomes")
def ag19(spark, sf):
    return T.outcomes(spark, sf).rollup("lang").agg(n_().alias("n"), r6(F.avg("y")).alias("rate")).select(F.coalesce("lang", F.lit("all")).alias("axis"), "n", "rate")


_LATEST = "SELECT packet, reviewer, arg_max(decision, (ts, event_id)) AS decision FROM reviews GROUP BY 1, 2"


@query(
    "AG20_majority_vote",
    f"WITH l AS ({_LATEST}), k AS (SELECT packet, decision, count(*) AS n, min(reviewer) AS first FROM l GROUP BY 1, 2), top AS (SELECT packet, decision FROM (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY n DESC, first) AS rn FROM k) WHERE rn = 1) SELECT packet, top.decision AS majority, v.votes, v.unanimous FROM top JOIN (SELECT packet, string_agg(decision, ';' ORDER BY reviewer) AS votes, count(DISTINCT decision) = 1 AS unanimous FROM l GROUP BY 1) v USING (packet)",
    "reviews",
)
def ag20(spark, sf):
    return S.majority(S.keep_last(T.reviews(spark, sf), ["packet", "reviewer"], ["ts", "event_id"]), "packet", "reviewer", "decision")


@query("AG21_conservative_double_review", f"WITH l AS (SELECT * FROM ({_LATEST}) WHERE reviewer IN (0, 1)) SELECT packet, count(*) = 2 AS complete, CASE WHEN count(*) = 2 THEN bool_and(decision = 'review_ready') END AS ready FROM l GROUP BY 1", "reviews")
def ag21(spark, sf):
    last = S.keep_last(T.reviews(spark, sf).where(c("reviewer").isin(0, 1)), ["packet", "reviewer"], ["ts", "event_id"])
    return S.conservative(last, "packet", "decision", "review_ready")


@query(
    "AG22_adjudicated_outcome",
    f"WITH l AS ({_LATEST}), two AS (SELECT packet, max(decision) FILTER (reviewer = 0) AS d0, max(decision) FILTER (reviewer = 1) AS d1, max(decision) FILTER (reviewer = 2) AS d2 FROM l GROUP BY 1) SELECT packet, CASE WHEN d0 = d1 THEN d0 ELSE d2 END AS label, CASE WHEN d0 = d1 THEN 'agreement' WHEN d2 IS NOT NULL THEN 'adjudication' ELSE 'open' END AS label_source FROM two WHERE d0 IS NOT NULL AND d1 IS NOT NULL",
    "reviews",
)
def ag22(spark, sf):
    return S.adjudicated(S.keep_last(T.reviews(spark, sf), ["packet", "reviewer"], ["ts", "event_id"]), "packet", "reviewer", "decision", (0, 1), 2)


@query("AG23_reason_union", "SELECT packet, string_agg(DISTINCT decision, ';' ORDER BY decision) AS reasons FROM reviews GROUP BY 1", "reviews")
def ag23(spark, sf):
    return T.reviews(spark, sf).groupBy("packet").agg(F.array_join(F.array_sort(F.collect_set("decision")), ";").alias("reasons"))


@query("AG24_component_sums", "SELECT comp, sum(w)::BIGINT AS w, round(sum(w * (p - p2)), 6) AS wd FROM outcomes GROUP BY 1", "outcomes")
def ag24(spark, sf):
    return T.outcomes(spark, sf).groupBy("comp").agg(F.sum("w").alias("w"), r6(F.sum(c("w") * (c("p") - c("p2")))).alias("wd"))


@query("AG25_kish", "SELECT fold, round(pow(sum(w), 2) / sum(w * w), 6) AS ess FROM outcomes GROUP BY 1", "outcomes")
def ag25(spark, sf):
    return T.outcomes(spark, sf).groupBy("fold").agg(r6(F.pow(F.sum("w"), F.lit(2)) / F.sum(c("w") * c("w"))).alias("ess"))


@query("AG26_matched_difference", "SELECT source, round(hi - lo, 6) AS diff FROM (SELECT source, avg(y) FILTER (p >= 0.5) AS hi, avg(y) FILTER (p < 0.5) AS lo FROM outcomes GROUP BY 1) WHERE hi IS NOT NULL AND lo IS NOT NULL", "outcomes")
def ag26(spark, sf):
    x = T.outcomes(spark, sf).withColumn("g", F.when(c("p") >= 0.5, "hi").otherwise("lo")).groupBy("source").pivot("g", ["hi", "lo"]).agg(F.avg("y"))
    return x.where("hi is not null and lo is not null").select("source", r6(c("hi") - c("lo")).alias("diff"))


@query("AG27_tie_summary", "SELECT count(*) AS n, count(DISTINCT v) AS uniq, (SELECT sum(k)::BIGINT FROM (SELECT count(*) AS k FROM images GROUP BY sharp HAVING count(*) > 1)) AS tied FROM (SELECT sharp AS v FROM images)", "images")
def ag27(spark, sf):
    g = T.images(spark, sf).groupBy("sharp").agg(n_().alias("k"))
    return g.agg(F.sum("k").alias("n"), n_().alias("uniq"), F.sum(F.when(c("k") > 1, c("k"))).alias("tied"))


@query("AG28_set_overlap", "WITH m AS (SELECT DISTINCT query AS q, candidate AS k FROM memberships WHERE descriptor = 'mega'), d AS (SELECT DISTINCT query AS q, candidate AS k FROM memberships WHERE descriptor = 'dino') SELECT coalesce(m.q, d.q) AS q, count(*) FILTER (m.k IS NOT NULL AND d.k IS NOT NULL) AS both_, count(*) AS either, round(count(*) FILTER (m.k IS NOT NULL AND d.k IS NOT NULL) / count(*)::DOUBLE, 6) AS jaccard FROM m FULL JOIN d ON m.q = d.q AND m.k = d.k GROUP BY 1", "memberships")
def ag28(spark, sf):
    m = T.memberships(spark, sf).groupBy(c("query").alias("q"), "candidate").agg(F.countDistinct("descriptor").alias("n"))
    both = F.count(F.when(c("n") == 2, 1))
    return m.groupBy("q").agg(both.alias("both_"), n_().alias("either"), r6(both / n_()).alias("jaccard"))


@query("AG29_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ag29(spark, sf):
    return S.duplicate_keys(t(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query("AG30_fold_share", "SELECT fold, round(sum(w * (p - p2)) / sum(sum(w * (p - p2))) OVER (), 6) AS share FROM outcomes GROUP BY 1", "outcomes")
def ag30(spark, sf):
    g = T.outcomes(spark, sf).groupBy("fold").agg(F.sum(c("w") * (c("p") - c("p2"))).alias("d"))
    return g.select("fold", r6(c("d") / F.sum("d").over(Window.partitionBy(F.lit(1)))).alias("share"))


@query("AG31_oracle_regret", "SELECT comp, round(sum(w * (pow(p - y, 2) - least(pow(p - y, 2), pow(p2 - y, 2)))) / sum(w), 6) AS regret FROM outcomes GROUP BY 1", "outcomes")
def ag31(spark, sf):
    a, b = F.pow(c("p") - c("y"), F.lit(2)), F.pow(c("p2") - c("y"), F.lit(2))
    return T.outcomes(spark, sf).groupBy("comp").agg(r6(F.sum(c("w") * (a - F.least(a, b))) / F.sum("w")).alias("regret"))


# ---------------------------------------------------------------- sort, limit, sets


@query("ST1_multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def st1(spark, sf):
    top = t(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)
    w = Window.partitionBy(F.lit(1)).orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return top.select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"))


@query("ST2_stable_reverse_sort", "SELECT query, candidate FROM (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY admissible DESC, pct DESC, candidate) AS rn FROM scored WHERE descriptor = 'mega') WHERE rn <= 2", "scored")
def st2(spark, sf):
    w = Window.partitionBy("query").orderBy(F.desc("admissible"), F.desc("pct"), "candidate")
    return scored(spark, sf).where("descriptor = 'mega'").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("query", "candidate")


@query("ST3_hash_order", "SELECT image_id, row_number() OVER (ORDER BY sha256('seed|' || image_id::VARCHAR)) AS place FROM images", "images")
def st3(spark, sf):
    return ranks.position(T.images(spark, sf).select("image_id"), "place", [H.hash_order("seed", c("image_id"))])


@query("ST4_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def st4(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(10)


@query("ST5_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 3")
def st5(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t(spark, sf, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("ST6_top_k_after_rescoring", "SELECT policy, query, candidate FROM (SELECT *, row_number() OVER (PARTITION BY policy, query ORDER BY score DESC, candidate) AS rn FROM policies WHERE descriptor = 'mega' AND route <> 'non_comparable') WHERE rn <= 3", "policies")
def st6(spark, sf):
    # a query has 20 candidates at most: they are gathered once and sorted in its row for each policy. The route is no filter,
    # as that would be moved below the scores and compute them anew wherever it names them
    p = E.policy_scores(c("pct"), c("weakest"), c("admissible"), c("review"), c("conflict"))
    s = scored(spark, sf).where("descriptor = 'mega'").select("query", F.when(c("route") != "non_comparable", F.struct("candidate", *[v.alias(k) for k, v in p.items()])).alias("x"))
    q = s.groupBy("query").agg(F.collect_list("x").alias("xs"))

    def best(policy):
        return F.slice(F.sort_array(F.transform("xs", lambda x: F.struct(-x[policy], x.candidate.alias("candidate")))), 1, 3)["candidate"]

    y = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), best(k).alias("best")) for k in p])).alias("y")
    return q.select("query", y).select("y.policy", "query", F.explode("y.best").alias("candidate"))


@query("ST7_next_pending", "WITH d AS (SELECT packet, count(*) FILTER (decision = 'review_ready') > 9 AS done FROM reviews GROUP BY 1) SELECT cur.k AS cur, coalesce(min(packet) FILTER (packet > cur.k), min(packet)) AS next FROM d, (VALUES (0), (100), (399)) cur(k) WHERE NOT done GROUP BY 1", "reviews")
def st7(spark, sf):
    d = T.reviews(spark, sf).groupBy("packet").agg((F.count(F.when(c("decision") == "review_ready", 1)) > 9).alias("done"))
    cur = spark.createDataFrame([(0,), (100,), (399,)], "cur int")
    return d.where("not done").crossJoin(F.broadcast(cur)).groupBy("cur").agg(F.coalesce(F.min(F.when(c("packet") > c("cur"), c("packet"))), F.min("packet")).alias("next"))


@query("SO1_union_aligned", "SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def so1(spark, sf):
    return t(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("bal"), c("c_mktsegment").alias("seg")).unionByName(t(spark, sf, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("bal")), allowMissingColumns=True)


@query("SO2_intersect", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def so2(spark, sf):
    return t(spark, sf, "labels").where("quality = 1").select("doc_id").intersect(t(spark, sf, "documents").where("lang = 'en'").select("doc_id"))


@query("SO3_difference", "SELECT 'missing' AS side, l_orderkey AS k FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) UNION ALL SELECT 'unexpected', o_orderkey FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def so3(spark, sf):
    return S.differences(t(spark, sf, "lineitem").select(c("l_orderkey").alias("k")), t(spark, sf, "orders").select(c("o_orderkey").alias("k")), ["k"])


@query("SO4_keep_first", "SELECT packet, reviewer, arg_min(event_id, (ts, event_id)) AS event_id FROM reviews GROUP BY 1, 2", "reviews")
def so4(spark, sf):
    return S.keep_first(T.reviews(spark, sf), ["packet", "reviewer"], [c("ts"), c("event_id")]).select("packet", "reviewer", "event_id")


@query("SO5_keep_last", "SELECT packet, reviewer, arg_max(event_id, (ts, event_id)) AS event_id FROM reviews GROUP BY 1, 2", "reviews")
def so5(spark, sf):
    return S.keep_last(T.reviews(spark, sf), ["packet", "reviewer"], ["ts", "event_id"]).select("packet", "reviewer", "event_id")


@query("SO6_upsert", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey NOT IN (3, 99) UNION ALL VALUES (3, 'THREE'), (99, 'NEW')")
def so6(spark, sf):
    new = spark.createDataFrame([(3, "THREE"), (99, "NEW")], "k int, v string")
    return S.upsert(t(spark, sf, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("v")), new, ["k"])


@query("SO7_duplicate_check", "SELECT count(*) AS dup_keys FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def so7(spark, sf):
    return S.duplicate_keys(t(spark, sf, "orders"), ["o_custkey"]).agg(n_().alias("dup_keys"))


@query("SO8_pairwise_disjoint", "WITH s AS (SELECT 'a' AS stage, id FROM frame WHERE id % 3 = 0 UNION ALL SELECT 'b', id FROM frame WHERE id % 5 = 0 UNION ALL SELECT 'c', id FROM frame WHERE id % 15 = 7) SELECT id FROM s GROUP BY 1 HAVING count(DISTINCT stage) > 1", "frame")
def so8(spark, sf):
    f = T.frame(spark, sf)
    return S.overlaps({"a": f.where("id % 3 = 0"), "b": f.where("id % 5 = 0"), "c": f.where("id % 15 = 7")}, "id")


@query("SO9_role_overlap_matrix", "WITH r AS (SELECT DISTINCT domain, site FROM images) SELECT x.domain AS role_a, y.domain AS role_b, count(*) AS n FROM r x JOIN r y ON x.site = y.site GROUP BY 1, 2", "images")
def so9(spark, sf):
    return S.role_overlap(T.images(spark, sf), "domain", "site")


@query("SO10_content_hash_dedup", "WITH h AS (SELECT doc_id, length(text) AS n, sha256(text) AS h FROM documents), a AS (SELECT * FROM h WHERE doc_id % 2 = 0), b AS (SELECT * FROM h WHERE doc_id % 2 = 1) SELECT a.doc_id, count(b.doc_id) AS matches, CASE count(b.doc_id) WHEN 0 THEN 'keep_unmatched' WHEN 1 THEN 'drop_duplicate' ELSE 'keep_ambiguous' END AS decision FROM a LEFT JOIN b ON a.n = b.n AND a.h = b.h GROUP BY 1")
def so10(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.length("text").alias("size"), "text")
    return S.content_dedup(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id", "size", "text")


@query("SO11_canonical_pairs", "SELECT a, b, n_members, n_descriptors FROM pairs", "pairs")
def so11(spark, sf):
    m = T.memberships(spark, sf)
    return m.groupBy(F.least("query", "candidate").alias("a"), F.greatest("query", "candidate").alias("b")).agg(n_().alias("n_members"), F.countDistinct("descriptor").alias("n_descriptors"))
