"""Ranks, percentiles, bins, prefixes (W), graphs (GR) and sampling (SA)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keyed_hash as H
from ..operators import graph as G
from ..operators import ranks as R
from ..operators import sampling as P
from . import tables as T
from .q_scalar import scored
from .registry import cte, query

c = F.col


def r6(x):
    return F.round(x, 6)


def n_():
    return F.count(F.lit(1))


# ---------------------------------------------------------------- windows


@query("W1_midrank", "SELECT image_id, round((rank() OVER (ORDER BY sharp) - 1 + count(*) OVER (PARTITION BY sharp) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct FROM images", "images")
def w1(spark, sf):
    return R.midrank(T.images(spark, sf).select("image_id", "sharp"), "sharp", "pct").select("image_id", r6(c("pct")).alias("pct"))


@query("W2_average_percentile", "SELECT image_id, round(CASE WHEN x IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY domain, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY domain, x) - 1) / 2.0) / count(x) OVER (PARTITION BY domain) END, 6)::DOUBLE AS pct FROM (SELECT *, CASE WHEN failed THEN NULL ELSE visible END AS x FROM images)", "images")
def w2(spark, sf):
    i = T.images(spark, sf).select("image_id", "domain", F.when(~c("failed"), c("visible")).alias("x"))
    return R.average_percentile(i, "x", "pct", ["domain"]).select("image_id", r6(c("pct")).alias("pct"))


@query("W3_positional_percentile", "SELECT image_id, round(row_number() OVER (ORDER BY clip DESC, image_id) / count(*) OVER ()::DOUBLE, 6) AS pct FROM images", "images")
def w3(spark, sf):
    return R.position(T.images(spark, sf), "rn", [F.desc("clip"), c("image_id")], total="n").select("image_id", r6(c("rn") / c("n")).alias("pct"))


@query("W4_linspace_rank", "SELECT image_id, round(CASE WHEN n = 1 THEN 1.0 ELSE (rn - 1) / (n - 1)::DOUBLE END, 6) AS pct FROM (SELECT image_id, row_number() OVER (PARTITION BY identity, site ORDER BY sharp, image_id) AS rn, count(*) OVER (PARTITION BY identity, site) AS n FROM images)", "images")
def w4(spark, sf):
    x = R.position(T.images(spark, sf), "rn", [c("sharp"), c("image_id")], ["identity", "site"], "n")
    return x.select("image_id", r6(F.when(c("n") == 1, 1.0).otherwise((c("rn") - 1) / F.greatest(c("n") - 1, F.lit(1)))).alias("pct"))


@query("W5_rank_first_desc", "SELECT descriptor, query, candidate, row_number() OVER (PARTITION BY descriptor, query ORDER BY review DESC, candidate) AS r FROM scored", "scored")
def w5(spark, sf):
    return R.position(scored(spark, sf), "r", [F.desc("review"), c("candidate")], ["descriptor", "query"]).select("descriptor", "query", "candidate", "r")


@query("W6_rerank_cumcount", "SELECT descriptor, query, candidate, row_number() OVER (PARTITION BY descriptor, query ORDER BY admissible DESC, similarity DESC, candidate) AS r FROM scored WHERE route <> 'non_comparable'", "scored")
def w6(spark, sf):
    return R.position(scored(spark, sf).where("route <> 'non_comparable'"), "r", [F.desc("admissible"), F.desc("similarity"), c("candidate")], ["descriptor", "query"]).select("descriptor", "query", "candidate", "r")


@query("W7_rank_to_percentile", "SELECT a, b, round((21 - least(mega_ab, mega_ba)) / 20.0::DOUBLE, 6) AS pct FROM pairs WHERE least(mega_ab, mega_ba) IS NOT NULL", "pairs")
def w7(spark, sf):
    return T.pairs(spark, sf).where("least(mega_ab, mega_ba) is not null").select("a", "b", r6((21 - F.least("mega_ab", "mega_ba")) / 20.0).alias("pct"))


@query("W8_equal_frequency_groups", "SELECT image_id, least(5, (rn - 1) * 5 // n + 1) AS g FROM (SELECT image_id, row_number() OVER (PARTITION BY domain ORDER BY sharp, image_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM images)", "images")
def w8(spark, sf):
    x = R.position(T.images(spark, sf), "rn", [c("sharp"), c("image_id")], ["domain"], "n")
    return x.select("image_id", R.equal_frequency(c("rn"), c("n"), 5).alias("g"))


@query("W9_rank_quantile_bins", "SELECT image_id, ((rn - 1 >= 1 * n // 4)::INT + (rn - 1 >= 2 * n // 4)::INT + (rn - 1 >= 3 * n // 4)::INT)::BIGINT AS bin FROM (SELECT image_id, row_number() OVER (ORDER BY visible, image_id) AS rn, count(*) OVER () AS n FROM images)", "images")
def w9(spark, sf):
    x = R.position(T.images(spark, sf), "rn", [c("visible"), c("image_id")], total="n")
    return x.select("image_id", R.rank_quantile_bin(c("rn"), c("n"), 4).alias("bin"))


@query("W10_tie_aware_bins")
def w10(spark, sf):
    return R.tie_aware_bins(T.images(spark, sf).select("clip"), "clip", 5)


@query("W11_qcut_first_ranks", "SELECT id, (CASE WHEN rn <= 1 + (n - 1) * 0.25 THEN 0 WHEN rn <= 1 + (n - 1) * 0.5 THEN 1 WHEN rn <= 1 + (n - 1) * 0.75 THEN 2 ELSE 3 END)::BIGINT AS bin FROM (SELECT id, row_number() OVER (ORDER BY p, id) AS rn, count(*) OVER () AS n FROM outcomes)", "outcomes")
def w11(spark, sf):
    x = R.position(T.outcomes(spark, sf), "rn", [c("p"), c("id")], total="n")
    edge = lambda q: c("rn") <= 1 + (c("n") - 1) * q
    return x.select("id", F.when(edge(0.25), 0).when(edge(0.5), 1).when(edge(0.75), 2).otherwise(3).cast("bigint").alias("bin"))


@query("W12_qcut_values", "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM outcomes) SELECT id, (CASE WHEN n_chars <= q1 THEN 0 WHEN n_chars <= q2 THEN 1 WHEN n_chars <= q3 THEN 2 ELSE 3 END)::BIGINT AS bin FROM outcomes, q", "outcomes")
def w12(spark, sf):
    o = T.outcomes(spark, sf)
    q = o.agg(F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    e = F.array_distinct("e")
    return o.crossJoin(F.broadcast(q.select(e.alias("e")))).select("id", F.size(F.filter("e", lambda x: x < c("n_chars"))).cast("bigint").alias("bin"))


@query("W13_floor_index_tertiles", "WITH v AS (SELECT admissible, row_number() OVER (ORDER BY admissible) AS rn, count(*) OVER () AS n FROM scored), k AS (SELECT max(admissible) FILTER (rn = floor((n - 1) * 0.333333) + 1) AS a, max(admissible) FILTER (rn = floor((n - 1) * 0.666667) + 1) AS b FROM v) SELECT t, count(*) AS n FROM (SELECT CASE WHEN admissible <= a THEN 'admissibility_low' WHEN admissible <= b THEN 'admissibility_mid' ELSE 'admissibility_high' END AS t FROM scored, k) GROUP BY 1", "scored")
def w13(spark, sf):
    s = scored(spark, sf).select("admissible")
    k = R.value_counts(s, "admissible")
    cut = lambda q: F.min(F.when(c("below") + c("n") >= F.floor((c("total") - 1) * q) + 1, c("admissible")))
    cuts = k.agg(cut(0.333333).alias("a"), cut(0.666667).alias("b"))
    return s.crossJoin(F.broadcast(cuts)).groupBy(F.when(c("admissible") <= c("a"), "admissibility_low").when(c("admissible") <= c("b"), "admissibility_mid").otherwise("admissibility_high").alias("t")).agg(n_().alias("n"))


@query("W14_group_minmax", "SELECT descriptor, query, candidate, round(CASE WHEN hi > lo THEN (similarity - lo) / (hi - lo) ELSE 0 END, 6) AS v FROM (SELECT *, min(similarity) OVER (PARTITION BY descriptor, query) AS lo, max(similarity) OVER (PARTITION BY descriptor, query) AS hi FROM memberships)", "memberships")
def w14(spark, sf):
    return T.memberships(spark, sf).select("descriptor", "query", "candidate", r6(R.minmax("similarity", ["descriptor", "query"])).alias("v"))


@query("W15_cumulative_sum", "SELECT fold, id, sum(y) OVER (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS hits FROM outcomes", "outcomes")
def w15(spark, sf):
    w = Window.partitionBy("fold").orderBy(F.desc("p"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return T.outcomes(spark, sf).select("fold", "id", F.sum("y").over(w).alias("hits"))


@query("W16_positive_retention_prefix", "SELECT fold, t.t AS target, min(rn) AS k FROM (SELECT fold, row_number() OVER w AS rn, sum(y) OVER (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS cum, sum(y) OVER (PARTITION BY fold) AS pos FROM outcomes WINDOW w AS (PARTITION BY fold ORDER BY p DESC, id)), (VALUES (0.5::DOUBLE), (0.8), (0.95)) t(t) WHERE cum >= ceil(pos * t.t) GROUP BY 1, 2", "outcomes")
def w16(spark, sf):
    return P.prefix_for_retention(T.outcomes(spark, sf), ["fold"], [F.desc("p"), c("id")], "y", [0.5, 0.8, 0.95])


@query("W17_coverage_prefix", "SELECT k / 10.0::DOUBLE AS coverage, count(*) AS n, round(avg(1 - y), 6) AS risk FROM (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n FROM outcomes), range(1, 11) g(k) WHERE rn <= ceil(n * k / 10.0::DOUBLE) GROUP BY 1", "outcomes")
def w17(spark, sf):
    x = R.position(T.outcomes(spark, sf), "rn", [F.desc("p"), c("id")], total="n")
    g = spark.range(1, 11).select((c("id") / 10.0).alias("coverage"), c("id").alias("k"))
    return x.select("y", "rn", "n").crossJoin(F.broadcast(g)).where(c("rn") <= F.ceil(c("n") * c("k") / 10.0)).groupBy("coverage").agg(n_().alias("n"), r6(F.avg(1 - c("y"))).alias("risk"))


@query("W18_risk_constrained_prefix", "SELECT fold, k, round(adm, 6) AS admission FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY adm DESC, k DESC) AS pick FROM (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY p DESC, id) AS k, sum(p) OVER (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS adm, avg(1 - y) OVER (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING) AS risk FROM outcomes) WHERE risk <= 0.2 AND k <= 30) WHERE pick = 1", "outcomes")
def w18(spark, sf):
    return P.risk_constrained_prefix(T.outcomes(spark, sf).withColumn("loss", 1 - c("y")), ["fold"], [F.desc("p"), c("id")], "p", "loss", 0.2, 30).select("fold", "k", r6(c("admission")).alias("admission"))


@query("W19_fixed_budget_prefix", "SELECT fold, id FROM (SELECT fold, id, row_number() OVER (PARTITION BY fold ORDER BY p DESC, id) AS rn FROM outcomes) WHERE rn <= 10", "outcomes")
def w19(spark, sf):
    return R.position(T.outcomes(spark, sf), "rn", [F.desc("p"), c("id")], ["fold"]).where("rn <= 10").select("fold", "id")


@query("W20_first_positive_rank", "SELECT descriptor, query, min(rank) FILTER (same) AS first_hit, round(coalesce(1.0 / min(rank) FILTER (same), 0), 6)::DOUBLE AS rr FROM evidence GROUP BY 1, 2", "evidence")
def w20(spark, sf):
    first = F.min(F.when(c("same"), c("rank")))
    return T.evidence(spark, sf).groupBy("descriptor", "query").agg(first.alias("first_hit"), r6(F.coalesce(1.0 / first, F.lit(0.0))).alias("rr"))


@query("W21_sliding_context", "SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations")
def w21(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-14, -1)
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ",").alias("before"))


@query("W22_margin", "SELECT descriptor, query, candidate, round(coalesce(similarity - lead(similarity) OVER (PARTITION BY descriptor, query ORDER BY rank), 0), 6) AS margin FROM memberships", "memberships")
def w22(spark, sf):
    w = Window.partitionBy("descriptor", "query").orderBy("rank")
    return T.memberships(spark, sf).select("descriptor", "query", "candidate", r6(F.coalesce(c("similarity") - F.lead("similarity").over(w), F.lit(0.0))).alias("margin"))


@query("W23_reciprocal_support", "SELECT m.query, m.candidate, coalesce(r.rank <= 10, false) AND coalesce(d.rank <= 20, false) AS reciprocal, coalesce(abs(m.rank - d.rank) >= 10 OR abs(m.similarity - d.similarity) >= 0.18, true) AS disagreement FROM memberships m LEFT JOIN memberships r ON r.descriptor = 'mega' AND r.query = m.candidate AND r.candidate = m.query LEFT JOIN memberships d ON d.descriptor = 'dino' AND d.query = m.query AND d.candidate = m.candidate WHERE m.descriptor = 'mega'", "memberships")
def w23(spark, sf):
    m = T.memberships(spark, sf)
    a = m.where("descriptor = 'mega'").drop("descriptor")
    r = a.select(c("candidate").alias("query"), c("query").alias("candidate"), c("rank").alias("back"))
    d = m.where("descriptor = 'dino'").select("query", "candidate", c("rank").alias("other"), c("similarity").alias("other_sim"))
    j = a.join(r, ["query", "candidate"], "left").join(d, ["query", "candidate"], "left")
    f = F.lit(False)
    return j.select(
        "query", "candidate",
        (F.coalesce(c("back") <= 10, f) & F.coalesce(c("other") <= 20, f)).alias("reciprocal"),
        F.coalesce((F.abs(c("rank") - c("other")) >= 10) | (F.abs(c("similarity") - c("other_sim")) >= 0.18), F.lit(True)).alias("disagreement"),
    )


@query("W24_monotonicity", "WITH b AS (SELECT lang, least(floor(p * 5), 4) AS bin, avg(y) AS rate FROM outcomes GROUP BY 1, 2), l AS (SELECT lang, rate < lag(rate) OVER (PARTITION BY lang ORDER BY bin) - 0.05 AS bad FROM b) SELECT lang, count(*) FILTER (bad) AS violations, count(*) FILTER (bad) = 0 AS monotone FROM l GROUP BY 1", "outcomes")
def w24(spark, sf):
    b = T.outcomes(spark, sf).groupBy("lang", F.least(F.floor(c("p") * 5), F.lit(4)).alias("bin")).agg(F.avg("y").alias("rate"))
    bad = c("rate") < F.lag("rate").over(Window.partitionBy("lang").orderBy("bin")) - 0.05
    v = F.count(F.when(c("bad"), 1))
    return b.withColumn("bad", bad).groupBy("lang").agg(v.alias("violations"), (v == 0).alias("monotone"))


@query("W25_average_ranks", "SELECT id, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM outcomes", "outcomes")
def w25(spark, sf):
    return R.average_rank(T.outcomes(spark, sf), "p", "r").select("id", "r")


@query("W26_evenly_spaced_picks", "WITH v AS (SELECT cell, id, row_number() OVER (PARTITION BY cell ORDER BY price, id) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM frame) SELECT DISTINCT cell, id FROM v, range(5) g(k) WHERE i = round_even(k * (n - 1) / 4.0::DOUBLE, 0)", "frame")
def w26(spark, sf):
    return P.evenly_spaced(T.frame(spark, sf), ["cell"], [c("price"), c("id")], 5).select("cell", "id")


@query("W27_segment_sample", "WITH v AS (SELECT id, row_number() OVER (ORDER BY price, id) - 1 AS i, count(*) OVER () AS n FROM frame), s AS (SELECT id, CASE WHEN i < n * 0.2 THEN 'low' WHEN i >= n * 0.4 AND i < n * 0.6 THEN 'mid' WHEN i >= n * 0.8 THEN 'high' END AS seg, i FROM v), r AS (SELECT seg, id, row_number() OVER (PARTITION BY seg ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY seg) AS m FROM s WHERE seg IS NOT NULL) SELECT DISTINCT seg, id FROM r, range(4) g(x) WHERE k = round_even(x * (m - 1) / 3.0::DOUBLE, 0)", "frame")
def w27(spark, sf):
    x = R.position(T.frame(spark, sf).select("id", "price"), "rn", [c("price"), c("id")], total="n").withColumn("i", c("rn") - 1)
    s = x.withColumn("seg", F.when(c("i") < c("n") * 0.2, "low").when((c("i") >= c("n") * 0.4) & (c("i") < c("n") * 0.6), "mid").when(c("i") >= c("n") * 0.8, "high")).where("seg is not null")
    return P.evenly_spaced(s.select("seg", "id", "i"), ["seg"], [c("i")], 4).select("seg", "id")


@query("W28_group_quantile_thresholds", "SELECT e.descriptor, query, candidate, similarity >= q.q75 AS high, reliability <= q.q25 AS weak FROM evidence e JOIN (SELECT descriptor, quantile_cont(similarity, 0.75) FILTER (NOT failed) AS q75, quantile_cont(reliability, 0.25) FILTER (same) AS q25 FROM evidence GROUP BY 1) q ON e.descriptor = q.descriptor", "evidence")
def w28(spark, sf):
    e = T.evidence(spark, sf)
    q = e.groupBy("descriptor").agg(F.percentile(F.when(~c("failed"), c("similarity")), F.lit(0.75)).alias("q75"), F.percentile(F.when(c("same"), c("reliability")), F.lit(0.25)).alias("q25"))
    return e.join(F.broadcast(q), "descriptor").select("descriptor", "query", "candidate", (c("similarity") >= c("q75")).alias("high"), (c("reliability") <= c("q25")).alias("weak"))


# ---------------------------------------------------------------- graphs

#: Edges: image pairs that share a site and identity or are close by both descriptors.
cte("edges", "SELECT a, b FROM pairs WHERE mega_ab <= 1 OR mega_ba <= 1", "pairs")
cte(
    "comps",
    """SELECT n AS node, min(m) AS comp FROM (WITH RECURSIVE e AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges), r AS (SELECT x AS n, x AS m FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.n) SELECT n, m FROM r) GROUP BY 1""",
    "edges",
)


def edges(spark, sf):
    return T.pairs(spark, sf).where("mega_ab <= 1 or mega_ba <= 1").select("a", "b")


def comps(spark, sf):
    return G.components(edges(spark, sf))


@query("GR1_components", "SELECT node, comp FROM comps", "comps")
def gr1(spark, sf):
    return comps(spark, sf)


@query("GR2_component_inventory", "SELECT 'component_' || lpad((dense_rank() OVER (ORDER BY comp))::VARCHAR, 6, '0') AS component_id, comp, n_nodes, n_edges FROM (SELECT comp, count(*) AS n_nodes FROM comps GROUP BY 1) JOIN (SELECT comp, count(*) AS n_edges FROM edges JOIN comps ON a = node GROUP BY 1) USING (comp)", "comps", "edges")
def gr2(spark, sf):
    return G.inventory(edges(spark, sf), comps(spark, sf))


@query("GR3_component_hash_id", "WITH d AS (SELECT node, count(*) AS deg FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1) SELECT 'cmp_' || substr(sha256(string_agg(k.node::VARCHAR, ',' ORDER BY k.node::VARCHAR)), 1, 16) AS component_id, count(*) AS n, max(deg) AS max_degree, count(*) FILTER (failed) AS failures FROM comps k JOIN d USING (node) JOIN images i ON i.image_id = k.node GROUP BY comp", "comps", "edges", "images")
def gr3(spark, sf):
    return G.hashed_components(edges(spark, sf), comps(spark, sf), T.images(spark, sf).select(c("image_id").alias("node"), "failed"))


@query("GR4_component_hash_fold", "SELECT node, (('0x' || substr(sha1(comp::VARCHAR), 1, 8))::BIGINT) % 5 AS fold FROM comps", "comps")
def gr4(spark, sf):
    return comps(spark, sf).select("node", E.stable_fold(c("comp").cast("string")).alias("fold"))


@query("GR5_degree", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1", "edges")
def gr5(spark, sf):
    return G.degrees(edges(spark, sf))


@query("GR6_vertex_disjoint_trees")
def gr6(spark, sf):
    return G.disjoint_trees(edges(spark, sf).withColumn("site", F.pmod(F.col("a"), F.lit(7))), "site", 4, "seed")


@query("GR7_balanced_folds")
def gr7(spark, sf):
    v = T.outcomes(spark, sf).groupBy("comp").agg(F.sum("y").alias("pos"), F.sum(1 - c("y")).alias("neg"), n_().alias("n"))
    return G.balanced_folds(v, "comp", ["pos", "neg", "n"], 5)


@query("GR8_nested_folds")
def gr8(spark, sf):
    v = T.outcomes(spark, sf).groupBy("comp").agg(F.sum("y").alias("pos"), n_().alias("n"))
    return G.nested_folds(v, "comp", ["pos", "n"], 4, 3)


@query("GR9_endpoint_leakage", "SELECT node, count(DISTINCT fold) AS folds FROM (SELECT a AS node, fold FROM outcomes UNION ALL SELECT b, fold FROM outcomes) GROUP BY 1 HAVING count(DISTINCT fold) > 1", "outcomes")
def gr9(spark, sf):
    return G.endpoint_leakage(T.outcomes(spark, sf), "a", "b", "fold")


@query("GR10_design_effect", "SELECT round(1 - 0.3 + 0.15 * sum(d * d) / (SELECT count(*) FROM edges), 6) AS deff FROM (SELECT count(*) AS d FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node)", "edges")
def gr10(spark, sf):
    d = G.degrees(edges(spark, sf)).agg(F.sum(c("degree") * c("degree")).alias("s"), (F.sum("degree") / 2).alias("m"))
    return d.select(r6(1 - 0.3 + 0.15 * c("s") / c("m")).alias("deff"))


@query("GR11_stable_fold_role", "SELECT identity, (('0x' || substr(sha1(identity::VARCHAR), 1, 8))::BIGINT) % 5 AS fold, CASE WHEN (('0x' || substr(sha1(identity::VARCHAR), 1, 8))::BIGINT) % 5 = 4 THEN 'evaluation' ELSE 'calibration' END AS role FROM (SELECT DISTINCT identity FROM images)", "images")
def gr11(spark, sf):
    f = E.stable_fold(c("identity").cast("string"))
    return T.images(spark, sf).select("identity").distinct().select("identity", f.alias("fold"), F.when(f == 4, "evaluation").otherwise("calibration").alias("role"))


# ---------------------------------------------------------------- sampling

_SEED = "00" * 32
_HS = H.hmac_sql("""'["contract","development","draw","' || cell || '","' || id::VARCHAR || '"]'""")


@query("SA1_hmac_digest", f"SELECT id, {_HS} AS digest FROM frame", "frame")
def sa1(spark, sf):
    return T.frame(spark, sf).select("id", H.seeded_digest(_SEED, "contract", "development", "draw", c("cell"), c("id")).alias("digest"))


_CAPS = "caps AS (SELECT cell, count(*) AS cap FROM frame GROUP BY 1)"


def caps(spark, sf):
    return T.frame(spark, sf).groupBy("cell").agg(n_().alias("cap"))


@query("SA2_waterfill", f"WITH {_CAPS} SELECT cell, count(*) AS quota FROM (SELECT cell, row_number() OVER (ORDER BY i, sha256('wf|' || cell), cell) AS place FROM caps, range(1, 100000) g(i) WHERE i <= cap) WHERE place <= 40 GROUP BY 1", "frame")
def sa2(spark, sf):
    return P.waterfill(caps(spark, sf), "cell", "cap", 40, H.hash_order("wf", c("cell")))


@query(
    "SA3_hamilton",
    f"WITH {_CAPS}, q AS (SELECT cell, cap, 200 * cap / (SELECT sum(cap) FROM caps)::DOUBLE AS ideal FROM caps), f AS (SELECT *, least(cap, greatest(1, floor(ideal)))::BIGINT AS base FROM q), r AS (SELECT *, row_number() OVER (ORDER BY ideal - floor(ideal) DESC, sha256('h|' || cell), cell) AS place FROM f WHERE base < cap) SELECT f.cell, f.base + coalesce((r.place <= 200 - (SELECT sum(base) FROM f))::INT, 0) AS quota FROM f LEFT JOIN r USING (cell)",
    "frame",
)
def sa3(spark, sf):
    return P.hamilton(caps(spark, sf), "cell", "cap", 200, H.hash_order("h", c("cell"))).select("cell", "quota")


@query("SA4_equal_base_remainder")
def sa4(spark, sf):
    return P.equal_base(caps(spark, sf), "cell", "cap", 45)


@query("SA5_role_quotas")
def sa5(spark, sf):
    return P.role_quotas(caps(spark, sf), "cell", "cap", {"development": 0.5, "confirmation": 0.3, "reserve": 0.2})


@query("SA6_role_allocation", "SELECT id, CASE WHEN rn <= floor(n * 0.5) THEN 'development' WHEN rn <= floor(n * 0.8) THEN 'confirmation' ELSE 'reserve' END AS role FROM (SELECT id, row_number() OVER (PARTITION BY cell ORDER BY sha256('role|' || cell || '|' || id::VARCHAR), id) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM frame)", "frame")
def sa6(spark, sf):
    x = R.position(T.frame(spark, sf), "rn", [H.hash_order("role", c("cell"), c("id")), c("id")], ["cell"], "n")
    return x.select("id", F.when(c("rn") <= F.floor(c("n") * 0.5), "development").when(c("rn") <= F.floor(c("n") * 0.8), "confirmation").otherwise("reserve").alias("role"))


_DRAW = f"SELECT id, cell, cap, quota, CAST(round(least(quota, cap) / cap::DOUBLE, 12) AS DOUBLE) AS pi FROM (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY {_HS}, id) AS rn, count(*) OVER (PARTITION BY cell) AS cap, 5::BIGINT AS quota FROM frame) WHERE rn <= quota"


def draw(frame, quota, stage="draw"):
    return P.stratified_draw(frame, "cell", "id", F.lit(quota), H.seeded_digest(_SEED, "contract", "development", stage, c("cell"), c("id")))


@query("SA7_stratified_srswor", _DRAW, "frame")
def sa7(spark, sf):
    return draw(T.frame(spark, sf), 5).select("id", "cell", "cap", "quota", "pi")


@query(
    "SA8_multi_stage_draw",
    f"WITH one AS (SELECT id FROM ({_DRAW})), rest AS (SELECT * FROM frame WHERE id NOT IN (SELECT id FROM one)) SELECT 'deployment' AS stage, id FROM one UNION ALL SELECT 'mechanism', id FROM (SELECT id, row_number() OVER (PARTITION BY cell ORDER BY {_HS.replace('draw', 'mechanism')}, id) AS rn FROM rest) WHERE rn <= 3",
    "frame",
)
def sa8(spark, sf):
    f = T.frame(spark, sf)
    one = draw(f, 5).select("id")
    two = draw(f.join(one, "id", "left_anti"), 3, "mechanism").select("id")
    return one.select(F.lit("deployment").alias("stage"), "id").unionByName(two.select(F.lit("mechanism").alias("stage"), "id"))


@query("SA9_stratum_key", "SELECT cell || '__' || (CASE WHEN price > 200000 THEN 'high' ELSE 'low' END) AS stratum, count(*) AS n FROM frame GROUP BY 1", "frame")
def sa9(spark, sf):
    return T.frame(spark, sf).groupBy(F.concat_ws("__", "status", "priority", F.when(c("price") > 200000, "high").otherwise("low")).alias("stratum")).agg(n_().alias("n"))


@query("SA10_hash_stratified", "SELECT cell, id FROM (SELECT cell, id, row_number() OVER (PARTITION BY cell ORDER BY sha256('s10|' || id::VARCHAR), id) AS rn FROM frame) WHERE rn <= 4", "frame")
def sa10(spark, sf):
    return P.first_per_group(T.frame(spark, sf), ["cell"], [H.hash_order("s10", c("id")), c("id")], 4).select("cell", "id")


@query("SA11_round_robin", "SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY rn, cell) AS place FROM (SELECT cell, id, row_number() OVER (PARTITION BY cell ORDER BY sha256('s11|' || id::VARCHAR), id) AS rn FROM frame)) WHERE place <= 100", "frame")
def sa11(spark, sf):
    return P.round_robin(T.frame(spark, sf), "cell", [H.hash_order("s11", c("id")), c("id")], 100).select("id", "place")


@query("SA12_round_robin_minimum", "WITH r AS (SELECT identity, image_id, row_number() OVER (PARTITION BY identity ORDER BY sharp DESC, image_id) AS rn, count(*) OVER (PARTITION BY identity) AS n FROM images) SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY (rn > 2), rn, identity) AS place FROM r WHERE n >= 2) WHERE place <= 60", "images")
def sa12(spark, sf):
    return P.round_robin_minimum(T.images(spark, sf), "identity", "image_id", [F.desc("sharp"), c("image_id")], 2, 60).select("image_id")


@query("SA13_capped_pick", "SELECT image_id FROM (SELECT image_id, row_number() OVER (ORDER BY sharp DESC, image_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY sharp DESC, image_id) AS rn FROM images) WHERE rn <= 3) WHERE place <= 25", "images")
def sa13(spark, sf):
    return P.capped_pick(T.images(spark, sf), ["identity"], [F.desc("sharp"), c("image_id")], 3, 25).select("image_id")


@query("SA14_score_bin_balanced", "WITH b AS (SELECT id, lang, least(3, (row_number() OVER (ORDER BY p, id) - 1) * 4 // count(*) OVER ()) AS bin FROM outcomes) SELECT lang, bin, id FROM (SELECT *, row_number() OVER (PARTITION BY lang, bin ORDER BY sha256('s14|' || id::VARCHAR), id) AS rn FROM b) ORDER BY (rn > 2), sha256('s14|' || id::VARCHAR), id LIMIT 60", "outcomes")
def sa14(spark, sf):
    x = R.position(T.outcomes(spark, sf), "rn", [c("p"), c("id")], total="n").withColumn("bin", F.least(F.lit(3), F.floor((c("rn") - 1) * 4 / c("n"))).cast("bigint"))
    return P.with_top_up(x.select("id", "lang", "bin"), ["lang", "bin"], [H.hash_order("s14", c("id")), c("id")], 2, 60).select("lang", "bin", "id")


@query("SA15_exclusion_register", "SELECT a, b, string_agg(reason, ';' ORDER BY reason) AS reasons FROM (SELECT a, b, 'failed_endpoint' AS reason FROM pairs JOIN images ON a = image_id WHERE failed UNION SELECT a, b, 'same_site' FROM pairs WHERE a % 7 = b % 7 UNION SELECT a, b, 'far_rank' FROM pairs WHERE best_rank > 15) GROUP BY 1, 2", "pairs", "images")
def sa15(spark, sf):
    p = T.pairs(spark, sf)
    f = T.images(spark, sf).where("failed").select(c("image_id").alias("a"))
    return P.exclusion_register(["a", "b"], {"failed_endpoint": p.join(f, "a", "left_semi"), "same_site": p.where("a % 7 = b % 7"), "far_rank": p.where("best_rank > 15")})


@query("SA16_reviewer_assignment")
def sa16(spark, sf):
    p = T.reviews(spark, sf).select("packet").distinct()
    return P.assign_reviewers(p, "packet", ["r1", "r2", "r3", "r4", "r5"], "seed")


@query("SA17_orientation_swap", "SELECT a, b, CASE WHEN substr(sha256('lr|' || a::VARCHAR || '|' || b::VARCHAR), 64, 1) IN ('1','3','5','7','9','b','d','f') THEN b ELSE a END AS left_image FROM pairs", "pairs")
def sa17(spark, sf):
    odd = F.substring(H.hash_order("lr", c("a"), c("b")), -1, 1).isin("1", "3", "5", "7", "9", "b", "d", "f")
    return T.pairs(spark, sf).select("a", "b", F.when(odd, c("b")).otherwise(c("a")).alias("left_image"))


@query("SA18_group_shuffle_split", "SELECT site, place <= round_even(n * 0.3, 0) AS test FROM (SELECT site, row_number() OVER (ORDER BY sha256('g|' || site)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT site FROM images))", "images")
def sa18(spark, sf):
    x = R.position(T.images(spark, sf).select("site").distinct(), "place", [H.hash_order("g", c("site"))], total="n")
    return x.select("site", (c("place") <= F.bround(c("n") * 0.3)).alias("test"))


@query("SA19_identity_split", "SELECT identity, CASE WHEN place * 2 <= n THEN 'calibration' ELSE 'evaluation' END AS split FROM (SELECT identity, row_number() OVER (ORDER BY sha256('i|' || identity::VARCHAR)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT identity FROM images))", "images")
def sa19(spark, sf):
    x = R.position(T.images(spark, sf).select("identity").distinct(), "place", [H.hash_order("i", c("identity"))], total="n")
    return x.select("identity", F.when(c("place") * 2 <= c("n"), "calibration").otherwise("evaluation").alias("split"))


@query("SA20_sharding", "SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1) // 500 AS shard, 'exec_' || substr(sha256('x|' || a::VARCHAR || '|' || b::VARCHAR), 1, 12) AS exec_id FROM pairs", "pairs")
def sa20(spark, sf):
    x = R.position(T.pairs(spark, sf).select("a", "b"), "rn", [c("a"), c("b")])
    return x.select("a", "b", F.floor((c("rn") - 1) / 500).cast("bigint").alias("shard"), F.concat(F.lit("exec_"), F.substring(H.hash_order("x", c("a"), c("b")), 1, 12)).alias("exec_id"))


@query("SA21_matched_random_control", "WITH k AS (SELECT query, count(*) FILTER (route = 'review') AS n FROM scored WHERE descriptor = 'mega' GROUP BY 1) SELECT s.query, candidate FROM (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY sha256('c|' || query::VARCHAR || '|' || candidate::VARCHAR)) AS rn FROM scored WHERE descriptor = 'mega') s JOIN k ON s.query = k.query WHERE rn <= n", "scored")
def sa21(spark, sf):
    s = scored(spark, sf).where("descriptor = 'mega'").select("query", "candidate", "route")
    k = s.groupBy("query").agg(F.count(F.when(c("route") == "review", 1)).alias("n"))
    return R.position(s, "rn", [H.hash_order("c", c("query"), c("candidate"))], ["query"]).join(k, "query").where("rn <= n").select("query", "candidate")


@query("SA22_fixed_n_renumbered", "SELECT site, image_id, row_number() OVER (ORDER BY site, image_id) AS number FROM (SELECT site, image_id, row_number() OVER (PARTITION BY site ORDER BY sha256('f|' || image_id::VARCHAR)) AS rn FROM images) WHERE rn <= 3", "images")
def sa22(spark, sf):
    x = P.first_per_group(T.images(spark, sf), ["site"], [H.hash_order("f", c("image_id"))], 3)
    return R.position(x.select("site", "image_id"), "number", [c("site"), c("image_id")])
