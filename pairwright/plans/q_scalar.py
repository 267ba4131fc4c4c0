"""Projections, filters, conditionals and scalar scores (PRJ, FIL, CND, SC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keyed_hash as H
from ..operators import knn
from ..operators import ranks as R
from . import tables as T
from .registry import cte, query

c = F.col


def r6(x):
    return F.round(x, 6)


# ---------------------------------------------------------------- shared scored evidence


def scored(spark, sf, members=None):
    """Directed evidence with the percentile, quality, geometry, conflict and admissibility scores of pairs."""
    m = T.memberships(spark, sf) if members is None else members
    e = R.average_percentile_within(T.evidence(spark, sf, m), m, "similarity", "pct", "descriptor")
    e = e.withColumn("weakest", F.least(E.image_quality(c("q_dim"), F.lit(0.0)), E.image_quality(c("c_dim"), F.lit(0.0))))
    e = e.withColumn("geometry", F.bround(0.55 * E.size_compatibility(c("q_dim"), c("c_dim")) + 0.45 * E.aspect_compatibility(c("q_aspect"), c("c_aspect")), 6))
    e = e.withColumn("conflict", F.bround(E.clamp01(c("pct") - (0.65 * c("weakest") + 0.35 * c("geometry"))), 6))
    e = e.withColumn("admissible", E.admissibility(c("weakest"), c("geometry"), c("conflict"), c("pct")))
    e = e.withColumn("review", E.review_score(c("pct"), c("admissible"), c("conflict")))
    return e.withColumn("route", E.route_for_score(c("admissible"), c("conflict")))


_CL = "greatest(0.0, least(1.0, {}))".format
cte(
    "scored",
    f"""
SELECT *, CASE WHEN admissible >= 0.78 AND conflict <= 0.20 THEN 'accept_review_ready' WHEN admissible >= 0.58 AND conflict <= 0.45 THEN 'review'
  WHEN admissible >= 0.40 THEN 'defer_low_evidence' ELSE 'non_comparable' END AS route
FROM (SELECT *, round_even({_CL('0.62 * pct + 0.38 * admissible - 0.20 * conflict')}, 6) AS review
FROM (SELECT *, round_even({_CL('0.42 * weakest + 0.28 * geometry + 0.20 * (1.0 - conflict) + 0.10 * pct')}, 6) AS admissible
FROM (SELECT *, round_even({_CL('pct - (0.65 * weakest + 0.35 * geometry)')}, 6) AS conflict
FROM (SELECT *, (rank() OVER (PARTITION BY descriptor ORDER BY similarity) + (count(*) OVER (PARTITION BY descriptor, similarity) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY descriptor) AS pct,
  round_even(0.55 * {_CL('least(q_dim, c_dim) / 512.0::DOUBLE')}, 6) AS weakest,
  round_even(0.55 * round_even(least(q_dim, c_dim) / greatest(q_dim, c_dim)::DOUBLE, 6) + 0.45 * round_even({_CL('1.0 - abs(q_aspect - c_aspect) / greatest(q_aspect, c_aspect)')}, 6), 6) AS geometry
FROM evidence))))""",
    "evidence",
)

# ---------------------------------------------------------------- projections and filters


@query("PRJ1_merge_right_wins", "SELECT a.c_custkey AS k, coalesce(b.n, 0) AS n, coalesce(b.v, a.c_acctbal) AS v FROM customer a LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey")
def prj1(spark, sf):
    b = T.table(spark, sf, "orders").groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("v2"))
    return T.table(spark, sf, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("v")).join(b, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v2", "v").alias("v"))


@query("PRJ2_prefix_columns", "SELECT n_nationkey AS query_n_nationkey, n_name AS query_n_name, n_regionkey AS query_n_regionkey FROM nation")
def prj2(spark, sf):
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select(*[c(x).alias(f"query_{x}") for x in n.columns])


@query("PRJ3_rename_drop_assign", "SELECT p_partkey AS part, p_name AS title, p_size * 2 AS size2 FROM part")
def prj3(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand").withColumnsRenamed({"p_partkey": "part", "p_name": "title"}).withColumns({"size2": c("p_size") * 2}).drop("p_size", "p_brand")


@query("PRJ4_blinded_projection", "SELECT a, b, best_rank FROM pairs", "pairs")
def prj4(spark, sf):
    return T.pairs(spark, sf).select("a", "b", "best_rank")


@query("PRJ5_first_nonempty", "SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'none') AS v FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, source FROM documents)")
def prj5(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 3 == 0, " ").when(c("doc_id") % 7 == 0, None).otherwise(c("lang")).alias("lang"), "source")
    return d.select("doc_id", E.first_value(c("lang"), c("source"), F.lit("none")).alias("v"))


@query("PRJ6_score_map", "SELECT vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.3 ELSE 0.5 END::DOUBLE AS s FROM embeddings")
def prj6(spark, sf):
    return T.images(spark, sf).select(c("image_id").alias("id"), E.score_map(F.concat(F.lit(" "), F.upper("side")), {"left": 1.0, "right": 0.8, "front": 0.3}, 0.5).alias("s"))


@query("FIL1_conjunctive_mask", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 10")
def fil1(spark, sf):
    return T.table(spark, sf, "lineitem").where((c("l_returnflag") == "R") & (c("l_linestatus") == "F") & (c("l_quantity") >= 10)).agg(F.count(F.lit(1)).alias("n"))


@query("FIL2_threshold_accept", "SELECT id, round(1 - p, 6) AS risk FROM outcomes WHERE 1 - p <= 0.3", "outcomes")
def fil2(spark, sf):
    return T.outcomes(spark, sf).where(1 - c("p") <= 0.3).select("id", r6(1 - c("p")).alias("risk"))


@query("FIL3_in_set", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (1, 3)")
def fil3(spark, sf):
    return T.table(spark, sf, "nation").where(c("n_regionkey").isin(1, 3)).select(c("n_nationkey").alias("k"))


@query("FIL4_between_inclusive", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 20")
def fil4(spark, sf):
    return T.table(spark, sf, "part").where(c("p_size").between(10, 20)).select(c("p_partkey").alias("k"))


@query("FIL5_unknown_never_equal", "SELECT count(*) AS n, count(*) FILTER (q_side = c_side AND q_side <> 'unknown') AS same FROM evidence", "evidence")
def fil5(spark, sf):
    return T.evidence(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(E.known_equal(c("q_side"), c("c_side")), 1)).alias("same"))


@query("FIL6_finite", "SELECT id FROM (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'NaN'::DOUBLE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 'Infinity'::DOUBLE ELSE vec_id::DOUBLE END AS x FROM embeddings) WHERE isfinite(x)")
def fil6(spark, sf):
    i = T.images(spark, sf).select(c("image_id").alias("id"), F.when(c("image_id") % 5 == 0, float("nan")).when(c("image_id") % 7 == 0, None).when(c("image_id") % 11 == 0, float("inf")).otherwise(c("image_id").cast("double")).alias("x"))
    return i.where(E.finite(c("x"))).select("id")


@query("FIL7_token_reject", "SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(text), 'licen[sc]e|copyright|password')")
def fil7(spark, sf):
    return T.table(spark, sf, "documents").where(~F.lower("text").rlike("licen[sc]e|copyright|password")).select("doc_id")


# ---------------------------------------------------------------- conditionals


def _bands(key, fn, col, sql_case, extra=()):
    @query(key, f"SELECT band, count(*) AS n FROM (SELECT {sql_case} AS band FROM scored) GROUP BY 1", "scored")
    def run(spark, sf):
        return scored(spark, sf).groupBy(fn().alias("band")).agg(F.count(F.lit(1)).alias("n"))

    return run


_bands("CND1_reliability_band", lambda: E.reliability_band(c("reliability")), None, "CASE WHEN reliability >= 0.75 THEN 'high' WHEN reliability >= 0.50 THEN 'medium' WHEN reliability >= 0.25 THEN 'low' ELSE 'unusable' END")
_bands("CND2_conflict_band", lambda: E.conflict_band(c("conflict")), None, "CASE WHEN conflict >= 0.75 THEN 'high_conflict' WHEN conflict >= 0.50 THEN 'medium_conflict' WHEN conflict >= 0.25 THEN 'low_conflict' ELSE 'minimal_conflict' END")
_bands("CND3_review_decision", lambda: E.review_decision(c("reliability"), c("conflict")), None, "CASE WHEN reliability < 0.25 THEN 'exclude_unusable_evidence' WHEN conflict >= 0.75 THEN 'defer_high_descriptor_evidence_conflict' WHEN reliability >= 0.50 THEN 'review_candidate' ELSE 'defer_low_admissibility' END")
_bands("CND4_route_for_score", lambda: E.route_for_score(c("admissible"), c("conflict")), None, "route")
_bands("CND5_route_decision", lambda: E.route_decision(c("admissible"), c("weakest"), c("conflict")), None, "CASE WHEN admissible >= 0.80 AND weakest >= 0.60 AND conflict < 0.40 THEN 'accept' WHEN admissible >= 0.55 AND weakest >= 0.45 AND conflict < 0.70 THEN 'review' WHEN admissible >= 0.30 AND weakest >= 0.30 THEN 'defer' WHEN weakest < 0.25 THEN 'species_level_only' ELSE 'non_comparable' END")
_bands(
    "CND6_primary_reason",
    lambda: E.primary_reason(c("conflict"), c("q_visible"), c("c_visible"), c("weakest"), c("geometry"), c("admissible")),
    None,
    "CASE WHEN conflict >= 0.70 THEN 'high_descriptor_evidence_conflict' WHEN q_visible < 0.35 THEN 'side_or_flank_not_comparable' WHEN c_visible < 0.35 THEN 'weak_pattern_evidence' WHEN weakest < 0.30 THEN 'weakest_image_low_evidence' WHEN geometry < 0.35 THEN 'animal_too_small_or_poor_detection_geometry' WHEN admissible >= 0.55 THEN 'evidence_comparable' ELSE 'low_pair_admissibility' END",
)


@query(
    "CND7_priority_actions",
    """WITH q AS (SELECT quantile_cont(review, 0.8) AS hi, quantile_cont(review, 0.4) AS lo FROM scored)
SELECT action, count(*) AS n FROM (SELECT CASE
  WHEN NOT (route = 'species_level_only' OR (weakest < 0.25 AND admissible < 0.30)) AND (route = 'non_comparable' OR admissible < 0.15) THEN 'non_comparable'
  WHEN route = 'species_level_only' OR (weakest < 0.25 AND admissible < 0.30) THEN 'species_level_only'
  WHEN review >= hi AND admissible >= 0.65 AND weakest >= 0.55 AND conflict < 0.50 THEN 'accept'
  WHEN review >= lo AND admissible >= 0.45 AND weakest >= 0.35 THEN 'review' ELSE 'defer' END AS action FROM scored, q) GROUP BY 1""",
    "scored",
)
def cnd7(spark, sf):
    s = scored(spark, sf)
    q = R.quantiles(s, "review", [0.8, 0.4]).select(c("q")[0].alias("hi"), c("q")[1].alias("lo"))
    a = E.review_action(c("review"), c("hi"), c("lo"), c("admissible"), c("weakest"), c("conflict"), c("route"), F.lit("reviewable"))
    return s.crossJoin(F.broadcast(q)).groupBy(a.alias("action")).agg(F.count(F.lit(1)).alias("n"))


_bands("CND8_rank_band", lambda: E.rank_band(c("rank")), None, "CASE WHEN rank <= 5 THEN 'rank_1_5' WHEN rank <= 10 THEN 'rank_6_10' ELSE 'rank_11_20' END")
_bands("CND9_rank_bin", lambda: E.rank_bin(c("rank")), None, "CASE WHEN rank = 1 THEN 'rank_01' WHEN rank <= 5 THEN 'rank_02_05' WHEN rank <= 10 THEN 'rank_06_10' ELSE 'rank_11_20' END")
_bands(
    "CND10_evidence_state",
    lambda: E.evidence_state(c("failed"), c("query") % 31 == 0, c("weakest") < 0.3, c("pct") <= 0.2, c("conflict") >= 0.6),
    None,
    "CASE WHEN failed OR query % 31 = 0 THEN 'measurement_failure' WHEN weakest < 0.3 OR pct <= 0.2 OR conflict >= 0.6 THEN 'evidence_stress' ELSE 'ordinary' END",
)


@query(
    "CND11_mechanism_state",
    """WITH f AS (SELECT a, b, CASE WHEN n_descriptors = 2 THEN 'both' WHEN mega_sim IS NOT NULL THEN 'megadescriptor_only' ELSE 'dinov2_only' END AS support,
  round(abs(mega_sim - dino_sim), 6) AS gap, (a % 19 = 0 OR b % 19 = 0) AS failure, (a * 31 + b) % 13 = 0 AS stress, ((a * 7 + b * 3) % 100) / 100.0::DOUBLE AS local_pct, best_rank FROM pairs),
m AS (SELECT a, b, (rank() OVER (ORDER BY gap) - 1 + count(*) OVER (PARTITION BY gap) / 2.0::DOUBLE) / count(*) OVER () AS dpct FROM f WHERE support = 'both')
SELECT f.a, f.b, CASE WHEN failure THEN 'automatic_measurement_failure' WHEN stress THEN 'image_quality_stress' WHEN local_pct <= 0.20 THEN 'local_correspondence_bottom_quintile'
  WHEN support <> 'both' THEN 'descriptor_exclusive' WHEN dpct >= 0.80 THEN 'dual_descriptor_percentile_disagreement_top_quintile' ELSE 'ordinary_reference' END AS state, round(dpct, 6) AS dpct
FROM f LEFT JOIN m USING (a, b)""",
    "pairs",
)
def cnd11(spark, sf):
    from ..operators.ranks import midrank

    p = T.pairs(spark, sf)
    f = p.select(
        "a", "b",
        F.when(c("n_descriptors") == 2, "both").when(c("mega_sim").isNotNull(), "megadescriptor_only").otherwise("dinov2_only").alias("support"),
        F.round(F.abs(c("mega_sim") - c("dino_sim")), 6).alias("gap"),
        ((c("a") % 19 == 0) | (c("b") % 19 == 0)).alias("failure"), ((c("a") * 31 + c("b")) % 13 == 0).alias("stress"),
        (((c("a") * 7 + c("b") * 3) % 100) / 100.0).alias("local_pct"),
    )
    m = midrank(f.where("support = 'both'"), "gap", "dpct").select("a", "b", "dpct")
    return f.join(m, ["a", "b"], "left").select("a", "b", E.mechanism_state(c("failure"), c("stress"), c("local_pct"), c("support"), c("dpct")).alias("state"), r6(c("dpct")).alias("dpct"))


_bands("CND12_conflict_group", lambda: E.conflict_group(c("pct"), c("reliability")), None, "CASE WHEN pct >= 0.90 AND reliability <= 0.40 THEN 'high_similarity_low_admissibility_conflict' WHEN pct >= 0.90 AND reliability >= 0.70 THEN 'high_similarity_high_admissibility' WHEN pct >= 0.90 THEN 'high_similarity_intermediate_admissibility' ELSE 'not_high_similarity' END")
_bands("CND13_fixed_bins", lambda: E.right_closed_bins(c("q_clip"), [-0.001, 0.0, 0.05, 0.1, 1.0], ["zero", "low", "mid", "high"]), None, "CASE WHEN q_clip <= 0 THEN 'zero' WHEN q_clip <= 0.05 THEN 'low' WHEN q_clip <= 0.1 THEN 'mid' ELSE 'high' END")
_bands(
    "CND14_later_wins",
    lambda: E.selection_bucket(~c("failed"), c("pct") >= 0.75, c("rank") <= 15, c("same"), c("rank") <= 5, c("rank") == 1),
    None,
    "CASE WHEN rank = 1 AND NOT failed THEN 'strict_core' WHEN rank <= 5 AND NOT failed THEN 'balanced_only' WHEN same AND NOT failed THEN 'current_high_final_not_balanced' WHEN rank <= 15 AND NOT failed THEN 'broad_reserve' WHEN pct >= 0.75 AND NOT failed THEN 'high_score_uncertain_or_partial' WHEN failed THEN 'hard_invalid' ELSE 'outside_recalibrated_pool' END",
)


@query(
    "CND15_domain_shift",
    """SELECT reason, score, count(*) AS n FROM (SELECT CASE WHEN q_species <> c_species THEN 'species_mismatch' WHEN q_domain <> c_domain THEN 'domain_mismatch' WHEN q_scope <> c_scope THEN 'scope_mismatch_same_domain'
 WHEN q_scope = 'lynx-wild' THEN 'same_scope_known_id_wild' WHEN q_scope = 'bobcat-urban' THEN 'same_scope_urban_periurban_stress' ELSE 'same_scope_wild_bobcat_transfer' END AS reason,
 CASE WHEN q_species <> c_species THEN 1.0 WHEN q_domain <> c_domain THEN 0.85 WHEN q_scope <> c_scope THEN 0.55 WHEN q_scope = 'lynx-wild' THEN 0.10 WHEN q_scope = 'bobcat-urban' THEN 0.35 ELSE 0.20 END::DOUBLE AS score FROM evidence) GROUP BY 1, 2""",
    "evidence",
)
def cnd15(spark, sf):
    s = E.domain_shift(c("q_species"), c("c_species"), c("q_domain"), c("c_domain"), c("q_scope"), c("c_scope"))
    return T.evidence(spark, sf).select(s.alias("s")).groupBy(c("s.reason").alias("reason"), c("s.score").alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "CND16_descriptor_consensus",
    """SELECT a, b, CASE WHEN f AND g THEN 'both_reciprocal' WHEN f OR g THEN 'both_agreement' ELSE 'unsupported' END AS category,
  CASE WHEN m IS NULL THEN 'not_retrieved' WHEN m <= 5 THEN 'top_5' WHEN m <= 10 THEN 'top_10' ELSE 'top_20' END AS band
FROM (SELECT *, greatest(CASE WHEN f THEN greatest(mega_ab, dino_ab) END, CASE WHEN g THEN greatest(mega_ba, dino_ba) END) AS m
  FROM (SELECT *, (mega_ab IS NOT NULL AND dino_ab IS NOT NULL) AS f, (mega_ba IS NOT NULL AND dino_ba IS NOT NULL) AS g FROM pairs))""",
    "pairs",
)
def cnd16(spark, sf):
    s = E.consensus(c("mega_ab"), c("mega_ba"), c("dino_ab"), c("dino_ba"))
    return T.pairs(spark, sf).select("a", "b", s.alias("s")).select("a", "b", "s.category", "s.band")


@query(
    "CND17_admission_route",
    """SELECT route, reason, count(*) AS n FROM (SELECT CASE WHEN k THEN 'conflict_review' WHEN review >= 0.7 THEN 'accept_review' WHEN review >= 0.5 THEN 'cautious_review' ELSE 'defer_low_evidence' END AS route,
 CASE WHEN k THEN 'high_descriptor_similarity_low_pair_evidence_or_descriptor_agreement' WHEN review >= 0.7 THEN 'score_above_alpha_0_15_threshold' WHEN review >= 0.5 THEN 'score_above_alpha_0_30_threshold' ELSE 'score_below_cautious_threshold' END AS reason
 FROM (SELECT *, pct >= 0.75 AND (q_sharp < 0.49 OR c_sharp < 0.55 OR q_visible < 0.65) AS k FROM scored)) GROUP BY 1, 2""",
    "scored",
)
def cnd17(spark, sf):
    s = E.admission_route(c("review"), c("pct"), c("q_sharp"), c("c_sharp"), c("q_visible"), 0.7, 0.5)
    return scored(spark, sf).select(s.alias("s")).groupBy("s.route", "s.reason").agg(F.count(F.lit(1)).alias("n"))


_FAMILIES = ["B_image_filter_query_only", "B_image_filter_gallery_only", "B_image_filter_query_and_gallery", "C_pair_level_topk_pruning", "D_defer"]
_STRICT = ["lenient", "standard", "strict", "defer_heavy", "exclusion_heavy"]


@query(
    "CND18_policy_assignment",
    """WITH g AS (SELECT * FROM (VALUES ('B_image_filter_query_only'), ('B_image_filter_gallery_only'), ('B_image_filter_query_and_gallery'), ('C_pair_level_topk_pruning'), ('D_defer')) f(family),
  (VALUES ('lenient'), ('standard'), ('strict'), ('defer_heavy'), ('exclusion_heavy')) s(strictness), (VALUES ('none'), ('defer'), ('exclude')) k(action)),
x AS (SELECT g.*, q_sharp >= 0.4 AS qp, c_sharp >= 0.4 AS gp, reliability >= 0.5 AS pp, conflict >= 0.5 AS severe, pct >= 0.9 AND weakest < 0.4 AS contra, reliability * 100 AS pm FROM scored, g),
y AS (SELECT *, CASE family WHEN 'B_image_filter_query_only' THEN qp WHEN 'B_image_filter_gallery_only' THEN gp WHEN 'B_image_filter_query_and_gallery' THEN qp AND gp END AS filt, qp AND gp AND pp AS fine FROM x),
z AS (SELECT *, CASE WHEN fine THEN 'review_candidate' WHEN family <> 'C_pair_level_topk_pruning' THEN 'defer_candidate' ELSE 'exclude_candidate' END AS a1 FROM y),
u AS (SELECT *, CASE WHEN strictness = 'lenient' AND severe AND a1 <> 'exclude_candidate' THEN 'defer_candidate' WHEN strictness = 'standard' AND severe THEN 'defer_candidate'
  WHEN strictness = 'strict' AND severe THEN CASE WHEN pm < 75 THEN 'exclude_candidate' ELSE 'defer_candidate' END WHEN strictness = 'defer_heavy' AND (severe OR NOT fine) THEN 'defer_candidate'
  WHEN strictness = 'exclusion_heavy' AND (severe OR NOT fine) THEN 'exclude_candidate' ELSE a1 END AS a2 FROM z)
SELECT family, strictness, action, CASE WHEN filt IS NOT NULL THEN CASE WHEN filt THEN 'review_candidate' ELSE 'exclude_candidate' END
  WHEN action = 'defer' AND contra AND a2 = 'review_candidate' THEN 'defer_candidate' WHEN action = 'exclude' AND contra THEN 'exclude_candidate' ELSE a2 END AS assignment, count(*) AS n FROM u GROUP BY 1, 2, 3, 4""",
    "scored",
)
def cnd18(spark, sf):
    grid = [(f, s, a) for f in _FAMILIES for s in _STRICT for a in ("none", "defer", "exclude")]
    g = spark.createDataFrame(grid, "family string, strictness string, action string")
    # a policy sees six conditions of a row only, so what meets the grid is their combinations with counts
    facts = {"qp": c("q_sharp") >= 0.4, "gp": c("c_sharp") >= 0.4, "pp": c("reliability") >= 0.5, "severe": c("conflict") >= 0.5, "contra": (c("pct") >= 0.9) & (c("weakest") < 0.4), "low": c("reliability") * 100 < 75.0}
    x = scored(spark, sf).groupBy(*[v.alias(k) for k, v in facts.items()]).agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(g))
    a = E.policy_assignment(c("family"), c("strictness"), c("action"), c("qp"), c("gp"), c("pp"), c("severe"), c("contra"), F.when(c("low"), 0.0).otherwise(100.0))
    return x.groupBy("family", "strictness", "action", a.alias("assignment")).agg(F.sum("rows").alias("n"))


_FLAG_SQL = {n: f"query % {k} = {i % k}" for i, (n, k) in enumerate(zip([x for v in E.FAILURES.values() for x in v], [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43]))}


@query(
    "CND19_failure_profile",
    "SELECT profile, count(*) FILTER (profile <> 'ignore' AND ("
    + " OR ".join(f"(profile IN ({', '.join(repr(x) for x in list(E.FAILURES)[i:])}) AND ({' OR '.join('(' + _FLAG_SQL[f] + ')' for f in fs)}))" for i, fs in enumerate(E.FAILURES.values()))
    + ")) AS masked, count(*) AS n FROM memberships, (VALUES ('ignore'), ('standard'), ('conservative'), ('side_sensitive'), ('all_failure_flags')) p(profile) GROUP BY 1",
    "memberships",
)
def cnd19(spark, sf):
    p = spark.createDataFrame([(x,) for x in ["ignore", *E.FAILURES]], "profile string")
    m = T.memberships(spark, sf).crossJoin(F.broadcast(p))
    mask = E.failure_mask(c("profile"), {n: F.expr(s) for n, s in _FLAG_SQL.items()})
    return m.groupBy("profile").agg(F.count(F.when(mask, 1)).alias("masked"), F.count(F.lit(1)).alias("n"))


@query(
    "CND20_flag_list",
    """SELECT image_id, coalesce(nullif(concat_ws(';', CASE WHEN sharp <= 0.1 THEN 'blur_risk' END, CASE WHEN clip >= 0.2 THEN 'clipped' END, CASE WHEN side = 'unknown' THEN 'weak_side_flank' END, CASE WHEN visible < 0.35 THEN 'low_body_visibility' END), ''), 'none') AS flags FROM images""",
    "images",
)
def cnd20(spark, sf):
    return T.images(spark, sf).select("image_id", E.flag_list((c("sharp") <= 0.1, "blur_risk"), (c("clip") >= 0.2, "clipped"), (c("side") == "unknown", "weak_side_flank"), (c("visible") < 0.35, "low_body_visibility")).alias("flags"))


@query("CND21_area_bin", "SELECT b, count(*) AS n FROM (SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a < 0.10 THEN 'lt_10pct' WHEN a < 0.15 THEN '10_15pct' WHEN a < 0.20 THEN '15_20pct' WHEN a < 0.30 THEN '20_30pct' ELSE 'ge_30pct' END AS b FROM (SELECT CASE WHEN failed THEN NULL ELSE visible / 2 END AS a FROM images)) GROUP BY 1", "images")
def cnd21(spark, sf):
    return T.images(spark, sf).groupBy(E.area_bin(F.when(~c("failed"), c("visible") / 2)).alias("b")).agg(F.count(F.lit(1)).alias("n"))


_bands("CND22_simulation_decision", lambda: E.simulation_decision(c("route"), ["accept_review_ready", "review"], ["defer_low_evidence"]), None, "CASE WHEN route IN ('accept_review_ready', 'review') THEN 'admitted_pre_inference' WHEN route = 'defer_low_evidence' THEN 'deferred_pre_inference' ELSE 'unmapped_route' END")

# ---------------------------------------------------------------- scalar scores


def _score(key, expr, sql, source="scored", keys=("descriptor", "query", "candidate")):
    src = {"scored": scored, "images": T.images, "pairs": T.pairs, "outcomes": T.outcomes, "evidence": T.evidence}[source]
    ks = ", ".join(keys)

    @query(key, f"SELECT {ks}, {sql} AS v FROM {source}", source)
    def run(spark, sf):
        return src(spark, sf).select(*keys, expr().alias("v"))

    return run


def _mean(key, expr, sql):
    """Mean of a score whose single values end in exact halves of the sixth digit."""

    @query(key, f"SELECT descriptor, query % 7 AS g, count(*) AS n, round(avg({sql}), 4) AS v FROM scored GROUP BY 1, 2", "scored")
    def run(spark, sf):
        return scored(spark, sf).groupBy("descriptor", (c("query") % 7).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(expr()), 4).alias("v"))


_P, _I, _O = ("a", "b"), ("image_id",), ("id",)
_score("SC1_clamp01", lambda: r6(E.clamp01(c("sharp") * 2 - 0.5)), f"round({_CL('sharp * 2 - 0.5')}, 6)", "images", _I)


@query("SC2_cosine", "SELECT p.a % 7 AS g, count(*) AS n, round(avg(list_inner_product(x.v, y.v)), 6) AS cos, round(avg(round_even(greatest(0, least(1, (list_inner_product(x.v, y.v) + 1) / 2)), 8)), 6) AS cos01 FROM pairs p JOIN images x ON p.a = x.image_id JOIN images y ON p.b = y.image_id GROUP BY 1", "pairs", "images")
def sc2(spark, sf):
    im = T.images(spark, sf)
    j = T.pairs(spark, sf).select("a", "b").join(im.select(c("image_id").alias("a"), c("v").alias("x")), "a").join(im.select(c("image_id").alias("b"), c("v").alias("y")), "b")
    return j.groupBy((c("a") % 7).alias("g")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(knn.cosine(c("x"), c("y")))).alias("cos"), r6(F.avg(knn.cosine01(c("x"), c("y")))).alias("cos01"))


@query("SC3_l2_normalise", "SELECT image_id, round(sqrt(list_inner_product(h, h)), 6) AS norm, round(h[1], 6) AS first FROM halves", "halves")
def sc3(spark, sf):
    h = T.images(spark, sf).select("image_id", knn.normalised(F.slice("v", 1, 32)).alias("h"))
    return h.select("image_id", r6(F.sqrt(knn.cosine(c("h"), c("h")))).alias("norm"), r6(c("h")[0]).alias("first"))


_score("SC4_size_compatibility", lambda: E.size_compatibility(c("q_dim"), c("c_dim")), "round_even(least(q_dim, c_dim) / greatest(q_dim, c_dim)::DOUBLE, 6)", "evidence")
_score("SC4b_area_compatibility", lambda: E.area_compatibility(c("q_dim"), c("c_dim")), "round_even(sqrt(least(q_dim, c_dim) / greatest(q_dim, c_dim)::DOUBLE), 6)", "evidence")
_score("SC5_aspect_compatibility", lambda: E.aspect_compatibility(c("q_aspect"), c("c_aspect")), f"round_even({_CL('1.0 - abs(q_aspect - c_aspect) / greatest(q_aspect, c_aspect)')}, 6)", "evidence")
_score("SC6_image_quality", lambda: E.image_quality(F.least("width", "height"), c("width") * c("height") / 1e6), f"round_even(0.55 * {_CL('least(width, height) / 512.0::DOUBLE')} + 0.45 * {_CL('width * height / 1e6::DOUBLE / 0.75')}, 6)", "images", _I)
_score(
    "SC7_side_comparability",
    lambda: r6(E.side_comparability(c("q_side"), c("c_side"), c("q_visible"), c("c_visible"))),
    "round(least(q_visible, c_visible) * CASE WHEN q_side IN ('left','right','both') AND c_side IN ('left','right','both') THEN CASE WHEN q_side = c_side THEN 1.0 ELSE 0.25 END WHEN q_side = c_side AND q_side <> 'unknown' THEN 0.5 ELSE 0.4 END, 6)",
    "evidence",
)
_score(
    "SC8_side_direction",
    lambda: E.side_direction(c("q_side"), c("c_side")),
    "CASE WHEN q_side = c_side AND q_side IN ('left','right') THEN 1.0 WHEN q_side IN ('left','right') AND c_side IN ('left','right') THEN 0.45 WHEN q_side = 'unknown' OR c_side = 'unknown' THEN 0.65 ELSE 0.25 END::DOUBLE",
    "evidence",
)
_score("SC9_viewpoint", lambda: r6(E.viewpoint_compatibility(c("q_side") == "front", c("c_side") == "front", c("q_sharp") < 0.1, c("c_sharp") < 0.1)), "round(greatest(0, 1 - (CASE WHEN q_side = 'front' THEN 0.3 ELSE 0 END + CASE WHEN c_side = 'front' THEN 0.3 ELSE 0 END + CASE WHEN q_sharp < 0.1 THEN 0.5 ELSE 0 END + CASE WHEN c_sharp < 0.1 THEN 0.5 ELSE 0 END)), 6)::DOUBLE", "evidence")
_score("SC10_weighted_pair_score", lambda: r6(E.weighted_score({"q_sharp": 0.35, "c_sharp": 0.35, "q_visible": 0.2, "c_visible": 0.1})), "round(0.35 * q_sharp + 0.35 * c_sharp + 0.2 * q_visible + 0.1 * c_visible, 6)", "evidence")
_mean(
    "SC11_conflict_and_utility",
    lambda: (E.candidate_utility(c("pct"), c("reliability"), (c("rank") <= 5).cast("double"), c("q_sharp"), (c("rank") > 10).cast("double"), E.conflict_score(c("pct"), c("reliability"), c("q_visible")))),
    "greatest(0, least(1, 0.45 * pct + 0.25 * reliability + 0.10 * (rank <= 5)::INT + 0.10 * q_sharp - 0.05 * (rank > 10)::INT - 0.15 * (pct * q_visible * (1 - reliability))))",
)
_mean("SC12_admissibility_review", lambda: c("admissible") + c("review"), "admissible + review")
_score("SC13_weakest_link", lambda: r6(F.least("q_sharp", "c_sharp") - F.greatest("q_clip", "c_clip")), "round(least(q_sharp, c_sharp) - greatest(q_clip, c_clip), 6)", "evidence")


@query("SC14_hard_negative", "WITH q AS (SELECT descriptor, quantile_cont(similarity, 0.9) AS q90 FROM evidence GROUP BY 1) SELECT e.descriptor, CASE WHEN NOT same AND similarity >= q90 AND reliability <= 0.40 THEN 0.25 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n FROM evidence e JOIN q USING (descriptor) GROUP BY 1, 2", "evidence")
def sc14(spark, sf):
    e = T.evidence(spark, sf)
    q = e.groupBy("descriptor").agg(F.percentile("similarity", F.lit(0.9)).alias("q90"))
    w = F.when(~c("same") & (c("similarity") >= c("q90")) & (c("reliability") <= 0.40), 0.25).otherwise(1.0)
    return e.join(F.broadcast(q), "descriptor").groupBy("descriptor", w.alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SC15_rerank_families",
    """SELECT method, alpha, descriptor, query % 7 AS g, round(avg(CASE method WHEN 'descriptor' THEN pct WHEN 'blend' THEN (1 - alpha) * pct + alpha * admissible WHEN 'penalty' THEN pct - alpha * conflict ELSE pct * pow(reliability, alpha) END), 4) AS score
FROM scored, (VALUES ('descriptor', 0.0::DOUBLE), ('blend', 0.25), ('blend', 0.5), ('penalty', 0.35), ('gate', 0.5)) g(method, alpha) GROUP BY 1, 2, 3, 4""",
    "scored",
)
def sc15(spark, sf):
    g = spark.createDataFrame([("descriptor", 0.0), ("blend", 0.25), ("blend", 0.5), ("penalty", 0.35), ("gate", 0.5)], "method string, alpha double")
    s = (
        F.when(c("method") == "descriptor", c("pct"))
        .when(c("method") == "blend", (1 - c("alpha")) * c("pct") + c("alpha") * c("admissible"))
        .when(c("method") == "penalty", c("pct") - c("alpha") * c("conflict"))
        .otherwise(c("pct") * F.pow("reliability", "alpha"))
    )
    return scored(spark, sf).crossJoin(F.broadcast(g)).groupBy("method", "alpha", "descriptor", (c("query") % 7).alias("g")).agg(F.round(F.avg(s), 4).alias("score"))


def policies(df):
    """Long form: one row for each policy with its score."""
    p = E.policy_scores(c("pct"), c("weakest"), c("admissible"), c("review"), c("conflict"))
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("score")) for k, v in p.items()])).alias("x")
    return df.select("*", pair).select("*", "x.policy", "x.score").drop("x")


cte(
    "policies",
    """SELECT *, 'descriptor_only' AS policy, pct AS score FROM scored UNION ALL SELECT *, 'quality_only', weakest FROM scored UNION ALL SELECT *, 'evidence_admissibility', admissible FROM scored
 UNION ALL SELECT *, 'evidence_review_router', review FROM scored UNION ALL SELECT *, 'conflict_penalized_descriptor', greatest(0, pct - 0.35 * conflict) FROM scored""",
    "scored",
)


@query("SC16_policy_scores", "SELECT policy, descriptor, count(*) AS n, round(avg(score), 6) AS mean FROM policies GROUP BY 1, 2", "policies")
def sc16(spark, sf):
    return policies(scored(spark, sf)).groupBy("policy", "descriptor").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("mean"))


_score("SC17_sigmoid_logit", lambda: r6(E.sigmoid(E.logit(c("p")) * 2)), "round(1 / (1 + exp(-greatest(-35, least(35, 2 * ln(p / (1 - p)))))), 6)", "outcomes", _O)
_score("SC18_platt", lambda: r6(E.platt(c("p"), 0.2, 1.3)), "round(1 / (1 + exp(-(0.2 + 1.3 * ln(p / (1 - p))))), 6)", "outcomes", _O)


@query("SC19_ipw_normalised", "SELECT id, round((1 / p) / avg(1 / p) OVER (), 6) AS hajek, round(sqrt(1 / p) / avg(sqrt(1 / p)) OVER (), 6) AS root FROM outcomes", "outcomes")
def sc19(spark, sf):
    o = T.outcomes(spark, sf).withColumn("i", 1 / c("p"))
    m = o.agg(F.avg("i").alias("m"), F.avg(F.sqrt("i")).alias("r"))
    return o.crossJoin(F.broadcast(m)).select("id", r6(c("i") / c("m")).alias("hajek"), r6(F.sqrt("i") / c("r")).alias("root"))


_score("SC20_pair_id", lambda: E.pair_id(c("a"), c("b")), "'pair_' || sha256('[\"' || least(a::VARCHAR, b::VARCHAR) || '\",\"' || greatest(a::VARCHAR, b::VARCHAR) || '\"]')", "pairs", _P)
_score("SC21_opaque_token", lambda: F.concat(F.lit("tok_"), F.substring(H.hmac_sha256(bytes(32), F.concat_ws("|", F.lit("token"), c("image_id").cast("string"))), 1, 16)), "'tok_' || substr(" + H.hmac_sql("'token|' || image_id::VARCHAR") + ", 1, 16)", "images", _I)


@query("SC22_commitment_digest", "SELECT fold, sha256(string_agg(id::VARCHAR || '|' || y::VARCHAR, chr(10) ORDER BY id::VARCHAR || '|' || y::VARCHAR)) AS digest, count(*) AS n FROM outcomes GROUP BY 1", "outcomes")
def sc22(spark, sf):
    line = F.concat_ws("|", c("id").cast("string"), c("y").cast("string"))
    return T.outcomes(spark, sf).groupBy("fold").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


_score("SC23_path_segment", lambda: F.try_element_at(F.split(F.concat_ws("/", F.lit("data"), c("domain"), c("site"), c("name")), "/"), F.lit(3)), "split_part('data/' || domain || '/' || site || '/' || name, '/', 3)", "images", _I)
_score("SC24_id_remap", lambda: F.concat(F.lit("legacy_"), F.lpad(F.regexp_extract("name", r"_0*(\d+)$", 1), 4, "0")), "'legacy_' || lpad(regexp_extract(name, '_0*(\\d+)$', 1), 4, '0')", "images", _I)
_score("SC25_category_canonical", lambda: F.coalesce(F.nullif(F.lower(F.trim(F.when(c("side") == "unknown", F.lit("  ")).otherwise(F.upper("side")))), F.lit("")), F.lit("__MISSING__")), "CASE WHEN side = 'unknown' THEN '__MISSING__' ELSE side END", "images", _I)


@query(
    "SC26_risk_term_scan",
    r"SELECT doc_id, regexp_matches(lower(text), '\b(idiot|scum|trash|stupid)\b') AS risk, regexp_matches(lower(text), '\b(not|no|never|without)\b[^.]{0,40}\b(idiot|scum|trash|stupid)\b') AS negated FROM documents",
)
def sc26(spark, sf):
    t = F.lower("text")
    return T.table(spark, sf, "documents").select("doc_id", t.rlike(r"\b(idiot|scum|trash|stupid)\b").alias("risk"), t.rlike(r"\b(not|no|never|without)\b[^.]{0,40}\b(idiot|scum|trash|stupid)\b").alias("negated"))


@query("SC27_token_in_name", "SELECT url, page_id, (contains(lower(url), 'blog') OR contains(lower(url), 'news')) AS hit FROM pages")
def sc27(spark, sf):
    u = F.lower("url")
    return T.table(spark, sf, "pages").select("url", "page_id", (u.contains("blog") | u.contains("news")).alias("hit"))


@query("SC28_value_token_hits", "SELECT source, count(*) FILTER (contains(lower(text), 'license')) AS license, count(*) FILTER (contains(text, '@')) AS at_sign, count(*) AS n FROM documents GROUP BY 1")
def sc28(spark, sf):
    return T.table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(F.lower("text").contains("license"), 1)).alias("license"), F.count(F.when(c("text").contains("@"), 1)).alias("at_sign"), F.count(F.lit(1)).alias("n"))


@query("SC29_utc_parse", "SELECT event_id, epoch_us(ts) AS us FROM events")
def sc29(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return T.table(spark, sf, "events").select("event_id", F.unix_micros(F.to_timestamp(text)).alias("us"))


_score("SC30_grid_value", lambda: E.grid_value(c("visible")), "(visible BETWEEN 0 AND 1 AND abs(round_even(visible * 20, 0) - visible * 20) < 1e-9)", "images", _I)
_score("SC31_canonical_measurement", lambda: E.canonical_measurement(c("q_sharp"), c("c_sharp"), c("query") % 17 == 0, c("candidate") % 17 == 0), "CASE WHEN query % 17 = 0 OR candidate % 17 = 0 THEN NULL ELSE least(q_sharp, c_sharp) END", "evidence")


@query(
    "SC35_component_risks",
    f"""SELECT descriptor, query, candidate, round_even({_CL('0.65 * (1.0 - q_visible) + 0.35 * q_clip')}, 6) AS image_evidence_deficit, round_even({_CL('0.60 * (1.0 - c_visible) + 0.40 * (1.0 - c_sharp)')}, 6) AS pair_non_comparability,
 round_even({_CL('greatest(0.0, pct - 0.70) * 1.8 + greatest(0.0, 0.55 - q_sharp)')}, 6) AS descriptor_evidence_conflict FROM scored""",
    "scored",
)
def sc35(spark, sf):
    k = E.component_risks(c("q_visible"), c("q_clip"), c("c_visible"), c("c_sharp"), c("pct"), c("q_sharp"))
    return scored(spark, sf).select("descriptor", "query", "candidate", *[v.alias(n) for n, v in k.items()])


_score(
    "SC36_detector_score",
    lambda: r6(E.detector_score(c("sharp"), c("visible"), c("clip"), c("clip") * 2, c("failed").cast("double"))),
    f"round({_CL('0.45 * sharp + 0.40 * CASE WHEN visible <= 0 THEN 0.0 WHEN visible <= 0.015 THEN 0.15 WHEN visible <= 0.035 THEN 0.35 WHEN visible <= 0.060 THEN 0.55 WHEN visible <= 0.850 THEN 1.0 ELSE 0.75 END + 0.15 * (least(clip / 0.18, 1.0) * 0.5 + least(clip * 2 / 0.18, 1.0) * 0.5) - 0.18 * failed::INT')}, 6)",
    "images", _I,
)


@query(
    "SC37_positive_pair_weights",
    "SELECT i.image_id, round(CASE WHEN n >= 2 THEN 0.45 * sharp + 0.20 * visible + 0.15 * (1 - clip) + 0.20 ELSE 0 END, 6) AS admissible_weight, CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS uniform_weight FROM images i JOIN (SELECT identity, site, count(DISTINCT image_id) AS n FROM images GROUP BY 1, 2) g ON i.identity = g.identity AND i.site = g.site",
    "images",
)
def sc37(spark, sf):
    i = T.images(spark, sf).drop("v")
    g = i.groupBy("identity", "site").agg(F.countDistinct("image_id").alias("n"))
    return i.join(g, ["identity", "site"]).select("image_id", r6(F.when(c("n") >= 2, 0.45 * c("sharp") + 0.20 * c("visible") + 0.15 * (1 - c("clip")) + 0.20).otherwise(0.0)).alias("admissible_weight"), F.when(c("n") >= 2, 1.0).otherwise(0.0).alias("uniform_weight"))


@query(
    "SC38_policy_weight_table",
    "SELECT policy, descriptor, query % 7 AS g, round(avg(w1 * pct + w2 * admissible - w3 * conflict), 4) AS best FROM scored, (VALUES ('a', 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('b', 0.6, 0.4, 0.1), ('c', 0.3, 0.7, 0.3)) p(policy, w1, w2, w3) GROUP BY 1, 2, 3",
    "scored",
)
def sc38(spark, sf):
    p = spark.createDataFrame([("a", 1.0, 0.0, 0.0), ("b", 0.6, 0.4, 0.1), ("c", 0.3, 0.7, 0.3)], "policy string, w1 double, w2 double, w3 double")
    return scored(spark, sf).crossJoin(F.broadcast(p)).groupBy("policy", "descriptor", (c("query") % 7).alias("g")).agg(F.round(F.avg(c("w1") * c("pct") + c("w2") * c("admissible") - c("w3") * c("conflict")), 4).alias("best"))


_bands(
    "SC39_reason_support",
    lambda: E.reason_support(F.when(c("rank") % 2 == 0, "image_evidence_deficit").otherwise("descriptor_evidence_conflict"), F.concat_ws(";", c("route"), c("q_side"))),
    None,
    "CASE WHEN rank % 2 = 0 AND contains(route, 'low_evidence') THEN 'human_or_route_supported' WHEN rank % 2 = 1 AND contains(route, 'conflict') THEN 'route_supported_feature_conflict' ELSE 'component_attribution_only' END",
)
