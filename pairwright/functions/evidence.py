"""Scores, bands and routes of image pairs as column expressions.

Thresholds, weights and labels are fixed values of the evidence model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def clamp01_or(x: Column, default: float = 0.5) -> Column:
    """NaN and NULL become the default."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(clamp01(x))


def cascade(default: str | None, *cases: tuple[Column, str]) -> Column:
    """First case that holds."""
    out = reduce(lambda acc, c: F.when(c[0], F.lit(c[1])) if acc is None else acc.when(c[0], F.lit(c[1])), cases, None)
    return out if default is None else out.otherwise(F.lit(default))


def banded(x: Column, cuts: list[tuple[float, str]], default: str) -> Column:
    """Label of the first descending cut that x reaches; NULL takes the default."""
    return cascade(default, *[(x >= c, label) for c, label in cuts])


def reliability_band(x: Column) -> Column:
    return banded(x, [(0.75, "high"), (0.50, "medium"), (0.25, "low")], "unusable")


def conflict_band(x: Column) -> Column:
    return banded(x, [(0.75, "high_conflict"), (0.50, "medium_conflict"), (0.25, "low_conflict")], "minimal_conflict")


def pair_band(x: Column) -> Column:
    return banded(x, [(0.80, "high_comparability"), (0.55, "reviewable_comparability"), (0.30, "low_comparability")], "non_comparable")


def review_decision(reliability: Column, conflict: Column) -> Column:
    return cascade(
        "defer_low_admissibility",
        (reliability < 0.25, "exclude_unusable_evidence"),
        (conflict >= 0.75, "defer_high_descriptor_evidence_conflict"),
        (reliability >= 0.50, "review_candidate"),
    )


def route_for_score(admissibility: Column, conflict: Column) -> Column:
    return cascade(
        "non_comparable",
        ((admissibility >= 0.78) & (conflict <= 0.20), "accept_review_ready"),
        ((admissibility >= 0.58) & (conflict <= 0.45), "review"),
        (admissibility >= 0.40, "defer_low_evidence"),
    )


def route_decision(pair: Column, weakest: Column, conflict: Column) -> Column:
    return cascade(
        "non_comparable",
        ((pair >= 0.80) & (weakest >= 0.60) & (conflict < 0.40), "accept"),
        ((pair >= 0.55) & (weakest >= 0.45) & (conflict < 0.70), "review"),
        ((pair >= 0.30) & (weakest >= 0.30), "defer"),
        (weakest < 0.25, "species_level_only"),
    )


def primary_reason(conflict: Column, side: Column, pattern: Column, weakest: Column, geometry: Column, pair: Column) -> Column:
    return cascade(
        "low_pair_admissibility",
        (conflict >= 0.70, "high_descriptor_evidence_conflict"),
        (side < 0.35, "side_or_flank_not_comparable"),
        (pattern < 0.35, "weak_pattern_evidence"),
        (weakest < 0.30, "weakest_image_low_evidence"),
        (geometry < 0.35, "animal_too_small_or_poor_detection_geometry"),
        (pair >= 0.55, "evidence_comparable"),
    )


def rank_band(rank: Column) -> Column:
    """1-5, 6-10, 11-20; any other rank is an error."""
    return F.when(rank.between(1, 5), "rank_1_5").when(rank.between(6, 10), "rank_6_10").when(rank.between(11, 20), "rank_11_20").otherwise(F.raise_error(F.concat(F.lit("rank out of range: "), rank.cast("string"))))


def rank_bin(rank: Column) -> Column:
    return cascade("rank_11_20", (rank == 1, "rank_01"), (rank <= 5, "rank_02_05"), (rank <= 10, "rank_06_10"))


def evidence_state(quality_failure: Column, local_failure: Column, quality_stress: Column, local_bottom: Column, disagreement_top: Column) -> Column:
    return cascade("ordinary", (quality_failure | local_failure, "measurement_failure"), (quality_stress | local_bottom | disagreement_top, "evidence_stress"))


def mechanism_state(failure: Column, stress: Column, local_pct: Column, support: Column, disagreement_pct: Column) -> Column:
    return cascade(
        "ordinary_reference",
        (failure, "automatic_measurement_failure"),
        (stress, "image_quality_stress"),
        (local_pct <= 0.20, "local_correspondence_bottom_quintile"),
        (support.isin("megadescriptor_only", "dinov2_only"), "descriptor_exclusive"),
        (disagreement_pct >= 0.80, "dual_descriptor_percentile_disagreement_top_quintile"),
    )


def conflict_group(similarity_pct: Column, reliability: Column) -> Column:
    high = similarity_pct >= 0.90
    return cascade(
        "not_high_similarity",
        (high & (reliability <= 0.40), "high_similarity_low_admissibility_conflict"),
        (high & (reliability >= 0.70), "high_similarity_high_admissibility"),
        (high, "high_similarity_intermediate_admissibility"),
    )


def selection_bucket(valid: Column, uncertain: Column, broad: Column, current: Column, balanced: Column, strict: Column) -> Column:
    """The last of a row of overwrites wins, so the cases are asked from the last."""
    return cascade(
        "outside_recalibrated_pool",
        (strict & valid, "strict_core"),
        (balanced & valid, "balanced_only"),
        (current & ~balanced & valid, "current_high_final_not_balanced"),
        (broad & valid, "broad_reserve"),
        (uncertain & valid, "high_score_uncertain_or_partial"),
        (~valid, "hard_invalid"),
    )


def domain_shift(q_species: Column, c_species: Column, q_domain: Column, c_domain: Column, q_scope: Column, c_scope: Column) -> Column:
    def made(score: float, reason: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    return (
        F.when(q_species != c_species, made(1.0, "species_mismatch"))
        .when(q_domain != c_domain, made(0.85, "domain_mismatch"))
        .when(q_scope != c_scope, made(0.55, "scope_mismatch_same_domain"))
        .when(q_scope == "lynx-wild", made(0.10, "same_scope_known_id_wild"))
        .when(q_scope == "bobcat-urban", made(0.35, "same_scope_urban_periurban_stress"))
        .otherwise(made(0.20, "same_scope_wild_bobcat_transfer"))
    )


def consensus(mega_ab: Column, mega_ba: Column, dino_ab: Column, dino_ba: Column) -> Column:
    """struct(category, band) of two descriptors' ranks in both directions."""
    forward, backward = mega_ab.isNotNull() & dino_ab.isNotNull(), mega_ba.isNotNull() & dino_ba.isNotNull()
    category = cascade("unsupported", (forward & backward, "both_reciprocal"), (forward | backward, "both_agreement"))
    none = F.lit(None).cast("bigint")
    most = F.greatest(F.when(forward, F.greatest(mega_ab, dino_ab)).otherwise(none), F.when(backward, F.greatest(mega_ba, dino_ba)).otherwise(none))
    return F.struct(category.alias("category"), cascade("not_retrieved", (most <= 5, "top_5"), (most <= 10, "top_10"), (most.isNotNull(), "top_20")).alias("band"))


def admission_route(score: Column, similarity_pct: Column, agreement: Column, overlap: Column, visible: Column, accept: float, cautious: float) -> Column:
    conflict = (similarity_pct >= 0.75) & ((agreement < 0.49) | (overlap < 0.55) | (visible < 0.65))

    def made(route: str, reason: str) -> Column:
        return F.struct(F.lit(route).alias("route"), F.lit(reason).alias("reason"))

    return (
        F.when(conflict, made("conflict_review", "high_descriptor_similarity_low_pair_evidence_or_descriptor_agreement"))
        .when(score >= accept, made("accept_review", "score_above_alpha_0_15_threshold"))
        .when(score >= cautious, made("cautious_review", "score_above_alpha_0_30_threshold"))
        .otherwise(made("defer_low_evidence", "score_below_cautious_threshold"))
    )


#: The failures that each profile adds to the one before it.
FAILURES = {
    "standard": ["pattern_none", "severe_blur", "major_occlusion", "frontal_rear"],
    "conservative": ["low_pattern_visibility", "low_body_fraction"],
    "side_sensitive": ["weak_side_evidence", "side_unknown"],
    "all_failure_flags": ["uncertainty_flag", "descriptor_disagreement", "high_descriptor_low_evidence"],
}


def failure_mask(profile: Column, flags: dict[str, Column]) -> Column:
    out, level = F.lit(False), list(FAILURES)
    for i, name in enumerate(level):
        within = profile.isin(*level[i:])
        for flag in FAILURES[name]:
            out = out | (within & flags[flag])
    return out


def policy_assignment(family: Column, strictness: Column, contradiction_action: Column, q_pass: Column, g_pass: Column, pair_pass: Column, severe: Column, contradiction: Column, pair_min: Column) -> Column:
    """review, defer or exclude: later rules overwrite earlier ones."""
    review, defer, exclude = F.lit("review_candidate"), F.lit("defer_candidate"), F.lit("exclude_candidate")
    filtered = (
        F.when(family.startswith("B_image_filter_query_only"), q_pass)
        .when(family.startswith("B_image_filter_gallery_only"), g_pass)
        .when(family.startswith("B_image_filter_query_and_gallery"), q_pass & g_pass)
    )
    fine = q_pass & g_pass & pair_pass
    first = F.when(fine, review).otherwise(F.when(family != "C_pair_level_topk_pruning", defer).otherwise(exclude))
    second = (
        F.when((strictness == "lenient") & severe & (first != exclude), defer)
        .when((strictness == "standard") & severe, defer)
        .when((strictness == "strict") & severe, F.when(pair_min < 75.0, exclude).otherwise(defer))
        .when((strictness == "defer_heavy") & (severe | ~fine), defer)
        .when((strictness == "exclusion_heavy") & (severe | ~fine), exclude)
        .otherwise(first)
    )
    third = F.when((contradiction_action == "defer") & contradiction & (second == review), defer).when((contradiction_action == "exclude") & contradiction, exclude).otherwise(second)
    return F.when(filtered.isNotNull(), F.when(filtered, review).otherwise(exclude)).otherwise(third)


def flag_list(*flags: tuple[Column, str]) -> Column:
    """Names of the flags that hold, in order, joined by ';' - or 'none'."""
    return F.coalesce(F.nullif(F.concat_ws(";", *[F.when(c, F.lit(n)) for c, n in flags]), F.lit("")), F.lit("none"))


def area_bin(area: Column) -> Column:
    return F.when(area.isNull(), "unknown").when(area < 0.10, "lt_10pct").when(area < 0.15, "10_15pct").when(area < 0.20, "15_20pct").when(area < 0.30, "20_30pct").otherwise("ge_30pct")


def simulation_decision(route: Column, admitted: list[str], deferred: list[str]) -> Column:
    return cascade("unmapped_route", (route.isin(*admitted), "admitted_pre_inference"), (route.isin(*deferred), "deferred_pre_inference"))


def review_action(score: Column, accept_at: Column, review_at: Column, comparability: Column, weakest: Column, conflict: Column, route: Column, band: Column) -> Column:
    species = (route == "species_level_only") | ((weakest < 0.25) & (comparability < 0.30))
    unfit = ~species & ((band == "non_comparable") | (route == "non_comparable") | (comparability < 0.15))
    return cascade(
        "defer",
        (unfit, "non_comparable"),
        (species, "species_level_only"),
        ((score >= accept_at) & (comparability >= 0.65) & (weakest >= 0.55) & (conflict < 0.50), "accept"),
        ((score >= review_at) & (comparability >= 0.45) & (weakest >= 0.35), "review"),
    )


def right_closed_bins(x: Column, edges: list[float], labels: list) -> Column:
    """Label of the bin (edge, next edge] that holds x; NULL outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        c = (x > lo) & (x <= hi)
        out = F.when(c, F.lit(label)) if out is None else out.when(c, F.lit(label))
    return out


def first_value(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def score_map(value: Column, mapping: dict[str, float], default: float) -> Column:
    entries = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(entries, F.lower(F.trim(value))), F.lit(default))


def known_equal(a: Column, b: Column) -> Column:
    """Equality that unknowns never satisfy."""
    return F.coalesce((a == b) & (a != "unknown") & (a != ""), F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


# ---------------------------------------------------------------- scores


def size_compatibility(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.bround(clamp01(F.least(a, b) / F.greatest(a, b)), 6))


def area_compatibility(area_a: Column, area_b: Column) -> Column:
    return F.when((area_a <= 0) | (area_b <= 0) | area_a.isNull() | area_b.isNull(), F.lit(0.6)).otherwise(F.bround(clamp01(F.sqrt(F.least(area_a, area_b) / F.greatest(area_a, area_b))), 6))


def aspect_compatibility(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.bround(clamp01(1.0 - F.abs(a - b) / F.greatest(a, b)), 6))


def image_quality(dimension: Column, megapixels: Column) -> Column:
    return F.bround(0.55 * clamp01(dimension / 512.0) + 0.45 * clamp01(megapixels / 0.75), 6)


def side_comparability(a: Column, b: Column, evidence_a: Column, evidence_b: Column) -> Column:
    known = ["left", "right", "both"]
    match = F.when(a.isin(*known) & b.isin(*known), F.when(a == b, 1.0).otherwise(0.25)).when((a == b) & ~a.isin("not_available", "unknown", "nan", ""), 0.50).otherwise(0.40)
    return clamp01(F.least(clamp01(evidence_a), clamp01(evidence_b)) * match)


def side_direction(a: Column, b: Column) -> Column:
    strong, weak, ends = ["left", "right", "both", "side"], ["unknown", "", "nan", "<na>"], ["frontal", "rear", "front", "back"]
    return (
        F.when((a == b) & a.isin(*strong), 1.0)
        .when((a == "both") & b.isin(*strong), 0.90)
        .when((b == "both") & a.isin(*strong), 0.90)
        .when(a.isin("left", "right") & b.isin("left", "right"), 0.45)
        .when(a.isin(*weak) | b.isin(*weak), 0.65)
        .when(a.isin(*ends) | b.isin(*ends), 0.25)
        .otherwise(0.50)
    )


def viewpoint_compatibility(q_end: Column, c_end: Column, q_silhouette: Column, c_silhouette: Column) -> Column:
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return clamp01(1.0 - (part(q_end, 0.30) + part(c_end, 0.30) + part(q_silhouette, 0.50) + part(c_silhouette, 0.50)))


def weighted_score(parts: dict[str, float]) -> Column:
    return clamp01(reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in parts.items()]))


def conflict_score(similarity_pct: Column, reliability: Column, *factors: Column) -> Column:
    return clamp01(reduce(lambda a, b: a * b, factors, similarity_pct) * (1.0 - reliability))


def candidate_utility(similarity_pct: Column, reliability: Column, reciprocal: Column, margin: Column, disagreement: Column, conflict: Column) -> Column:
    return clamp01(0.45 * similarity_pct + 0.25 * reliability + 0.10 * reciprocal + 0.10 * margin - 0.05 * disagreement - 0.15 * conflict)


def admissibility(weakest: Column, geometry: Column, conflict: Column, pct: Column) -> Column:
    return F.bround(clamp01(0.42 * weakest + 0.28 * geometry + 0.20 * (1.0 - conflict) + 0.10 * pct), 6)


def review_score(pct: Column, admissible: Column, conflict: Column) -> Column:
    return F.bround(clamp01(0.62 * pct + 0.38 * admissible - 0.20 * conflict), 6)


def component_risks(visible: Column, blur: Column, overlap: Column, side: Column, similarity_pct: Column, agreement: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "image_evidence_deficit": F.bround(clamp01(0.65 * (1.0 - visible) + 0.35 * blur), 6),
        "pair_non_comparability": F.bround(clamp01(0.60 * (1.0 - overlap) + 0.40 * (1.0 - side)), 6),
        "descriptor_evidence_conflict": F.bround(clamp01(F.greatest(zero, similarity_pct - 0.70) * 1.8 + F.greatest(zero, 0.55 - agreement)), 6),
    }


def detector_score(confidence: Column, area: Column, width: Column, height: Column, edge: Column) -> Column:
    one = F.lit(1.0)
    area_score = right_closed_bins(area, [-0.001, 0.0, 0.015, 0.035, 0.060, 0.850, 1.000], [0.0, 0.15, 0.35, 0.55, 1.0, 0.75])
    shape = F.least(width / 0.18, one) * 0.5 + F.least(height / 0.18, one) * 0.5
    return clamp01(0.45 * confidence + 0.40 * area_score + 0.15 * shape - 0.18 * edge)


def reason_support(family: Column, text: Column) -> Column:
    t = F.lower(text)
    return cascade(
        "component_attribution_only",
        ((family == "image_evidence_deficit") & (t.contains("low_evidence") | t.contains("blur") | t.contains("visibility")), "human_or_route_supported"),
        ((family == "pair_non_comparability") & (t.contains("non_comparable") | t.contains("partial") | t.contains("occlusion")), "human_or_route_supported"),
        ((family == "descriptor_evidence_conflict") & t.contains("conflict"), "route_supported_feature_conflict"),
        ((family == "domain_source_stress") & t.contains("domain"), "route_supported_domain_stress"),
    )


def policy_scores(descriptor: Column, quality: Column, admissible: Column, review: Column, conflict: Column) -> dict[str, Column]:
    return {
        "descriptor_only": descriptor,
        "quality_only": quality,
        "evidence_admissibility": admissible,
        "evidence_review_router": review,
        "conflict_penalized_descriptor": F.greatest(F.lit(0.0), descriptor - 0.35 * conflict),
    }


def sigmoid(z: Column, clip: float = 35.0) -> Column:
    c = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return 1.0 / (1.0 + F.exp(-c))


def logit(p: Column, eps: float = 1e-12) -> Column:
    c = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.log(c / (1.0 - c))


def platt(p: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) + F.lit(b) * logit(p))


def canonical_measurement(first: Column, second: Column, first_failed: Column, second_failed: Column) -> Column:
    """The smaller of two directions; a failure of either leaves NULL."""
    return F.when(first_failed | second_failed, None).otherwise(F.least(first, second))


def pair_id(a: Column, b: Column, prefix: str = "pair_") -> Column:
    """prefix + sha256 of the JSON array of the ordered ids."""
    x, y = a.cast("string"), b.cast("string")
    return F.concat(F.lit(prefix), F.sha2(F.to_json(F.array(F.least(x, y), F.greatest(x, y))), 256))


def stable_fold(value: Column, folds: int = 5) -> Column:
    return F.conv(F.substring(F.sha1(value), 1, 8), 16, 10).cast("bigint") % folds


def grid_value(v: Column, steps: int = 20) -> Column:
    """Does v lie in 0..1 on a grid of 1 / steps?"""
    return (v >= 0) & (v <= 1) & (F.abs(F.bround(v * steps, 0) - v * steps) < 1e-9)
