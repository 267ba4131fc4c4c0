"""Models (MD), audits (VA), user code (UD), logs (LG), sources (SRC), sinks (SNK) and streams (STR)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keyed_hash as H
from ..operators import audits as A
from ..operators import boosting as G
from ..operators import fits as L
from ..operators import metrics as M
from ..operators import models as D
from ..operators import ranks as R
from ..operators import sets as S
from ..sources import io
from ..sources.shared import shared_folder
from ..streaming import review as V
from . import tables as T
from .q_scalar import scored
from .q_windows import _HS, draw
from .registry import query

c, t = F.col, T.table
FEATURES = ["p", "p2", "n_chars"]


def r6(x):
    return F.round(x, 6)


def n_():
    return F.count(F.lit(1))


@query(
    "MD1_fold_preprocessor",
    """WITH tr AS (SELECT * FROM x WHERE fold <> 0), x AS (SELECT id, fold, lang, CASE WHEN id % 9 = 0 THEN NULL ELSE n_chars END AS v FROM outcomes), m AS (SELECT quantile_cont(v, 0.5) AS med FROM tr), s AS (SELECT avg(coalesce(v, med)) AS mu, stddev_pop(coalesce(v, med)) AS sd FROM tr, m), l AS (SELECT list_sort(list_distinct(list(lang))) AS ls FROM tr)
SELECT id, round((coalesce(v, med) - mu) / sd, 6) AS z, (v IS NULL)::INT AS missing, (NOT list_contains(ls, lang))::INT AS unknown FROM x, m, s, l""".replace("WITH tr AS (SELECT * FROM x WHERE fold <> 0), x AS (SELECT id, fold, lang, CASE WHEN id % 9 = 0 THEN NULL ELSE n_chars END AS v FROM outcomes)", "WITH x AS (SELECT id, fold, lang, CASE WHEN id % 9 = 0 THEN NULL ELSE n_chars END AS v FROM outcomes), tr AS (SELECT * FROM x WHERE fold <> 0)"),
    "outcomes",
)
def md1(spark, sf):
    x = T.outcomes(spark, sf).select("id", "fold", "lang", F.when(c("id") % 9 != 0, c("n_chars")).alias("v"))
    p = D.fit_preprocessor(x.where("fold <> 0"), ["v"], ["lang"])
    return D.apply_preprocessor(x, p, ["id"]).select("id", r6(c("z_v")).alias("z"), c("missing_v").alias("missing"), c("lang___UNKNOWN__").alias("unknown"))


def oof(spark, sf, models):
    return D.cross_validated(T.outcomes(spark, sf), "id", FEATURES, "y", "w", "fold", models)


@query("MD2_weighted_logistic")
def md2(spark, sf):
    return oof(spark, sf, {"l2": ("newton", 0.01)}).select("id", "fold", r6(c("p")).alias("p"))


@query("MD3_descent_logistic")
def md3(spark, sf):
    return oof(spark, sf, {"gd": ("descent", 0.05)}).select("id", r6(c("p")).alias("p"))


@query("MD4_balanced_logistic")
def md4(spark, sf):
    return oof(spark, sf, {"bal": ("balanced", 0.05)}).select("id", r6(c("p")).alias("p"))


@query("MD5_spline_basis")
def md5(spark, sf):
    o = T.outcomes(spark, sf)
    lo, mid, hi = o.agg(F.min("p"), F.percentile("p", F.lit(0.5)), F.max("p")).first()
    return o.select("id", *[r6(b).alias(f"b{i}") for i, b in enumerate(D.spline_basis(c("p"), lo, mid, hi))])


def losses(spark, sf):
    got = oof(spark, sf, {f"l{k}": ("newton", lam) for k, lam in enumerate((0.001, 0.01, 0.1, 1.0))})
    x = got.groupBy("model", "fold").agg((F.sum(c("w") * F.pow(c("p") - c("y"), F.lit(2))) / F.sum("w")).alias("loss"))
    return x.withColumn("lam", F.element_at(F.array(*[F.lit(v) for v in (0.001, 0.01, 0.1, 1.0)]), (F.substring("model", 2, 1).cast("int") + 1)))


@query("MD6_one_se_lambda")
def md6(spark, sf):
    return D.one_se_lambda(losses(spark, sf).withColumn("family", F.lit("l2")), "family", "lam", "fold", "loss")


#: The eight models by their feature blocks: descriptor p, independent quality n_chars, pair evidence p2.
NESTED = {
    "P0": ("linear", []), "P1": ("linear", ["p"]), "P2": ("linear", ["n_chars"]), "P3": ("linear", ["p", "n_chars"]), "P4": ("linear", ["p2"]), "P5": ("linear", ["p", "n_chars", "p2"]),
    "S1": ("splines", ["p", "n_chars"]), "S2": ("splines", ["p", "n_chars", "p2"]),
}
LAMBDAS = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0]


@query("MD7_nested_cv")
def md7(spark, sf):
    got = D.nested_cross_validated(T.outcomes(spark, sf), "id", "y", "w", "comp", NESTED, LAMBDAS, 5, 4)
    return got.groupBy("model", "fold", "lam").agg(n_().alias("n"), r6(F.sum(c("w") * F.pow(c("p") - c("y"), F.lit(2))) / F.sum("w")).alias("brier"))


@query("MD8_tolerance_choice")
def md8(spark, sf):
    x = losses(spark, sf).groupBy("model").agg(F.avg("loss").alias("loss"), (-F.max("lam")).alias("cost")).withColumn("g", F.lit("l2"))
    return D.tolerance_choice(x, "g", "model", "loss", "cost", 0.01).select("g", "model", r6(c("loss")).alias("loss"))


@query("MD9_boosted_ranker")
def md9(spark, sf):
    """Boosted trees without monotone constraints, which Spark's trees don't offer."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    o = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(T.outcomes(spark, sf).withColumn("label", c("y").cast("double")))
    m = GBTClassifier(maxIter=10, maxDepth=3, seed=1).fit(o.where("fold <> 0"))
    return m.transform(o).select("id", r6(vector_to_array("probability")[1]).alias("p"))


def _train(spark, sf):
    return T.outcomes(spark, sf).where("fold <> 0").select("id", *FEATURES, "y", "w")


@query("MD9_monotone_ranker")
def md9_monotone(spark, sf):
    """Boosted trees whose predictions never fall along either score."""
    m = G.monotone_trees(_train(spark, sf), FEATURES, "y", "w", {"p": 1, "p2": 1}, trees=10)
    return m.scored(T.outcomes(spark, sf).select("id", "fold", *FEATURES), "s").select("id", "fold", r6(c("s")).alias("p"))


@query("MD10_shape_functions")
def md10_shapes(spark, sf):
    return G.additive(_train(spark, sf), FEATURES, "y", "w", cycles=10).shapes(spark).select("feature", "bin", "over", r6(c("value")).alias("value"))


@query("MD10_additive_scores")
def md10_scores(spark, sf):
    m = G.additive(_train(spark, sf), FEATURES, "y", "w", cycles=10)
    return m.scored(T.outcomes(spark, sf).select("id", "fold", *FEATURES), "s").select("id", "fold", r6(c("s")).alias("p"))


@query("MD11_firth_logistic")
def md11(spark, sf):
    return oof(spark, sf, {"firth": ("firth", 0.0)}).select("id", r6(c("p")).alias("p"))


@query("MD13_platt_recalibration")
def md13(spark, sf):
    o = T.outcomes(spark, sf)
    a, b = D.calibration_line(o.where("fold <> 0"), "p", "y", "w").first()
    return o.where("fold = 0").select("id", r6(E.platt(c("p"), a, b)).alias("p"))


REPLICATES = 2000
#: The draws of each replicate, then Newton steps of all replicates from 0 in closed form for two coefficients.
_REPLICATES = f"""WITH RECURSIVE o AS (SELECT comp, y, w, ln(q / (1 - q)) AS z FROM (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM outcomes WHERE fold <> 0)),
u AS (SELECT comp, row_number() OVER (ORDER BY comp) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT comp FROM o)),
k AS MATERIALIZED (SELECT r.r AS rep, x.comp, count(*) AS times FROM range({REPLICATES}) r(r), u s JOIN u x ON x.i = (('0x' || substr(sha256('md13|' || r.r::VARCHAR || '|' || s.i::VARCHAR), 1, 8))::BIGINT) % s.n GROUP BY 1, 2),
x AS MATERIALIZED (SELECT rep, z, y, w * times AS w FROM k JOIN o USING (comp)),
f AS MATERIALIZED (SELECT rep, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 1) AS ones FROM x GROUP BY 1),
nt(rep, i, a, b) AS (
  SELECT rep, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM f WHERE zeros > 0 AND ones > 0
  UNION ALL
  SELECT rep, i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT rep, i, a, b, sum(w * (y - q)) AS g0, sum(w * (y - q) * z) AS g1, sum(w * q * (1 - q)) AS h00, sum(w * q * (1 - q) * z) AS h01, sum(w * q * (1 - q) * z * z) AS h11
        FROM (SELECT nt.*, x.z, x.y, x.w, 1 / (1 + exp(-(a + b * z))) AS q FROM nt JOIN x USING (rep) WHERE i < 25) GROUP BY 1, 2, 3, 4))
"""


def replicate_fits(spark, sf):
    """Platt's line of each of REPLICATES draws of components."""
    o = T.outcomes(spark, sf).where("fold <> 0").select("comp", "y", "w", E.logit(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), c("p")))).alias("z"))
    rows = o.join(L.component_draws(o, "comp", REPLICATES, "md13"), "comp").withColumn("draws", F.transform("draws", lambda d: F.struct(d["r"].alias("r"), (d["w"] * c("w")).alias("w"))))
    return L.newton(rows, ["z"], "y", "draws", [0.0] * REPLICATES).summary(spark)


@query("MD13_replicate_fits", _REPLICATES + "SELECT f.rep, zeros, ones, round(a, 6) AS intercept, round(b, 6) AS slope FROM f LEFT JOIN (SELECT * FROM nt WHERE i = 25) n USING (rep)", "outcomes")
def md13_fits(spark, sf):
    ok = c("converged")
    return replicate_fits(spark, sf).where("total > 0").select(c("r").cast("bigint").alias("rep"), "zeros", "ones", F.when(ok, r6(c("intercept"))).alias("intercept"), F.when(ok, r6(c("slopes")[0])).alias("slope"))


@query("MD13_bootstrap_interval", _REPLICATES + f"SELECT {REPLICATES} AS requested, count(*) AS completed, round(quantile_cont(a, 0.025), 6) AS intercept_low, round(quantile_cont(a, 0.975), 6) AS intercept_high, round(quantile_cont(b, 0.025), 6) AS slope_low, round(quantile_cont(b, 0.975), 6) AS slope_high FROM nt WHERE i = 25", "outcomes")
def md13_interval(spark, sf):
    f = replicate_fits(spark, sf).where("converged")
    ends = [r6(F.percentile(x, F.lit(q))).alias(f"{name}_{end}") for name, x in (("intercept", c("intercept")), ("slope", c("slopes")[0])) for end, q in (("low", 0.025), ("high", 0.975))]
    return f.agg(F.lit(REPLICATES).cast("bigint").alias("requested"), n_().alias("completed"), *ends)


@query("MD14_synthetic_probabilities")
def md14(spark, sf):
    x = T.outcomes(spark, sf).select("id", (1.2 * (c("p") - 0.5) + 0.4 * ((c("a") % 5) - 2)).alias("eta"))
    k = D.intercept_for_rate(x, "eta", 0.35)
    return x.select("id", r6(E.sigmoid(c("eta") + k)).alias("p"))


@query("MD15_out_of_fold_scores")
def md15(spark, sf):
    got = oof(spark, sf, {"gd": ("descent", 0.05)})
    return M.auroc(got, "p", "y", ["fold"]).select("fold", r6(c("auroc")).alias("auroc"))


@query("MD17_gauss_hermite", "SELECT id, round((SELECT sum(exp(-u * u / 2) / (1 + exp(-(e + 0.7 * sqrt(2) * u)))) / sum(exp(-u * u / 2)) FROM (SELECT k / 50.0::DOUBLE AS u FROM range(-400, 401) g(k))), 4) AS p FROM (SELECT id, ln(p / (1 - p)) AS e FROM outcomes)", "outcomes")
def md17(spark, sf):
    return T.outcomes(spark, sf).select("id", F.round(D.gauss_hermite(E.logit(c("p")), 0.7), 4).alias("p"))


# ---------------------------------------------------------------- audits


@query(
    "VA1_contract_issues",
    "SELECT code, message, row_id FROM (SELECT a::VARCHAR || '-' || b::VARCHAR AS row_id, unnest([CASE WHEN NOT (best_rank BETWEEN 1 AND 15) THEN 'RANK' END, CASE WHEN NOT coalesce(mega_sim <= 0.9, false) THEN 'SIM' END, CASE WHEN NOT a < b THEN 'ORDER' END]) AS code FROM pairs) JOIN (VALUES ('RANK', 'rank out of range'), ('SIM', 'similarity missing or too large'), ('ORDER', 'endpoints not ordered')) m(code, message) USING (code)",
    "pairs",
)
def va1(spark, sf):
    p = T.pairs(spark, sf)
    rules = {"RANK": (c("best_rank").between(1, 15), "rank out of range"), "SIM": (c("mega_sim") <= 0.9, "similarity missing or too large"), "ORDER": (c("a") < c("b"), "endpoints not ordered")}
    return A.issues(p, F.concat_ws("-", c("a").cast("string"), c("b").cast("string")), rules)


@query("VA2_partition_validator", "WITH r AS (SELECT image_id, CASE WHEN identity % 2 = 0 THEN 'dev' ELSE 'conf' END AS role, identity FROM images) SELECT (SELECT count(*) FROM r) AS images, (SELECT count(*) FROM pairs JOIN r x ON a = x.image_id JOIN r y ON b = y.image_id WHERE x.role <> y.role) AS crossing, (SELECT count(*) FROM (SELECT identity FROM r GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS split_identities", "pairs", "images")
def va2(spark, sf):
    r = T.images(spark, sf).select("image_id", "identity", F.when(c("identity") % 2 == 0, "dev").otherwise("conf").alias("role"))
    p = T.pairs(spark, sf).select("a", "b")
    cross = p.join(r.select(c("image_id").alias("a"), c("role").alias("x")), "a").join(r.select(c("image_id").alias("b"), c("role").alias("y")), "b").where("x <> y").agg(n_().alias("crossing"))
    return r.agg(n_().alias("images")).crossJoin(cross).crossJoin(A.incomplete_shards(r, ["identity"], "role", ["dev", "conf"]).limit(0).agg(n_().alias("_z"))).crossJoin(r.groupBy("identity").agg(F.countDistinct("role").alias("k")).where("k > 1").agg(n_().alias("split_identities"))).drop("_z")


@query("VA3_independent_redraw", f"WITH r AS (SELECT row_number() OVER (PARTITION BY cell ORDER BY {_HS}, id) AS rn FROM frame) SELECT 'same' AS redraw, 0::BIGINT AS only_first, 0::BIGINT AS only_second UNION ALL SELECT 'wider', count(*) FILTER (rn IN (4, 5)), 0 FROM r", "frame")
def va3(spark, sf):
    """Draws by windows, of three and of five a cell, against a draw of three by thresholds of the digest."""
    f = T.frame(spark, sf)
    d = f.select("id", "cell", H.seeded_digest("00" * 32, "contract", "development", "draw", c("cell"), c("id")).alias("d"))
    cut = d.groupBy("cell").agg(F.min("d").alias("cut"))
    for _ in range(2):  # the next smallest digest, where a cell has one
        more = d.join(cut, "cell").where("d > cut").groupBy("cell").agg(F.min("d").alias("more"))
        cut = cut.join(more, "cell", "left").select("cell", F.coalesce("more", "cut").alias("cut"))
    again = d.join(cut, "cell").where("d <= cut").select("id")
    found = [A.same_rows(draw(f, n).select("id"), again).select(F.lit(name).alias("redraw"), "*") for name, n in (("same", 3), ("wider", 5))]
    return A.union_all(found)


@query("VA4_feature_audit", "SELECT 'sharp' AS feature, count(*) FILTER (sharp IS NULL) AS missing, count(*) FILTER (sharp < 0.1) AS below, count(*) FILTER (sharp > 0.9) AS above, count(*) AS n FROM images UNION ALL SELECT 'clip', count(*) FILTER (clip IS NULL), count(*) FILTER (clip < 0), count(*) FILTER (clip > 0.2), count(*) FROM images", "images")
def va4(spark, sf):
    return A.feature_audit(T.images(spark, sf), {"sharp": (0.1, 0.9), "clip": (0.0, 0.2)})


@query("VA5_pair_audit", "SELECT CASE WHEN dup = 0 AND self_ = 0 THEN 'PASS' ELSE 'FAIL' END AS status, '' AS failures, n, dup, self_ FROM (SELECT count(*) AS n, count(*) - count(DISTINCT (a, b)) AS dup, count(*) FILTER (a = b) AS self_ FROM pairs)", "pairs")
def va5(spark, sf):
    k = T.pairs(spark, sf).agg(n_().alias("n"), (n_() - F.countDistinct("a", "b")).alias("dup"), F.count(F.when(c("a") == c("b"), 1)).alias("self_"))
    return A.verdict(k, {"dup": ("==", 0), "self_": ("==", 0)})


@query("VA6_shard_completeness", "SELECT a, b, count(*) AS n FROM (SELECT least(query, candidate) AS a, greatest(query, candidate) AS b, CASE WHEN query < candidate THEN 'A_to_B' ELSE 'B_to_A' END AS d FROM memberships WHERE descriptor = 'mega') GROUP BY 1, 2 HAVING count(DISTINCT d) <> 2 OR count(*) <> 2", "memberships")
def va6(spark, sf):
    m = T.memberships(spark, sf).where("descriptor = 'mega'")
    d = m.select(F.least("query", "candidate").alias("a"), F.greatest("query", "candidate").alias("b"), F.when(c("query") < c("candidate"), "A_to_B").otherwise("B_to_A").alias("d"))
    return A.incomplete_shards(d, ["a", "b"], "d", ["A_to_B", "B_to_A"])


@query("VA7_declared_order_merge", "SELECT descriptor, query, candidate, row_number() OVER (ORDER BY descriptor, query, candidate) AS place FROM memberships", "memberships")
def va7(spark, sf):
    m = T.memberships(spark, sf).select("descriptor", "query", "candidate")
    return R.position(A.union_all([m.where(c("query") % 3 == k) for k in range(3)]), "place", [c("descriptor"), c("query"), c("candidate")])


@query("VA8_stage_isolation", "WITH k AS (SELECT fold, sha256(string_agg(id::VARCHAR || '|' || y::VARCHAR, chr(10) ORDER BY id::VARCHAR || '|' || y::VARCHAR)) AS digest FROM outcomes GROUP BY 1) SELECT id, o.fold, CASE WHEN o.fold IN (0, 1) THEN y END AS y, CASE WHEN o.fold NOT IN (0, 1) THEN digest END AS commitment FROM outcomes o JOIN k ON o.fold = k.fold", "outcomes")
def va8(spark, sf):
    o = T.outcomes(spark, sf)
    line = F.concat_ws("|", c("id").cast("string"), c("y").cast("string"))
    k = o.groupBy("fold").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
    return A.stage_views(o.select("id", "fold"), o.select("id", "y"), "id", "fold", [0, 1], k)


@query("VA9_claim_gate", "SELECT CASE WHEN brier <= 0.3 AND n >= 100 THEN 'PASS' ELSE 'FAIL' END AS status, concat_ws(';', CASE WHEN brier > 0.3 THEN 'brier <= 0.3' END, CASE WHEN n < 100 THEN 'n >= 100' END) AS failures, brier, n FROM (SELECT round(avg(pow(p - y, 2)), 6) AS brier, count(*) AS n FROM outcomes)", "outcomes")
def va9(spark, sf):
    k = T.outcomes(spark, sf).agg(r6(F.avg(F.pow(c("p") - c("y"), F.lit(2)))).alias("brier"), n_().alias("n"))
    return A.verdict(k, {"brier": ("<=", 0.3), "n": (">=", 100)})


@query("VA10_leakage_pressure", "WITH q AS (SELECT q_domain, quantile_cont(similarity, 0.9) AS q90 FROM evidence GROUP BY 1) SELECT e.q_domain AS dataset, count(*) AS n, count(*) FILTER (q_site = c_site AND similarity >= q90) AS pressure FROM evidence e JOIN q ON e.q_domain = q.q_domain GROUP BY 1", "evidence")
def va10(spark, sf):
    e = T.evidence(spark, sf)
    q = e.groupBy("q_domain").agg(F.percentile("similarity", F.lit(0.9)).alias("q90"))
    return e.join(F.broadcast(q), "q_domain").groupBy(c("q_domain").alias("dataset")).agg(n_().alias("n"), F.count(F.when(E.known_equal(c("q_site"), c("c_site")) & (c("similarity") >= c("q90")), 1)).alias("pressure"))


@query("VA12_component_leakage", "SELECT scheme, comp, count(DISTINCT fold) AS folds FROM (SELECT 'by_component' AS scheme, comp, fold FROM outcomes UNION ALL SELECT 'by_row', comp, id % 3 FROM outcomes) GROUP BY 1, 2 HAVING count(DISTINCT fold) > 1", "outcomes")
def va12(spark, sf):
    """Folds by component leak nothing; folds by row do."""
    folds = F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), v.alias("fold")) for k, v in (("by_component", c("fold")), ("by_row", c("id") % 3))])).alias("x")
    return T.outcomes(spark, sf).select("comp", folds).groupBy("x.scheme", "comp").agg(F.countDistinct("x.fold").alias("folds")).where("folds > 1")


# ---------------------------------------------------------------- user code, logs


@query("UD1_row_function", "SELECT image_id, 'img' || (width * height)::VARCHAR AS v FROM images", "images")
def ud1(spark, sf):
    return T.images(spark, sf).select("image_id", F.concat(F.lit("img"), (c("width") * c("height")).cast("string")).alias("v"))


@query("UD2_lambda_aggregate", "SELECT lang, round(max(p) - min(p), 6) AS spread, count(*) FILTER (p > 0.5) AS high FROM outcomes GROUP BY 1", "outcomes")
def ud2(spark, sf):
    return T.outcomes(spark, sf).groupBy("lang").agg(r6(F.max("p") - F.min("p")).alias("spread"), F.count(F.when(c("p") > 0.5, 1)).alias("high"))


@query("UD3_group_map", "SELECT comp, round(sum(w * p) / sum(w), 6) AS m FROM outcomes GROUP BY 1", "outcomes")
def ud3(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "m": [round((pdf["w"] * pdf["p"]).sum() / pdf["w"].sum(), 6)]})

    return T.outcomes(spark, sf).select("comp", "w", "p").groupBy("comp").applyInPandas(run, "comp bigint, m double")


@query("UD4_row_generator", "SELECT image_id, k.k AS slot, (image_id * 31 + k.k) % 97 AS v FROM images, range(1, 4) k(k)", "images")
def ud4(spark, sf):
    return T.images(spark, sf).select("image_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("slot")).withColumn("v", (c("image_id") * 31 + c("slot")) % 97)


@query("LG1_latest_and_pending", "WITH l AS (SELECT packet, reviewer, arg_max(decision, (ts, event_id)) AS decision FROM reviews GROUP BY 1, 2) SELECT packet, count(*) AS answered, count(*) FILTER (decision = 'uncertain') AS pending FROM l GROUP BY 1", "reviews")
def lg1(spark, sf):
    last = S.keep_last(T.reviews(spark, sf), ["packet", "reviewer"], ["ts", "event_id"])
    return last.groupBy("packet").agg(n_().alias("answered"), F.count(F.when(c("decision") == "uncertain", 1)).alias("pending"))


@query("LG2_decision_update", "WITH l AS (SELECT packet, arg_max(decision, (ts, event_id)) AS decision, max(ts) AS ts FROM reviews GROUP BY 1) SELECT n_nationkey::BIGINT AS packet, coalesce(decision, 'open') AS decision, epoch_us(ts) AS updated FROM nation LEFT JOIN l ON packet = n_nationkey", "reviews")
def lg2(spark, sf):
    last = S.keep_last(T.reviews(spark, sf).select("packet", "ts", "event_id", "decision"), ["packet"], ["ts", "event_id"])
    base = t(spark, sf, "nation").select(c("n_nationkey").cast("bigint").alias("packet"))
    return base.join(last, "packet", "left").select("packet", F.coalesce("decision", F.lit("open")).alias("decision"), F.unix_micros("ts").alias("updated"))


@query("LG3_resumable_run", "SELECT packet % 8 AS shard, count(*) AS n FROM reviews GROUP BY 1", "reviews")
def lg3(spark, sf):
    """Shards that are there already are skipped: the second pass writes only what the first left out."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    r = T.reviews(spark, sf).withColumn("shard", c("packet") % 8)
    r.where("shard < 3").write.partitionBy("shard").parquet(path)
    done = spark.read.parquet(path).select(c("shard").cast("bigint").alias("shard")).distinct()
    r.join(done, "shard", "left_anti").write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.parquet(path).groupBy(c("shard").cast("bigint").alias("shard")).agg(n_().alias("n"))


@query("LG4_run_plan", "SELECT count(*) AS declared, count(*) FILTER (packet % 3 = 0) AS completed, count(*) FILTER (packet % 3 <> 0) AS pending, count(*) FILTER (packet % 3 = 1) AS scheduled FROM (SELECT DISTINCT packet FROM reviews)", "reviews")
def lg4(spark, sf):
    d = T.reviews(spark, sf).select("packet").distinct()
    done, booked = d.where("packet % 3 = 0"), d.where("packet % 3 = 1")
    pending = d.join(done, "packet", "left_anti")
    return d.agg(n_().alias("declared")).crossJoin(done.agg(n_().alias("completed"))).crossJoin(pending.agg(n_().alias("pending"))).crossJoin(pending.join(booked, "packet", "left_semi").agg(n_().alias("scheduled")))


# ---------------------------------------------------------------- sources and sinks


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SRC1_csv_text", "SELECT n_nationkey::VARCHAR AS k, n_name AS v FROM nation")
def src1(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(t(spark, sf, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("v")), p, ["k", "v"])
    return io.read_csv(spark, p, required=["k"])


@query("SRC2_csv_typed", "SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier")
def src2(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(t(spark, sf, "supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("bal")), p, ["k", "bal"])
    return io.typed(io.read_csv(spark, p), {"k": "bigint", "bal": "double"})


@query("SRC4_csv_pruned", "SELECT r_name FROM region")
def src4(spark, sf):
    p = _path(spark, "csv")
    io.write_csv(t(spark, sf, "region"), p, ["r_name", "r_regionkey"], strict=False)
    return io.read_csv(spark, p, columns=["r_name"])


@query("SRC9_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src9(spark, sf):
    p = _path(spark, "json")
    t(spark, sf, "events").select("event_id", "props").write.json(p)
    j = io.read_json(spark, p, "event_id bigint, props string")
    return j.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SRC13_embedding_literal", "SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 4) AS first FROM embeddings")
def src13(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", F.to_json("embedding").alias("s"))
    v = io.embedding_literal(c("s"))
    return e.select("vec_id", F.size(v).cast("bigint").alias("n"), F.round(v[0].cast("double"), 4).alias("first"))


@query("SRC14_file_listing", "SELECT r_regionkey::VARCHAR AS folder, 1::BIGINT AS files FROM region")
def src14(spark, sf):
    """Nested folders; files of another suffix stay out."""
    p = _path(spark, "files")
    r = t(spark, sf, "region").coalesce(1)
    r.write.partitionBy("r_regionkey").parquet(f"{p}/tables")
    r.write.partitionBy("r_regionkey").json(f"{p}/notes")
    return io.list_files(spark, p, "*.parquet").groupBy(F.regexp_extract("path", r"r_regionkey=([^/]+)/", 1).alias("folder")).agg(n_().alias("files"))


@query("SRC15_reviewer_files", "SELECT 'r' || (n_nationkey % 3)::VARCHAR AS reviewer, count(*) AS n FROM nation GROUP BY 1")
def src15(spark, sf):
    p = _path(spark, "reviewers")
    n = t(spark, sf, "nation").select(c("n_nationkey").cast("string").alias("k"), F.concat(F.lit("r"), (c("n_nationkey") % 3).cast("string")).alias("who"))
    n.write.partitionBy("who").option("header", True).csv(p)
    d = spark.read.schema(io.text_schema(["k"])).option("header", True).option("recursiveFileLookup", True).csv(p)
    return d.select(F.regexp_extract(c("_metadata.file_path"), r"who=([^/]+)/", 1).alias("reviewer")).groupBy("reviewer").agg(n_().alias("n"))


@query("SNK6_validated_publish", "SELECT r_regionkey, r_name FROM region")
def snk6(spark, sf):
    p = _path(spark, "published")

    def check(df):
        if df.count() == 0:
            raise ValueError("nothing to publish")

    io.publish(t(spark, sf, "region").select("r_regionkey", "r_name"), p, check)
    return spark.read.parquet(p)


@query("SNK7_checksums", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS sha256 FROM region")
def snk7(spark, sf):
    p = _path(spark, "sums")
    t(spark, sf, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(p)
    return io.checksums(spark, p).select("sha256")


# ---------------------------------------------------------------- streams


def _log(spark, sf, parts=3):
    p = _path(spark, "log")
    T.reviews(spark, sf).repartition(parts, "event_id").write.parquet(p)
    return V.log_stream(spark, p)


@query("STR1_latest_by_key", "SELECT packet, reviewer, arg_max(decision, (ts, event_id)) AS decision FROM reviews GROUP BY 1, 2", "reviews")
def str1(spark, sf):
    return V.latest_by_key(_log(spark, sf), ["packet", "reviewer"], ["ts", "event_id"], "decision")


@query("STR2_without_repeats", "SELECT event_id, packet FROM reviews", "reviews")
def str2(spark, sf):
    p = _path(spark, "twice")
    r = T.reviews(spark, sf).select("event_id", "packet", "ts")
    r.unionByName(r).repartition(2).write.parquet(p)
    return V.without_repeats(V.log_stream(spark, p), "event_id", "ts").select("event_id", "packet")


@query("STR3_double_review_completeness", "SELECT packet, count(DISTINCT reviewer) AS n, count(DISTINCT reviewer) >= 2 AS complete FROM reviews GROUP BY 1", "reviews")
def str3(spark, sf):
    return V.completeness(_log(spark, sf), "packet", "reviewer", 2)


#: Rounds one after another; those whose time isn't over two hours before the last response are given only if complete.
_ROUNDS = """WITH RECURSIVE r AS MATERIALIZED (SELECT packet, reviewer, epoch_us(ts) AS moment FROM reviews WHERE packet IS NOT NULL AND reviewer IS NOT NULL AND ts IS NOT NULL),
rounds(packet, opened) AS (
  SELECT packet, min(moment) FROM r GROUP BY 1
  UNION ALL
  SELECT o.packet, min(r.moment) FROM rounds o JOIN r ON r.packet = o.packet AND r.moment > o.opened + 432000000000 GROUP BY o.packet),
f AS (SELECT packet, opened, reviewer, min(moment) AS moment FROM rounds JOIN r USING (packet) WHERE moment BETWEEN opened AND opened + 432000000000 GROUP BY 1, 2, 3),
k AS (SELECT packet, opened, count(*) AS n, (list_sort(list(moment)))[2] AS second FROM f GROUP BY 1, 2)
SELECT packet, make_timestamp(opened) AS opened, least(n, 2) AS n, CASE WHEN n >= 2 THEN 'complete' ELSE 'timed_out' END AS status, make_timestamp(CASE WHEN n >= 2 THEN second ELSE opened + 432000000000 END) AS closed
FROM k WHERE n >= 2 OR opened + 432000000000 < (SELECT max(moment) FROM r) - 7200000000"""


@query("STR3_double_review_rounds", _ROUNDS, "reviews")
def str3_rounds(spark, sf):
    p = _path(spark, "rounds")
    T.reviews(spark, sf).select("packet", "reviewer", "ts").repartitionByRange(4, "ts").write.parquet(p)
    return V.double_reviews(V.log_stream(spark, p, 100), "packet", "reviewer", "ts", 2, 5 * 86400, "2 hours")


@query("STR4_reviewer_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY reviewer ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM reviews WHERE ts IS NOT NULL), s AS (SELECT *, sum(opens) OVER (PARTITION BY reviewer ORDER BY ts, event_id) AS k FROM g)
SELECT reviewer, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS responses FROM s GROUP BY reviewer, k""", "reviews")
def str4(spark, sf):
    return V.sessions(_log(spark, sf), "reviewer", "ts", "30 minutes")


@query("STR4b_pacing", "SELECT reviewer, count(*) AS n, count(DISTINCT gap) AS distinct_gaps FROM (SELECT reviewer, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY reviewer ORDER BY ts, event_id) AS gap FROM reviews) GROUP BY 1", "reviews")
def str4b(spark, sf):
    w = Window.partitionBy("reviewer").orderBy("ts", "event_id")
    g = T.reviews(spark, sf).withColumn("gap", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w))
    return g.groupBy("reviewer").agg(n_().alias("n"), F.countDistinct("gap").alias("distinct_gaps"))


# ---------------------------------------------------------------- whole pipelines


@query("E3_smallest_pipeline", "SELECT descriptor, route, count(*) AS n, round(avg(same::INT), 6) AS ready_rate FROM scored GROUP BY 1, 2", "scored")
def e3(spark, sf):
    return scored(spark, sf).groupBy("descriptor", "route").agg(n_().alias("n"), r6(F.avg(c("same").cast("int"))).alias("ready_rate"))
