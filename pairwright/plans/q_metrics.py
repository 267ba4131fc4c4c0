"""Metrics (MT) and resampling (BS)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import keyed_hash as H
from ..operators import metrics as M
from ..operators import ranks as R
from . import tables as T
from .q_scalar import policies, scored
from .registry import cte, query

c = F.col


def r6(x):
    return F.round(x, 6)


def n_():
    return F.count(F.lit(1))


def grid(spark, n, d=20.0, name="tau"):
    return spark.range(n).select((c("id") / d).alias(name))


@query("MT1_average_precision", "SELECT fold, round(sum(y * hits / rn::DOUBLE) / sum(y), 6) AS ap FROM (SELECT fold, y, sum(y) OVER w AS hits, row_number() OVER w AS rn FROM outcomes WINDOW w AS (PARTITION BY fold ORDER BY p DESC, y DESC, id ROWS UNBOUNDED PRECEDING)) GROUP BY 1", "outcomes")
def mt1(spark, sf):
    return M.average_precision(T.outcomes(spark, sf), [F.desc("p"), F.desc("y"), c("id")], "y", ["fold"]).select("fold", r6(c("ap")).alias("ap"))


_RETRIEVAL = """
WITH t AS (SELECT {g} AS g, query, same, {rank} AS rk, {ready} AS ready, sum(same::INT) OVER (PARTITION BY {g}, query ORDER BY {rank} ROWS UNBOUNDED PRECEDING) AS hits FROM {src} WHERE {rank} <= 5),
q AS (SELECT g, query, coalesce(avg(hits / rk::DOUBLE) FILTER (same), 0) AS ap, coalesce(1.0::DOUBLE / min(rk) FILTER (same), 0) AS rr, max(CASE WHEN rk = 1 THEN same::INT ELSE 0 END) AS top1, max(same::INT) AS a, sum(1 - same::INT) AS f, sum(ready::INT) AS rd FROM t GROUP BY 1, 2)
SELECT g AS {name}, count(*) AS queries, round(avg(ap), 6) AS map_at_k, round(avg(rr), 6) AS mrr_at_k, round(avg(top1), 6) AS top1, round(avg(a), 6) AS positive_at_k, round(avg(f), 6) AS false_at_k, round(avg(rd), 6) AS ready_at_k FROM q GROUP BY 1"""


@query("MT2_retrieval_metrics", _RETRIEVAL.format(g="descriptor", rank="rank", ready="false", src="evidence", name="descriptor"), "evidence")
def mt2(spark, sf):
    m, im = T.memberships(spark, sf), T.images(spark, sf).select("image_id", "identity")
    j = m.join(im.withColumnsRenamed({"image_id": "query", "identity": "x"}), "query").join(im.withColumnsRenamed({"image_id": "candidate", "identity": "y"}), "candidate")
    return M.retrieval(j.withColumn("same", c("x") == c("y")), ["descriptor"], "query", "rank", "same", 5)


cte("reranked", "SELECT *, row_number() OVER (PARTITION BY policy, query ORDER BY score DESC, candidate) AS rk FROM policies WHERE descriptor = 'mega'", "policies")


def reranked(spark, sf):
    x = policies(scored(spark, sf).where("descriptor = 'mega'"))
    return R.position(x, "rk", [F.desc("score"), c("candidate")], ["policy", "query"])


@query("MT3_retrieval_bundle", _RETRIEVAL.format(g="policy", rank="rk", ready="route IN ('accept_review_ready', 'review')", src="reranked", name="policy"), "reranked")
def mt3(spark, sf):
    return M.retrieval(reranked(spark, sf), ["policy"], "query", "rk", "same", 5, c("route").isin("accept_review_ready", "review"))


_AUC = "SELECT {g} round(sum(CASE WHEN x.p > z.p THEN {w} WHEN x.p = z.p THEN 0.5 * {w} ELSE 0 END)::DOUBLE / sum({w})::DOUBLE, 6) AS auroc FROM outcomes x JOIN outcomes z ON x.y = 1 AND z.y = 0 {on} {by}"


@query("MT4_auroc_pairwise", _AUC.format(g="", w="1", on="", by=""), "outcomes")
def mt4(spark, sf):
    return M.auroc(T.outcomes(spark, sf), "p", "y").select(r6(c("auroc")).alias("auroc"))


@query("MT5_auroc_rank_sum", _AUC.format(g="x.lang,", w="1", on="AND x.lang = z.lang", by="GROUP BY 1"), "outcomes")
def mt5(spark, sf):
    x = R.average_rank(T.outcomes(spark, sf), "p", "r", ["lang"])
    pos, neg = F.sum("y"), F.sum(1 - c("y"))
    return x.groupBy("lang").agg(r6(F.try_divide(F.sum(F.when(c("y") == 1, c("r"))) - pos * (pos + 1) / 2, pos * neg)).alias("auroc")).where("auroc is not null")


@query("MT6_weighted_auroc", _AUC.format(g="x.fold,", w="x.w * z.w", on="AND x.fold = z.fold", by="GROUP BY 1"), "outcomes")
def mt6(spark, sf):
    return M.auroc(T.outcomes(spark, sf), "p", "y", ["fold"], "w").select("fold", r6(c("auroc")).alias("auroc"))


@query("MT7_weighted_auprc", "SELECT round(sum(y * w * ch / cw::DOUBLE) / sum(y * w), 6) AS ap FROM (SELECT y, w, sum(y * w) OVER o AS ch, sum(w) OVER o AS cw FROM outcomes WINDOW o AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING))", "outcomes")
def mt7(spark, sf):
    return M.average_precision(T.outcomes(spark, sf), [F.desc("p"), c("id")], "y", weight="w").select(r6(c("ap")).alias("ap"))


@query("MT8_brier_logloss", "SELECT fold, round(sum(w * pow(p - y, 2)) / sum(w), 6) AS brier, round(-sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 6) AS logloss FROM outcomes GROUP BY 1", "outcomes")
def mt8(spark, sf):
    return T.outcomes(spark, sf).groupBy("fold").agg(r6(F.sum(c("w") * F.pow(c("p") - c("y"), F.lit(2))) / F.sum("w")).alias("brier"), r6(-F.sum(c("w") * (c("y") * F.log("p") + (1 - c("y")) * F.log(1 - c("p")))) / F.sum("w")).alias("logloss"))


@query("MT9_ece", "SELECT fold, round(sum(n * abs(mp - r)) / sum(n), 6) AS ece FROM (SELECT fold, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM outcomes GROUP BY fold, least(floor(p * 5), 4)) GROUP BY 1", "outcomes")
def mt9(spark, sf):
    return M.ece(T.outcomes(spark, sf), "p", "y", 5, ["fold"]).select("fold", r6(c("ece")).alias("ece"))


@query("MT10_reliability_bins", "SELECT g.b AS bin, count(id) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM range(20) g(b) LEFT JOIN outcomes ON least(floor(p * 20), 19) = g.b GROUP BY 1", "outcomes")
def mt10(spark, sf):
    return M.reliability_bins(T.outcomes(spark, sf), "p", "y", 20).select("bin", "n", r6(c("mean_p")).alias("mean_p"), r6(c("rate")).alias("rate"))


#: Newton steps in closed form from intercept 0 and slope 1.
_LINE = """WITH RECURSIVE o AS (SELECT y, w, ln(q / (1 - q)) AS z FROM (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS q FROM outcomes)),
nt(i, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT i, a, b, sum(w * (y - q)) AS g0, sum(w * (y - q) * z) AS g1, sum(w * q * (1 - q)) AS h00, sum(w * q * (1 - q) * z) AS h01, sum(w * q * (1 - q) * z * z) AS h11
        FROM (SELECT nt.*, o.*, 1 / (1 + exp(-(a + b * z))) AS q FROM nt, o WHERE i < 12) GROUP BY 1, 2, 3))
SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM nt WHERE i = 12"""


@query("MT11_calibration_line", _LINE, "outcomes")
def mt11(spark, sf):
    from ..operators import models as D

    return D.calibration_line(T.outcomes(spark, sf), "p", "y", "w")


@query("MT12_selective_metrics", "SELECT count(*) FILTER (1 - p <= 0.5) AS n, round(count(*) FILTER (1 - p <= 0.5) / count(*)::DOUBLE, 6) AS coverage, round(avg(1 - y) FILTER (1 - p <= 0.5), 6) AS risk, round(least(1, avg(1 - y) FILTER (1 - p <= 0.5) + sqrt(ln(1 / 0.05) / (2 * count(*) FILTER (1 - p <= 0.5)))), 6) AS upper_ FROM outcomes", "outcomes")
def mt12(spark, sf):
    ok = 1 - c("p") <= 0.5
    n, risk = F.count(F.when(ok, 1)), F.avg(F.when(ok, 1 - c("y")))
    return T.outcomes(spark, sf).agg(n.alias("n"), r6(n / n_()).alias("coverage"), r6(risk).alias("risk"), r6(M.hoeffding_upper(risk, n, 0.05)).alias("upper_"))


_CURVE = "curve AS (SELECT fold, tau, n, n / tot::DOUBLE AS coverage, s / n::DOUBLE AS risk FROM (SELECT fold, 1 - p AS tau, sum(k) OVER o AS n, sum(l) OVER o AS s, sum(k) OVER (PARTITION BY fold) AS tot FROM (SELECT fold, p, count(*) AS k, sum(1 - y) AS l FROM outcomes GROUP BY 1, 2) WINDOW o AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)))"


def curve(spark, sf):
    o = T.outcomes(spark, sf).withColumn("risk", 1 - c("p")).withColumn("loss", 1 - c("y"))
    return M.risk_coverage(o, "risk", "loss", ["fold"])


@query("MT13_risk_coverage_curve", f"WITH {_CURVE} SELECT fold, round(tau, 6) AS tau, n::BIGINT AS n, round(coverage, 6) AS coverage, round(risk, 6) AS selective_risk FROM curve", "outcomes")
def mt13(spark, sf):
    return curve(spark, sf).select("fold", r6(c("tau")).alias("tau"), "n", r6(c("coverage")).alias("coverage"), r6(c("selective_risk")).alias("selective_risk"))


_CHOOSE = "SELECT f.fold, a.alpha, round(coalesce(max(tau) FILTER (risk <= alpha), {s}), 6) AS tau, coalesce(max(n) FILTER (risk <= alpha), 0)::BIGINT AS n, CASE WHEN count(*) FILTER (risk <= alpha) = 0 THEN 'no_admission' ELSE 'admitted' END AS status FROM (SELECT DISTINCT fold FROM outcomes) f, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2)) a(alpha), curve WHERE curve.fold = f.fold GROUP BY 1, 2"


@query("MT14_threshold_choice", f"WITH {_CURVE} " + _CHOOSE.format(s="-1.0::DOUBLE"), "outcomes")
def mt14(spark, sf):
    return M.choose_threshold(curve(spark, sf), [0.0, 0.05, 0.1, 0.2], ["fold"]).select("fold", "alpha", r6(c("tau")).alias("tau"), "n", "status")


@query("MT15_admission_threshold", "WITH g AS (SELECT p AS t, (SELECT count(*) FROM outcomes o WHERE o.p >= x.p) AS n, (SELECT avg(1 - y) FROM outcomes o WHERE o.p >= x.p) AS risk FROM (SELECT DISTINCT p FROM outcomes) x) SELECT a.alpha, round(coalesce(min(t) FILTER (risk <= alpha), 1.01), 6)::DOUBLE AS threshold, coalesce(max(n) FILTER (risk <= alpha), 0) AS n FROM g, (VALUES (0.0::DOUBLE), (0.1), (0.2)) a(alpha) GROUP BY 1", "outcomes")
def mt15(spark, sf):
    o = T.outcomes(spark, sf).withColumn("risk", -c("p")).withColumn("loss", 1 - c("y"))
    x = M.choose_threshold(M.risk_coverage(o, "risk", "loss"), [0.0, 0.1, 0.2], sentinel=-1.01)
    return x.select("alpha", r6(-c("tau")).alias("threshold"), "n")


@query("MT16_retention_curve", "SELECT k / 10.0::DOUBLE AS tau, count(*) FILTER (admissible >= k / 10.0) AS kept, round(count(*) FILTER (same AND admissible >= k / 10.0) / nullif(count(*) FILTER (same), 0)::DOUBLE, 6) AS positive_retention FROM scored, range(11) g(k) WHERE descriptor = 'mega' GROUP BY 1", "scored")
def mt16(spark, sf):
    ok = c("admissible") >= c("tau")
    return scored(spark, sf).where("descriptor = 'mega'").crossJoin(F.broadcast(grid(spark, 11, 10.0))).groupBy("tau").agg(F.count(F.when(ok, 1)).alias("kept"), r6(F.try_divide(F.count(F.when(c("same") & ok, 1)), F.count(F.when(c("same"), 1)))).alias("positive_retention"))


@query("MT17_fixed_budget", "SELECT policy, b.k AS budget, count(*) AS reviewed, count(*) FILTER (same) AS found, round(avg(same::INT), 6) AS yield FROM reranked, (VALUES (1), (3), (10)) b(k) WHERE rk <= b.k GROUP BY 1, 2", "reranked")
def mt17(spark, sf):
    b = spark.createDataFrame([(1,), (3,), (10,)], "budget int")
    return reranked(spark, sf).crossJoin(F.broadcast(b)).where("rk <= budget").groupBy("policy", "budget").agg(n_().alias("reviewed"), F.count(F.when(c("same"), 1)).alias("found"), r6(F.avg(c("same").cast("int"))).alias("yield"))


@query("MT18_abstention", "SELECT k / 10.0::DOUBLE AS coverage, count(*) FILTER (rn <= ceil(n * k / 10.0::DOUBLE)) AS retained, count(*) FILTER (rn > ceil(n * k / 10.0::DOUBLE)) AS deferred, round(avg(y) FILTER (rn <= ceil(n * k / 10.0::DOUBLE)), 6) AS retained_rate, round(avg(y) FILTER (rn > ceil(n * k / 10.0::DOUBLE)), 6) AS deferred_rate FROM (SELECT y, row_number() OVER (ORDER BY p2 DESC, id) AS rn, count(*) OVER () AS n FROM outcomes), range(2, 10) g(k) GROUP BY 1", "outcomes")
def mt18(spark, sf):
    x = R.position(T.outcomes(spark, sf), "rn", [F.desc("p2"), c("id")], total="n").select("y", "rn", "n")
    g = spark.range(2, 10).select((c("id") / 10.0).alias("coverage"), "id")
    ok = c("rn") <= F.ceil(c("n") * c("id") / 10.0)
    return x.crossJoin(F.broadcast(g)).groupBy("coverage").agg(F.count(F.when(ok, 1)).alias("retained"), F.count(F.when(~ok, 1)).alias("deferred"), r6(F.avg(F.when(ok, c("y")))).alias("retained_rate"), r6(F.avg(F.when(~ok, c("y")))).alias("deferred_rate"))


_C19 = "c19 AS (SELECT k / 20.0::DOUBLE AS tau, count(*) FILTER (p >= k / 20.0) / count(*)::DOUBLE AS coverage, avg(1 - y) FILTER (p >= k / 20.0) AS risk FROM outcomes, range(21) g(k) GROUP BY 1)"


@query("MT19_confidence_summary", f"WITH {_C19} SELECT round(min(risk) FILTER (coverage >= 0.8), 6) AS best_risk, round(max(coverage) FILTER (risk <= 0.2), 6) AS best_coverage FROM c19", "outcomes")
def mt19(spark, sf):
    ok = c("p") >= c("tau")
    g = T.outcomes(spark, sf).crossJoin(F.broadcast(grid(spark, 21))).groupBy("tau").agg((F.count(F.when(ok, 1)) / n_()).alias("coverage"), F.avg(F.when(ok, 1 - c("y"))).alias("risk"))
    return g.agg(r6(F.min(F.when(c("coverage") >= 0.8, c("risk")))).alias("best_risk"), r6(F.max(F.when(c("risk") <= 0.2, c("coverage")))).alias("best_coverage"))


@query("MT20_wilson", "SELECT lang, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM (SELECT lang, sum(y)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z FROM outcomes GROUP BY 1)", "outcomes")
def mt20(spark, sf):
    w = M.wilson(F.sum("y").cast("double"), n_().cast("double"))
    return T.outcomes(spark, sf).groupBy("lang").agg(w.alias("w")).select("lang", r6(c("w.low")).alias("low"), r6(c("w.high")).alias("high"))


_TWO = "two AS (SELECT x.packet, x.reviewer AS ra, y.reviewer AS rb, x.decision AS a, y.decision AS b FROM (SELECT packet, reviewer, arg_max(decision, (ts, event_id)) AS decision FROM reviews GROUP BY 1, 2) x JOIN (SELECT packet, reviewer, arg_max(decision, (ts, event_id)) AS decision FROM reviews GROUP BY 1, 2) y ON x.packet = y.packet AND x.reviewer < y.reviewer)"
_KAPPA = "SELECT {g} n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT {g} count(*) AS n, avg((a = b)::INT) AS po, any_value(pe) AS pe FROM two JOIN (SELECT {g} sum(ca * cb) / pow(sum(DISTINCT tot), 2) AS pe FROM (SELECT {t} l.k, (SELECT count(*) FROM two WHERE a = l.k {f}) AS ca, (SELECT count(*) FROM two WHERE b = l.k {f}) AS cb, (SELECT count(*) FROM two WHERE true {f}) AS tot FROM (SELECT DISTINCT decision AS k FROM reviews) l {x}) {by}) e {on} {by})"


def two(spark, sf):
    from ..operators import sets as S

    last = S.keep_last(T.reviews(spark, sf), ["packet", "reviewer"], ["ts", "event_id"])
    a = last.select("packet", c("reviewer").alias("ra"), c("decision").alias("a"))
    return a.join(last.select("packet", c("reviewer").alias("rb"), c("decision").alias("b")), "packet").where("ra < rb")


@query("MT21_cohen_kappa", f"WITH {_TWO}, ma AS (SELECT a AS k, count(*) AS n FROM two GROUP BY 1), mb AS (SELECT b AS k, count(*) AS n FROM two GROUP BY 1), e AS (SELECT sum(ma.n * mb.n)::DOUBLE AS e FROM ma JOIN mb USING (k)), o AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM two) SELECT n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM o, e", "reviews")
def mt21(spark, sf):
    return M.kappa(two(spark, sf), "a", "b").select("n", r6(c("agreement")).alias("agreement"), r6(c("kappa")).alias("kappa"))


@query("MT22_agreement_matrix", f"WITH {_TWO}, ma AS (SELECT ra, rb, a AS k, count(*) AS n FROM two GROUP BY 1, 2, 3), mb AS (SELECT ra, rb, b AS k, count(*) AS n FROM two GROUP BY 1, 2, 3), e AS (SELECT ra, rb, sum(ma.n * mb.n)::DOUBLE AS e FROM ma JOIN mb USING (ra, rb, k) GROUP BY 1, 2), o AS (SELECT ra, rb, count(*) AS n, avg((a = b)::INT) AS po FROM two GROUP BY 1, 2) SELECT ra, rb, n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM o JOIN e USING (ra, rb)", "reviews")
def mt22(spark, sf):
    return M.kappa(two(spark, sf), "a", "b", ["ra", "rb"]).select("ra", "rb", "n", r6(c("agreement")).alias("agreement"), r6(c("kappa")).alias("kappa"))


_ORD = "x AS (SELECT image_id, least(4, floor(sharp * 5))::BIGINT AS a, least(4, floor((sharp + visible) * 2.5))::BIGINT AS b FROM images)"


def ordinal(spark, sf):
    return T.images(spark, sf).select("image_id", F.least(F.lit(4), F.floor(c("sharp") * 5)).cast("bigint").alias("a"), F.least(F.lit(4), F.floor((c("sharp") + c("visible")) * 2.5)).cast("bigint").alias("b"))


@query("MT23_linear_kappa", f"WITH {_ORD}, o AS (SELECT avg(abs(a - b)) / 4 AS o FROM x), e AS (SELECT avg(abs(l.a - r.b)) / 4 AS e FROM x l, x r) SELECT round(1 - o / e, 6) AS kappa FROM o, e", "images")
def mt23(spark, sf):
    return M.linear_kappa(ordinal(spark, sf), "a", "b", 5).select(r6(c("kappa")).alias("kappa"))


@query("MT24_icc", "WITH x AS (SELECT sharp AS a, visible AS b, (sharp + visible) / 2 AS m FROM images), g AS (SELECT count(*) AS n, avg(m) AS g, avg(a) AS ca, avg(b) AS cb, 2 * var_pop(m) * count(*) / (count(*) - 1) AS msr, sum(pow(a - m, 2) + pow(b - m, 2)) AS within_ FROM x), h AS (SELECT *, n * (pow(ca - g, 2) + pow(cb - g, 2)) AS ssc FROM g) SELECT n, round((msr - (within_ - ssc) / (n - 1)) / (msr + (within_ - ssc) / (n - 1) + 2 * (ssc - (within_ - ssc) / (n - 1)) / n), 6) AS icc FROM h", "images")
def mt24(spark, sf):
    return M.icc_a1(T.images(spark, sf), "image_id", ["sharp", "visible"]).select("n", r6(c("icc")).alias("icc"))


_TAB = "tab AS (SELECT lang, count(*) FILTER (p >= 0.5 AND y = 1) AS a, count(*) FILTER (p >= 0.5 AND y = 0) AS b, count(*) FILTER (p < 0.5 AND y = 1) AS c, count(*) FILTER (p < 0.5 AND y = 0) AS d FROM outcomes GROUP BY 1)"


def tab(spark, sf):
    cell = lambda hi, v: F.count(F.when((c("p") >= 0.5 if hi else c("p") < 0.5) & (c("y") == v), 1))
    return T.outcomes(spark, sf).groupBy("lang").agg(cell(True, 1).alias("a"), cell(True, 0).alias("b"), cell(False, 1).alias("c"), cell(False, 0).alias("d"))


@query("MT25_fisher_exact", f"WITH {_TAB}, t AS (SELECT lang, a, a + b AS r, a + c AS k, a + b + c + d AS n FROM tab), l AS (SELECT lang, a, x, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) AS lp FROM (SELECT *, unnest(range(greatest(0, k - (n - r)), least(r, k) + 1)) AS x FROM t)) SELECT lang, round(least(1, sum(exp(lp)) FILTER (lp <= s + 1e-9)), 6) AS p_value FROM (SELECT *, max(CASE WHEN x = a THEN lp END) OVER (PARTITION BY lang) AS s FROM l) GROUP BY 1", "outcomes")
def mt25(spark, sf):
    return M.fisher_exact(tab(spark, sf), "a", "b", "c", "d").select("lang", r6(c("p_value")).alias("p_value"))


@query("MT26_odds_ratio", f"WITH {_TAB}, h AS (SELECT lang, a + 0.5::DOUBLE AS a, b + 0.5::DOUBLE AS b, c + 0.5::DOUBLE AS c, d + 0.5::DOUBLE AS d FROM tab) SELECT lang, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1/a + 1/b + 1/c + 1/d)), 6) AS low, round(exp(ln(a * d / (b * c)) + 1.959963984540054 * sqrt(1/a + 1/b + 1/c + 1/d)), 6) AS high FROM h", "outcomes")
def mt26(spark, sf):
    x = tab(spark, sf).select("lang", M.odds_ratio(c("a"), c("b"), c("c"), c("d")).alias("o"))
    return x.select("lang", *[r6(c(f"o.{k}")).alias(k) for k in ("odds_ratio", "low", "high")])


@query("MT27_mann_whitney", "WITH r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM outcomes), s AS (SELECT sum(r) FILTER (y = 1) AS sr, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM r) SELECT round(sr - a * (a + 1) / 2, 6) AS u, round(2 * (sr - a * (a + 1) / 2) / (a * b) - 1, 6) AS rank_biserial, round((sr - a * (a + 1) / 2 - a * b / 2) / sqrt(a * b * (a + b + 1) / 12), 6) AS z FROM s", "outcomes")
def mt27(spark, sf):
    x = R.average_rank(T.outcomes(spark, sf), "n_chars", "r")
    s = x.agg(F.sum(F.when(c("y") == 1, c("r"))).alias("sr"), F.sum("y").cast("double").alias("a"), F.sum(1 - c("y")).cast("double").alias("b")).withColumn("u", c("sr") - c("a") * (c("a") + 1) / 2)
    return s.select(r6(c("u")).alias("u"), r6(2 * c("u") / (c("a") * c("b")) - 1).alias("rank_biserial"), r6((c("u") - c("a") * c("b") / 2) / F.sqrt(c("a") * c("b") * (c("a") + c("b") + 1) / 12)).alias("z"))


@query("MT28_cliffs_delta", "SELECT x.lang, round(sum(sign(x.p2 - z.p2))::DOUBLE / count(*), 6) AS delta FROM outcomes x JOIN outcomes z ON x.lang = z.lang AND x.y = 1 AND z.y = 0 GROUP BY 1", "outcomes")
def mt28(spark, sf):
    return M.auroc(T.outcomes(spark, sf), "p2", "y", ["lang"]).where("auroc is not null").select("lang", r6(2 * c("auroc") - 1).alias("delta"))


@query("MT29_correlations", "SELECT round(corr(p, p2), 6) AS pearson, round(corr(r, r2), 6) AS spearman FROM (SELECT p, p2, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0::DOUBLE AS r2 FROM outcomes)", "outcomes")
def mt29(spark, sf):
    x = R.average_rank(R.average_rank(T.outcomes(spark, sf), "p", "r"), "p2", "r2")
    return x.agg(r6(F.corr("p", "p2")).alias("pearson"), r6(F.corr("r", "r2")).alias("spearman"))


@query("MT30_risk_contrast", f"WITH {_TAB} SELECT lang, round(a / nullif(a + b, 0)::DOUBLE - c / nullif(c + d, 0)::DOUBLE, 6) AS risk_difference, round((a / nullif(a + b, 0)::DOUBLE) / nullif(c / nullif(c + d, 0)::DOUBLE, 0), 6) AS risk_ratio FROM tab", "outcomes")
def mt30(spark, sf):
    hi, lo = F.try_divide(c("a"), c("a") + c("b")), F.try_divide(c("c"), c("c") + c("d"))
    return tab(spark, sf).select("lang", r6(hi - lo).alias("risk_difference"), r6(F.try_divide(hi, lo)).alias("risk_ratio"))


@query("MT31_dyadic_interval", "WITH m AS (SELECT avg(pow(p - y, 2) - pow(p2 - y, 2)) AS mean, count(*) AS n FROM outcomes), u AS (SELECT a, b, pow(p - y, 2) - pow(p2 - y, 2) - mean AS u FROM outcomes, m), s AS (SELECT sum(t * t) AS ss FROM (SELECT sum(u) AS t FROM (SELECT a AS node, u FROM u UNION ALL SELECT b, u FROM u) GROUP BY node)), q AS (SELECT sum(u * u) AS uu FROM u) SELECT n, round(mean, 6) AS mean, round(sqrt(greatest(ss - uu, 0)) / n, 6) AS se, round(mean - 1.959963984540054 * sqrt(greatest(ss - uu, 0)) / n, 6) AS low, round(mean + 1.959963984540054 * sqrt(greatest(ss - uu, 0)) / n, 6) AS high FROM m, s, q", "outcomes")
def mt31(spark, sf):
    o = T.outcomes(spark, sf).withColumn("d", F.pow(c("p") - c("y"), F.lit(2)) - F.pow(c("p2") - c("y"), F.lit(2)))
    x = M.dyadic_interval(o.select("a", "b", "d"), "a", "b", "d")
    return x.select("n", *[r6(c(k)).alias(k) for k in ("mean", "se", "low", "high")])


@query("MT32_median_split", "WITH m AS (SELECT lang, quantile_cont(p, 0.5) AS med FROM outcomes GROUP BY 1) SELECT o.lang, count(*) FILTER (p > med) AS n_high, count(*) FILTER (p <= med) AS n_low, CASE WHEN count(*) FILTER (p > med) >= 5 AND count(*) FILTER (p <= med) >= 5 THEN round(avg(y) FILTER (p > med) - avg(y) FILTER (p <= med), 6) END AS contrast FROM outcomes o JOIN m ON o.lang = m.lang GROUP BY 1", "outcomes")
def mt32(spark, sf):
    o = T.outcomes(spark, sf)
    m = o.groupBy("lang").agg(F.percentile("p", F.lit(0.5)).alias("med"))
    hi = c("p") > c("med")
    nh, nl = F.count(F.when(hi, 1)), F.count(F.when(~hi, 1))
    return o.join(F.broadcast(m), "lang").groupBy("lang").agg(nh.alias("n_high"), nl.alias("n_low"), F.when((nh >= 5) & (nl >= 5), r6(F.avg(F.when(hi, c("y"))) - F.avg(F.when(~hi, c("y"))))).alias("contrast"))


@query("MT33_score_separation", "SELECT descriptor, round(avg(review) FILTER (same) - avg(review) FILTER (NOT same), 6) AS mean_gap, round(median(review) FILTER (same), 6) AS pos_median, round(median(review) FILTER (NOT same), 6) AS neg_median FROM scored GROUP BY 1", "scored")
def mt33(spark, sf):
    pos, neg = F.when(c("same"), c("review")), F.when(~c("same"), c("review"))
    return scored(spark, sf).groupBy("descriptor").agg(r6(F.avg(pos) - F.avg(neg)).alias("mean_gap"), r6(F.percentile(pos, F.lit(0.5))).alias("pos_median"), r6(F.percentile(neg, F.lit(0.5))).alias("neg_median"))


@query("MT34_query_difficulty", "WITH q AS (SELECT descriptor, query, max(same::INT) AS ceiling_, max(CASE WHEN rank = 1 THEN same::INT ELSE 0 END) AS top1 FROM evidence GROUP BY 1, 2) SELECT descriptor, round(avg(ceiling_), 6) AS ceiling_, round(avg(top1), 6) AS top1, round(avg(ceiling_ - top1), 6) AS gap FROM q GROUP BY 1", "evidence")
def mt34(spark, sf):
    h = c("same").cast("int")
    q = T.evidence(spark, sf).groupBy("descriptor", "query").agg(F.max(h).alias("ceil"), F.max(F.when(c("rank") == 1, h).otherwise(0)).alias("top"))
    return q.groupBy("descriptor").agg(r6(F.avg("ceil")).alias("ceiling_"), r6(F.avg("top")).alias("top1"), r6(F.avg(c("ceil") - c("top"))).alias("gap"))


_TRANS = "tr AS (SELECT a.query, CASE WHEN NOT a.same AND b.same THEN 'rescue' WHEN a.same AND NOT b.same THEN 'harm' WHEN a.same THEN 'both_true' ELSE 'both_false' END AS move, a.reliability, a.conflict FROM (SELECT * FROM reranked WHERE policy = 'descriptor_only' AND rk = 1) a JOIN (SELECT * FROM reranked WHERE policy = 'evidence_admissibility' AND rk = 1) b ON a.query = b.query)"


def transitions(spark, sf):
    r = reranked(spark, sf).where("rk = 1")
    a = r.where("policy = 'descriptor_only'").select("query", c("same").alias("x"), "reliability", "conflict")
    j = a.join(r.where("policy = 'evidence_admissibility'").select("query", c("same").alias("y")), "query")
    return j.withColumn("move", F.when(~c("x") & c("y"), "rescue").when(c("x") & ~c("y"), "harm").when(c("x"), "both_true").otherwise("both_false"))


@query("MT35_paired_transition", f"WITH {_TRANS} SELECT move, count(*) AS n FROM tr GROUP BY 1 UNION ALL SELECT 'net_gain', count(*) FILTER (move = 'rescue') - count(*) FILTER (move = 'harm') FROM tr", "reranked")
def mt35(spark, sf):
    t = transitions(spark, sf)
    return t.groupBy("move").agg(n_().alias("n")).unionByName(t.agg((F.count(F.when(c("move") == "rescue", 1)) - F.count(F.when(c("move") == "harm", 1))).alias("n")).withColumn("move", F.lit("net_gain")))


@query("MT36_rescue_harm_contrast", f"WITH {_TRANS}, l AS (SELECT move, 'reliability' AS feature, reliability AS v FROM tr UNION ALL SELECT move, 'conflict', conflict FROM tr) SELECT feature, round(avg(v) FILTER (move = 'rescue'), 6) AS rescue, round(avg(v) FILTER (move = 'harm'), 6) AS harm FROM l GROUP BY 1", "reranked")
def mt36(spark, sf):
    long_ = transitions(spark, sf).unpivot("move", ["reliability", "conflict"], "feature", "v")
    return long_.groupBy("feature").agg(r6(F.avg(F.when(c("move") == "rescue", c("v")))).alias("rescue"), r6(F.avg(F.when(c("move") == "harm", c("v")))).alias("harm"))


@query("MT37_conflict_lift", "WITH q AS (SELECT quantile_cont(pct, 0.9) AS qd, quantile_cont(review, 0.9) AS qr FROM scored), x AS (SELECT unnest(list_filter(['all', CASE WHEN pct >= qd THEN 'descriptor' END, CASE WHEN review >= qr THEN 'diagnostic' END], lambda v: v IS NOT NULL)) AS subset, conflict >= 0.5 AS k FROM scored, q) SELECT subset, count(*) AS n, round(avg(k::INT), 6) AS rate FROM x GROUP BY 1", "scored")
def mt37(spark, sf):
    s = scored(spark, sf)
    q = s.agg(F.percentile("pct", F.lit(0.9)).alias("qd"), F.percentile("review", F.lit(0.9)).alias("qr"))
    tags = F.explode(F.array_compact(F.array(F.lit("all"), F.when(c("pct") >= c("qd"), "descriptor"), F.when(c("review") >= c("qr"), "diagnostic"))))
    return s.crossJoin(F.broadcast(q)).select(tags.alias("subset"), (c("conflict") >= 0.5).cast("int").alias("k")).groupBy("subset").agg(n_().alias("n"), r6(F.avg("k")).alias("rate"))


@query("MT38_overlapping_populations", "SELECT descriptor, pop, count(*) AS n, round(avg((conflict >= 0.5)::INT), 6) AS rate FROM (SELECT *, unnest(list_filter(['all', CASE WHEN rank = 1 THEN 'top1' END, CASE WHEN rank <= 5 THEN 'top5' END, CASE WHEN NOT same THEN 'false' END, CASE WHEN pct >= 0.9 AND NOT same THEN 'hard' END], lambda v: v IS NOT NULL)) AS pop FROM scored) GROUP BY 1, 2", "scored")
def mt38(spark, sf):
    tags = F.array_compact(F.array(F.lit("all"), F.when(c("rank") == 1, "top1"), F.when(c("rank") <= 5, "top5"), F.when(~c("same"), "false"), F.when((c("pct") >= 0.9) & ~c("same"), "hard")))
    return scored(spark, sf).select("descriptor", F.explode(tags).alias("pop"), (c("conflict") >= 0.5).cast("int").alias("k")).groupBy("descriptor", "pop").agg(n_().alias("n"), r6(F.avg("k")).alias("rate"))


@query("MT39_policy_on_calibration", "WITH m AS (SELECT policy, query % 2 = 0 AS calib, avg(same::INT) FILTER (rk = 1) AS top1, avg(same::INT) FILTER (rk <= 5) AS p5, avg(conflict) FILTER (rk = 1) AS k FROM reranked GROUP BY 1, 2), pick AS (SELECT policy FROM m WHERE calib ORDER BY top1 DESC, p5 DESC, k, policy LIMIT 1) SELECT policy, round(top1, 6) AS top1, round(p5, 6) AS p5 FROM m JOIN pick USING (policy) WHERE NOT calib", "reranked")
def mt39(spark, sf):
    h = c("same").cast("int")
    m = reranked(spark, sf).groupBy("policy", (c("query") % 2 == 0).alias("calib")).agg(F.avg(F.when(c("rk") == 1, h)).alias("top1"), F.avg(F.when(c("rk") <= 5, h)).alias("p5"), F.avg(F.when(c("rk") == 1, c("conflict"))).alias("k"))
    pick = m.where("calib").orderBy(F.desc("top1"), F.desc("p5"), "k", "policy").limit(1).select("policy")
    return m.where("not calib").join(F.broadcast(pick), "policy").select("policy", r6(c("top1")).alias("top1"), r6(c("p5")).alias("p5"))


@query("MT40_control_policy_bundle", "SELECT route, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, round(count(DISTINCT query) / (SELECT count(DISTINCT query) FROM scored WHERE descriptor = 'mega')::DOUBLE, 6) AS query_coverage, round(avg(same::INT), 6) AS precision_ FROM scored WHERE descriptor = 'mega' GROUP BY 1", "scored")
def mt40(spark, sf):
    s = scored(spark, sf).where("descriptor = 'mega'")
    t = s.agg(n_().alias("t"), F.countDistinct("query").alias("qs"))
    g = s.groupBy("route").agg(n_().alias("n"), F.countDistinct("query").alias("q"), F.avg(c("same").cast("int")).alias("pr"))
    return g.crossJoin(F.broadcast(t)).select("route", "n", r6(c("n") / c("t")).alias("share"), r6(c("q") / c("qs")).alias("query_coverage"), r6(c("pr")).alias("precision_"))


@query("MT41_hygiene_summary", "SELECT q_scope AS scope, route, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY q_scope)::DOUBLE, 6) AS fraction, round(coalesce(count(*) FILTER (same) / nullif(sum(count(*) FILTER (same)) OVER (PARTITION BY q_scope), 0)::DOUBLE, 0), 6) AS retention FROM scored GROUP BY 1, 2", "scored")
def mt41(spark, sf):
    g = scored(spark, sf).groupBy(c("q_scope").alias("scope"), "route").agg(n_().alias("n"), F.count(F.when(c("same"), 1)).alias("s"))
    w = Window.partitionBy("scope")
    return g.select("scope", "route", "n", r6(c("n") / F.sum("n").over(w)).alias("fraction"), r6(F.coalesce(F.try_divide(c("s"), F.sum("s").over(w)), F.lit(0.0))).alias("retention"))


@query("MT42_out_of_fold_threshold", "WITH f AS (SELECT DISTINCT fold AS held FROM outcomes), k AS (SELECT held, p, count(*) AS n, sum(1 - y) AS l FROM outcomes, f WHERE fold <> held GROUP BY 1, 2), g AS (SELECT held, p, sum(n) OVER o AS n, sum(l) OVER o / sum(n) OVER o::DOUBLE AS risk FROM k WINDOW o AS (PARTITION BY held ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) SELECT held, round(coalesce(min(p) FILTER (risk <= 0.1), 1.01), 6)::DOUBLE AS threshold FROM g GROUP BY 1", "outcomes")
def mt42(spark, sf):
    o = T.outcomes(spark, sf)
    f = o.select(c("fold").alias("held")).distinct()
    x = o.crossJoin(F.broadcast(f)).where("fold <> held").withColumn("risk", -c("p")).withColumn("loss", 1 - c("y"))
    return M.choose_threshold(M.risk_coverage(x, "risk", "loss", ["held"]), [0.1], ["held"], -1.01).select("held", r6(-c("tau")).alias("threshold"))


# ---------------------------------------------------------------- resampling

_IDX = "(('0x' || substr(sha256('{s}|' || r.r::VARCHAR || '|' || s.i::VARCHAR), 1, 8))::BIGINT) % s.n"
_UNITS = "u AS (SELECT query, avg(same::INT) FILTER (rank <= 5) AS v, row_number() OVER (ORDER BY query) - 1 AS i, count(*) OVER () AS n FROM evidence WHERE descriptor = 'mega' GROUP BY 1)"


def _boot_sql(units, value, seed, reps, ends="round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high"):
    return f"WITH {units}, b AS (SELECT r.r AS rep, {value} AS v FROM range({reps}) r(r), u s JOIN u x ON x.i = {_IDX.format(s=seed)} GROUP BY 1) SELECT count(*) AS reps, round(avg(v), 6) AS mean, {ends} FROM b"


def interval(b):
    x = M.percentile_interval(b)
    return x.select("reps", *[r6(c(k)).alias(k) for k in ("mean", "low", "high")])


def query_units(spark, sf):
    return T.evidence(spark, sf).where("descriptor = 'mega'").groupBy("query").agg(F.avg(F.when(c("rank") <= 5, c("same").cast("int"))).alias("v"))


@query("BS1_bootstrap_mean", _boot_sql(_UNITS, "avg(x.v)", "b1", 100), "evidence")
def bs1(spark, sf):
    return interval(M.bootstrap(query_units(spark, sf), [c("query")], F.sum(c("v") * c("times")) / F.sum("times"), 100, "b1"))


@query("BS2_paired_delta", _boot_sql("u AS (SELECT id, pow(p - y, 2) - pow(p2 - y, 2) AS v, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM outcomes)", "avg(x.v)", "b2", 50), "outcomes")
def bs2(spark, sf):
    u = T.outcomes(spark, sf).select("id", (F.pow(c("p") - c("y"), F.lit(2)) - F.pow(c("p2") - c("y"), F.lit(2))).alias("v"))
    return interval(M.bootstrap(u, [c("id")], F.sum(c("v") * c("times")) / F.sum("times"), 50, "b2"))


@query("BS3_two_sample_difference", _boot_sql("u AS (SELECT id, y, p, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM outcomes)", "avg(x.p) FILTER (x.y = 1) - avg(x.p) FILTER (x.y = 0)", "b3", 50), "outcomes")
def bs3(spark, sf):
    mean = lambda v: F.sum(F.when(c("y") == v, c("p") * c("times"))) / F.sum(F.when(c("y") == v, c("times")))
    return interval(M.bootstrap(T.outcomes(spark, sf).select("id", "y", "p"), [c("id")], mean(1) - mean(0), 50, "b3"))


_COMP = "u AS (SELECT comp, sum(w)::DOUBLE AS w, sum(w * (pow(p - y, 2) - pow(p2 - y, 2))) AS d, row_number() OVER (ORDER BY comp) - 1 AS i, count(*) OVER () AS n FROM outcomes GROUP BY 1)"


def comp_units(spark, sf):
    d = F.pow(c("p") - c("y"), F.lit(2)) - F.pow(c("p2") - c("y"), F.lit(2))
    return T.outcomes(spark, sf).groupBy("comp").agg(F.sum("w").cast("double").alias("w"), F.sum(c("w") * d).alias("d"))


@query("BS4_cluster_bootstrap", _boot_sql(_COMP, "sum(x.d) / sum(x.w)", "b4", 100), "outcomes")
def bs4(spark, sf):
    return interval(M.bootstrap(comp_units(spark, sf), [c("comp")], F.sum(c("d") * c("times")) / F.sum(c("w") * c("times")), 100, "b4"))


@query("BS5_component_multinomial", _boot_sql(_COMP, "sum(x.d) / sum(x.w)", "b5", 500, "round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(avg((v <= 0)::INT), 6) AS share_below"), "outcomes")
def bs5(spark, sf):
    b = M.bootstrap(comp_units(spark, sf), [c("comp")], F.sum(c("d") * c("times")) / F.sum(c("w") * c("times")), 500, "b5")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return b.agg(n_().alias("reps"), r6(F.avg("value")).alias("mean"), q.alias("q"), r6(F.avg((c("value") <= 0).cast("int"))).alias("share_below")).select("reps", "mean", r6(c("q")[0]).alias("low"), r6(c("q")[1]).alias("high"), "share_below")


@query("BS6_conflict_enrichment", "WITH t AS (SELECT q_domain AS block, count(*) FILTER (conflict >= 0.4 AND NOT same) AS a, count(*) FILTER (conflict >= 0.4 AND same) AS b, count(*) FILTER (conflict < 0.4 AND NOT same) AS c, count(*) FILTER (conflict < 0.4 AND same) AS d FROM scored GROUP BY 1) SELECT block, round(a / nullif(a + b, 0)::DOUBLE - c / nullif(c + d, 0)::DOUBLE, 6) AS risk_difference, round((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))::DOUBLE, 6) AS odds_ratio FROM t", "scored")
def bs6(spark, sf):
    k = c("conflict") >= 0.4
    n = lambda x: F.count(F.when(x, 1))
    t = scored(spark, sf).groupBy(c("q_domain").alias("block")).agg(n(k & ~c("same")).alias("a"), n(k & c("same")).alias("b"), n(~k & ~c("same")).alias("c"), n(~k & c("same")).alias("d"))
    return t.select("block", r6(F.try_divide(c("a"), c("a") + c("b")) - F.try_divide(c("c"), c("c") + c("d"))).alias("risk_difference"), r6(M.odds_ratio(c("a"), c("b"), c("c"), c("d"))["odds_ratio"]).alias("odds_ratio"))


@query("BS7_power_simulation")
def bs7(spark, sf):
    """Share of simulated draws of n pairs whose interval excludes zero, over a grid of n."""
    u = comp_units(spark, sf)
    x = M._indexed(u.withColumn("e", c("d") / c("w")), [c("comp")])
    g = spark.createDataFrame([(10,), (20,), (40,)], "size int")
    d = g.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("slot", F.explode(F.sequence(F.lit(1), c("size"))))
    n = u.agg(n_().alias("n"))
    d = d.crossJoin(F.broadcast(n)).withColumn("_i", H.hash_index("b7", c("n"), c("size"), c("rep"), c("slot")))
    s = d.join(x.select("_i", "e"), "_i").groupBy("size", "rep").agg(F.avg("e").alias("m"), (F.stddev_samp("e") / F.sqrt(n_())).alias("se"))
    return s.groupBy("size").agg(r6(F.avg((F.abs("m") > 1.96 * c("se")).cast("int"))).alias("power"))


@query("BS8_random_candidate_control", "SELECT r.r AS rep, round(avg(same::INT), 6) AS rate FROM range(20) r(r), evidence WHERE descriptor = 'mega' AND rank - 1 = (('0x' || substr(sha256('b8|' || r.r::VARCHAR || '|' || query::VARCHAR), 1, 8))::BIGINT) % 20 GROUP BY 1", "evidence")
def bs8(spark, sf):
    r = spark.range(20).withColumnRenamed("id", "rep")
    e = T.evidence(spark, sf).where("descriptor = 'mega'").crossJoin(F.broadcast(r))
    return e.where(c("rank") - 1 == H.hash_index("b8", 20, c("rep"), c("query"))).groupBy("rep").agg(r6(F.avg(c("same").cast("int"))).alias("rate"))


@query("BS9_workload_grid", "SELECT n.n AS pairs, f.f AS completion, s.s AS seconds, ceil(n.n / f.f)::BIGINT AS launched, ceil(2 * n.n * s.s / 3600)::BIGINT AS hours FROM (VALUES (400), (1600)) n(n), (VALUES (0.8::DOUBLE), (0.95)) f(f), (VALUES (12.0::DOUBLE), (24.0)) s(s)")
def bs9(spark, sf):
    from ..operators.joins import grid as g

    x = g(spark, {"pairs": [400, 1600], "completion": [0.8, 0.95], "seconds": [12.0, 24.0]}, "pairs int, completion double, seconds double")
    return x.withColumns({"launched": F.ceil(c("pairs") / c("completion")), "hours": F.ceil(2 * c("pairs") * c("seconds") / 3600)})
