"""Golden values, invariants and refusals of single operators."""

import pytest
from pyspark.sql import functions as F

from pairwright.functions import evidence as E
from pairwright.functions import keyed_hash as H
from pairwright.operators import audits, graph, joins, metrics, ranks, sampling, sets
from pairwright.operators import models as D
from pairwright.sources import io


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_midrank_golden(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0), ("d", 2.0)], "k string, v double")
    assert rows(ranks.midrank(df, "v", "p"), "k", "p") == [("a", 0.25), ("b", 0.25), ("c", 0.625), ("d", 0.875)]


def test_midrank_refuses_nan(spark):
    with pytest.raises(ValueError, match="finite"):
        ranks.midrank(spark.createDataFrame([("a", float("nan"))], "k string, v double"), "v", "p")


def cells(spark, caps):
    return spark.createDataFrame(list(caps.items()), "cell string, cap bigint")


def tie(order):
    return F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("cell"))


def test_hamilton_invariants(spark):
    caps = {"large": 7, "medium": 2, "small": 1}
    q = dict(rows(sampling.hamilton(cells(spark, caps), "cell", "cap", 6, tie({"large": "2", "medium": "1", "small": "0"})), "cell", "quota"))
    assert sum(q.values()) == 6 and all(1 <= q[c] <= caps[c] for c in caps)


def test_waterfill_golden_and_capacity(spark):
    q = sampling.waterfill(cells(spark, {"a": 1, "b": 4, "c": 4}), "cell", "cap", 7, tie({"a": "0", "b": "1", "c": "2"}))
    assert rows(q, "cell", "quota") == [("a", 1), ("b", 3), ("c", 3)]
    with pytest.raises(ValueError, match="INSUFFICIENT_FRAME_CAPACITY"):
        sampling.waterfill(cells(spark, {"a": 1}), "cell", "cap", 2, F.lit("0"))


def test_hmac_golden(spark):
    d = spark.range(1).select(H.seeded_digest("00" * 32, "contract", "development", "allocation_tie_break", F.lit("cell_a"), F.lit("")).alias("d")).first().d
    assert d == "a4862037bbb033d209577af1421865503e335db6b5b23e83f6892c80606ef670"
    with pytest.raises(ValueError):
        H.seeded_digest("00", "c", "r", "s", F.lit("x"), F.lit("y"))


def test_evidence_states(spark):
    t, f = F.lit(True), F.lit(False)
    r = spark.range(1).select(E.evidence_state(f, t, f, f, f).alias("a"), E.evidence_state(f, f, f, t, f).alias("b"), E.evidence_state(f, f, f, f, f).alias("c")).first()
    assert (r.a, r.b, r.c) == ("measurement_failure", "evidence_stress", "ordinary")


def test_stratified_draw_ignores_input_order(spark):
    ids = [(f"id{i}", "cell") for i in range(4)]
    draw = lambda x: rows(sampling.stratified_draw(spark.createDataFrame(x, "id string, cell string"), "cell", "id", F.lit(2), H.seeded_digest("00" * 32, "c", "r", "s", F.col("cell"), F.col("id"))), "id", "pi")
    assert draw(ids) == draw(ids[::-1]) and [p for _, p in draw(ids)] == [0.5, 0.5]


def test_mechanism_precedence(spark):
    df = spark.createDataFrame(
        [(1, True, True, 0.1, "both", 0.9), (2, False, True, 0.1, "both", 0.9), (3, False, False, 0.1, "dinov2_only", None), (4, False, False, 0.5, "dinov2_only", None), (5, False, False, 0.5, "both", 0.9), (6, False, False, 0.5, "both", 0.1)],
        "i int, f boolean, s boolean, l double, p string, d double",
    )
    got = [r.m for r in df.select("i", E.mechanism_state(F.col("f"), F.col("s"), F.col("l"), F.col("p"), F.col("d")).alias("m")).orderBy("i").collect()]
    assert got == ["automatic_measurement_failure", "image_quality_stress", "local_correspondence_bottom_quintile", "descriptor_exclusive", "dual_descriptor_percentile_disagreement_top_quintile", "ordinary_reference"]


def test_overlapping_samples_are_refused(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    with pytest.raises(ValueError, match="overlap"):
        sets.assert_disjoint({"x": a, "y": a.limit(1)}, "id")


def test_selective_metrics_and_thresholds(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.9, 1)], "risk double, loss int")
    at = {r.tau: r for r in metrics.risk_coverage(df, "risk", "loss").collect()}[0.2]
    assert at.n == 2 and abs(at.coverage - 2 / 3) < 1e-12 and at.selective_risk == 0.5
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 1), (0.9, 1)], "risk double, loss int")
    best = metrics.choose_threshold(metrics.risk_coverage(df, "risk", "loss"), [0.25]).first()
    assert (best.tau, best.n, best.selective_risk) == (0.2, 2, 0.0)
    none = metrics.choose_threshold(metrics.risk_coverage(spark.createDataFrame([(0.1, 1), (0.2, 1)], "risk double, loss int"), "risk", "loss"), [0.05]).first()
    assert (none.tau, none.n, none.status) == (-1.0, 0, "no_admission")


def test_components(spark):
    c = rows(graph.components(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a bigint, b bigint")), "node", "comp")
    assert c == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]


def test_long_path_is_one_component(spark):
    c = graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint"))
    assert c.select("comp").distinct().count() == 1


def test_checked_join_refuses_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="not unique"):
        joins.one_to_one(a, a.distinct(), ["k"])


def test_lookup_missing_key_stops(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        joins.lookup(a, b, ["k"], ["v"]).collect()


def test_rank_band_out_of_range_stops(spark):
    with pytest.raises(Exception, match="rank out of range"):
        spark.range(21, 22).select(E.rank_band(F.col("id")).alias("b")).collect()


def test_forbidden_and_required_columns(spark):
    df = spark.createDataFrame([(1, "x")], "id int, identity_label string")
    with pytest.raises(ValueError, match="forbidden"):
        audits.assert_no_forbidden_columns(df, ["identity"])
    with pytest.raises(ValueError, match="missing"):
        audits.assert_required_columns(df, ["nope"])


def test_csv_round_trip_and_refused_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted", cell'), ("", "x")], "k string, v string")
    p = str(tmp_path / "t")
    io.write_csv(df, p, ["k", "v"])
    assert rows(io.read_csv(spark, p), "k", "v") == rows(df, "k", "v")
    assert {r.k for r in io.typed(io.read_csv(spark, p), {"k": "bigint"}).collect()} == {1, None}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        io.write_csv(df, p, ["k", "v"])


def test_failed_validation_publishes_nothing(spark, tmp_path):
    def refuse(_):
        raise ValueError("refused")

    p = tmp_path / "out"
    with pytest.raises(ValueError, match="refused"):
        io.publish(spark.range(3), str(p), refuse)
    assert not p.exists() and not list(tmp_path.glob("out.staging*"))


def test_zip_member_and_npy(spark, tmp_path):
    import zipfile

    import numpy as np

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.csv", "﻿k,v\n1,x\n2,y\n")
    got = io.read_zip_csv(spark, str(tmp_path / "a.zip"), "m.csv").select("line", F.col("cells")["k"].alias("k")).collect()
    assert [(r.line, r.k) for r in got] == [(1, "1"), (2, "2")]
    np.save(tmp_path / "m.npy", np.eye(2, dtype="float32"))
    assert [r.vector for r in io.npy_rows(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[1.0, 0.0], [0.0, 1.0]]


def test_firth_and_newton_agree_in_sign():
    import numpy as np

    g = np.random.default_rng(0)
    x = g.normal(size=(400, 2))
    y = (x[:, 0] + g.normal(size=400) > 0).astype(float)
    a, b = D.newton_logistic(x, y, np.ones(400), 1e-3), D.firth_logistic(x, y)
    assert a[1] > 0.5 and b[1] > 0.5 and abs(a[2]) < 0.5
    assert abs(D.predict(b, x).mean() - y.mean()) < 1e-3


def test_image_metrics(spark):
    flat, noisy = bytes([100] * 25), bytes(i * 37 % 256 for i in range(25))
    r = {x.k: x for x in D.image_metrics(spark.createDataFrame([(1, flat), (2, noisy), (3, b"")], "k int, c binary"), "k", "c", 5).collect()}
    assert r[1].sharpness == 0 and r[2].sharpness > 0 and r[3].sharpness is None


def test_sessions_open_at_the_end_and_late_responses(spark, tmp_path):
    """Two files; the second is 90 days older. A gap of just 30 minutes doesn't split."""
    from pairwright.streaming import review as V

    for k, rows in enumerate(([("a", "2024-04-01 10:00:00"), ("a", "2024-04-01 10:30:00"), ("b", "2024-04-01 10:00:00")], [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:30:01")])):
        spark.createDataFrame(rows, "reviewer string, t string").selectExpr("reviewer", "timestamp(t) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    got = V.sessions(V.log_stream(spark, str(tmp_path / "log")), "reviewer", "ts", "30 minutes")
    assert sorted((r.reviewer, str(r.start), str(r.end), r.responses) for r in got.collect()) == [
        ("a", "2024-01-01 10:00:00", "2024-01-01 10:30:00", 1), ("a", "2024-01-01 10:30:01", "2024-01-01 11:00:01", 1), ("a", "2024-04-01 10:00:00", "2024-04-01 11:00:00", 2), ("b", "2024-04-01 10:00:00", "2024-04-01 10:30:00", 1),
    ]


def test_nested_cv_chooses_lambda_inside(spark):
    import numpy as np

    from pairwright.operators.graph import nested_folds
    from pairwright.plans import q_models as Q
    from pairwright.plans import tables as T

    o = T.outcomes(spark, "/root/testdata/sf0.001")
    got = D.nested_cross_validated(o, "id", "y", "w", "comp", Q.NESTED, Q.LAMBDAS, 5, 4).toPandas()
    data = o.select("id", "y", "w", "comp", "p").toPandas()
    assert sorted(got["model"].unique()) == ["P0", "P1", "P2", "P3", "P4", "P5", "S1", "S2"]
    assert (got.groupby("model")["id"].apply(sorted).map(tuple) == tuple(sorted(data["id"]))).all()
    assert got.merge(data[["id", "comp"]]).groupby("comp")["fold"].nunique().max() == 1 and got["p"].between(0, 1).all()
    v = o.groupBy("comp").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    f = nested_folds(v.withColumnRenamed("pos", "_pos").withColumnRenamed("n", "_n"), "comp", ["_pos", "_n"], 5, 4).toPandas()
    k = int(got["fold"].min())
    tr = data.merge(f[f["outer"] == k][["comp", "inner"]]).sort_values("id")

    def fit(a, b, lam):
        m, s = a["p"].mean(), a["p"].std(ddof=0)
        beta = D.newton_logistic(((a[["p"]] - m) / s).to_numpy(), a["y"].to_numpy(float), a["w"].to_numpy(float), lam)
        return D.predict(beta, ((b[["p"]] - m) / s).to_numpy())

    loss = {}
    for lam in Q.LAMBDAS:
        parts = [(tr[tr["inner"] != i], tr[tr["inner"] == i]) for i in sorted(tr["inner"].unique())]
        loss[lam] = [float(np.average((b["y"] - fit(a, b, lam)) ** 2, weights=b["w"])) for a, b in parts]
    best = min(loss.values(), key=np.mean)
    lam = max(g for g, x in loss.items() if np.mean(x) <= np.mean(best) + np.std(best, ddof=1) / len(best) ** 0.5)
    own = got[(got["model"] == "P1") & (got["fold"] == k)].sort_values("id")
    assert set(own["lam"]) == {lam}
    te = data[data["id"].isin(own["id"])].sort_values("id")
    assert np.allclose(own["p"], fit(tr, te, lam))
    zero = got[(got["model"] == "P0") & (got["fold"] == k)]
    assert np.allclose(zero["p"], np.average(tr["y"], weights=tr["w"]), atol=1e-6)
