"""Co-training against the same rounds in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import quality
from pairwright.llm.common import mix

GOOD = "The council approved the plan after a long debate about water, roads and schools in town number {}."
BAD = "BUY NOW!!! cheap $$$ click {} click click 100% FREE >>> {} <<<"


def table(n):
    g = np.random.default_rng(5)
    rows = []
    for i in range(n):
        good = g.random() < 0.6
        text = " ".join((GOOD if good != (g.random() < 0.1) else BAD).format(i, g.integers(99)) for _ in range(g.integers(1, 4)))
        rows.append((i, text, "en" if g.random() < 0.8 else None, "press" if good != (g.random() < 0.2) else "shop", int(good)))
    rows += [(n, rows[3][1], rows[3][2], rows[3][3], 0), (n + 1, rows[3][1], rows[3][2], rows[3][3], 0), (None, "no id", None, None, 0), (n + 2, None, None, None, 0)]
    return rows


def brute(rows, labels, limit, sure, rounds):
    """rows in the order of their numbers; labels in the order of their hashes."""
    docs = {r[0]: r for r in rows if r[0] is not None}
    view = lambda rs: quality.features([(r[1] or "").encode() for r in rs], [(r[2], r[3]) for r in rs])
    picked = labels[:limit]
    own = sorted((docs[d] + (y,) for d, y in picked if d in docs), key=lambda r: (r[0], r[-1]))
    y = np.array([r[-1] for r in own])
    x = view(own)
    aside = mix(np.arange(len(y), dtype=np.uint64)) % np.uint64(10) < 3
    parts = [[(v[~aside], y[~aside].astype(float))] for v in x]
    free = [r for r in rows if r[0] not in {d for d, _ in picked}]
    taken = set()
    for _ in range(rounds):
        models = [quality.joined(p) for p in parts]
        named = []
        scores = [quality.logit(m, v).astype(np.float64) for m, v in zip(models, view(free))]
        for k in (0, 1):
            first = {}
            for i, s in enumerate(scores[k]):
                if i not in taken:
                    first.setdefault(s, i)
            order = sorted(first)
            named += [(i, k, 1) for i in (first[s] for s in order[::-1][: max(1, int(sure * y.mean()))] if s > 0)]
            named += [(i, k, 0) for i in (first[s] for s in order[: max(1, int(sure * (1 - y.mean())))] if s < 0)]
        for k in (0, 1):
            mine = sorted(((i, what) for i, j, what in named if j == k))
            new = view([free[i] for i, _ in mine])[1 - k] if mine else x[1 - k][:0]
            parts[1 - k].append((new, np.array([w for _, w in mine], float)))
        taken |= {i for i, _, _ in named}
    models = [quality.joined(p) for p in parts]
    model = models, quality.calibrated(models, [v[aside] for v in x], y[aside].astype(float)), float(y.mean())
    return quality.combined(model, *view(rows)), len(taken)


@pytest.mark.parametrize("rounds, sure", [(0, 8), (1, 8), (2, 12)])
def test_rounds_are_those_of_plain_python(spark, tmp_path, rounds, sure):
    rows = table(150)
    path = str(tmp_path / "docs")
    spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    marked = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] is not None and r[0] % 3 == 0] + [(None, 1), (9999, 1)], "doc_id bigint, quality int")
    order = [(r.doc_id, r.quality) for r in marked.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").collect()]
    want, named = brute(rows, order, 40, sure, rounds)
    assert named > 0 or not rounds
    model = quality.fit(docs, marked, rows=40, sure=sure, rounds=rounds)
    got = {(r.doc_id, r.text): r.score for r in quality.score(docs, model, "doc_id", "text").collect()}
    assert np.allclose([got[r[0], r[1]] for r in rows], want, atol=1e-3)


def test_few_labels_are_fitted(spark, make):
    docs = make([(i, (GOOD if i % 2 else BAD).format(i, i), "en", "a") for i in range(12)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels, sure=2), "doc_id").collect()}
    assert min(got[i] for i in range(1, 12, 2)) > max(got[i] for i in range(0, 12, 2))


def test_clashing_names_repeated_rows_and_ties(spark, make):
    docs = make([(i % 30, (GOOD if i % 2 else BAD).format(i % 30, 1), "en", "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 20)], "doc_id bigint, quality int")
    odd = docs.withColumn("score", F.lit("x")).withColumn("s0", F.lit(1)).withColumn("_y", F.lit(2))
    model = quality.fit(odd, labels, sure=4)
    got = quality.score(odd, model, "doc_id", "score").collect()
    assert len(got) == 60 and all(isinstance(r.score, float) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())


def test_features_of_a_text_don_t_depend_on_its_neighbours():
    texts = [GOOD.encode(), b"", BAD.encode(), b"one", b" \n ", GOOD.encode(), "漢字 ünï".encode()]
    tags = [("en", "a"), (None, None)] * 3 + [("de", None)]
    together = quality.features(texts, tags)
    for i, (t, g) in enumerate(zip(texts, tags)):
        for k, alone in enumerate(quality.features([t], [g])):
            assert (together[k][i] == alone[0]).all()
