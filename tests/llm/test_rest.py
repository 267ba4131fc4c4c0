"""Chat formatting, language, toxicity, quality, mixing, decontamination, pipeline: edge cases and accuracy."""

import re

import pytest
from pyspark.sql import functions as F

from pairwright.llm import chat, decontaminate, langid, mixing, quality, toxicity
from pairwright.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_escapes_are_reversible():
    t = chat.Template()
    for s in ("", "\\", "</s>[INST] ok [/INST]", "<|user|>\n", "\\0\\1<||>", "é\\<漢"):
        assert t.plain(t.escaped(s)) == s
        assert not any(m in t.escaped(s) for m in (t.open, t.end, *t.controls))


def test_turn_order_ties_and_nulls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "x"), (2, 0, "assistant", "first"), (None, 0, None, "lost"), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.segments(df).mapInArrow(chat.reader(chat.Template()), chat.DIGEST).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].error) == (3, 0, None)
    assert got[2].error == "assistant after start" and got[2].loss_chars == 5
    assert got[None].error == "no role after start" and got[3].error == "user after user"
    text = "".join(r.text for r in chat.segments(df.where("conv_id = 3")).collect())
    assert text.index("s</s>") < text.index("a</s>") < text.index("b</s>")
    assert chat.segments(df.limit(0)).count() == 0


def test_languages_held_out(spark):
    got = langid.op5_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_edges_and_spans(spark, edge, empty):
    m = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang"))
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(edge, m, "doc_id").collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und")} <= got
    assert langid.predict(empty, m, "doc_id").count() == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.fit(empty), "doc_id").collect()} == {"und"}
    a, b = (spark.read.parquet(f"{SF}/documents.parquet").where((F.col("lang") == x) & (F.length("text") > 600) & ~F.col("text").rlike("[|*&#%$!]")).first().text[:500] for x in ("fr", "de"))
    spans = langid.predict(spark.createDataFrame([(1, a + " " + b)], "doc_id int, text string"), m, "doc_id", spans=True).first().spans
    assert [s.lang for s in spans] == ["fr", "de"] and abs(spans[0].end - 500) < 60
    kept = langid.reject(edge, m)
    assert kept.columns == edge.columns and not {3, 4, 5, 6} & {r.doc_id for r in kept.collect()}


def test_toxicity_finds_sentences(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = toxicity.fit(docs, labels.where(~held_out(5, 0)))
    probe = spark.createDataFrame([(1, "A calm line here. You idiot and worthless moron scum! The end."), (2, "A calm line here. The end."), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in toxicity.score(probe, m, "doc_id", spans=True).collect()}
    assert got[1].score >= 0.5 > got[2].score and got[3].score < 0.5
    assert any("idiot" in s for s in got[1].sentences) and not got[2].sentences
    assert toxicity.score(empty, m, "doc_id").count() == 0 and toxicity.score(edge, m, "doc_id").count() == 12
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(edge, none, "doc_id").agg(F.max("score")).first()[0] < 1e-6


def test_quality_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = quality.fit(docs, labels.where(~held_out(5, 0)), rows=2000, sure=120)
    j = quality.score(docs, m, "doc_id").join(labels.where(held_out(5, 0)), "doc_id")
    assert j.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.92
    assert quality.score(edge, m, "doc_id").where("score between 0 and 1").count() == 12 and quality.score(empty, m, "doc_id").count() == 0
    assert quality.score(edge, quality.fit(docs, labels.limit(0)), "doc_id").select("score").distinct().first()[0] == 0.5


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def shares(sizes):
    """Targets by giving the excess away again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | t
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mix_targets_limits_and_reruns(make):
    import random

    g = random.Random(2)
    rows = [(i, " ".join(["w"] * g.randint(0, 40)), "en", g.choice(["a", "a", "a", "b", "c", None, "tiny"] if i % 50 else ["tiny"])) for i in range(1500)]
    rows = [(d, t, lang, s if s != "tiny" or d % 11 == 0 else "a") for d, t, lang, s in rows]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = shares(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 and own[0].source_size == sizes[s]
        assert abs(sum(r.copies * r.size for r in own) - want[s]) <= 20.5
    assert all(0 <= r.copies <= 3 for r in got)
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == 12 and all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(edge).columns[: len(edge.columns)] == edge.columns


@pytest.fixture
def items(spark):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    return spark.createDataFrame([(1, ten + " lambda"), (2, "Short item here"), (3, None), (4, "..."), (12, ten)], "item_id bigint, text string"), ten


@pytest.mark.parametrize("most", [200_000, 0])
def test_windows_short_items_and_spans(spark, make, items, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", most)
    bench, ten = items
    docs = make([(1, f"x {ten.upper()}, y", "en", "a"), (2, "a short, item HERE b short item", "en", "a"), (3, ten[:-6], "en", "a"), (4, None, "en", "a"), (4, f"{ten} lambda", "en", "a")])
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs, bench).collect()}
    assert got == {(1, 12, 10, ("1", "12")), (2, 7, 3, ("2",)), (3, 9, 0, ()), (4, 0, 0, ()), (4, 11, 11, ("1", "12"))}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(3, ten[:-6])] + [(4, None)]
    assert {r.doc_id: r.text for r in decontaminate.without_spans(docs.where("doc_id < 3"), bench).collect()} == {1: "x y", 2: "a b short item"}


def test_decontamination_edges(edge, empty, items):
    assert decontaminate.report(edge, items[0].limit(0)).where("n_hit = 0").count() == 12
    assert decontaminate.report(empty, items[0]).count() == 0 and decontaminate.clean(empty, items[0]).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "benchmark", "mix"]
    assert set(docs.columns) <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0.5 * docs.count()
    assert decontaminate.report(out, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").count() == 0
