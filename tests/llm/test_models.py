"""Fitted operators: brute force on small inputs, recall and false alarms on held-out rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import chat, langid, lm_score, toxicity
from pairwright.llm.common import held_out

from .test_lm import tokens

SF = "/root/testdata/sf0.1"


def test_letters_of_every_script():
    none = ["😀😀", "٠١٢", "،؟", "१२३", "։", "", "́", "12 ३४ ①"]
    some = {"\U00030001": "han", "ب": "arabic", "नमस्ते": "devanagari", "ǅ": "latin", "ﬀ": "latin", "ﬓ": "armenian", "ﭐ": "arabic", "ꙁ": "cyrillic", "㐀": "han", "\U0001E900": "other"}
    w = langid.Words([*none, *some])
    assert (w.last[: len(none)] == w.first[: len(none)]).all()
    assert [langid.NAMES[w.script[i] - 1] for i in w.first[len(none) :]] == list(some.values()) and (w.last[len(none) :] - w.first[len(none) :] == 1).all()


def test_texts_without_letters_are_und(spark):
    model = langid.fit(spark.createDataFrame([("hello there world", "en"), ("bonjour le monde", "fr")], "text string, lang string"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["😀", "٠١٢", "։", "१२", None, "", " \n"])], "doc_id int, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(rows, model, "doc_id").collect()} == {("und", 0.0)}


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_viterbi_is_the_best_of_all_labellings(monkeypatch, cells):
    monkeypatch.setattr(langid, "TABLE_CELLS", cells)
    g = np.random.default_rng(4)
    model = langid.Model(["a", "b", "c"], g.integers(0, 40, (3, langid.BUCKETS + len(langid.NAMES) + 1)), penalty=1.5)
    texts = [" ".join("".join(g.choice(list("abcdeé"), g.integers(1, 6))) for _ in range(n)) for n in (0, 1, 3, 6, 5)]
    w = langid.Words(texts)
    s = model.word_scores(w)
    labels = model.label(s, w.first, w.last)
    for a, b in zip(w.first, w.last):
        value = lambda own: sum(s[a + i, x] for i, x in enumerate(own)) - 1.5 * sum(x != y for x, y in zip(own, own[1:]))  # noqa: B023, E731
        if b > a:
            assert value(labels[a:b]) == pytest.approx(max(value(own) for own in itertools.product(range(3), repeat=b - a)), abs=1e-4)


def quantised(n, code):
    q = int(np.searchsorted(code, n, side="right"))
    return (int(code[q - 1]), int(code[q]) - 1) if q else (0, 0)


@pytest.mark.parametrize("bits", [1 << 30, 1])
def test_score_by_brute_force(make, monkeypatch, bits):
    """With so many probes the filter doesn't err, and the scores are those of the quantised counts."""
    monkeypatch.setattr(lm_score, "PROBES", 30)
    g = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in g.geometric(0.1, g.integers(0, 30))), "en", "a") for i in range(60)]
    one, two, kinds, total = {}, {}, {}, 0
    for _, t, _, _ in rows[:40]:
        for a, b in zip(["\0start", *tokens(t)], tokens(t)):
            one[b], two[a, b], total = one.get(b, 0) + 1, two.get((a, b), 0) + 1, total + 1
    starts = 40
    for a, b in two:
        kinds[a] = kinds.get(a, 0) + 1
    floor = total + len(one) + 1

    def log_p(t):
        out = 0.0
        for a, b in zip(["\0start", *tokens(t)], tokens(t)):
            n = starts if a == "\0start" else one.get(a, 0)
            times = max(quantised(n, lm_score.WORD_CODE)[1], 1)
            rest = min(max(lm_score.DISCOUNT * quantised(kinds.get(a, 0), lm_score.WORD_CODE)[0] / times, 1e-3), 1) if n else 1.0
            single = (quantised(one.get(b, 0), lm_score.WORD_CODE)[0] + 1) / floor
            out += math.log10(min(1, max(quantised(two.get((a, b), 0), lm_score.PAIR_CODE)[0] - lm_score.DISCOUNT, 0) / times + rest * single))
        return out

    docs = make(rows)
    got = {r.doc_id: r.score for r in lm_score.scores(docs, docs.where("doc_id < 40"), "doc_id", bits=bits).collect()}
    assert got == pytest.approx({d: log_p(t) for d, t, _, _ in rows}, abs=1e-6)


def test_toxic_documents_are_caught_and_clean_ones_left_alone(spark):
    rows = toxicity.op8_toxicity(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    recall, alarms = rows.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert recall > 0.85 and alarms < 0.01


def test_length_alone_is_not_toxic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    calm = "A calm line about the weather in town. "
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, calm), (2, calm * 3000)], "doc_id int, text string"), m, "doc_id").collect()}
    assert got[2] == pytest.approx(got[1]) and got[1] < 0.1


def test_noisy_or_and_flips_by_brute_force():
    z, doc = np.array([-1.0, 0.5, 2.0]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-z))
    assert toxicity.noisy_or(z, doc, 3) == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])
    assert toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0, 0.1, 0.2).label(np.array([0.0, 1.0])) == pytest.approx([0.2, 0.9])


def test_templates_with_many_controls_are_reversible():
    t = chat.Template(controls=tuple(f"{c}x" for c in "[{(#@$%^&*aZ09"))
    for s in ("", "\\0\\a", "ax[x{x0x9xZx aZ09", "\\\\a\\", "</s>[INST]"):
        assert t.plain(t.escaped(s)) == s and not any(m in t.escaped(s) for m in (t.open, t.end, *t.controls))
    for bad in (dict(escape="<"), dict(escape="ab"), dict(controls=("",)), dict(controls=tuple(chr(0x4E00 + i) for i in range(80)))):
        with pytest.raises(ValueError):
            chat.Template(**bad)
