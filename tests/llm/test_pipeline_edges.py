"""The pipeline on empty tables, without languages, with null ids and with columns of its own names."""

import os

import pytest
from pyspark.sql import functions as F

from pairwright.llm.common import shared_dir

import corpus_pipeline

TEXT = "The mayor of the small town opened the new bridge in the morning, and many people came to see it with their children."
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mix_size string, rid int"


def folder(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def stages(spark):
    return [d for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("stage-")]


@pytest.mark.parametrize("lang", ["en", None])
def test_null_ids_copies_and_clashing_names(spark, tmp_path, lang):
    before = set(stages(spark))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, TEXT, lang, "a", 1, "x", 5), (2, TEXT.replace(" ", "  "), lang, "a", 1, "x", 5), (None, TEXT + " no id", lang, None, 1, None, None), (3, None, lang, "a", 1, "x", 5), (4, "", lang, "a", 1, "x", 5), (5, "12 34 !!", lang, "b", 1, "x", 5), (6, f"He said {item} and went home to his house by the river.", lang, "b", 1, "x", 5)]
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, rows, [(1, item), (2, None)]))
    assert set(out.columns) == {c.split()[0] for c in SCHEMA.split(", ")} | {"mix_copies", "mix_size", "mix_target"}
    got = out.select("doc_id", "text").collect()
    assert {r.doc_id for r in got} <= ({1, None} if lang else set()) and (not lang or 1 in {r.doc_id for r in got})
    assert len(set(stages(spark)) - before) <= 1
    assert lang is None or out.where(F.col("doc_id") == 1).first().mix_size == len(TEXT.split())


def test_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, [], []))
    assert out.count() == 0 and "mix_target" in out.columns


def test_language_stage_sends_texts_in_small_batches_and_stores_what_stays(spark, monkeypatch):
    import corpus_pipeline
    from pairwright.llm import common

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    reject = corpus_pipeline.langid.reject
    monkeypatch.setattr(corpus_pipeline.langid, "reject", lambda *a: (seen.append(int(spark.conf.get(name))), reject(*a))[1])
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "hello there my friend", "en"), (2, "12 34", "en"), (3, None, None)], "doc_id bigint, text string, lang string")
    out = corpus_pipeline.language(spark, docs, "")
    assert [r.doc_id for r in out.collect()] == [1] and out.columns == docs.columns and out.inputFiles()
    assert seen == [common.BATCH_ROWS] and spark.conf.get(name) == before
