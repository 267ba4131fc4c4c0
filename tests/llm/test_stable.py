"""Results don't depend on how rows are dealt out, nor on what workers can import."""

import subprocess
import sys

import pytest

from pairwright.llm import common, decontaminate, exact_dedup, jaccard_join, lm_score, mixing, suffix_dedup, winnow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twelve(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("twelve") / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def unsteady(spark, monkeypatch):
    """After each stored table the number of splits changes, as it may when executors are lost."""
    number = iter(range(1, 10_000))
    real = common.kept

    def changing(df, name):
        out = real(df, name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 5 * (next(number) % 3)))
        return out

    for module in (common, decontaminate, exact_dedup, jaccard_join, lm_score, mixing, suffix_dedup, winnow):
        monkeypatch.setattr(module, "kept", changing)
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


RUNS = {
    "op1": lambda d: exact_dedup.classes(d).drop("loc"),
    "op2": lambda d: lm_score.scores(d, d, "doc_id").selectExpr("doc_id", "n_tokens", "round(score, 6)", "round(base_score, 6)"),
    "op3": lambda d: suffix_dedup.remove_repeats(d, "doc_id"),
    "op6": lambda d: jaccard_join.near_duplicates(d).select("doc_id", "n", "component_id"),
    "op6 pipeline": lambda d: jaccard_join.one_of_each(d).select("doc_id"),
    "op7 pipeline": lambda d: mixing.mixed(d).select("doc_id", "mix_size", "mix_copies"),
    "op13": lambda d: winnow.with_next(d).select("doc_id", "next_text", "fp"),
    "op9 pipeline": lambda d: decontaminate.clean(d, d.sparkSession.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id"),
}


@pytest.mark.parametrize("name", RUNS)
def test_other_splits_give_the_same_rows(twelve, name, request):
    want = sorted(map(str, RUNS[name](twelve).collect()))
    request.getfixturevalue("unsteady")
    assert sorted(map(str, RUNS[name](twelve).collect())) == want


def test_numbers_are_those_of_file_and_row(spark, twelve):
    own = {r.doc_id: r.rid for r in common.numbered(twelve, "doc_id").collect()}
    assert len(set(own.values())) == twelve.count()
    assert {r.doc_id: r.rid for r in common.numbered(twelve.where("doc_id > 50").repartition(3), "doc_id").collect()}.keys() == {d for d in own if d > 50}
    assert all(own[r.doc_id] == r.rid for r in common.numbered(twelve.where("doc_id > 50").select("doc_id"), "doc_id").collect())
    twice = twelve.selectExpr("doc_id", "explode(array(1, 2)) as k")
    assert len({r.rid for r in common.numbered(twice, "doc_id").collect()}) == 2 * len(own)


def test_workers_need_no_copy_of_the_repository(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(sys.path[0])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
def importable(batches):
    try:
        import pairwright
        yield from [b.slice(0, 1) for b in batches]
    except ImportError:
        pass
assert spark.range(1).mapInArrow(importable, "id long").count() == 0, "workers can import it"
from pairwright.llm.queries import QUERIES
for name in ("op2_lm_score", "op3_suffix_dedup", "op4_chat_format", "op5_langid", "op6_jaccard_join", "op8_toxicity", "op10_quality", "op11_repair"):
    assert QUERIES[name](spark, {SF!r}).count() > 0
"""
    (tmp_path / "run.py").write_text(code)
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]


def test_results_replace_columns_of_their_names(spark, twelve):
    from pairwright.llm import langid, toxicity

    once = common.kept(mixing.mixed(twelve), "once")
    again = mixing.mixed(once)
    assert again.columns == once.columns and again.count() > 0
    odd = common.kept(twelve.selectExpr("doc_id", "text", "lang", "source", "'x' as score", "'y' as lang_pred", "1 as n_bytes", "2 as rid", "3 as n_tokens"), "odd")
    assert langid.predict(odd, langid.fit(odd), "doc_id", "score", "lang_pred").columns == ["doc_id", "lang_pred", "score"]
    assert toxicity.score(odd, toxicity.fit(odd, odd.selectExpr("doc_id", "doc_id % 2 as toxic")), "doc_id", "score").columns == ["doc_id", "score"]
    assert suffix_dedup.remove_repeats(odd, "doc_id", "n_bytes").where("n_bytes > 1").count() > 0
    assert lm_score.scores(odd, odd, "doc_id", "score", "n_tokens").columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_windows_travel_without_their_text(spark, make, monkeypatch):
    """Beyond the bound of the broadcast too, no exchanged row of the lookup holds the words of a text."""
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = make([(1, long, "en", "a"), (2, "one two three", "en", "a")])
    plan = decontaminate.looks(docs, [3, 10])
    assert plan.columns == ["rid", "n_words", "pos", "len", "h"]
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500, 515))), (2, "two three")], "item_id bigint, text string")
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.report(docs, bench).collect()} == {(1, 20_000, 15, ("1",)), (2, 3, 2, ("2",))}
