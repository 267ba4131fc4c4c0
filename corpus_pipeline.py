"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Defined results: null, empty and letter-free texts go in the first stage, and so does all if no row has a language to
learn from; repeated rows are one from the second stage on, also where their ids are null; an empty table, or one of
which nothing is left, gives no rows; without benchmark rows the fourth stage keeps all. Texts are looked at whole,
however long. Further columns stay as they are, whatever their names; the last stage adds mix_copies, mix_size and
mix_target, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontaminate, exact_dedup, jaccard_join, langid, mixing
from pairwright.llm.common import kept, remove, small_batches, stored_alone


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or without a language that has half of the letters, go."""
    with small_batches(spark):
        return kept(langid.reject(docs, langid.fit(docs.where(F.col("lang").isNotNull()).select("text", "lang"))), "language")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with mix_copies, mix_size and mix_target."""
    return mixing.mixed(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mix", mix)]

#: A trained language model and hashed random numbers decide, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave of documents. A stage's table, and those written on its way, are deleted when the next one's result is stored."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if written:
            remove(spark, written)
        written = next((f.rpartition("/")[0] for f in docs.inputFiles()), None)
    return docs
