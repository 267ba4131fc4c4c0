"""Benchmark decontamination by a hash set of normalised n-grams.

The benchmark's windows (10 consecutive words; an item of fewer words is one window) become
a table of 64-bit hashes, broadcast when its size, which is checked, is within
MAX_BROADCAST_WINDOWS; beyond it a Bloom filter of fixed size is broadcast and what passes it
meets the table in a shuffled join. Every window of a training text looks its hash up, as a
narrow row (number of the text, place, length, hash) that never holds the text. A hit is
verified word by word: only texts with a hit are taken up again.

Defined results: null and word-free texts have no words, no hits and stay; a null item has
no windows; equal windows of several items count for each of them; repeated rows and equal
ids are separate documents; no benchmark rows, or none with words, leave all documents
clean; no documents give no rows; texts are looked at whole, however long. Other columns, of
whatever names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, kept, likely, numbered, stored, text_of, without

#: Fixed value: a word is a run of these; ASCII other than digits and letters separates words.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Hash-set rows that are broadcast at most (16 bytes each); beyond it what passes a Bloom filter meets them in a shuffled join.
MAX_BROADCAST_WINDOWS = 200_000


def words_of(name: str = "text") -> Column:
    return F.regexp_extract_all(F.translate(text_of(name), UPPER, LOWER), F.lit(TOKEN), F.lit(0))


def windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(h, len, words, items): each distinct window with the ids of the items that hold it."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of().alias("w")).where(F.size("w") > 0)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(width)))
    w = b.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return w.groupBy("len", "words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64(F.transform("words", lambda x: F.xxhash64(x))).alias("h"), "len", "words", "items")


def _look(k: int):
    return lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.xxhash64(F.slice("hashes", i + 1, k)).alias("h"))


def looks(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """rid, n_words, pos, len, h: the windows of every text, and one row of length 0 for each text."""
    found = numbered(docs, F.transform(words_of(), lambda x: F.xxhash64(x)).alias("hashes"))
    n = F.size("hashes")
    own = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("h")))
    for k in sorted(lengths):
        own = F.concat(own, F.transform(F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>")), _look(k)))
    # the array of hashes stays behind: inline_outer() gives narrow rows, and lets no filter on the array be inferred, which would make it twice
    return found.select("rid", n.cast("bigint").alias("n_words"), own.alias("look")).select("rid", "n_words", F.inline_outer("look"))


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rid, n_words) of all documents, and (rid, spans) of those with hits; a span is (pos, len, items). docs comes straight from files."""
    w = kept(windows(benchmark, width), "windows")
    count, lengths = w.agg(F.count(F.lit(1)), F.collect_set("len")).first()  # at most `width` lengths
    keys = w.select("h", "len").distinct()
    rows = looks(docs, lengths)
    mark = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("len"))
    known = keys.unionByName(mark)
    if count <= MAX_BROADCAST_WINDOWS:
        met = kept(rows.join(F.broadcast(known), ["h", "len"]), "window-hits")
    else:
        met = kept(likely(rows, F.xxhash64("h", "len"), known, F.xxhash64("h", "len")), "window-hits")
    sizes, met = met.where("len = 0").select("rid", "n_words"), met.where("len > 0").select("rid", "pos", "len", "h")
    texts = likely(numbered(docs, "text"), F.xxhash64("rid"), met, F.xxhash64("rid")).select("rid", words_of().alias("own"))
    # a text with its hits at hand gives each hit's words; then narrow rows meet the windows
    said = met.groupBy("rid").agg(F.collect_list(F.struct("pos", "len", "h")).alias("at")).join(texts, "rid")
    cut = lambda x: F.struct(x["pos"], x["len"], x["h"], F.slice("own", x["pos"] + 1, x["len"]).alias("words"))
    said = said.select("rid", F.inline_outer(F.transform("at", cut)))
    sure = said.join(F.broadcast(w) if count <= MAX_BROADCAST_WINDOWS else w, ["h", "len", "words"])
    return sizes, kept(sure.groupBy("rid").agg(F.collect_list(F.struct("pos", "len", "items")).alias("spans")), "window-spans")


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) of every document."""
    docs = stored(docs)
    sizes, found = hits(docs, benchmark, width)
    none = F.array().cast("array<struct<pos:int,len:int,items:array<string>>>")
    own = numbered(docs, "doc_id").join(sizes, "rid").join(found, "rid", "left").withColumn("spans", F.coalesce("spans", none))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))))
    return own.select("doc_id", "n_words", covered.cast("bigint").alias("n_hit"), items.alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; the columns stay as they are."""
    docs = stored(docs)
    return without(docs, hits(docs, benchmark, width)[1].select("rid"))


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id and the words of each text that no benchmark window covers, joined by single spaces."""
    docs = stored(docs)
    found = hits(docs, benchmark, width)[1]
    own = numbered(docs, "doc_id", words_of().alias("own")).join(found, "rid", "left")
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("own") - 1), inside)
    words = F.when(F.col("spans").isNull(), F.col("own")).otherwise(F.transform(left, lambda i: F.get("own", i)))
    return own.select("doc_id", F.array_join(words, " ").alias("text"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return r.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
look AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, i, k, item_id FROM look JOIN win USING (g, k)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
