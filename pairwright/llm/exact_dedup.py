"""Exact dedup by a stateful stream.

Digest rows (digest, identifier, content locator) run through Structured Streaming. The
stream keeps, in a RocksDB state store on disk and without expiry, for every digest the
smallest identifier, that row's content locator and the number of rows. Hits are checked
on full bytes afterwards, so a collision of digests can't drop a text.

Defined results: a null text is the empty text, and empty texts equal one another; a null
identifier counts as larger than any other; rows with the same text and the same
identifier are told apart by the content locator (file and row as one number), of which the
smallest stays. No rows give no rows; texts are compared whole, however long. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, kept, likely, numbered, scratch, stored, text_of, without

#: A digest with more than one HOT-th of all rows is handled apart.
HOT = 256
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised():
    return F.regexp_replace(text_of(), SPACE_RUN, " ")


def run_state(spark: SparkSession, source: str, schema, files_per_batch: int, partitions: int | None) -> DataFrame:
    """Drain the digest rows under source through the keyed state; one row for each digest."""
    out, check = scratch(spark, "dedup-state"), scratch(spark, "dedup-stream")
    # RocksDB would reserve 4 MB of disk for each state partition's manifest, however little it holds
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    held = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        state = stream.groupBy("digest").agg(F.min("who").alias("keeper"), F.count(F.lit(1)).alias("n"))

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        state.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = spark.read.schema("digest string, keeper struct<absent:boolean,doc_id:bigint,loc:bigint>, n bigint, batch int").option("basePath", out)
    try:
        found = found.parquet(f"{out}/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "digest string, keeper struct<absent:boolean,doc_id:bigint,loc:bigint>, n bigint")
    # Counts rise and keepers fall, so the last state of a digest is its largest count.
    return found.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("n").alias("n"))


def classes(docs: DataFrame, files_per_batch: int = 4096, state_partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and loc (the locator)."""
    spark = docs.sparkSession
    docs = numbered(docs, "doc_id", "text", name="_loc")
    rows = kept(
        docs.select(
            F.sha2(normalised().cast("binary"), 256).alias("digest"),
            F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("_loc").alias("loc")).alias("who"),
        ),
        "dedup-digests",
    )
    path = rows.inputFiles()[0].rpartition("/")[0] if rows.inputFiles() else None
    if path is None:
        state = spark.createDataFrame([], "digest string, keeper struct<absent:boolean,doc_id:bigint,loc:bigint>, n bigint")
    else:
        state = run_state(spark, path, rows.schema, files_per_batch, state_partitions)
    hits = kept(state.where("n > 1"), "dedup-hits")
    # a digest with a 256th of all rows is hot; there are 256 of them at most, so they can be broadcast
    large = max(2, rows.count() // HOT)
    hot, cold = F.broadcast(hits.where(F.col("n") >= large)), hits.where(F.col("n") < large)
    bad = false_hits(docs, hits)
    base = rows.join(hot, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(cold, "digest", "left"), allowMissingColumns=True).select(
        F.col("who.doc_id").alias("doc_id"),
        F.coalesce("keeper", "who").alias("keeper"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("digest").alias("text_sha256"),
        F.col("who").alias("_who"),
    )
    if bad is not None:
        base = split_collisions(base, bad)
    return base.select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        "group_size",
        (F.col("keeper") == F.col("_who")).alias("kept"),
        "text_sha256",
        F.col("_who.loc").alias("loc"),
    )


def false_hits(docs: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Compare full bytes of all rows that share a digest; returns the rows of digests with unlike texts, if any.

    A Bloom filter of the hit digests, of SLOTS rows at most, is broadcast, so only texts that were hit (and the few
    that it takes for such) move. Within a digest the smallest and the largest text are kept, by a partial
    aggregation first: of a hot digest each task sends one row.
    """
    texts = docs.select(F.sha2(normalised().cast("binary"), 256).alias("digest"), normalised().alias("body"), "_loc")
    hash_ = F.xxhash64("digest")
    seen = likely(texts, hash_, hits, hash_).groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    wrong = kept(seen.where("low <> high").select("digest"), "dedup-collisions")
    if wrong.isEmpty():
        return None
    return texts.join(wrong, "digest", "left_semi").select(F.col("_loc").alias("loc"), "body", "digest")


def split_collisions(base: DataFrame, bad: DataFrame) -> DataFrame:
    """Regroup the rows of collided digests by their full texts."""
    own = base.join(bad.drop("digest"), base["_who.loc"] == bad["loc"], "left").drop("loc")
    w = Window.partitionBy("text_sha256", "body")
    hit = F.col("body").isNotNull()
    return own.select(
        "doc_id",
        F.when(hit, F.min("_who").over(w)).otherwise(F.col("keeper")).alias("keeper"),
        F.when(hit, F.count(F.lit(1)).over(w)).otherwise(F.col("group_size")).alias("group_size"),
        "text_sha256",
        "_who",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row's text makes superfluous; the columns stay as they are."""
    docs = stored(docs)
    return without(docs, classes(docs).where(~F.col("kept")).select(F.col("loc").alias("rid")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("loc")


#: DuckDB: the sha256 of a text is that of its UTF-8 bytes.
OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM n
"""
