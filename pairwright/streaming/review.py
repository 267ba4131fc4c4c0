"""The review log as a stream: compaction, duplicates, completeness, pacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drain(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run what is there now and return the last state of each key's rows, written as Parquet."""
    import uuid

    spark = df.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{out}/b=*")


def latest_by_key(stream: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Latest response for each key: running maxima in state; of several updates of a key the largest counts."""
    best = stream.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("s"))
    return _drain(best, "update", "latest").groupBy(*keys).agg(F.max("s").alias("s")).select(*keys, F.col(f"s.{value}").alias(value))


def without_repeats(stream: DataFrame, key: str, time: str, delay: str = "60 days") -> DataFrame:
    """Each response id once, remembered for the watermark's delay."""
    return _drain(stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]), "append", "once").drop("_batch")


def completeness(stream: DataFrame, packet: str, reviewer: str, wanted: int) -> DataFrame:
    """Packets by the number of different reviewers who have answered so far."""
    n = stream.groupBy(packet).agg(F.size(F.collect_set(reviewer)).cast("bigint").alias("n"))
    got = _drain(n, "update", "complete").groupBy(packet).agg(F.max("n").alias("n"))
    return got.withColumn("complete", F.col("n") >= wanted)


def sessions(stream: DataFrame, reviewer: str, time: str, gap: str) -> DataFrame:
    """Working sessions of each reviewer: start, end, responses. No watermark, so that late responses count and the sessions open at the end of the log are in."""
    s = stream.groupBy(F.session_window(time, gap).alias("w"), reviewer).agg(F.count(F.lit(1)).alias("responses"))
    got = _drain(s, "complete", "sessions")  # every batch holds all sessions so far
    last = got.agg(F.max("_batch")).first()[0]
    return got.where(F.col("_batch") == F.lit(last)).select(reviewer, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "responses")


def double_reviews(stream: DataFrame, packet: str, reviewer: str, time: str, wanted: int, timeout_s: int, delay: str) -> DataFrame:
    """Rounds of review of each packet: packet, opened, n (different reviewers), status, closed.

    The first response opens a round. It is complete with the response of the `wanted`-th reviewer; what else arrives until
    opened + timeout belongs to it and changes nothing. A round that isn't complete by then is timed_out, closed at opened +
    timeout, with the reviewers it has. A later response opens the next round. State holds one round of a packet: when its time
    is over, by a response or by the watermark's timer, it goes. Rows without time, packet or reviewer are in no round; rows
    that are later than the watermark of the batch before are dropped by the stream; rounds whose time isn't over at the end are not given
    unless complete. Within a batch rows are taken by time.
    """
    from pyspark.sql.streaming import StatefulProcessor

    limit = timeout_s * 1_000_000

    class Rounds(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.round = handle.getValueState("round", "opened bigint, n bigint, complete boolean, reviewers array<string>")

        def row(self, key, opened, n, status, closed):
            return Row(**{packet: key[0], "opened": opened, "n": n, "status": status, "closed": closed})

        def over(self, key, opened, n):
            return self.row(key, opened, n, "timed_out", opened + limit)

        def handleInputRows(self, key, rows, timerValues):
            now = self.round.get() if self.round.exists() else None
            for row in sorted(rows, key=lambda r: (r.at, r.who)):
                if now is not None and row.at > now[0] + limit:
                    if not now[2]:
                        yield self.over(key, now[0], now[1])
                    now = None
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                if now is None:
                    now = (row.at, 0, False, [])
                    self.handle.registerTimer((row.at + limit) // 1000 + 1)
                if not now[2] and row.who not in now[3]:
                    now = (now[0], now[1] + 1, now[1] + 1 >= wanted, [*now[3], row.who])
                    if now[2]:
                        yield self.row(key, now[0], now[1], "complete", row.at)
            if now is not None:
                self.round.update(now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.round.exists():
                now = self.round.get()
                self.round.clear()
                if not now[2]:
                    yield self.over(key, now[0], now[1])

        def close(self):
            pass

    spark = stream.sparkSession
    rows = stream.where(F.col(packet).isNotNull() & F.col(reviewer).isNotNull() & F.col(time).isNotNull()).withWatermark(time, delay)
    rows = rows.select(packet, time, F.unix_micros(time).alias("at"), F.col(reviewer).cast("string").alias("who"))
    kind = dict(rows.dtypes)[packet]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        closing = rows.groupBy(packet).transformWithState(Rounds(), f"`{packet}` {kind}, opened bigint, n bigint, status string, closed bigint", "Append", "EventTime")
        got = _drain(closing, "append", "rounds")
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return got.select(packet, F.timestamp_micros("opened").alias("opened"), "n", "status", F.timestamp_micros("closed").alias("closed"))
