"""Rounds of double review by state and timers."""

from pairwright.streaming import review


def test_rounds_time_out_complete_and_go(spark, tmp_path):
    log = str(tmp_path / "log")
    batches = [
        [("a", "x", "2024-01-01 00:00:00"), ("b", "x", "2024-01-01 00:00:00"), (None, "x", "2024-01-01 00:00:00"), ("c", None, "2024-01-01 00:00:00")],
        [("a", "x", "2024-01-01 00:20:00"), ("a", "y", "2024-01-01 00:30:00"), ("d", "x", "2024-01-01 00:10:00")],
        [("a", "z", "2024-01-01 00:50:00"), ("e", "x", "2024-01-01 03:00:00")],  # the watermark passes the rounds of b and d
        [("f", "x", "2024-01-01 03:05:00")],
        [("b", "y", "2024-01-01 00:40:00")],  # later than the delay: dropped
        [("d", "y", "2024-01-01 03:10:00"), ("d", "z", "2024-01-01 03:20:00"), ("e", "x", "2024-01-01 05:30:00")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "packet string, reviewer string, t string").selectExpr("packet", "reviewer", "timestamp(t) AS ts").coalesce(1).write.mode("append").parquet(log)
    got = review.double_reviews(review.log_stream(spark, log), "packet", "reviewer", "ts", 2, 3600, "10 minutes").collect()
    assert sorted((r.packet, str(r.opened)[11:16], r.n, r.status, str(r.closed)[11:16]) for r in got) == [
        ("a", "00:00", 2, "complete", "00:30"), ("b", "00:00", 1, "timed_out", "01:00"), ("d", "00:10", 1, "timed_out", "01:10"), ("d", "03:10", 2, "complete", "03:20"), ("e", "03:00", 1, "timed_out", "04:00"),
        ("f", "03:05", 1, "timed_out", "04:05"),
    ]
