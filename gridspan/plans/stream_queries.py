"""Queries that run as Structured Streaming over ``events``, to the end of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspan.plans.catalogue import query, rounded
from gridspan.streaming import drain, slabs, windows


def _events(spark, sf_dir):
    return drain.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


_CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR"


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR {_CLOSED} GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """Hours of each type, as they close behind a watermark of two hours."""
    held = windows.tumbling(windows.late_safe(_events(spark, sf_dir), "ts", "2 hours"), "ts", ["event_type"], "value", "1 hour")
    return rounded(drain.drained(held, "tumbling").withColumn("start", F.col("start").cast("timestamp_ntz")), 3)


@query(f"WITH s AS (SELECT event_type, value, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * unnest(range(3)) AS start FROM events) SELECT event_type, start, count(*) AS n, round(sum(value), 3) AS total FROM s WHERE start + INTERVAL 30 MINUTE {_CLOSED} GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    held = windows.sliding(windows.late_safe(_events(spark, sf_dir), "ts", "2 hours"), "ts", ["event_type"], "value", "30 minutes", "10 minutes")
    return rounded(drain.drained(held, "sliding").withColumn("start", F.col("start").cast("timestamp_ntz")), 3)


@query("SELECT event_type, count(*) AS n, round(avg(abs(value - 50)), 4) AS mae, round(avg((value - 50) * (value - 50)), 4) AS mse FROM events GROUP BY event_type")
def stream_metrics(spark, sf_dir):
    """Running errors of a stream, their last state."""
    held = slabs.streamed_metrics(_events(spark, sf_dir).withColumn("target", F.lit(50.0)), ["event_type"], "value", "target")
    return rounded(drain.final(held, "metrics"))


@query("SELECT event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r = 1")
def stream_newest(spark, sf_dir):
    """The newest event of each type; state is one row a type."""
    held = windows.newest(_events(spark, sf_dir), ["event_type"], "ts", ["value"])
    return drain.final(held, "newest").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
