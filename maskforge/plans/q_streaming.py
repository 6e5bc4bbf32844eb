"""Streaming queries (X1-X3): the final sink of each stream, read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskforge.plans.registry import register
from maskforge.streaming import ingest


@register("x1_resumable_ingest", """
SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY 1""")
def x1_resumable_ingest(spark, sf_dir):
    """A stream run twice over one checkpoint holds every event once."""
    return ingest.ingest_twice(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("distinct_events"))


@register("x2_stream_event_stats", """
SELECT event_type, count(*) AS events, round(sum(value), 6) AS value_sum FROM events GROUP BY 1""")
def x2_stream_event_stats(spark, sf_dir):
    """File-stream ingestion with a running aggregate."""
    return ingest.event_stats(spark, sf_dir)


@register("x3_stream_first_seen", """
SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY user_id""")
def x3_stream_first_seen(spark, sf_dir):
    """The first event of every user as events arrive."""
    return ingest.first_seen(spark, sf_dir).select("user_id", "first_event")
