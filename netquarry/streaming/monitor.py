"""Structured Streaming side of the index: fan-out per window and live sessions.

These go beyond the batch operators: a stream cannot hold exact distinct sets, so
destinations are counted by sketch, and late flows are bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions.columns import epoch_us, source_id


def _timed(flows: DataFrame, lateness: str) -> DataFrame:
    """Flows with source and start as an event time, repeats of an id within the watermark dropped."""
    t = flows.select(F.col("_flow_id").alias("flow_id"), source_id(F.col("src_ip")).alias("src_ip"), source_id(F.col("dst_ip")).alias("dst_ip"), F.timestamp_micros(epoch_us(F.col("ts_start"))).alias("at"))
    return t.where("src_ip is not null and at is not null").withWatermark("at", lateness).dropDuplicatesWithinWatermark(["flow_id"])


def fanout(flows: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes", error: float = 0.05) -> DataFrame:
    """Per source and epoch-aligned window: flow_count and approximate distinct_destinations. Works on streams and on batches."""
    w = _timed(flows, lateness).groupBy(F.window("at", window), "src_ip")
    return w.agg(F.count(F.lit(1)).alias("flow_count"), F.approx_count_distinct("dst_ip", error).alias("distinct_destinations")).select(F.col("window.start").alias("window_start"), "src_ip", "flow_count", "distinct_destinations")


def live_sessions(flows: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions by start times alone (a stream's session window knows no flow durations)."""
    s = _timed(flows, lateness).groupBy(F.session_window("at", gap), "src_ip").agg(F.count(F.lit(1)).alias("flow_count"))
    return s.select("src_ip", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "flow_count")


def to_jsonl(df: DataFrame, path: str, checkpoint: str):
    """Appends finished rows as JSON lines, once each. One run over what has arrived."""
    return df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
