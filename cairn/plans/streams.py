"""Streaming queries; each gives the rows of its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import ORACLES, query
from cairn.streaming import jobs

Spark = SparkSession


def _events(spark: Spark, sf_dir: str) -> DataFrame:
    e = jobs.stream(spark, f"{sf_dir}/events.parquet")
    return e.select("event_id", F.col("user_id").alias("peer"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.round(F.col("value") * 100).cast("long").alias("latency"), "event_type", "props")


@query(ORACLES["webhook_filter"])
def stream_webhook_filter(spark: Spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    found = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup")).select("event_id", "peer", k.alias("k")).where("k >= 10")
    return spark.read.schema("event_id long, peer long, k long").parquet(jobs.run(found, "webhook"))


@query(ORACLES["rate_series"])
def stream_rate_series(spark: Spark, sf_dir: str) -> DataFrame:
    """Hourly counts with a watermark, every update kept and the last one read."""
    w = _events(spark, sf_dir).withWatermark("ts", "365 days").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("latency").alias("bytes"))
    rows = w.select(F.expr("unix_seconds(window.start) div 3600").alias("hour"), "event_type", "n", "bytes")
    return jobs.upserted(rows, "rates", "update", ["hour", "event_type"], "n")


@query(ORACLES["peer_ema"])
def stream_peer_ema(spark: Spark, sf_dir: str) -> DataFrame:
    return jobs.upserted(jobs.moving_average(_events(spark, sf_dir)), "ema", "update", ["peer"], "n")


@query(ORACLES["rate_limit_sliding"])
def stream_rate_limit(spark: Spark, sf_dir: str) -> DataFrame:
    found = jobs.limited(_events(spark, sf_dir), 3_600_000_000, 3)
    return spark.read.schema("event_id long, peer long, allowed boolean").parquet(jobs.run(found, "limit"))


@query(ORACLES["kv_latest"])
def stream_kv_latest(spark: Spark, sf_dir: str) -> DataFrame:
    """Upserts by batch; the last version per key is what is read."""
    rows = jobs.stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return jobs.upserted(rows, "latest", "append", ["key"], "us").select("key", "event_id", "value")
