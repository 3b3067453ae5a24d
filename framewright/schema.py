"""The frame: one timestamped row of a stream. Times are nanoseconds as LONG; a frame without a time has a null pts_ns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.catalog import table

FRAME = (
    "stream string, input int, sequence long, pts_ns long, dts_ns long, duration_ns long, capture_ns long, arrival_ns long, "
    "keyframe boolean, caps_epoch int, flush_epoch int, caps struct<kind:string,format:string,width:int,height:int,rate_q16:bigint,"
    "interlace:string,channels:int,sample_rate:int,dtype:string,shape:array<int>,layout:string>, payload binary, values array<double>, "
    "tags map<string,string>"
)
STREAMS = ["click", "error", "purchase", "signup", "view"]
#: 2024-01-01, from which relative times count.
EPOCH_NS = 1_704_067_200_000_000_000
DAY_NS, HOUR_NS, MINUTE_NS, MS_NS = 86_400_000_000_000, 3_600_000_000_000, 60_000_000_000, 1_000_000

FRAMES_SQL = f"""frames AS (SELECT event_type AS stream, CAST(list_position({STREAMS}, event_type) - 1 AS INTEGER) AS input,
  event_id AS sequence, epoch_us(ts) * 1000 AS pts_ns, epoch_us(ts) * 1000 - {EPOCH_NS} AS rel_ns, user_id, value,
  event_id % 10 = 0 AS keyframe, props FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: stream, input (the stream's rank), sequence, pts_ns, rel_ns, user_id, value, keyframe, props."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_type").alias("stream"),
        (F.array_position(F.array(*map(F.lit, STREAMS)), F.col("event_type")) - 1).cast("int").alias("input"),
        F.col("event_id").alias("sequence"),
        (us * 1000).alias("pts_ns"),
        (us * 1000 - EPOCH_NS).alias("rel_ns"),
        "user_id",
        "value",
        (F.col("event_id") % 10 == 0).alias("keyframe"),
        "props",
    )
