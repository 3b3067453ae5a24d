"""Structured Streaming: windows, late frames, deduplication, latest values and ordered release, each the same as its batch form.

A streaming query reads its source to the end that it finds (trigger availableNow), writes Parquet beside its checkpoint in the shared
folder, and starts again from that checkpoint if it is stopped.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.catalog import query, table


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """Events as they are found, with t a TIMESTAMP (watermarks refuse the zoneless type)."""
    schema = table(spark, sf_dir, "events").schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parq*")
    return s.withColumn("t", F.col("ts").cast("timestamp")).drop("ts")


def run(stream: DataFrame, name: str) -> DataFrame:
    """All that the query gives until its source is exhausted."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def late_split(stream: DataFrame, arrival: Column, max_lateness: str) -> tuple[DataFrame, DataFrame]:
    """Frames in time, and late ones: judged against their own arrival before any watermark drops them silently."""
    late = arrival > F.col("t") + F.expr(f"INTERVAL {max_lateness}")
    return stream.where(~late), stream.where(late)


@query("s_late_split", "SELECT event_type, count(*) AS n FROM events WHERE event_id * 37 % 60 <= 20 GROUP BY event_type")
def s_late_split(spark, sf_dir):
    arrival = F.timestamp_seconds(F.unix_seconds("t") + F.col("event_id") * 37 % 60)
    good, _ = late_split(event_stream(spark, sf_dir).withColumn("t", F.date_trunc("second", "t")), arrival, "20 SECONDS")
    return run(good.select("event_id", "event_type"), "late").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS w, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def s_tumbling(spark, sf_dir):
    """Hours that the watermark has closed; the rest stays in state, for frames to come."""
    w = event_stream(spark, sf_dir).withWatermark("t", "10 minutes").groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return run(w, "tumbling").select(F.unix_seconds("w.start").alias("w"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def s_dedup(spark, sf_dir):
    return run(event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(), "dedup")


class Latest:
    """The greatest (time, id) of each user so far, in state; given out when it changes."""

    schema = "user_id long, event_id long, us long"

    @staticmethod
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = tuple(state.get) if state.exists else (-1, -1)
        for b in batches:
            if len(b):
                top = b.sort_values(["us", "event_id"]).iloc[-1]
                best = max(best, (int(top["us"]), int(top["event_id"])))
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "us": [best[0]]})


@query("s_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def s_latest(spark, sf_dir):
    """Custom state: applyInPandasWithState keeps two numbers a user."""
    s = event_stream(spark, sf_dir).select("user_id", "event_id", F.unix_micros("t").alias("us"))
    out = s.groupBy("user_id").applyInPandasWithState(Latest.update, Latest.schema, "us long, event_id long", "append", "NoTimeout")
    return run(out, "latest").groupBy("user_id").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))


@query("s_interval_join", "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def s_interval_join(spark, sf_dir):
    """Two streams: purchases within an hour of the user's click. Watermarks and the bound on times let state of both sides go."""
    side = lambda kind, n: event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("event_id").alias(n), F.col("user_id").alias(f"{n}_user"), F.col("t").alias(f"{n}_t")).withWatermark(f"{n}_t", "10 minutes")
    on = F.expr("click_user = purchase_user AND purchase_t >= click_t AND purchase_t <= click_t + INTERVAL 1 HOUR")
    return run(side("click", "click").join(side("purchase", "purchase"), on).select("click", "purchase"), "join")
