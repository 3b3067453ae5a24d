"""Test sources and frames from an application."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.schema import FRAME

# The colours of SMPTE bars, left to right, as RGB.
BARS = [(192, 192, 192), (192, 192, 0), (0, 192, 192), (0, 192, 0), (192, 0, 192), (192, 0, 0), (0, 0, 192)]
SECOND_NS = 1_000_000_000


def appsrc(spark: SparkSession, rows: list) -> DataFrame:
    """Frames that the application hands over."""
    return spark.createDataFrame(rows, FRAME)


def videotestsrc(spark: SparkSession, num_buffers: int, width: int = 320, height: int = 240, rate: tuple[int, int] = (30, 1), pattern: str = "smpte") -> DataFrame:
    """sequence, pts_ns, duration_ns, keyframe, width, height and pattern. Pixels are drawn on demand, by pixels()."""
    n, d = rate
    at = lambda i: F.expr(f"({i} * {SECOND_NS} * {d}) div {n}")
    f = spark.range(num_buffers).withColumnRenamed("id", "sequence")
    return f.select("sequence", at("sequence").alias("pts_ns"), (at("(sequence + 1)") - at("sequence")).alias("duration_ns"), F.lit(True).alias("keyframe"), F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(pattern).alias("pattern"))


def pixels(frames: DataFrame) -> DataFrame:
    """sequence, x, y, r, g, b: bars (smpte), a level that falls and rises (gradient), or one colour (solid)."""
    grid = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    bar = (F.floor(F.col("x") * len(BARS) / F.col("width")) + 1).cast("int")
    bars = [F.element_at(F.array(*(F.lit(c[i]) for c in BARS)), bar) for i in range(3)]
    level = ((F.col("x") + F.col("y") + F.col("sequence") * 4) % 256).cast("int")
    value = lambda i: F.when(F.col("pattern") == "smpte", bars[i]).when(F.col("pattern") == "gradient", level).otherwise(F.lit(16))
    return grid.select("sequence", "x", "y", *(value(i).alias(c) for i, c in enumerate("rgb")))


def audiotestsrc(spark: SparkSession, samples: int, freq: float = 440.0, rate: int = 48_000, wave: str = "sine", volume: float = 0.8) -> DataFrame:
    """n, pts_ns, s: 16-bit samples of a tone."""
    phase = F.col("id") * (freq / rate)
    turn: dict[str, Column] = {
        "sine": F.sin(phase * (2 * math.pi)),
        "square": F.when(phase - F.floor(phase) < 0.5, 1.0).otherwise(-1.0),
        "saw": 2 * (phase - F.floor(phase)) - 1,
        "triangle": 1 - 4 * F.abs(phase - F.floor(phase) - 0.5),
        "silence": F.lit(0.0),
    }
    return spark.range(samples).select(F.col("id").alias("n"), F.expr(f"(id * {SECOND_NS}) div {rate}").alias("pts_ns"), F.round(turn[wave] * (volume * 32767)).cast("int").alias("s"))


@query("a_videotestsrc", "WITH f AS (SELECT unnest(generate_series(0, 99)) AS sequence) SELECT sequence, (sequence * 1000000000 * 1001) // 30000 AS pts_ns, ((sequence + 1) * 1000000000 * 1001) // 30000 - (sequence * 1000000000 * 1001) // 30000 AS duration_ns FROM f")
def a_videotestsrc(spark, sf_dir):
    return videotestsrc(spark, 100, rate=(30_000, 1001)).select("sequence", "pts_ns", "duration_ns")


@query("a_patternsrc", "WITH f AS (SELECT unnest(generate_series(0, 4)) AS sequence), y AS (SELECT sequence, unnest(generate_series(0, 23)) AS y FROM f), g AS (SELECT *, unnest(generate_series(0, 31)) AS x FROM y) SELECT sequence, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST((x + y + sequence * 4) % 256 AS INTEGER) AS r FROM g")
def a_patternsrc(spark, sf_dir):
    return pixels(videotestsrc(spark, 5, 32, 24, pattern="gradient")).select("sequence", "x", "y", "r")


@query("a_audiotestsrc", "SELECT n, (n * 1000000000) // 48000 AS pts_ns, CAST(CASE WHEN n * (440.0::DOUBLE / 48000) - floor(n * (440.0::DOUBLE / 48000)) < 0.5 THEN 26214 ELSE -26214 END AS INTEGER) AS s FROM (SELECT unnest(generate_series(0, 4799)) AS n)")
def a_audiotestsrc(spark, sf_dir):
    return audiotestsrc(spark, 4800, wave="square")
