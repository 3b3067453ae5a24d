"""Frames from and to files, and the recording of frame tables for replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import containers
from framewright.functions.parsers import subpicture_unit
from framewright.operators import text
from framewright.operators.packets import vobsub_index

CUES = {"srt": text.parse_blocks, "vtt": text.parse_blocks, "ssa": text.parse_ssa, "ass": text.parse_ssa, "ttml": text.parse_ttml, "xml": text.parse_ttml}


def filesrc(spark: SparkSession, location: str, blocksize: int = 4096) -> DataFrame:
    """path, sequence, payload: each file's bytes in blocks."""
    f = spark.read.format("binaryFile").load(location).select("path", "content")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.length("content") - 1), F.lit(blocksize).cast("long"))
    return f.select("path", F.posexplode(starts).alias("sequence", "at"), "content").select("path", F.col("sequence").cast("long").alias("sequence"), F.expr(f"substring(content, cast(at as int) + 1, {blocksize})").alias("payload"))


def multifilesrc(spark: SparkSession, folder: str, pattern: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """One frame a file, in the order of the number that the pattern's group finds in the name."""
    f = spark.read.format("binaryFile").load(folder).withColumn("sequence", F.regexp_extract("path", pattern, 1))
    f = f.where("sequence <> ''").withColumn("sequence", F.col("sequence").cast("long")).where(F.col("sequence") >= start)
    return (f if stop is None else f.where(F.col("sequence") <= stop)).select("sequence", F.col("content").alias("payload"))


def subtitlesrc(spark: SparkSession, location: str, format: str | None = None) -> DataFrame:
    """path, n, start_ns, end_ns, text of the cues in subtitle files."""
    docs = spark.read.text(location, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))
    kind = format or location.rsplit(".", 1)[-1].lower()
    if kind not in CUES:
        raise ValueError(f"no subtitle format {kind}; known: {sorted(CUES)}")
    return CUES[kind](docs, "path", F.col("doc"))


def vobsubsrc(spark: SparkSession, folder: str, language: str | None = None) -> DataFrame:
    """path (without suffix), language, track, start_ns, payload: each subtitle unit that the .idx files of a folder place in the .sub beside
    them, put together from its program stream packets; null where that file is missing or breaks off before the unit is whole."""
    stem = lambda suffix: F.regexp_replace("_metadata.file_path", rf"\.{suffix}$", "").alias("path")
    docs = spark.read.text(folder, wholetext=True, pathGlobFilter="*.idx").select(stem("idx"), F.col("value").alias("doc"))
    cues = vobsub_index(docs, "path", F.col("doc"))
    cues = cues if language is None else cues.where(F.col("language") == language)
    cues = cues.groupBy("path").agg(F.collect_list(F.struct("language", "track", "start_ns", "filepos", "bytes")).alias("cues"))  # one file's
    subs = spark.read.format("binaryFile").option("pathGlobFilter", "*.sub").load(folder).select(stem("sub"), "content")
    part = F.transform("cues", lambda c: F.struct(c["language"].alias("language"), c["track"].alias("track"), c["start_ns"].alias("start_ns"), F.substr("content", (c["filepos"] + 1).cast("int"), F.coalesce(c["bytes"].cast("int"), F.octet_length("content"))).alias("part")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["payload"] = [None if p is None else subpicture_unit(bytes(p), 0 if t is None or pd.isna(t) else int(t)) for p, t in zip(b.pop("part"), b["track"], strict=True)]
            yield b

    out = cues.join(subs, "path", "left").select("path", F.explode(part).alias("c")).select("path", "c.*")
    return out.mapInPandas(run, "path string, language string, track int, start_ns long, payload binary")


def record(df: DataFrame, location: str) -> None:
    """recordsink: the table as it is, sorted by time within files so that a range of times reads few row groups."""
    df.sortWithinPartitions("pts_ns").write.mode("errorifexists").parquet(location)


def replay(spark: SparkSession, location: str, start_ns: int | None = None, stop_ns: int | None = None) -> DataFrame:
    """replaysrc: the recording, or the times asked for (a filter that reaches the scan)."""
    df = spark.read.parquet(location)
    df = df if start_ns is None else df.where(F.col("pts_ns") >= start_ns)
    return df if stop_ns is None else df.where(F.col("pts_ns") < stop_ns)


def recordsrc(spark: SparkSession, location: str) -> DataFrame:
    """path, sequence, payload of files of length-prefixed records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                got = list(containers.read_records(bytes(data)))
                if got:
                    yield pd.DataFrame({"path": path, "sequence": range(len(got)), "payload": got})

    return spark.read.format("binaryFile").load(location).select("path", "content").mapInPandas(run, "path string, sequence long, payload binary")


def fakesink(df: DataFrame) -> None:
    """Everything is computed, nothing is kept."""
    df.write.format("noop").mode("overwrite").save()


def appsink(df: DataFrame, callback) -> int:
    """Rows one by one to a callback on the driver, partition by partition; returns how many."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        callback(row)
        n += 1
    return n


def filesink(df: DataFrame, location: str) -> None:
    """Payloads in the order of time, a file for each partition of the range sort."""
    df.orderBy("pts_ns", "sequence").select(F.base64("payload").alias("value")).write.mode("errorifexists").text(location)


def multifilesink(df: DataFrame, location: str, by: str = "file_no") -> None:
    """A folder for each file number (see operators.flow.key_frame_files)."""
    df.write.mode("errorifexists").partitionBy(by).parquet(location)
