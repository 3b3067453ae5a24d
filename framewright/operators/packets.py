"""Packet streams read by their heads: Opus packets, FLAC frames, VobSub indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.catalog import query, table
from framewright.functions import parsers
from framewright.operators import media
from framewright.operators.text import stamp_ns
from framewright.schema import frames


def byte_at(packet: Column, n: int) -> Column:
    return F.conv(F.hex(F.substring(packet, n + 1, 1)), 16, 10).cast("int")


def opus_head(packet: Column) -> Column:
    """channels, frames and samples (at 48 kHz) of an Opus packet by its first bytes (RFC 6716, 3.1); samples are null for packets that
    are cut short, hold no frame or last over 120 ms, and all fields for empty ones and the stream's own heads."""
    toc, second = byte_at(packet, 0), byte_at(packet, 1)
    config, code = F.shiftright(toc, 3), toc.bitwiseAND(3)
    pick = lambda sizes, at: F.element_at(F.array(*map(F.lit, sizes)), at + 1)
    each = F.when(config < 12, pick([480, 960, 1920, 2880], config % 4)).when(config < 16, pick([480, 960], config % 2)).otherwise(pick([120, 240, 480, 960], config % 4))
    count = F.when(code == 0, 1).when(code < 3, 2).otherwise(second.bitwiseAND(63))
    whole = F.when(code < 2, True).otherwise(F.octet_length(packet) > 1) & (count > 0) & (each * count <= 5760)
    head = F.substring(packet, 1, 4) == F.lit(b"Opus")
    fields = F.struct(F.when(toc.bitwiseAND(4) > 0, 2).otherwise(1).alias("channels"), F.when(whole, count).alias("frames"), F.when(whole, each * count).alias("samples"))
    return F.when((F.octet_length(packet) > 0) & ~head, fields)


@query(
    "o_opusparse",
    """WITH p AS (SELECT event_id, event_id * 37 % 256 AS toc, event_id * 13 % 256 AS b, event_id % 5 <> 0 AS more FROM events),
    c AS (SELECT *, toc // 8 AS config, CASE WHEN toc % 4 = 0 THEN 1 WHEN toc % 4 < 3 THEN 2 WHEN more THEN b % 64 END AS n FROM p),
    s AS (SELECT *, CASE WHEN config < 12 THEN [480, 960, 1920, 2880][config % 4 + 1] WHEN config < 16 THEN [480, 960][config % 2 + 1] ELSE 120 * 2 ** (config % 4) END AS each FROM c),
    w AS (SELECT *, (toc % 4 < 2 OR more) AND n > 0 AND n * each <= 5760 AS whole FROM s)
    SELECT event_id, CAST(CASE WHEN toc // 4 % 2 = 1 THEN 2 ELSE 1 END AS INTEGER) AS channels, CAST(CASE WHEN whole THEN n END AS INTEGER) AS frames, CAST(CASE WHEN whole THEN n * each END AS INTEGER) AS samples FROM w""",
)
def o_opusparse(spark, sf_dir):
    """A packet an event, of all 256 first bytes; every fifth is cut to one byte."""
    hex2 = lambda x: F.lpad(F.hex(x), 2, "0")
    e = F.col("event_id")
    packet = F.unhex(F.concat(hex2(e * 37 % 256), F.when(e % 5 == 0, F.lit("")).otherwise(hex2(e * 13 % 256))))
    return table(spark, sf_dir, "events").select("event_id", opus_head(packet).alias("h")).select("event_id", "h.channels", "h.frames", "h.samples")


def flac_writer(g: pd.DataFrame) -> bytes:
    return parsers.write_flac(48_000, [bytes(p) for p in g["payload"]])


@query("o_flacparse", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 4096 * 1000000000 // 48000 AS pts_ns, props FROM events")
def o_flacparse(spark, sf_dir):
    """A stream a user, whose frames hold the events' properties: split again by sync words, numbers and checksums."""
    f = frames(spark, sf_dir).select("user_id", F.lit(0).alias("track"), "pts_ns", "sequence", F.encode("props", "UTF-8").alias("payload"))
    out = media.demux(media.mux(f, "user_id", flac_writer), "user_id", "payload", "flac")
    number = F.when(F.col("sequence") < 128, 1).when(F.col("sequence") < 2048, 2).when(F.col("sequence") < 65536, 3).otherwise(4)
    body = F.substr("payload", number + 6, F.octet_length("payload") - number - 7)
    return out.select("user_id", "pts_ns", F.decode(body, "UTF-8").alias("props"))


def vobsub_index(df: DataFrame, key: str, document: Column) -> DataFrame:
    """key, language, track, start_ns, filepos, bytes of each subtitle that an .idx document names; bytes reach to the language's next one
    (null for its last). Each `id:` line begins a language; comments and lines that are no times are passed over."""
    text = F.regexp_replace(F.regexp_replace(document, "\r\n?", "\n"), r"(?m)^[ \t]*#.*$", "")
    part = df.select(key, F.explode(F.slice(F.split(F.concat(F.lit("\n"), text), r"\n[ \t]*id:"), 2, F.length(text) + 1)).alias("_part"))
    line = r"(?m)^[ \t]*timestamp:[ \t]*(\d+:\d\d:\d\d:\d+),[ \t]*filepos:[ \t]*([0-9a-fA-F]+)"
    stamps = F.regexp_extract_all("_part", F.lit(line), F.lit(1))
    places = F.transform(F.regexp_extract_all("_part", F.lit(line), F.lit(2)), lambda x: F.conv(x, 16, 10).cast("long"))
    track = F.nullif(F.regexp_extract("_part", r"^[^\n]*index:[ \t]*(\d+)", 1), F.lit("")).cast("int")
    cues = part.select(key, F.regexp_extract("_part", r"^[ \t]*([A-Za-z-]*)", 1).alias("language"), track.alias("track"), places.alias("_at"), F.posexplode(stamps).alias("_n", "_t"))
    at = F.get("_at", F.col("_n"))
    clock = F.regexp_replace("_t", r":(\d+)$", ".$1")
    return cues.select(key, "language", "track", stamp_ns(clock, 1).alias("start_ns"), at.alias("filepos"), (F.get("_at", F.col("_n") + 1) - at).alias("bytes"))


@query("q_vobsub_index", "SELECT conv_id, substr(role, 1, 2) AS language, turn * 5000000000 AS start_ns, turn * 2048 AS filepos, (lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) - turn) * 2048 AS bytes FROM conversations")
def q_vobsub_index(spark, sf_dir):
    """Conversations as indexes: a language a role, a subtitle a turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    s = F.col("turn") * 5
    stamp = F.format_string("timestamp: %02d:%02d:%02d:000, filepos: %09x", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.col("turn") * 2048)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", stamp.alias("x")))), lambda v: v["x"])
    part = c.groupBy("conv_id", "role").agg(F.concat(F.lit("id: "), F.substring("role", 1, 2), F.lit(", index: 0\n# cues\n"), F.array_join(lines, "\n")).alias("part"))
    docs = part.groupBy("conv_id").agg(F.concat(F.lit("# VobSub index file, v7\nsize: 720x576\n"), F.array_join(F.collect_list("part"), "\n")).alias("doc"))
    return vobsub_index(docs, "conv_id", F.col("doc")).drop("track")
