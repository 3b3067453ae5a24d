"""Text streams: subtitle documents, Cursor-on-Target events, session descriptions, telemetry as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.catalog import query, table
from framewright.schema import FRAMES_SQL, MS_NS, frames

STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"


def stamp_ns(line: Column, which: int) -> Column:
    """Nanoseconds of the first or second [hours:]minutes:seconds.millis of a timing line; null if there is none."""
    at = F.element_at(F.regexp_extract_all(line, F.lit(r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"), F.lit(1)), which)
    part = lambda i: F.regexp_extract(at, f"^{STAMP}$", i)
    number = lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(c.cast("long"))
    ms = F.rpad(part(4), 3, "0").cast("long")
    seconds, minutes = part(3).cast("long"), part(2).cast("long")
    good = at.isNotNull() & (seconds < 60) & (minutes < 60)
    return F.when(good, ((number(part(1)) * 60 + minutes) * 60 + seconds) * 1000 * MS_NS + ms * MS_NS)


def markup_free(text: Column) -> Column:
    """Without tags, and with the references that subtitles use resolved."""
    out = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\{\\[^}]*\}", "")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return out


def parse_blocks(df: DataFrame, key: str, document: Column) -> DataFrame:
    """SubRip and WebVTT: blocks between blank lines with a timing line; text lines below it. key, n (from 0), start_ns, end_ns, text."""
    clean = F.regexp_replace(F.regexp_replace(document, "^﻿", ""), "\r\n?", "\n")
    blocks = df.select(key, F.posexplode(F.filter(F.split(clean, r"\n[ \t]*\n\s*"), lambda b: F.contains(b, F.lit("-->")))).alias("n", "block"))
    lines = blocks.withColumn("timing", F.regexp_extract("block", r"(?m)^(.*-->.*)$", 1)).withColumn("body", F.regexp_extract("block", r"(?s)-->[^\n]*\n(.*)", 1))
    cues = lines.select(key, F.col("n").cast("long").alias("n"), stamp_ns(F.col("timing"), 1).alias("start_ns"), stamp_ns(F.col("timing"), 2).alias("end_ns"), F.regexp_replace(markup_free(F.col("body")), r"\s+$", "").alias("text"))
    return cues.where("start_ns IS NOT NULL AND end_ns IS NOT NULL")


def parse_ssa(df: DataFrame, key: str, document: Column) -> DataFrame:
    """SSA/ASS Dialogue lines: the tenth field on is the text, times have centiseconds."""
    lines = df.select(key, F.posexplode(F.split(document, "\r?\n")).alias("n", "line")).where("line LIKE 'Dialogue:%'")
    f = F.split(F.col("line"), ",", 10)
    text = F.replace(markup_free(f[9]), F.lit("\\N"), F.lit("\n"))
    return lines.where(F.size(f) == 10).select(key, F.col("n").cast("long").alias("n"), stamp_ns(f[1], 1).alias("start_ns"), stamp_ns(f[2], 1).alias("end_ns"), text.alias("text"))


def parse_ttml(df: DataFrame, key: str, document: Column) -> DataFrame:
    """TTML paragraphs with begin and end."""
    ps = df.select(key, F.posexplode(F.regexp_extract_all(document, F.lit(r"(?s)(<p\b.*?</p>)"), F.lit(1))).alias("n", "p"))
    at = lambda a: F.regexp_extract("p", rf'\b{a}="([^"]*)"', 1)
    body = markup_free(F.regexp_replace(F.regexp_extract("p", r"(?s)<p\b[^>]*>(.*)</p>", 1), r"<br\s*/>", "\n"))
    return ps.select(key, F.col("n").cast("long").alias("n"), stamp_ns(at("begin"), 1).alias("start_ns"), stamp_ns(at("end"), 1).alias("end_ns"), body.alias("text"))


def render_stamp(ms: Column, comma: str) -> Column:
    return F.format_string(f"%02d:%02d:%02d{comma}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def subtitles(spark, sf_dir, comma: str) -> DataFrame:
    """Conversations as subtitle documents: a turn is a cue of two seconds, five seconds apart."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"[<>&{}\s]+", " ")).alias("t"))
    begin = F.col("turn") * 5000
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), render_stamp(begin, comma), F.lit(" --> "), render_stamp(begin + 2000, comma), F.lit("\n<i>"), "role", F.lit("</i>: "), "t", F.lit(" &amp; &lt;"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("doc"))


_CUES = "SELECT conv_id, turn * 5000000000 AS start_ns, turn * 5000000000 + 2000000000 AS end_ns, role || ': ' || trim(regexp_replace(text, '[<>&{}\\s]+', ' ', 'g')) || ' & <' AS text FROM conversations"


@query("q_subparse_srt", _CUES)
def q_subparse_srt(spark, sf_dir):
    return parse_blocks(subtitles(spark, sf_dir, ","), "conv_id", F.col("doc")).select("conv_id", "start_ns", "end_ns", "text")


@query("q_subparse_vtt", _CUES)
def q_subparse_vtt(spark, sf_dir):
    doc = F.concat(F.lit("WEBVTT\n\nNOTE made here\n\n"), "doc")
    return parse_blocks(subtitles(spark, sf_dir, "."), "conv_id", doc).select("conv_id", "start_ns", "end_ns", "text")


def xml_escaped(c: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(ref))
    return c


def cot_event(uid: Column, kind: Column, lat: Column, lon: Column, time: Column, stale_s: int) -> Column:
    """A Cursor-on-Target event as XML. time: TIMESTAMP, in UTC."""
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stale = F.timestamp_seconds(F.unix_seconds(time) + stale_s)
    return F.concat(F.lit('<event version="2.0" uid="'), xml_escaped(uid), F.lit('" type="'), xml_escaped(kind), F.lit('" time="'), at(time), F.lit('" stale="'), at(stale), F.lit('"><point lat="'), lat, F.lit('" lon="'), lon, F.lit('"/></event>'))


@query("d_cotsink", "SELECT event_id, '<event version=\"2.0\" uid=\"u&amp;' || user_id || '\" type=\"' || event_type || '\" time=\"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '\" stale=\"' || strftime(ts + INTERVAL 60 SECOND, '%Y-%m-%dT%H:%M:%SZ') || '\"><point lat=\"' || (event_id % 90) || '\" lon=\"' || (user_id % 180) || '\"/></event>' AS xml FROM events")
def d_cotsink(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    uid = F.concat(F.lit("u&"), F.col("user_id").cast("string"))
    xml = cot_event(uid, F.col("event_type"), (F.col("event_id") % 90).cast("string"), (F.col("user_id") % 180).cast("string"), F.col("ts").cast("timestamp"), 60)
    return e.select("event_id", xml.alias("xml"))


def parse_sdp(df: DataFrame, key: str, document: Column) -> DataFrame:
    """Media sections of session descriptions: key, n (from 0), media, port, payload type, encoding and clock of its rtpmap."""
    sections = df.select(key, F.posexplode(F.slice(F.split(document, r"(?m)^m="), 2, 10_000)).alias("n", "s"))
    first = F.regexp_extract("s", r"^(\w+) (\d+) \S+ (\d+)", 0)
    part = lambda i: F.regexp_extract(first, r"^(\w+) (\d+) \S+ (\d+)", i)
    rtpmap = lambda i: F.regexp_extract("s", r"(?m)^a=rtpmap:\d+ ([^/\s]+)/(\d+)", i)
    return sections.select(key, F.col("n").cast("long").alias("n"), part(1).alias("media"), part(2).cast("int").alias("port"), part(3).cast("int").alias("payload_type"), rtpmap(1).alias("encoding"), rtpmap(2).cast("int").alias("clock"))


@query("q_sdp", "SELECT s_suppkey AS key, CAST(n AS BIGINT) AS n, CASE n WHEN 0 THEN 'video' ELSE 'audio' END AS media, CAST(5000 + s_suppkey % 100 + n AS INTEGER) AS port, CAST(96 + n AS INTEGER) AS payload_type, CASE n WHEN 0 THEN 'H264' ELSE 'opus' END AS encoding, CAST(CASE n WHEN 0 THEN 90000 ELSE 48000 END AS INTEGER) AS clock FROM supplier, (VALUES (0), (1)) v(n)")
def q_sdp(spark, sf_dir):
    port = (5000 + F.col("s_suppkey") % 100).cast("string")
    next_port = (5001 + F.col("s_suppkey") % 100).cast("string")
    doc = F.concat(F.lit("v=0\r\ns="), "s_name", F.lit("\r\nm=video "), port, F.lit(" RTP/AVP 96\r\na=rtpmap:96 H264/90000\r\na=fmtp:96 packetization-mode=1\r\nm=audio "), next_port, F.lit(" RTP/AVP 97\r\na=rtpmap:97 opus/48000/2\r\n"))
    return parse_sdp(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), doc.alias("doc")), "key", F.col("doc"))


@query("q_json_props", f"WITH {FRAMES_SQL} SELECT stream, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM frames GROUP BY stream")
def q_json_props(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("stream").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("q_misp_time", "SELECT event_id, lpad(hex(epoch_us(ts)), 16, '0') AS stamp, epoch_us(ts) AS us FROM events")
def q_misp_time(spark, sf_dir):
    """Microsecond stamps as they stand in an SEI: eight bytes, big-endian; and read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = e.withColumn("stamp", F.lpad(F.hex("t"), 16, "0"))
    return e.select("event_id", "stamp", F.conv("stamp", 16, 10).cast("long").alias("us"))
