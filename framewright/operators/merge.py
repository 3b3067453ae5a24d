"""N inputs to one and one to N: ordered merge, concatenation, selection, rounds, latest values, mixing, overlays, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions.order import latest, running_number, running_sum
from framewright.schema import DAY_NS, FRAMES_SQL, HOUR_NS, MINUTE_NS, STREAMS, frames

ORDER = ["pts_ns", "input", "sequence"]
#: Time buckets of the carried windows.
WIDTH = 6 * HOUR_NS
#: Whole numbers of items in a bucket of a playlist.
ITEMS = 4096
#: What a LONG can hold, 292 years of nanoseconds.
FIRST_NS, LAST_NS = -(1 << 63), (1 << 63) - 1


def funnel(df: DataFrame) -> DataFrame:
    """All inputs in one order: time, then input, then sequence; position counts from 1."""
    return running_number(df, [], "pts_ns", ORDER, "position", WIDTH)


@query("h_funnel", f"WITH {FRAMES_SQL} SELECT stream, sequence, row_number() OVER (ORDER BY pts_ns, input, sequence) AS position FROM frames")
def h_funnel(spark, sf_dir):
    return funnel(frames(spark, sf_dir)).select("stream", "sequence", "position")


def begins(spans: DataFrame, item: str, span: str) -> DataFrame:
    """spans with _o, the sum of the earlier items' spans, as an exact DECIMAL: a long playlist's end is beyond LONG. Rows without an item have no place."""
    spans = spans.where(F.col(item).isNotNull())
    exact = F.col(span).cast("decimal(20,0)")
    if spans.schema[item].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return running_sum(spans, [], item, [item], exact, "_o", ITEMS, inclusive=False)
    before = Window.orderBy(item).rowsBetween(Window.unboundedPreceding, -1)  # one row for each item
    return spans.withColumn("_o", F.coalesce(F.sum(exact).over(before), F.lit(0)))


def moved(time: Column, offset: Column) -> Column:
    """time + offset, added exactly; beyond LONG it stays at LONG's end, as the reference's saturating_add stays at its own type's."""
    t = time.cast("decimal(20,0)") + offset
    return F.when(t > LAST_NS, LAST_NS).when(t < FIRST_NS, FIRST_NS).otherwise(t).cast("long")


def concat(df: DataFrame, time: str, duration: Column) -> DataFrame:
    """Inputs one after the other: each is moved by the sum of the earlier inputs' ends."""
    ends = df.groupBy("input").agg(F.max(F.col(time).cast("decimal(20,0)") + duration).alias("_end"))
    offsets = begins(ends, "input", "_end").select("input", "_o")
    return df.join(F.broadcast(offsets), "input").withColumn(time, moved(F.col(time), F.col("_o"))).drop("_o")  # one row for each input


@query("h_concat", f"WITH {FRAMES_SQL}, e AS (SELECT input, max(rel_ns + 1000000) AS e FROM frames GROUP BY input), o AS (SELECT input, coalesce(sum(e) OVER (ORDER BY input ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM e) SELECT stream, sequence, CAST(rel_ns + o AS BIGINT) AS rel_ns FROM frames JOIN o USING (input)")
def h_concat(spark, sf_dir):
    return concat(frames(spark, sf_dir), "rel_ns", F.lit(1_000_000)).select("stream", "sequence", "rel_ns")


def input_selector(df: DataFrame, switch: Column, default: int = 0) -> DataFrame:
    """Frames of the active input; a row whose switch is not null makes that input active from then on."""
    df = latest(df, [], "pts_ns", ["pts_ns", "sequence"], switch.cast("int"), "_active", WIDTH)
    return df.where(F.col("input") == F.coalesce("_active", F.lit(default))).drop("_active")


@query("h_input_selector", f"WITH {FRAMES_SQL}, a AS (SELECT *, last_value(CASE WHEN stream = 'error' THEN sequence % 5 END IGNORE NULLS) OVER (ORDER BY pts_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM frames) SELECT stream, sequence FROM a WHERE input = coalesce(active, 0)")
def h_input_selector(spark, sf_dir):
    return input_selector(frames(spark, sf_dir), F.when(F.col("stream") == "error", F.col("sequence") % 5)).select("stream", "sequence")


@query("h_merger", f"WITH {FRAMES_SQL} SELECT sequence, pts_ns, value FROM frames WHERE input = 2")
def h_merger(spark, sf_dir):
    return frames(spark, sf_dir).where("input = 2").select("sequence", "pts_ns", "value")


def output_selector(df: DataFrame, key: Column, ports: int) -> DataFrame:
    return df.withColumn("port", F.pmod(key, F.lit(ports)).cast("int"))


@query("h_output_selector", f"WITH {FRAMES_SQL} SELECT CAST(user_id % 4 AS INTEGER) AS port, count(*) AS frames, count(*) FILTER (keyframe) AS keyframes FROM frames GROUP BY ALL")
def h_output_selector(spark, sf_dir):
    return output_selector(frames(spark, sf_dir), F.col("user_id"), 4).groupBy("port").agg(F.count(F.lit(1)).alias("frames"), F.count_if("keyframe").alias("keyframes"))


def round_zip(df: DataFrame) -> DataFrame:
    """Round r joins the r-th frames of all inputs; ended inputs leave the round. items: (input, sequence, value) by input."""
    rows = running_number(df, ["input"], "pts_ns", ["pts_ns", "sequence"], "round", WIDTH)
    return rows.groupBy("round").agg(F.array_sort(F.collect_list(F.struct("input", "sequence", "value"))).alias("items"))


@query("h_round_zip", f"WITH {FRAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY pts_ns, sequence) AS round FROM frames) SELECT round, count(*) AS inputs, string_agg(CAST(sequence AS VARCHAR), ',' ORDER BY input) AS sequences, min(value) AS least FROM r GROUP BY round")
def h_round_zip(spark, sf_dir):
    items = round_zip(frames(spark, sf_dir))
    return items.select("round", F.size("items").cast("long").alias("inputs"), F.array_join(F.transform("items", lambda x: x["sequence"].cast("string")), ",").alias("sequences"), F.array_min(F.transform("items", lambda x: x["value"])).alias("least"))


def latest_wins(df: DataFrame, driver: str, others: list[str]) -> DataFrame:
    """Each frame of the driving stream with the latest value of every other, once all have had one."""
    for s in others:
        df = latest(df, [], "pts_ns", ["pts_ns", "sequence"], F.when(F.col("stream") == s, F.col("value")), f"v_{s}", WIDTH)
    df = df.where(F.col("stream") == driver)
    for s in others:
        df = df.where(F.col(f"v_{s}").isNotNull())
    return df


def _last(s: str) -> str:
    return f"last_value(CASE WHEN stream = '{s}' THEN value END IGNORE NULLS) OVER (ORDER BY pts_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v_{s}"


@query("h_latest_wins", f"WITH {FRAMES_SQL}, l AS (SELECT *, {', '.join(map(_last, STREAMS[:4]))} FROM frames) SELECT sequence, value, v_click, v_error, v_purchase, v_signup FROM l WHERE stream = 'view' AND v_click IS NOT NULL AND v_error IS NOT NULL AND v_purchase IS NOT NULL AND v_signup IS NOT NULL")
def h_latest_wins(spark, sf_dir):
    return latest_wins(frames(spark, sf_dir), "view", STREAMS[:4]).select("sequence", "value", *(f"v_{s}" for s in STREAMS[:4]))


def audiomixer(samples: DataFrame) -> DataFrame:
    """slot, sample of many inputs: the sum in each slot, clamped to 16 bits; slots without any are silence."""
    mixed = samples.groupBy("slot").agg(F.sum("sample").alias("_s"))
    ends = samples.agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    grid = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("slot"))
    return grid.join(mixed, "slot", "left").select("slot", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.coalesce("_s", F.lit(0)))).cast("int").alias("sample"))


@query("h_audiomixer", f"WITH {FRAMES_SQL}, s AS (SELECT rel_ns // {10 * MINUTE_NS} AS slot, CAST(floor(value * 200) AS BIGINT) AS sample FROM frames), m AS (SELECT slot, sum(sample) AS s FROM s GROUP BY slot), g AS (SELECT unnest(generate_series(min(slot), max(slot))) AS slot FROM s) SELECT g.slot, CAST(greatest(-32768, least(32767, coalesce(m.s, 0))) AS INTEGER) AS sample FROM g LEFT JOIN m USING (slot)")
def h_audiomixer(spark, sf_dir):
    return audiomixer(frames(spark, sf_dir).select(F.expr(f"rel_ns div {10 * MINUTE_NS}").alias("slot"), F.floor(F.col("value") * 200).alias("sample")))


def interval_overlay(video: DataFrame, cues: DataFrame, width_ns: int) -> DataFrame:
    """Pairs with start <= t < end: cues stand in every bucket that they reach, frames in one, so this is an equi-join."""
    c = cues.withColumn("_b", F.explode(F.sequence(F.expr(f"start_ns div {width_ns}"), F.expr(f"(end_ns - 1) div {width_ns}"))))
    v = video.withColumn("_b", F.expr(f"pts_ns div {width_ns}"))
    return v.join(c, "_b").where("start_ns <= pts_ns AND pts_ns < end_ns").drop("_b")


@query("h_text_overlay", f"WITH {FRAMES_SQL} SELECT v.sequence, count(*) AS cues, min(c.sequence) AS first_cue FROM frames v JOIN frames c ON v.stream = 'view' AND c.stream = 'purchase' AND c.pts_ns <= v.pts_ns AND v.pts_ns < c.pts_ns + {10 * MINUTE_NS} GROUP BY v.sequence")
def h_text_overlay(spark, sf_dir):
    f = frames(spark, sf_dir)
    cues = f.where("stream = 'purchase'").select(F.col("sequence").alias("cue"), F.col("pts_ns").alias("start_ns"), (F.col("pts_ns") + 10 * MINUTE_NS).alias("end_ns"))
    video = f.where("stream = 'view'").select("sequence", "pts_ns")
    return interval_overlay(video, cues, 10 * MINUTE_NS).groupBy("sequence").agg(F.count(F.lit(1)).alias("cues"), F.min("cue").alias("first_cue"))


def subpicture_overlay(df: DataFrame, canvas: Column, keys: list[str]) -> DataFrame:
    """The latest canvas at or before each frame of its key."""
    return latest(df, keys, "pts_ns", ["pts_ns", "sequence"], canvas, "canvas", 10 * DAY_NS)


@query("h_subpicture_overlay", f"WITH {FRAMES_SQL}, l AS (SELECT *, last_value(CASE WHEN stream = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pts_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS canvas FROM frames) SELECT sequence, user_id, canvas FROM l WHERE stream = 'view'")
def h_subpicture_overlay(spark, sf_dir):
    return subpicture_overlay(frames(spark, sf_dir), F.when(F.col("stream") == "purchase", F.col("value")), ["user_id"]).where("stream = 'view'").select("sequence", "user_id", "canvas")


@query("h_compositor", f"WITH {FRAMES_SQL}, l AS (SELECT *, CAST(floor(value) AS BIGINT) % 256 AS src, (sequence * 5) % 256 AS a, last_value(CASE WHEN stream = 'purchase' THEN CAST(floor(value) AS BIGINT) % 256 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pts_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dst FROM frames) SELECT sequence, (src * a + dst * (255 - a) + 127) // 255 AS sample FROM l WHERE stream = 'view' AND dst IS NOT NULL")
def h_compositor(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("src", F.floor("value") % 256).withColumn("a", (F.col("sequence") * 5) % 256)
    f = latest(f, ["user_id"], "pts_ns", ["pts_ns", "sequence"], F.when(F.col("stream") == "purchase", F.col("src")), "dst", 10 * DAY_NS)
    return f.where("stream = 'view' AND dst IS NOT NULL").select("sequence", blended(F.col("src"), F.col("dst"), F.col("a")).alias("sample"))


def blended(src: Column, dst: Column, alpha: Column) -> Column:
    """src over dst, in 8 bits."""
    return F.floor((src * alpha + dst * (255 - alpha) + 127) / 255)


def script_router(df: DataFrame, ports: Column) -> DataFrame:
    """A copy of the frame for each of its ports; no port: dropped."""
    return df.withColumn("port", F.explode(F.filter(ports, lambda p: p >= 0)))


@query("h_script_router", f"WITH {FRAMES_SQL} SELECT sequence, 0 AS port FROM frames WHERE sequence % 2 = 0 UNION ALL SELECT sequence, 2 FROM frames WHERE value > 50")
def h_script_router(spark, sf_dir):
    ports = F.array(F.when(F.col("sequence") % 2 == 0, 0).otherwise(-1), F.when(F.col("value") > 50, 2).otherwise(-1))
    return script_router(frames(spark, sf_dir), ports).select("sequence", "port")


@query("h_stream_demux", f"WITH {FRAMES_SQL} SELECT CASE WHEN keyframe THEN 0 WHEN value < 50 THEN 1 ELSE 2 END AS port, stream, count(*) AS frames FROM frames GROUP BY ALL")
def h_stream_demux(spark, sf_dir):
    port = F.when(F.col("keyframe"), 0).when(F.col("value") < 50, 1).otherwise(2)
    return frames(spark, sf_dir).withColumn("port", port).groupBy("port", "stream").agg(F.count(F.lit(1)).alias("frames"))


def bounded_skew(df: DataFrame, depth: int) -> DataFrame:
    """What an input keeps when only its last frames have room, and how many it dropped."""
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy("input").orderBy(F.desc("pts_ns"), F.desc("sequence")))).where(F.col("_n") <= depth).drop("_n")
    counts = df.groupBy("input").agg(F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - depth).alias("dropped"))
    return kept.join(F.broadcast(counts), "input")  # one row for each input


@query("h_bounded_skew", f"WITH {FRAMES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY input ORDER BY pts_ns DESC, sequence DESC) AS n, count(*) OVER (PARTITION BY input) AS c FROM frames) SELECT input, sequence, greatest(0, c - 10) AS dropped FROM n WHERE n <= 10")
def h_bounded_skew(spark, sf_dir):
    return bounded_skew(frames(spark, sf_dir), 10).select("input", "sequence", "dropped")


@query("a_gaplesssrc", f"WITH {FRAMES_SQL}, e AS (SELECT user_id, max(rel_ns) - min(rel_ns) + 1000 AS d, min(rel_ns) AS f FROM frames GROUP BY user_id), o AS (SELECT *, coalesce(sum(d) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM e) SELECT sequence, CAST(rel_ns - f + o AS BIGINT) AS pts_ns FROM frames JOIN o USING (user_id)")
def a_gaplesssrc(spark, sf_dir):
    return gapless(frames(spark, sf_dir), "user_id", 1000).select("sequence", "pts_ns")


def gapless(df: DataFrame, item: str, last_duration_ns: int) -> DataFrame:
    """Playlist items back to back on one timeline that starts at 0. The items' spans, not their frames, are put in order. _o is where an item begins, exactly, beyond LONG too."""
    spans = df.groupBy(item).agg(F.min("rel_ns").alias("_first"), (F.max("rel_ns") - F.min("rel_ns") + last_duration_ns).alias("_d"))
    return df.join(begins(spans, item, "_d"), item).withColumn("pts_ns", moved(F.col("rel_ns") - F.col("_first"), F.col("_o")))


