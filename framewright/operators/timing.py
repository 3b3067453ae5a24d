"""Time: segments, seeks, rate conversion, control curves, latency and clocks, tags, telemetry, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.schema import DAY_NS, FRAMES_SQL, HOUR_NS, frames


def running_time(ts: Column, rate: float, base: int, start: int, stop: int | None) -> Column:
    """Time since playback began; null outside the segment or without motion."""
    if rate == 0 or (rate < 0 and stop is None):
        return F.lit(None).cast("long")
    along = ts - start if rate > 0 else F.lit(stop).cast("long") - ts
    inside = (ts >= start) & (F.lit(True) if stop is None else ts <= stop)
    return F.when(inside, (along.cast("double") / abs(rate)).cast("long") + base)


def stream_time(ts: Column, applied_rate: float, time: int, start: int, stop: int | None) -> Column:
    inside = (ts >= start) & (F.lit(True) if stop is None else ts <= stop)
    return F.when(inside, ((ts - start).cast("double") * abs(applied_rate)).cast("long") + time)


S0, S1 = 5 * DAY_NS, 20 * DAY_NS


@query(
    "u_segment_running_time",
    f"""WITH {FRAMES_SQL} SELECT sequence,
    CASE WHEN rel_ns BETWEEN {S0} AND {S1} THEN CAST(floor(CAST(rel_ns - {S0} AS DOUBLE) / 2.0) AS BIGINT) + 1000 END AS forward_ns,
    CASE WHEN rel_ns BETWEEN {S0} AND {S1} THEN {S1} - rel_ns + 7 END AS reverse_ns,
    CASE WHEN rel_ns BETWEEN {S0} AND {S1} THEN CAST(floor(CAST(rel_ns - {S0} AS DOUBLE) * 0.5) AS BIGINT) + 11 END AS stream_ns FROM frames""",
)
def u_segment_running_time(spark, sf_dir):
    t = F.col("rel_ns")
    return frames(spark, sf_dir).select("sequence", running_time(t, 2.0, 1000, S0, S1).alias("forward_ns"), running_time(t, -1.0, 7, S0, S1).alias("reverse_ns"), stream_time(t, 0.5, 11, S0, S1).alias("stream_ns"))


def clip(begin: Column, end: Column, start: int, stop: int) -> tuple[Column, Column, Column]:
    """Whether an interval touches the segment, and its ends inside."""
    return (begin < stop) & (end > start), F.greatest(begin, F.lit(start)), F.least(end, F.lit(stop))


@query("u_segment_clip", f"WITH {FRAMES_SQL} SELECT sequence, greatest(rel_ns, {S0}) AS a, least(rel_ns + {12 * HOUR_NS}, {S1}) AS b FROM frames WHERE rel_ns < {S1} AND rel_ns + {12 * HOUR_NS} > {S0}")
def u_segment_clip(spark, sf_dir):
    keep, a, b = clip(F.col("rel_ns"), F.col("rel_ns") + 12 * HOUR_NS, S0, S1)
    return frames(spark, sf_dir).where(keep).select("sequence", a.alias("a"), b.alias("b"))


def seek_fold(df: DataFrame, keys: list[str], flushing: Column) -> DataFrame:
    """The running time at each seek: a flushing one sets it to 0, an accumulating one goes on."""
    by = Window.partitionBy(*keys).orderBy("rel_ns", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_epoch", F.sum(flushing.cast("long")).over(by))
    return df.withColumn("base_ns", F.col("rel_ns") - F.min("rel_ns").over(Window.partitionBy(*keys, "_epoch"))).drop("_epoch")


@query("u_seek_fold", f"WITH {FRAMES_SQL}, e AS (SELECT *, sum(CASE WHEN sequence % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rel_ns, sequence) AS epoch FROM frames) SELECT user_id, sequence, rel_ns - min(rel_ns) OVER (PARTITION BY user_id, epoch) AS base_ns FROM e")
def u_seek_fold(spark, sf_dir):
    return seek_fold(frames(spark, sf_dir), ["user_id"], F.col("sequence") % 3 == 0).select("user_id", "sequence", "base_ns")


@query("u_trick_mode", f"WITH {FRAMES_SQL} SELECT stream, sequence FROM frames WHERE keyframe OR stream <> 'view'")
def u_trick_mode(spark, sf_dir):
    return frames(spark, sf_dir).where((F.col("stream") != "view") | F.col("keyframe")).select("stream", "sequence")


def videorate(df: DataFrame, keys: list[str], dt_ns: int) -> DataFrame:
    """A constant rate: slots from the first frame's time on, each with the nearest frame (the earlier of two); after the last frame
    becomes nearest one slot more, then it ends. Times must ascend. Every frame finds its own slots, from its neighbours alone."""
    by = Window.partitionBy(*keys).orderBy("rel_ns", "sequence")
    first = F.min("rel_ns").over(Window.partitionBy(*keys))
    df = df.withColumn("_f0", first).withColumn("_before", F.lag("rel_ns").over(by)).withColumn("_after", F.lead("rel_ns").over(by))
    # Slot k at f0 + k dt belongs to a frame t if it is beyond the midpoint with the frame before and up to that with the next.
    low = F.when(F.col("_before").isNull(), F.lit(0).cast("long")).otherwise(F.expr(f"((rel_ns + _before) - 2 * _f0) div {2 * dt_ns} + 1"))
    high = F.when(F.col("_after").isNotNull(), F.expr(f"((rel_ns + _after) - 2 * _f0) div {2 * dt_ns}")).otherwise(low)
    df = df.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    return df.withColumn("slot", F.explode(F.sequence("_low", "_high"))).withColumn("out_ns", F.col("_f0") + F.col("slot") * dt_ns).drop("_f0", "_before", "_after", "_low", "_high")


DT = 6 * HOUR_NS


@query(
    "i_videorate",
    f"""WITH {FRAMES_SQL}, n AS (SELECT *, min(rel_ns) OVER (PARTITION BY user_id) AS f0, lag(rel_ns) OVER w AS b, lead(rel_ns) OVER w AS a FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY rel_ns, sequence)),
    r AS (SELECT *, CASE WHEN b IS NULL THEN 0 ELSE (rel_ns + b - 2 * f0) // {2 * DT} + 1 END AS low FROM n),
    h AS (SELECT *, CASE WHEN a IS NULL THEN low ELSE (rel_ns + a - 2 * f0) // {2 * DT} END AS high FROM r)
    SELECT user_id, f0 + k * {DT} AS out_ns, sequence FROM (SELECT user_id, f0, sequence, unnest(generate_series(low, high)) AS k FROM h WHERE low <= high)""",
)
def i_videorate(spark, sf_dir):
    return videorate(frames(spark, sf_dir), ["user_id"], DT).select("user_id", "out_ns", "sequence")


def control_value(df: DataFrame, keys: DataFrame, mode: str) -> DataFrame:
    """The curve's value at each frame's time: keys (t, v), stepwise or linear, level beyond both ends. keys is a curve: small enough for a broadcast."""
    w = Window.orderBy("t")
    spans = keys.withColumn("_t1", F.lead("t").over(w)).withColumn("_v1", F.lead("v").over(w)).withColumn("_first", F.lag("t").over(w).isNull())
    t = F.col("rel_ns")
    inside = ((F.col("t") <= t) | F.col("_first")) & (F.col("_t1").isNull() | (t < F.col("_t1")))
    low = F.when(t <= F.col("t"), F.col("v"))
    if mode == "linear":
        value = low.when(F.col("_t1").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("_v1") - F.col("v")) * ((t - F.col("t")).cast("double") / (F.col("_t1") - F.col("t")).cast("double")))
    else:
        value = low.otherwise(F.col("v"))
    return df.join(F.broadcast(spans), inside, "left").withColumn("control", F.coalesce(value, F.lit(0.0))).drop("t", "v", "_t1", "_v1", "_first")


CURVE = [(3 * DAY_NS, 1.0), (9 * DAY_NS, 5.0), (10 * DAY_NS, -2.0), (25 * DAY_NS, 4.0)]
CURVE_SQL = "k(t, v) AS (VALUES " + ", ".join(f"({t}, CAST({v} AS DOUBLE))" for t, v in CURVE) + ")"


@query(
    "u_control_curve",
    f"""WITH {FRAMES_SQL}, {CURVE_SQL}, s AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS t1, lead(v) OVER (ORDER BY t) AS v1 FROM k)
    SELECT sequence, round(CASE WHEN rel_ns <= {CURVE[0][0]} THEN {CURVE[0][1]} WHEN rel_ns >= {CURVE[-1][0]} THEN {CURVE[-1][1]} ELSE (SELECT v + (v1 - v) * (CAST(rel_ns - t AS DOUBLE) / CAST(t1 - t AS DOUBLE)) FROM s WHERE t <= rel_ns AND rel_ns < t1) END, 6) AS linear,
    CASE WHEN rel_ns <= {CURVE[0][0]} THEN {CURVE[0][1]} ELSE (SELECT arg_max(v, t) FROM k WHERE t <= rel_ns) END AS step FROM frames""",
)
def u_control_curve(spark, sf_dir):
    keys = spark.createDataFrame(CURVE, "t long, v double")
    df = control_value(frames(spark, sf_dir), keys, "linear").withColumnRenamed("control", "linear")
    df = control_value(df, keys, "step").withColumnRenamed("control", "step")
    return df.select("sequence", F.round("linear", 6).alias("linear"), "step")


@query("u_latency_fold", f"WITH {FRAMES_SQL} SELECT user_id, bool_or(stream = 'error') AS live, CAST(sum(sequence % 100) AS BIGINT) AS min_ms, CASE WHEN count(CASE WHEN stream <> 'signup' THEN 1 END) < count(*) THEN NULL ELSE CAST(sum(sequence % 1000) AS BIGINT) END AS max_ms FROM frames GROUP BY user_id")
def u_latency_fold(spark, sf_dir):
    """Live if any is; least latencies add up; an unknown greatest latency makes the sum unknown."""
    most = F.when(F.col("stream") != "signup", F.col("sequence") % 1000)
    total = F.when(F.count(most) == F.count(F.lit(1)), F.sum(most))
    return frames(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("stream") == "error").alias("live"), F.sum(F.col("sequence") % 100).alias("min_ms"), total.alias("max_ms"))


BUCKETS = 32


def latency_histogram(df: DataFrame, keys: list[str], ns: Column, percentiles: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """count, mean and upper bucket edges at percentiles, from a histogram of powers of two (values under 2 in bucket 0); edges stop at the maximum."""
    bucket = F.least(F.lit(BUCKETS), F.when(ns < 2, 0).otherwise(F.length(F.conv(ns.cast("string"), 10, 2)) - 1))
    h = df.groupBy(*keys, bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(ns).alias("s"), F.max(ns).alias("m"))
    by = Window.partitionBy(*keys)
    h = h.withColumn("total", F.sum("n").over(by)).withColumn("acc", F.sum("n").over(by.orderBy("b")))
    top = F.max("m")
    edge = lambda p: F.least(top, F.min(F.when(F.col("acc") * 100 >= F.col("total") * p, F.when(F.col("b") >= BUCKETS, F.lit(2**62)).otherwise(F.expr("shiftleft(cast(2 as bigint), b)")))))
    return h.groupBy(*keys).agg(F.sum("n").alias("count"), F.expr("sum(s) div sum(n)").alias("mean_ns"), top.alias("max_ns"), *(edge(p).alias(f"p{p}_ns") for p in percentiles))


_EDGE = "least(max(m), min(CASE WHEN acc * 100 >= total * {p} THEN CASE WHEN b >= 32 THEN 4611686018427387904 ELSE CAST(2 AS BIGINT) << b END END)) AS p{p}_ns"


@query(
    "u_latency_histogram",
    f"""WITH {FRAMES_SQL}, v AS (SELECT stream, CAST(floor(abs(value) * 1000000) AS BIGINT) AS ns FROM frames),
    h AS (SELECT stream, CASE WHEN ns < 2 THEN 0 ELSE least(32, length(ltrim(bin(ns), '0')) - 1) END AS b, count(*) AS n, sum(ns) AS s, max(ns) AS m FROM v GROUP BY ALL),
    a AS (SELECT *, sum(n) OVER (PARTITION BY stream) AS total, sum(n) OVER (PARTITION BY stream ORDER BY b) AS acc FROM h)
    SELECT stream, CAST(sum(n) AS BIGINT) AS count, CAST(sum(s) // sum(n) AS BIGINT) AS mean_ns, max(m) AS max_ns, {", ".join(_EDGE.format(p=p) for p in (50, 90, 99))} FROM a GROUP BY stream""",
)
def u_latency_histogram(spark, sf_dir):
    return latency_histogram(frames(spark, sf_dir), ["stream"], F.floor(F.abs("value") * 1_000_000))


@query("u_clock_election", f"WITH {FRAMES_SQL} SELECT user_id, sequence AS clock FROM frames QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY input DESC, sequence) = 1")
def u_clock_election(spark, sf_dir):
    """The highest priority wins, of equal ones the one furthest upstream; a maximum, so that no sort is needed."""
    return frames(spark, sf_dir).groupBy("user_id").agg(F.max_by("sequence", F.struct("input", (-F.col("sequence")).alias("at"))).alias("clock"))


@query(
    "u_drift_fit",
    f"""WITH {FRAMES_SQL}, x AS (SELECT user_id, sequence, rel_ns / 1e9 AS local, rel_ns / 1e9 * 1.0001 + sequence % 7 AS master, rel_ns FROM frames)
    SELECT user_id, sequence, round(CASE WHEN count(*) OVER w < 2 THEN 1.0 ELSE regr_slope(master, local) OVER w END, 6) AS slope FROM x WINDOW w AS (PARTITION BY user_id ORDER BY rel_ns, sequence ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""",
)
def u_drift_fit(spark, sf_dir):
    """Slope of the master clock over the local one in the last 64 samples; 1 before there are two."""
    x = frames(spark, sf_dir).withColumn("local", F.col("rel_ns") / 1e9).withColumn("master", F.col("rel_ns") / 1e9 * 1.0001 + F.col("sequence") % 7)
    w = Window.partitionBy("user_id").orderBy("rel_ns", "sequence").rowsBetween(-63, 0)
    slope = F.when(F.count(F.lit(1)).over(w) < 2, 1.0).otherwise(F.regr_slope("master", "local").over(w))
    return x.select("user_id", "sequence", F.round(slope, 6).alias("slope"))


def tag_merge(of_stream: DataFrame, of_all: DataFrame, key: str) -> DataFrame:
    """Stream tags, and global tags whose key no stream tag has."""
    return of_stream.unionByName(of_all.join(of_stream, key, "left_anti"))


@query("u_tag_merge", f"WITH {FRAMES_SQL}, s AS (SELECT user_id AS key, max(value) AS tag FROM frames WHERE stream = 'signup' AND sequence % 3 = 0 GROUP BY 1), g AS (SELECT user_id AS key, min(value) AS tag FROM frames GROUP BY 1) SELECT * FROM s UNION ALL SELECT * FROM g WHERE key NOT IN (SELECT key FROM s)")
def u_tag_merge(spark, sf_dir):
    f = frames(spark, sf_dir)
    own = f.where("stream = 'signup' AND sequence % 3 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("tag"))
    return tag_merge(own, f.groupBy(F.col("user_id").alias("key")).agg(F.min("value").alias("tag")), "key")


@query("u_tag_split", f"WITH {FRAMES_SQL}, t AS (SELECT DISTINCT stream, user_id AS key, sequence % 4 AS tag FROM frames) SELECT key, tag FROM t GROUP BY key, tag HAVING count(DISTINCT stream) = (SELECT count(DISTINCT stream) FROM t)")
def u_tag_split(spark, sf_dir):
    """Tags that all streams have in common become global, if there is more than one stream."""
    t = frames(spark, sf_dir).select("stream", F.col("user_id").alias("key"), (F.col("sequence") % 4).alias("tag")).distinct()
    n = t.agg(F.count_distinct("stream").alias("n"))
    shared = t.groupBy("key", "tag").agg(F.count_distinct("stream").alias("streams"))
    return shared.join(F.broadcast(n), F.col("streams") == F.col("n")).where("n > 1").select("key", "tag")  # one row


def rtp_ticks(time: str, rate: int) -> Column:
    """RTP ticks of a time, modulo 2^32; seconds and their rest apart, so nothing overflows."""
    return F.expr(f"pmod(({time} div 1000000000) * {rate} + (({time} % 1000000000) * {rate}) div 1000000000, 4294967296)")


def unwrap(ticks: Column, reference: Column) -> Column:
    """The 64-bit count nearest to the reference whose lower 32 bits are ticks."""
    off = F.pmod(ticks - reference, F.lit(1 << 32))
    return reference + F.when(off >= 1 << 31, off - (1 << 32)).otherwise(off)


@query(
    "u_media_clock",
    f"""WITH {FRAMES_SQL}, t AS (SELECT sequence, ((rel_ns // 1000000000) * 90000 + ((rel_ns % 1000000000) * 90000) // 1000000000) AS full_ticks FROM frames),
    o AS (SELECT *, full_ticks % 4294967296 AS ticks, full_ticks - 12345678 AS ref FROM t), d AS (SELECT *, (((ticks - ref) % 4294967296) + 4294967296) % 4294967296 AS off FROM o)
    SELECT sequence, ticks, ref + CASE WHEN off >= 2147483648 THEN off - 4294967296 ELSE off END AS unwrapped FROM d""",
)
def u_media_clock(spark, sf_dir):
    full = F.expr("(rel_ns div 1000000000) * 90000 + ((rel_ns % 1000000000) * 90000) div 1000000000")
    f = frames(spark, sf_dir).withColumn("ticks", rtp_ticks("rel_ns", 90000)).withColumn("ref", full - 12345678)
    return f.select("sequence", "ticks", unwrap(F.col("ticks"), F.col("ref")).alias("unwrapped"))


@query("u_dedup", f"WITH {FRAMES_SQL} SELECT stream, sequence % 1000 AS seq, pts_ns, sequence FROM frames QUALIFY row_number() OVER (PARTITION BY stream, sequence % 1000 ORDER BY pts_ns, sequence) = 1")
def u_dedup(spark, sf_dir):
    """The first copy of each number that arrives by either path; a minimum, so copies are dropped before the shuffle."""
    f = frames(spark, sf_dir).withColumn("seq", F.col("sequence") % 1000)
    return f.groupBy("stream", "seq").agg(F.min(F.struct("pts_ns", "sequence")).alias("x")).select("stream", "seq", "x.pts_ns", "x.sequence")


@query("u_journeys", f"WITH {FRAMES_SQL}, s AS (SELECT sequence, stage, rel_ns + stage * 1000 AS enter_ns, rel_ns + stage * 1000 + (sequence * (stage + 1)) % 900 AS exit_ns FROM frames, (VALUES (0), (1), (2)) v(stage)) SELECT stage, count(*) AS frames, CAST(sum(exit_ns - enter_ns) AS BIGINT) AS busy_ns, max(exit_ns - enter_ns) AS worst_ns FROM s GROUP BY stage")
def u_journeys(spark, sf_dir):
    """Where frames spend their time, by stage."""
    s = frames(spark, sf_dir).withColumn("stage", F.explode(F.array(*map(F.lit, range(3)))))
    took = (F.col("sequence") * (F.col("stage") + 1)) % 900
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("frames"), F.sum(took).alias("busy_ns"), F.max(took).alias("worst_ns"))


@query("u_conformance", f"WITH {FRAMES_SQL}, e AS (SELECT user_id, bool_or(stream = 'signup') AS a, bool_or(stream = 'purchase' AND value > 90) AS b, bool_or(stream = 'error' AND value > 95) AS c FROM frames GROUP BY user_id) SELECT user_id, CASE WHEN a AND b AND c THEN 'stable' WHEN a AND b THEN 'beta' WHEN a THEN 'alpha' ELSE 'none' END AS level FROM e")
def u_conformance(spark, sf_dir):
    """An element's maturity follows from its evidence."""
    s, v = F.col("stream"), F.col("value")
    e = frames(spark, sf_dir).groupBy("user_id").agg(F.bool_or(s == "signup").alias("a"), F.bool_or((s == "purchase") & (v > 90)).alias("b"), F.bool_or((s == "error") & (v > 95)).alias("c"))
    return e.select("user_id", F.when(F.expr("a AND b AND c"), "stable").when(F.expr("a AND b"), "beta").when(F.expr("a"), "alpha").otherwise("none").alias("level"))


@query("u_psnr", f"WITH {FRAMES_SQL}, p AS (SELECT stream, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + sequence % 3 - 1 AS b FROM frames) SELECT stream, round(10 * log10(255.0 * 255.0 / avg((a - b) * (a - b))), 6) AS psnr_db FROM p GROUP BY stream")
def u_psnr(spark, sf_dir):
    p = frames(spark, sf_dir).withColumn("a", F.floor("value")).withColumn("b", F.floor("value") + F.col("sequence") % 3 - 1)
    return p.groupBy("stream").agg(F.round(psnr_db(F.col("a"), F.col("b")), 6).alias("psnr_db"))


def psnr_db(a: Column, b: Column) -> Column:
    """Peak signal to noise of 8-bit samples, as an aggregate; infinite if all are equal."""
    mse = F.avg((a - b) * (a - b))
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(255.0 * 255.0 / mse))


@query("u_rtp_gaps", f"WITH {FRAMES_SQL} SELECT user_id, count(*) AS received, count(DISTINCT sequence // 2) AS distinct_seqs, max(sequence // 2) - min(sequence // 2) + 1 AS expected, greatest(0, max(sequence // 2) - min(sequence // 2) + 1 - count(DISTINCT sequence // 2)) AS lost FROM frames GROUP BY user_id")
def u_rtp_gaps(spark, sf_dir):
    """Packets received, expected from the range of extended sequence numbers, and lost."""
    f = frames(spark, sf_dir).withColumn("seq", F.expr("sequence div 2"))
    expected = F.max("seq") - F.min("seq") + 1
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("received"), F.count_distinct("seq").alias("distinct_seqs"), expected.alias("expected"), F.greatest(F.lit(0).cast("long"), expected - F.count_distinct("seq")).alias("lost"))
