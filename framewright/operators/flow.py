"""Flow control: filters, offsets, gates, queues, pacing, probes and the rules by which sinks cut files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from framewright.catalog import query, table
from framewright.functions.order import running_sum
from framewright.schema import DAY_NS, EPOCH_NS, FRAMES_SQL, HOUR_NS, MS_NS, frames

ORDER = ["pts_ns", "sequence"]


def avoffset(df: DataFrame, offset_ns: int, columns: tuple[str, ...] = ("pts_ns",)) -> DataFrame:
    """Times moved by an offset, not below 0."""
    return df.withColumns({c: F.greatest(F.lit(0).cast("long"), F.col(c) + F.lit(offset_ns)) for c in columns})


@query("g_avoffset", f"WITH {FRAMES_SQL} SELECT stream, sequence, greatest(0, rel_ns - {10 * DAY_NS}) AS pts_ns FROM frames")
def g_avoffset(spark, sf_dir):
    return avoffset(frames(spark, sf_dir), -EPOCH_NS - 10 * DAY_NS).select("stream", "sequence", "pts_ns")


def capsfilter(df: DataFrame, allowed: dict[str, list], ranges: dict[str, tuple] | None = None) -> DataFrame:
    """Rows whose fields have one of the allowed values or lie in a range; unknown fields fail at planning."""
    if missing := {*allowed, *(ranges or {})} - {*df.columns}:
        raise ValueError(f"no such fields: {sorted(missing)}")
    for c, values in allowed.items():
        df = df.where(F.col(c).isin(values))
    for c, (low, high) in (ranges or {}).items():
        df = df.where(F.col(c).between(low, high))
    return df


@query("g_capsfilter", f"WITH {FRAMES_SQL} SELECT stream, sequence, pts_ns, value FROM frames WHERE stream IN ('purchase', 'view') AND value BETWEEN 10 AND 80")
def g_capsfilter(spark, sf_dir):
    return capsfilter(frames(spark, sf_dir), {"stream": ["purchase", "view"]}, {"value": (10, 80)}).select("stream", "sequence", "pts_ns", "value")


ARRIVAL_SQL = f"pts_ns + ((sequence * 7919) % 50 - 10) * {MS_NS}"


def with_arrival(df: DataFrame) -> DataFrame:
    return df.withColumn("arrival_ns", F.expr(ARRIVAL_SQL))


def clocksync(df: DataFrame) -> DataFrame:
    """Nothing is dropped; wait_ns says how long a frame is held until its time."""
    return df.withColumn("wait_ns", F.greatest(F.lit(0).cast("long"), F.col("pts_ns") - F.col("arrival_ns")))


@query("g_clocksync", f"WITH {FRAMES_SQL} SELECT stream, sequence, pts_ns, greatest(0, pts_ns - ({ARRIVAL_SQL})) AS wait_ns FROM frames")
def g_clocksync(spark, sf_dir):
    return clocksync(with_arrival(frames(spark, sf_dir))).select("stream", "sequence", "pts_ns", "wait_ns")


def gopreverse(df: DataFrame, keys: list[str], arrival: str = "sequence") -> DataFrame:
    """For reverse playback: a group ends where a time is below its predecessor's; position orders groups as they came, times downwards."""
    by = Window.partitionBy(*keys).orderBy(arrival)
    df = df.withColumn("_new", F.coalesce((F.col("pts_ns") < F.lag("pts_ns").over(by)).cast("long"), F.lit(0)))
    df = df.withColumn("gop", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("gop", F.desc("pts_ns"), arrival)).cast("long")).drop("_new")


@query(
    "g_gopreverse",
    f"""WITH {FRAMES_SQL}, a AS (SELECT *, CASE WHEN pts_ns < lag(pts_ns) OVER (PARTITION BY user_id ORDER BY sequence) THEN 1 ELSE 0 END AS n FROM frames),
    g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY sequence) AS BIGINT) AS gop FROM a)
    SELECT user_id, sequence, gop, row_number() OVER (PARTITION BY user_id ORDER BY gop, pts_ns DESC, sequence) AS position FROM g""",
)
def g_gopreverse(spark, sf_dir):
    return gopreverse(frames(spark, sf_dir), ["user_id"]).select("user_id", "sequence", "gop", "position")


def identity(df: DataFrame, name: str = "probe") -> tuple[DataFrame, Observation]:
    """The frames as they are, and an observation whose `get` has their number and first and last time once they have been run through."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("pts_ns").alias("first_ns"), F.max("pts_ns").alias("last_ns")), seen


@query("g_identity", f"WITH {FRAMES_SQL} SELECT stream, sequence, pts_ns, value FROM frames")
def g_identity(spark, sf_dir):
    return identity(frames(spark, sf_dir).select("stream", "sequence", "pts_ns", "value"))[0]


def progressreport(df: DataFrame, every_ns: int) -> DataFrame:
    """A row for each stream and period: frames in it, and so far."""
    slots = df.groupBy("stream", F.expr(f"rel_ns div {every_ns}").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return slots.withColumn("so_far", F.sum("n").over(Window.partitionBy("stream").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)))


@query("g_progressreport", f"WITH {FRAMES_SQL}, s AS (SELECT stream, rel_ns // {DAY_NS} AS slot, count(*) AS n FROM frames GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY stream ORDER BY slot) AS BIGINT) AS so_far FROM s")
def g_progressreport(spark, sf_dir):
    return progressreport(frames(spark, sf_dir), DAY_NS)


# The first bytes of formats (offset, bytes in hex, media type).
MAGIC = [
    (8, "57415645", "audio/x-wav"),
    (4, "66747970", "video/quicktime"),
    (0, "1A45DFA3", "video/x-matroska"),
    (0, "4F676753", "application/ogg"),
    (0, "464C5601", "video/x-flv"),
    (0, "444B4946", "video/x-ivf"),
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "664C6143", "audio/x-flac"),
    (0, "000001BA", "video/mpeg-ps"),
    (0, "574542565454", "text/vtt"),
    (0, "3C21444F4354595045", "text/html"),
    (0, "5B53637269707420496E666F5D", "text/x-ssa"),
]


def typefind(payload: Column) -> Column:
    """The media type that a payload's first bytes show, else application/octet-stream (null for null). A transport stream has its sync byte
    at the head of each of the first three packets, as far as the payload goes."""
    out = F.when(payload.isNotNull(), F.lit("application/octet-stream"))
    sync = lambda at: F.hex(F.substring(payload, at + 1, 1)) == "47"
    size = F.octet_length(payload)
    out = F.when(sync(0) & ((size == 188) | sync(188)) & ((size <= 376) | sync(376)), "video/mpegts").otherwise(out)
    for at, magic, kind in reversed(MAGIC):
        out = F.when(F.hex(F.substring(payload, at + 1, len(magic) // 2)) == magic, kind).otherwise(out)
    return out


@query("g_typefind", "SELECT page_id AS id, CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'text/html' WHEN strlen(html) = 188 AND starts_with(html, 'G') THEN 'video/mpegts' WHEN hex(encode(html)) LIKE '47%' AND substr(hex(encode(html)), 377, 2) = '47' AND (strlen(html) <= 376 OR substr(hex(encode(html)), 753, 2) = '47') THEN 'video/mpegts' ELSE 'application/octet-stream' END AS kind FROM pages UNION ALL SELECT -1 - doc_id, CASE WHEN strlen(text) = 188 AND starts_with(text, 'G') THEN 'video/mpegts' WHEN hex(encode(text)) LIKE '47%' AND substr(hex(encode(text)), 377, 2) = '47' AND (strlen(text) <= 376 OR substr(hex(encode(text)), 753, 2) = '47') THEN 'video/mpegts' ELSE 'application/octet-stream' END FROM documents")
def g_typefind(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t"))
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("t"))
    return pages.unionByName(docs).select("id", typefind(F.encode("t", "UTF-8")).alias("kind"))


def gate(df: DataFrame, toggles: Column) -> DataFrame:
    """Frames that come while the gate is open; each row for which toggles is true turns it."""
    df = running_sum(df, [], "pts_ns", ORDER, toggles.cast("long"), "_turns", 6 * HOUR_NS)
    return df.where("_turns % 2 = 0").drop("_turns")


@query("g_gate", f"WITH {FRAMES_SQL}, t AS (SELECT *, sum(CASE WHEN stream = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY pts_ns, sequence) AS turns FROM frames) SELECT stream, sequence FROM t WHERE turns % 2 = 0")
def g_gate(spark, sf_dir):
    return gate(frames(spark, sf_dir), F.col("stream") == "signup").select("stream", "sequence")


def router(df: DataFrame, port: Column) -> DataFrame:
    """The port that a frame leaves by; what has none (null or negative) is dropped."""
    return df.withColumn("port", port.cast("int")).where("port >= 0")


@query("g_router", f"WITH {FRAMES_SQL} SELECT sequence, CAST(input % 3 AS INTEGER) AS port FROM frames WHERE value >= 20")
def g_router(spark, sf_dir):
    return router(frames(spark, sf_dir), F.when(F.col("value") >= 20, F.col("input") % 3)).select("sequence", "port")


def leaky_queue(df: DataFrame, keys: list[str], capacity: int, policy: str) -> DataFrame:
    """What a queue of that capacity holds of each arrival batch (keys): its last frames (oldest), or its first (newest).

    A live queue leaks by speed; this model leaks by batch, so it gives the same rows every time.
    """
    order = {"oldest": [F.desc(c) for c in ORDER], "newest": [F.asc(c) for c in ORDER]}[policy]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= capacity).drop("_n")


@query(
    "g_queue_leaky",
    f"""WITH {FRAMES_SQL}, b AS (SELECT *, rel_ns // {6 * HOUR_NS} AS batch FROM frames),
    n AS (SELECT *, row_number() OVER (PARTITION BY stream, batch ORDER BY pts_ns DESC, sequence DESC) AS o, row_number() OVER (PARTITION BY stream, batch ORDER BY pts_ns, sequence) AS f FROM b)
    SELECT 'oldest' AS policy, stream, sequence FROM n WHERE o <= 5 UNION ALL SELECT 'newest', stream, sequence FROM n WHERE f <= 5""",
)
def g_queue_leaky(spark, sf_dir):
    df = frames(spark, sf_dir).withColumn("batch", F.expr(f"rel_ns div {6 * HOUR_NS}"))
    parts = [leaky_queue(df, ["stream", "batch"], 5, p).select(F.lit(p).alias("policy"), "stream", "sequence") for p in ("oldest", "newest")]
    return parts[0].unionByName(parts[1])


def num_buffers(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The first n frames of each key; the planner limits before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))).where(F.col("_n") <= n).drop("_n")


@query("g_num_buffers", f"WITH {FRAMES_SQL} SELECT stream, sequence FROM frames QUALIFY row_number() OVER (PARTITION BY stream ORDER BY pts_ns, sequence) <= 25")
def g_num_buffers(spark, sf_dir):
    return num_buffers(frames(spark, sf_dir), 25, ["stream"]).select("stream", "sequence")


def chain(*steps):
    """Transforms in a row as one; sources and sinks join in the same way."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


@query("g_chain", f"WITH {FRAMES_SQL} SELECT stream, sequence, rel_ns + 1000 AS rel_ns, value * 2 AS value FROM frames WHERE keyframe")
def g_chain(spark, sf_dir):
    double = lambda df: df.withColumn("value", F.col("value") * 2)
    return chain(lambda df: df.where("keyframe"), lambda df: avoffset(df, 1000, ("rel_ns",)), double)(frames(spark, sf_dir)).select("stream", "sequence", "rel_ns", "value")


def judged(df: DataFrame, max_lateness_ns: int) -> DataFrame:
    """late: now is beyond the deadline and the lateness allowed; jitter_ns: now less deadline."""
    return df.withColumn("jitter_ns", F.col("arrival_ns") - F.col("pts_ns")).withColumn("late", F.col("jitter_ns") > max_lateness_ns)


@query("f_syncsink", f"WITH {FRAMES_SQL}, j AS (SELECT stream, ({ARRIVAL_SQL}) - pts_ns AS jitter FROM frames) SELECT stream, count(*) FILTER (jitter <= {20 * MS_NS}) AS presented, count(*) FILTER (jitter > {20 * MS_NS}) AS dropped, max(jitter) AS worst_ns, CAST(sum(jitter) AS BIGINT) AS total_ns FROM j GROUP BY stream")
def f_syncsink(spark, sf_dir):
    rows = judged(with_arrival(frames(spark, sf_dir)), 20 * MS_NS)
    return rows.groupBy("stream").agg(F.count_if(~F.col("late")).alias("presented"), F.count_if("late").alias("dropped"), F.max("jitter_ns").alias("worst_ns"), F.sum("jitter_ns").alias("total_ns"))


# --- sinks that cut files -----------------------------------------------------------------------------------------------------


def key_frame_files(df: DataFrame, keys: list[str]) -> DataFrame:
    """multifilesink with next-file=key-frame: a file begins at each key frame."""
    return running_sum(df, keys, "pts_ns", ORDER, F.col("keyframe").cast("long"), "file_no", DAY_NS)


@query("d_multifilesink", f"WITH {FRAMES_SQL} SELECT stream, sequence, CAST(sum(CASE WHEN keyframe THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY pts_ns, sequence) AS BIGINT) AS file_no FROM frames")
def d_multifilesink(spark, sf_dir):
    return key_frame_files(frames(spark, sf_dir), ["stream"]).select("stream", "sequence", "file_no")


def greedy_cuts(df: DataFrame, keys: list[str], limit_ns: int) -> DataFrame:
    """keys and pts_ns of the key frames that begin a file: each the first at or past the limit since the one before. The recurrence runs over
    sorted distinct times that stream through a task, so memory holds one Arrow batch and the last cut, however many a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, due = None, None
        for b in batches:
            at = []
            for i, (*k, t) in enumerate(zip(*(b.column(c).to_pylist() for c in [*keys, "pts_ns"]), strict=True)):
                if due is None or k != key or t >= due:
                    key, due = k, t + limit_ns
                    at.append(i)
            yield b.take(pa.array(at, pa.int32()))

    times = df.where("keyframe AND pts_ns IS NOT NULL").select(*keys, "pts_ns").distinct()
    dealt = times.repartition(*keys) if keys else times.repartition(1)
    return dealt.sortWithinPartitions(*keys, "pts_ns").mapInArrow(run, times.schema)


def greedy_segments(df: DataFrame, keys: list[str], limit_ns: int) -> DataFrame:
    """splitmuxsink and hlssink: segment is the number of cuts up to a frame, from 0; frames before the first cut, or without a time, are in 0."""
    cuts = greedy_cuts(df, keys, limit_ns).withColumn("_cut", F.lit(1).cast("long"))
    both = df.withColumn("_cut", F.lit(0).cast("long")).unionByName(cuts, allowMissingColumns=True)
    order = ["pts_ns", F.desc("_cut"), *(c for c in ORDER if c in df.columns and c != "pts_ns")]
    out = running_sum(both, keys, "pts_ns", order, F.col("_cut"), "segment", DAY_NS)
    return out.where("_cut = 0").withColumn("segment", F.greatest(F.lit(0).cast("long"), F.col("segment") - 1)).drop("_cut")


@query(
    "d_splitmuxsink",
    f"""WITH RECURSIVE {FRAMES_SQL}, k AS (SELECT user_id, pts_ns FROM frames WHERE keyframe),
    c(user_id, cut) AS (SELECT user_id, min(pts_ns) FROM k GROUP BY user_id UNION ALL
      SELECT c.user_id, (SELECT min(k.pts_ns) FROM k WHERE k.user_id = c.user_id AND k.pts_ns >= c.cut + {3 * DAY_NS}) FROM c WHERE c.cut IS NOT NULL)
    SELECT f.user_id, f.sequence, greatest(0, (SELECT count(*) FROM c WHERE c.user_id = f.user_id AND c.cut <= f.pts_ns) - 1) AS segment FROM frames f""",
)
def d_splitmuxsink(spark, sf_dir):
    return greedy_segments(frames(spark, sf_dir), ["user_id"], 3 * DAY_NS).select("user_id", "sequence", "segment")
