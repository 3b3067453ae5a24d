"""Audio. Samples are rows (buffer, n, channel, s) or arrays; recurrences (echo with feedback, equaliser) run per stream in NumPy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.catalog import query, table
from framewright.functions.order import latest, running_sum
from framewright.schema import DAY_NS, FRAMES_SQL, HOUR_NS, frames

SAMPLES_SQL = "samples AS (SELECT l_orderkey AS buffer, CAST(l_linenumber AS BIGINT) AS n, l_linenumber % 2 AS channel, (l_partkey * 7919 + l_suppkey * 104729) % 65536 - 32768 AS s FROM lineitem)"


def samples(spark, sf_dir) -> DataFrame:
    """Lineitems as 16-bit samples: an order is a buffer."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("buffer"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_linenumber") % 2).alias("channel"), ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 65536 - 32768).alias("s"))


ORDERED_SQL = "samples AS (SELECT l_orderkey AS buffer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, (l_partkey * 7919 + l_suppkey * 104729) % 65536 - 32768 AS s FROM lineitem)"


def ordered_samples(spark, sf_dir) -> DataFrame:
    """samples() with n counting 1, 2, ... in each buffer."""
    li = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    return li.select(F.col("l_orderkey").alias("buffer"), n.alias("n"), ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 65536 - 32768).alias("s"))


def clamp16(c: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), c))


def half_away(c: Column) -> Column:
    """Rounded, halves away from 0, to LONG."""
    return F.when(c >= 0, F.floor(c + 0.5)).otherwise(F.ceil(c - 0.5))


def gained(c: Column, gain: float, mute: bool = False) -> Column:
    return F.lit(0).cast("long") if mute else clamp16(half_away(c * F.lit(float(gain))))


_HALF = "CASE WHEN {x} >= 0 THEN CAST(floor({x} + 0.5) AS BIGINT) ELSE CAST(ceil({x} - 0.5) AS BIGINT) END"


@query("j_volume", f"WITH {SAMPLES_SQL} SELECT buffer, n, greatest(-32768, least(32767, {_HALF.format(x='s * 1.5')})) AS s FROM samples")
def j_volume(spark, sf_dir):
    return samples(spark, sf_dir).select("buffer", "n", gained(F.col("s"), 1.5).alias("s"))


def amplified(c: Column, gain: float, method: str) -> Column:
    """Beyond 16 bits: clip, wrap as two's complement (wrap-negative), or mirror at the end (wrap-positive)."""
    x = half_away(c * F.lit(float(gain)))
    if method == "clip":
        return clamp16(x)
    if method == "wrap-negative":
        return F.pmod(x + 32768, F.lit(65536)) - 32768
    return clamp16(F.when(x > 32767, 2 * 32767 - x).when(x < -32768, 2 * -32768 - x).otherwise(x))


@query("j_amplify", f"WITH {SAMPLES_SQL}, a AS (SELECT buffer, n, {_HALF.format(x='s * 2.5')} AS x FROM samples) SELECT buffer, n, greatest(-32768, least(32767, x)) AS clip, (((x + 32768) % 65536) + 65536) % 65536 - 32768 AS wrap_negative, greatest(-32768, least(32767, CASE WHEN x > 32767 THEN 65534 - x WHEN x < -32768 THEN -65536 - x ELSE x END)) AS wrap_positive FROM a")
def j_amplify(spark, sf_dir):
    return samples(spark, sf_dir).select("buffer", "n", *(amplified(F.col("s"), 2.5, m).alias(m.replace("-", "_")) for m in ("clip", "wrap-negative", "wrap-positive")))


def panned(left: Column, right: Column, pan: float) -> tuple[Column, Column]:
    pan = max(-1.0, min(1.0, pan))
    return gained(left, 1 - max(0.0, pan)), gained(right, 1 + min(0.0, pan))


@query("j_panorama", f"WITH {SAMPLES_SQL}, p AS (SELECT buffer, (n - 1) // 2 AS frame, max(CASE WHEN channel = 1 THEN s END) AS l, max(CASE WHEN channel = 0 THEN s END) AS r FROM samples GROUP BY ALL) SELECT buffer, frame, {_HALF.format(x='(l * 0.7::DOUBLE)')} AS l, r FROM p WHERE l IS NOT NULL AND r IS NOT NULL")
def j_panorama(spark, sf_dir):
    p = samples(spark, sf_dir).groupBy("buffer", F.expr("(n - 1) div 2").alias("frame")).agg(F.max(F.when(F.col("channel") == 1, F.col("s"))).alias("l"), F.max(F.when(F.col("channel") == 0, F.col("s"))).alias("r"))
    left, right = panned(F.col("l"), F.col("r"), 0.3)
    return p.where("l IS NOT NULL AND r IS NOT NULL").select("buffer", "frame", left.alias("l"), right.alias("r"))


# Full scale of PCM formats.
FULL_SCALE = {"S16": 32768, "S24": 8388608, "S32": 2147483648}


def to_float(c: Column, fmt: str) -> Column:
    return (c - 128) / 128.0 if fmt == "U8" else c.cast("double") / FULL_SCALE[fmt] if fmt != "F32" else c.cast("double")


def from_float(c: Column, fmt: str) -> Column:
    if fmt == "F32":
        return c
    top = 128 if fmt == "U8" else FULL_SCALE[fmt]
    x = F.greatest(F.lit(-top), F.least(F.lit(top - 1), half_away(c * top)))
    return x + 128 if fmt == "U8" else x


@query("j_audioconvert", f"WITH {SAMPLES_SQL} SELECT buffer, n, s / 32768.0::DOUBLE AS f32, CAST(s AS BIGINT) * 256 AS s24, CAST(s AS BIGINT) * 65536 AS s32, greatest(0, least(255, {_HALF.format(x='(s / 256.0::DOUBLE)')} + 128)) AS u8 FROM samples")
def j_audioconvert(spark, sf_dir):
    f = to_float(F.col("s"), "S16")
    return samples(spark, sf_dir).select("buffer", "n", f.alias("f32"), *(from_float(f, k).alias(k.lower()) for k in ("S24", "S32", "U8")))


@query("t_pcm_convert", f"WITH {SAMPLES_SQL} SELECT buffer, n, (CAST(s AS BIGINT) * 70001) >> 16 AS s FROM samples")
def t_pcm_convert(spark, sf_dir):
    """32-bit capture slots to 16 bits: the upper half."""
    return samples(spark, sf_dir).select("buffer", "n", F.shiftright(F.col("s") * 70001, 16).alias("s"))


# Channel orders by count.
LAYOUTS = {1: ["FC"], 2: ["FL", "FR"], 4: ["FL", "FR", "BL", "BR"], 6: ["FL", "FR", "FC", "LFE", "BL", "BR"]}


def downmix(channels: int, out: int) -> list[list[float]]:
    """Rows of output gains: what an output lacks goes to its neighbours at 1/sqrt 2, bass effects go nowhere, and the loudest row is scaled to 1."""
    src, dst, half = LAYOUTS[channels], LAYOUTS[out], 1 / math.sqrt(2)
    near = {"FL": [("FC", half)], "FR": [("FC", half)], "FC": [("FL", half), ("FR", half)], "BL": [("FL", half), ("FC", 0.5)], "BR": [("FR", half), ("FC", 0.5)], "LFE": []}
    gains = [[0.0] * channels for _ in range(out)]
    for i, name in enumerate(src):
        if name in dst:
            gains[dst.index(name)][i] += 1
            continue
        options = [(o, g) for o, g in near[name] if o in dst]
        for o, g in options if name == "FC" else options[:1]:
            gains[dst.index(o)][i] += g
    top = max(1.0, *(sum(map(abs, row)) for row in gains))
    return [[g / top for g in row] for row in gains]


def mixed(df: DataFrame, channels: int, out: int) -> DataFrame:
    """frame, channel, s (floats) to the output channels, by a matrix of constants in the plan."""
    rows = downmix(channels, out)
    gain = lambda o: F.element_at(F.array(*map(F.lit, rows[o])), (F.col("channel") + 1).cast("int"))
    return df.groupBy("frame").agg(*(F.sum(F.col("s") * gain(o)).alias(f"c{o}") for o in range(out)))


_MIX = [[g for g in row] for row in downmix(6, 2)]


@query("j_downmix", f"WITH {SAMPLES_SQL} SELECT buffer * 2 + (n - 1) // 6 AS frame, " + ", ".join("round(sum(s / 32768.0 * CASE (n - 1) % 6 " + " ".join(f"WHEN {i} THEN {g!r}" for i, g in enumerate(row)) + f" END), 6) AS c{o}" for o, row in enumerate(_MIX)) + " FROM samples GROUP BY ALL")
def j_downmix(spark, sf_dir):
    """Samples six by six; a frame that is cut short is silent in its last channels."""
    s = samples(spark, sf_dir).select(F.expr("buffer * 2 + (n - 1) div 6").alias("frame"), ((F.col("n") - 1) % 6).alias("channel"), (F.col("s") / 32768.0).alias("s"))
    return mixed(s, 6, 2).select("frame", F.round("c0", 6).alias("c0"), F.round("c1", 6).alias("c1"))


def level(df: DataFrame) -> DataFrame:
    """Peak and RMS of each buffer and channel, linear."""
    v = F.col("s") / 32768.0
    return df.groupBy("buffer", "channel").agg(F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"))


@query("j_level", f"WITH {SAMPLES_SQL} SELECT buffer, channel, max(abs(s / 32768.0)) AS peak, round(sqrt(avg((s / 32768.0) * (s / 32768.0))), 9) AS rms FROM samples GROUP BY ALL")
def j_level(spark, sf_dir):
    return level(samples(spark, sf_dir)).withColumn("rms", F.round("rms", 9))


def resampled(df: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Linear interpolation of each buffer (n from 1): ceil(count * out / in) outputs, the last sample held. Every sample makes the outputs up to its successor."""
    by = Window.partitionBy("buffer").orderBy("n")
    i = F.col("n") - 1
    last = F.count(F.lit(1)).over(Window.partitionBy("buffer"))
    up = lambda x: F.ceil(x * rate_out / rate_in).cast("long")  # noqa: E731  first output at or past input x
    df = df.withColumn("_next", F.coalesce(F.lead("s").over(by), F.col("s"))).withColumn("_last", last)
    df = df.withColumn("_a", up(i)).withColumn("_b", up(i + 1) - 1).where("_a <= _b")
    df = df.withColumn("k", F.explode(F.sequence("_a", "_b")))
    frac = F.col("k") * rate_in / rate_out - i
    return df.select("buffer", "k", half_away(F.col("s") + (F.col("_next") - F.col("s")) * frac).alias("s"))


@query(
    "j_audioresample",
    f"""WITH {ORDERED_SQL}, c AS (SELECT buffer, count(*) AS n FROM samples GROUP BY buffer), o AS (SELECT buffer, n, unnest(generate_series(0, CAST(ceil(n * 1.5) AS BIGINT) - 1)) AS k FROM c),
    p AS (SELECT o.buffer, k, a.s AS a, coalesce(b.s, a.s) AS b, k * 2 / 3.0::DOUBLE - (k * 2) // 3 AS f FROM o JOIN samples a ON a.buffer = o.buffer AND a.n = (k * 2) // 3 + 1 LEFT JOIN samples b ON b.buffer = o.buffer AND b.n = (k * 2) // 3 + 2)
    SELECT buffer, k, {_HALF.format(x='(a + (b - a) * f)')} AS s FROM p""",
)
def j_audioresample(spark, sf_dir):
    return resampled(ordered_samples(spark, sf_dir), 2, 3)


def cutter(df: DataFrame, threshold: float, run_length_ns: int) -> DataFrame:
    """Rows (key, rel_ns, sequence, mean_square, duration_ns) with silent: quiet time since the last loud row has reached run_length."""
    loud = F.col("mean_square") >= threshold * threshold
    order = ["rel_ns", "sequence"]
    df = running_sum(df, ["stream"], "rel_ns", order, F.when(loud, 0).otherwise(F.col("duration_ns")), "_quiet", DAY_NS)
    df = latest(df, ["stream"], "rel_ns", order, F.when(loud, F.col("_quiet")), "_at_loud", DAY_NS)
    quiet = F.col("_quiet") - F.coalesce("_at_loud", F.lit(0))
    return df.withColumn("silent", ~loud & (quiet >= run_length_ns)).drop("_quiet", "_at_loud")


@query(
    "j_cutter",
    f"""WITH {FRAMES_SQL}, m AS (SELECT *, value / 100 AS ms, {HOUR_NS} AS d FROM frames), q AS (SELECT *, ms >= 0.25 AS loud, sum(CASE WHEN ms >= 0.25 THEN 0 ELSE d END) OVER w AS quiet FROM m WINDOW w AS (PARTITION BY stream ORDER BY rel_ns, sequence)),
    l AS (SELECT *, coalesce(last_value(CASE WHEN loud THEN quiet END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY rel_ns, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS at_loud FROM q)
    SELECT stream, sequence, NOT loud AND quiet - at_loud >= {2 * HOUR_NS} AS silent FROM l""",
)
def j_cutter(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("mean_square", F.col("value") / 100).withColumn("duration_ns", F.lit(HOUR_NS))
    return cutter(f, 0.5, 2 * HOUR_NS).select("stream", "sequence", "silent")


def spectrum(df: DataFrame, bands: int) -> DataFrame:
    """Magnitudes of each whole window of n = the next power of two of 2 bands samples, Hann-weighted, over n. In: key, n from 0, s. Arrow, one FFT a batch."""
    size = 1 << (2 * bands - 1).bit_length()
    windows = df.groupBy("key", F.expr(f"n div {size}").alias("w")).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x")).where(F.size("x") == size)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.vstack([np.asarray(v, float) for v in b["x"]])
                yield pd.DataFrame({"key": b["key"], "w": b["w"], "magnitude": list(np.abs(np.fft.fft(x * hann, axis=1))[:, :bands] / size)})

    key = df.schema["key"].dataType.simpleString()
    return windows.select("key", "w", F.transform("x", lambda v: v["s"].cast("double")).alias("x")).mapInPandas(run, f"key {key}, w long, magnitude array<double>")


_DFT = "sqrt(pow(sum(v * cos(2 * pi() * k * i / 8)), 2) + pow(sum(v * sin(2 * pi() * k * i / 8)), 2)) / 8"


@query("j_spectrum", f"WITH {FRAMES_SQL}, n AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY rel_ns, sequence) - 1 AS n, value FROM frames), x AS (SELECT key, n // 8 AS w, n % 8 AS i, value * 0.5 * (1 - cos(2 * pi() * (n % 8) / 7)) AS v, count(*) OVER (PARTITION BY key, n // 8) AS c FROM n) SELECT key, w, k, round({_DFT}, 6) AS magnitude FROM x, (VALUES (0), (1), (2), (3)) b(k) WHERE c = 8 GROUP BY key, w, k")
def j_spectrum(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("rel_ns", "sequence")
    s = frames(spark, sf_dir).select(F.col("user_id").alias("key"), (F.row_number().over(by).cast("long") - 1).alias("n"), F.col("value").alias("s"))
    return spectrum(s, 4).select("key", "w", F.posexplode("magnitude").alias("k", "magnitude")).withColumn("magnitude", F.round("magnitude", 6))


def echoed(c: Column, delay: int, intensity: float, by) -> Column:
    """One echo without feedback, so it is a lag."""
    return clamp16(half_away(c + intensity * F.coalesce(F.lag(c, delay).over(by), F.lit(0))))


@query("j_echo", f"WITH {ORDERED_SQL}, e AS (SELECT buffer, n, s + 0.5::DOUBLE * coalesce(lag(s, 2) OVER (PARTITION BY buffer ORDER BY n), 0) AS x FROM samples) SELECT buffer, n, greatest(-32768, least(32767, {_HALF.format(x='x')})) AS s FROM e")
def j_echo(spark, sf_dir):
    return ordered_samples(spark, sf_dir).select("buffer", "n", echoed(F.col("s"), 2, 0.5, Window.partitionBy("buffer").orderBy("n")).alias("s"))


def feedback_echo(x: np.ndarray, delay: int, intensity: float, feedback: float) -> np.ndarray:
    """out = in + intensity * line; the delay line takes in + feedback * line."""
    line, out = np.zeros(len(x)), np.zeros(len(x))
    for begin in range(0, len(x), delay):  # a block of delay samples depends on earlier blocks only
        part = slice(begin, min(len(x), begin + delay))
        back = line[begin - delay : part.stop - delay] if begin else np.zeros(part.stop - begin)
        out[part] = x[part] + intensity * back
        line[part] = x[part] + feedback * back
    return np.clip(np.sign(out) * np.floor(np.abs(out) + 0.5), -32768, 32767)


def peaking(f0: float, rate: float, q: float, gain_db: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a peaking biquad (Bristow-Johnson)."""
    a, w = 10 ** (gain_db / 40), 2 * math.pi * f0 / rate
    alpha, a0 = math.sin(w) / (2 * q), 1 + math.sin(w) / (2 * q) / a
    return (1 + alpha * a) / a0, -2 * math.cos(w) / a0, (1 - alpha * a) / a0, -2 * math.cos(w) / a0, (1 - alpha / a) / a0


def biquad(x: np.ndarray, c: tuple[float, float, float, float, float]) -> np.ndarray:
    b0, b1, b2, a1, a2 = c
    out, s1, s2 = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[i] = y
    return out


def in_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key: its samples' n and s as arrays, in the order of n."""
    x = F.array_sort(F.collect_list(F.struct("n", F.col("s").cast("double").alias("s"))))
    return df.groupBy(*keys).agg(x.alias("_x")).select(*keys, F.transform("_x", lambda v: v["n"]).alias("n"), F.transform("_x", lambda v: v["s"]).alias("s"))


def per_stream(df: DataFrame, keys: list[str], f) -> DataFrame:
    """f over each key's samples in the order of n; for recurrences that span a whole stream, whose length bounds the task. Many short streams share an Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(s=[f(np.asarray(s, float)) for s in b["s"]])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out = in_order(df, keys).mapInPandas(run, f"{schema}, n array<long>, s array<double>")
    return out.select(*keys, F.explode(F.arrays_zip("n", "s")).alias("x")).select(*keys, "x.n", "x.s")


@query("j_echo_feedback")
def j_echo_feedback(spark, sf_dir):
    return per_stream(ordered_samples(spark, sf_dir), ["buffer"], lambda x: feedback_echo(x, 2, 0.5, 0.3))


@query("j_equalizer")
def j_equalizer(spark, sf_dir):
    bands = [peaking(100, 48_000, 0.7, 3.0), peaking(1100, 48_000, 0.7, -6.0), peaking(11_000, 48_000, 0.7, 2.0)]

    def run(x: np.ndarray) -> np.ndarray:
        for c in bands:
            x = biquad(x, c)
        return np.clip(np.round(x), -32768, 32767)

    return per_stream(ordered_samples(spark, sf_dir), ["buffer"], run)


# --- G.711 ------------------------------------------------------------------------------------------------------------------------


def mulaw_encode(s: Column) -> Column:
    """G.711 mu-law of a 16-bit sample: sign, segment (the place of the top bit) and four bits below it, all inverted."""
    biased = F.least(F.lit(32635), F.abs(s)) + 132
    segment = F.length(F.conv(biased.cast("string"), 10, 2)) - 8
    mantissa = F.expr("1") * F.pmod(F.floor(biased / F.pow(F.lit(2.0), segment + 3)), F.lit(16))
    return (255 - (F.when(s < 0, 128).otherwise(0) + segment * 16 + mantissa)).cast("long")


def mulaw_decode(code: Column) -> Column:
    x = 255 - code
    segment, mantissa = F.floor((x % 128) / 16), x % 16
    size = (mantissa * 8 + 132) * F.pow(F.lit(2.0), segment).cast("long") - 132
    return F.when(x >= 128, -size).otherwise(size)


@query(
    "t_g711",
    f"""WITH {SAMPLES_SQL}, b AS (SELECT buffer, n, s, least(32635, abs(s)) + 132 AS m FROM samples), e AS (SELECT *, length(ltrim(bin(m), '0')) - 8 AS seg FROM b),
    c AS (SELECT buffer, n, 255 - (CASE WHEN s < 0 THEN 128 ELSE 0 END + seg * 16 + (m >> (seg + 3)) % 16) AS code FROM e)
    SELECT buffer, n, CAST(code AS BIGINT) AS code, CAST((CASE WHEN 255 - code >= 128 THEN -1 ELSE 1 END) * ((((255 - code) % 16) * 8 + 132) * pow(2, ((255 - code) % 128) // 16) - 132) AS BIGINT) AS decoded FROM c""",
)
def t_g711(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("code", mulaw_encode(F.col("s")))
    return s.select("buffer", "n", "code", mulaw_decode(F.col("code")).alias("decoded"))
