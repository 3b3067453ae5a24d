"""User code as operators: a function for each frame, for batches, for rounds, or as a table function; models over batches; recurrent codecs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.catalog import query
from framewright.functions import images
from framewright.operators.audio import ordered_samples, per_stream
from framewright.operators.merge import round_zip
from framewright.schema import frames
from framewright.sources import synthetic


def script_element(df: DataFrame, process: Callable[[np.ndarray], np.ndarray], column: str = "payload") -> DataFrame:
    """process on the bytes of each frame, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: [process(np.frombuffer(bytes(p), np.uint8)).astype(np.uint8).tobytes() for p in b[column]]})

    return df.mapInPandas(run, df.schema)


# What scripts build on.
def invert(x: np.ndarray) -> np.ndarray:
    return 255 - x


def fill(value: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.full_like(x, value)


def apply_lut(lut: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: lut[x]


@query("k_script", "SELECT event_id, string_agg(CAST(255 - ascii(c) AS VARCHAR), ',' ORDER BY i) AS bytes FROM (SELECT event_id, unnest(string_split(props, '')) AS c, generate_subscripts(string_split(props, ''), 1) AS i FROM events) GROUP BY event_id")
def k_script(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.col("sequence").alias("event_id"), F.encode("props", "UTF-8").alias("payload"))
    hexed = F.hex("payload")
    each = F.transform(F.sequence(F.lit(0), F.length("payload") - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10))
    return script_element(f, invert).select("event_id", F.array_join(each, ",").alias("bytes"))


def batch_transform(df: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A hosted transform: batches in, batches out."""
    return df.mapInPandas(lambda batches: (transform(b) for b in batches), schema)


def batch_aggregate(df: DataFrame, aggregate: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A hosted aggregator: called with batches of rounds (round_zip), one row a round."""
    return round_zip(df).mapInPandas(lambda batches: (aggregate(b) for b in batches), schema)


@query("k_aggregator", "WITH r AS (SELECT value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS round FROM events) SELECT round, count(*) AS inputs, max(value) AS top FROM r GROUP BY round")
def k_aggregator(spark, sf_dir):
    def aggregate(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"round": b["round"], "inputs": [len(x) for x in b["items"]], "top": [max(i["value"] for i in x) for x in b["items"]]})

    return batch_aggregate(frames(spark, sf_dir), aggregate, "round long, inputs long, top double")


# --- pictures --------------------------------------------------------------------------------------------------------------------


@query("i_overlays", "SELECT sequence, CAST(64 AS INTEGER) AS width, CAST(48 AS INTEGER) AS height FROM (SELECT unnest(generate_series(0, 4)) AS sequence)")
def i_overlays(spark, sf_dir):
    """A clock, a box and a translucent picture on each frame, scaled to half and converted, in one pass through Python."""

    def draw(px: np.ndarray, row: pd.Series) -> np.ndarray:
        px = images.draw_text(px, images.clock_text(int(row["sequence"]) * 40_000_000), 2, 2, 1)
        px = images.draw_box(px, (0.25, 0.25, 0.5, 0.5), (255, 0, 0))
        px = images.over(px, np.full((10, 10, 4), 128, np.uint8), -3, 90)
        return images.scale(px, 64, 48)

    pictures = images.raster(synthetic.pixels(synthetic.videotestsrc(spark, 5, 128, 96)))
    return images.map_frames(pictures, draw, "RGBA", "NV12").select("sequence", "width", "height")


@query(
    "i_overlay_pixels",
    """WITH g AS (SELECT s.sequence, x.x, y.y, s.sequence * 40 AS v, x.x BETWEEN 32 AND 95 AND y.y BETWEEN 24 AND 71 AND NOT (x.x BETWEEN 34 AND 93 AND y.y BETWEEN 26 AND 69) AS edge, x.x < 7 AND y.y >= 90 AS pic
      FROM (SELECT unnest(generate_series(0, 4)) AS sequence) s, (SELECT unnest(generate_series(0, 127)) AS x) x, (SELECT unnest(generate_series(0, 95)) AS y) y),
    c AS (SELECT sequence, x, y, unnest([0, 1, 2]) AS channel, v, edge, pic FROM g)
    SELECT sequence, x, y, channel, CASE WHEN edge THEN CASE channel WHEN 0 THEN 255 ELSE 0 END WHEN pic THEN (90 * 128 + v * 127 + 127) // 255 ELSE v END AS v FROM c""",
)
def i_overlay_pixels(spark, sf_dir):
    """Every pixel of flat frames under a box's outline and a half translucent picture that the left and lower edges cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in b["id"]:
                px = np.full((96, 128, 4), (n * 40, n * 40, n * 40, 255), np.uint8)
                px = images.draw_box(px, (0.25, 0.25, 0.5, 0.5), (255, 0, 0))
                px = images.over(px, np.full((10, 10, 4), (90, 90, 90, 128), np.uint8), -3, 90)
                y, x, c = np.indices((96, 128, 3)).reshape(3, -1)
                yield pd.DataFrame({"sequence": n, "x": x, "y": y, "channel": c, "v": px[y, x, c]})

    return spark.range(5).mapInPandas(run, "sequence long, x long, y long, channel long, v long")


@query("o_png", "WITH f AS (SELECT unnest(generate_series(0, 2)) AS sequence), y AS (SELECT sequence, unnest(generate_series(0, 11)) AS y FROM f), g AS (SELECT *, unnest(generate_series(0, 15)) AS x FROM y) SELECT sequence, string_agg(lpad(hex((x + y + sequence * 4) % 256), 2, '0'), '' ORDER BY y, x) AS reds FROM g GROUP BY sequence")
def o_png(spark, sf_dir):
    """Frames to PNG and back."""
    pictures = images.raster(synthetic.pixels(synthetic.videotestsrc(spark, 3, 16, 12, pattern="gradient")))
    back = images.png_decode(images.png_encode(pictures))
    hexed = F.hex("payload")
    reds = F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda i: F.substring(hexed, i * 8 + 1, F.lit(2)))
    return back.select("sequence", F.array_join(reds, "").alias("reds"))


# --- IMA ADPCM -----------------------------------------------------------------------------------------------------------------------

# Fixed values of IMA ADPCM: how the step's place moves by the code's size, and the quantiser steps.
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]


def adpcm_encode(x: np.ndarray) -> list[int]:
    guess, place, out = 0, 0, []
    for v in x.astype(int).tolist():
        step, d = STEPS[place], v - guess
        code = min(7, abs(d) * 4 // step)
        moved = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
        guess = max(-32768, min(32767, guess + (moved if d >= 0 else -moved)))
        out.append(code | (8 if d < 0 else 0))
        place = max(0, min(88, place + MOVES[code]))
    return out


def adpcm_decode(codes: list[int]) -> np.ndarray:
    guess, place, out = 0, 0, []
    for c in codes:
        step, code = STEPS[place], c & 7
        moved = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
        guess = max(-32768, min(32767, guess + (-moved if c & 8 else moved)))
        out.append(guess)
        place = max(0, min(88, place + MOVES[code]))
    return np.asarray(out, float)


@query("t_adpcm")
def t_adpcm(spark, sf_dir):
    """Each buffer coded in four bits a sample and decoded again."""
    return per_stream(ordered_samples(spark, sf_dir), ["buffer"], lambda x: adpcm_decode(adpcm_encode(x)))


def fir_resampled(x: np.ndarray, up: int, down: int, taps: int = 16) -> np.ndarray:
    """Polyphase resampling with a Hann-windowed sinc."""
    cut, half = 1 / max(up, down), taps * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n * cut) * cut * up * (0.5 + 0.5 * np.cos(np.pi * n / half))
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    return np.convolve(spread, h)[half : half + len(spread)][::down]
