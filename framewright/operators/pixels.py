"""Raw video. Kernels are column expressions over pixels (frame, x, y, r, g, b); frames as BINARY go through framewright.functions.images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.catalog import query, table

WIDTH = 40
# The green and blue keys' margin, the luma axis of hue rotation, Rec. 601 luma weights.
KEY_MARGIN = 40
LUMA_AXIS = (0.447_179_5, 0.877_952_5, 0.170_502_5)
LUMA = (0.299, 0.587, 0.114)

PIXELS_SQL = f"""pixels AS (SELECT p_partkey % {WIDTH} AS x, p_partkey // {WIDTH} AS y, (p_partkey * 37) % 256 AS r,
  (p_size * 29) % 256 AS g, CAST(floor(p_retailprice) AS BIGINT) % 256 AS b, p_partkey FROM part)"""


def pixels(spark, sf_dir) -> DataFrame:
    """Parts as the pixels of one picture, WIDTH wide."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") % WIDTH).alias("x"),
        F.expr(f"p_partkey div {WIDTH}").alias("y"),
        ((F.col("p_partkey") * 37) % 256).alias("r"),
        ((F.col("p_size").cast("long") * 29) % 256).alias("g"),
        (F.floor("p_retailprice") % 256).alias("b"),
        "p_partkey",
    )


def clamp8(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), c))


def key_alpha(method: str, value: int = 255) -> Column:
    """A new alpha: the value, or 0 where green or blue stands out from both other channels, else 255."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    keyed = {"green": (g - r > KEY_MARGIN) & (g - b > KEY_MARGIN), "blue": (b - r > KEY_MARGIN) & (b - g > KEY_MARGIN)}
    return F.lit(value) if method == "set" else F.when(keyed[method], 0).otherwise(255)


@query("i_alpha", f"WITH {PIXELS_SQL} SELECT x, y, CASE WHEN g - r > 40 AND g - b > 40 THEN 0 ELSE 255 END AS green, CASE WHEN b - r > 40 AND b - g > 40 THEN 0 ELSE 255 END AS blue FROM pixels")
def i_alpha(spark, sf_dir):
    return pixels(spark, sf_dir).select("x", "y", key_alpha("green").alias("green"), key_alpha("blue").alias("blue"))


def gamma_corrected(c: Column, gamma: float) -> Column:
    if gamma <= 0 or gamma == 1:
        return c
    return F.floor(clamp8(F.pow(c / 255.0, F.lit(1 / gamma)) * 255.0 + 0.5))


@query("i_gamma", f"WITH {PIXELS_SQL} SELECT x, y, CAST(floor(pow(r / 255.0, 1 / 2.2) * 255.0 + 0.5) AS BIGINT) AS r, CAST(floor(pow(g / 255.0, 1 / 2.2) * 255.0 + 0.5) AS BIGINT) AS g FROM pixels")
def i_gamma(spark, sf_dir):
    return pixels(spark, sf_dir).select("x", "y", *(gamma_corrected(F.col(c), 2.2).alias(c) for c in "rg"))


def balance_matrix(contrast: float, saturation: float, hue: float) -> list[list[float]]:
    """The 3 x 3 matrix M of contrast, saturation and hue (in half turns).

    With luma weights w and J = 1 w', a colour c splits into its grey J c and its chroma (I - J) c. Hue turns chroma about the luma axis, K being
    the axis's cross product: M = contrast (J + saturation (cos I + sin K) (I - J)).
    """
    one = np.eye(3)
    grey = np.outer(np.ones(3), LUMA)
    x, y, z = LUMA_AXIS
    turned = math.cos(hue * math.pi) * one + math.sin(hue * math.pi) * np.asarray([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return (contrast * (grey + saturation * turned @ (one - grey))).tolist()


def balanced(brightness: float, contrast: float, saturation: float, hue: float) -> dict[str, Column]:
    """Contrast about 128, brightness (of 255), saturation and hue, each channel cut to 8 bits."""
    m, shift = balance_matrix(contrast, saturation, hue), 128.0 * (1 - contrast) + 255.0 * brightness
    return {c: F.floor(clamp8(sum((F.col(x) * k for x, k in zip("rgb", row, strict=True)), F.lit(shift)))) for c, row in zip("rgb", m, strict=True)}


_BALANCE = (0.05, 1.2, 0.8, 0.1)


def _balance_sql() -> str:
    """The same by luma, differences and a turn about the axis, in float arithmetic of its own."""
    b, k, s, h = _BALANCE
    a = {c: f"(({c} - 128.0::DOUBLE) * {k}::DOUBLE + 128.0::DOUBLE + {b}::DOUBLE * 255.0::DOUBLE)" for c in "rgb"}
    luma = " + ".join(f"{w}::DOUBLE * {a[c]}" for w, c in zip(LUMA, "rgb", strict=True))
    x, y, z = (f"{v!r}::DOUBLE" for v in LUMA_AXIS)
    cross = {"r": f"{y} * db - {z} * dg", "g": f"{z} * dr - {x} * db", "b": f"{x} * dg - {y} * dr"}
    out = [f"CAST(floor(greatest(0, least(255, luma + {s}::DOUBLE * (d{c} * cos({h}::DOUBLE * pi()) + ({cross[c]}) * sin({h}::DOUBLE * pi()))))) AS BIGINT) AS {c}" for c in "rgb"]
    return f"WITH {PIXELS_SQL}, l AS (SELECT *, {luma} AS luma FROM pixels), d AS (SELECT *, {', '.join(f'{a[c]} - luma AS d{c}' for c in 'rgb')} FROM l) SELECT x, y, {', '.join(out)} FROM d"


@query("i_videobalance", _balance_sql())
def i_videobalance(spark, sf_dir):
    return pixels(spark, sf_dir).select("x", "y", *(v.alias(c) for c, v in balanced(*_BALANCE).items()))



def flipped(df: DataFrame, method: str, w: Column, h: Column) -> DataFrame:
    """Pixels moved; w and h are the picture's size."""
    x, y = F.col("x"), F.col("y")
    to = {
        "horizontal-flip": (w - 1 - x, y),
        "vertical-flip": (x, h - 1 - y),
        "rotate-180": (w - 1 - x, h - 1 - y),
        "clockwise": (h - 1 - y, x),
        "counterclockwise": (y, w - 1 - x),
        "transpose": (y, x),
        "none": (x, y),
    }[method]
    return df.withColumns({"x": to[0], "y": to[1]})


@query("i_videoflip", f"WITH {PIXELS_SQL}, h AS (SELECT max(y) + 1 AS h FROM pixels) SELECT p_partkey, {WIDTH} - 1 - x AS mx, h - 1 - y AS cx, x AS cy FROM pixels, h")
def i_videoflip(spark, sf_dir):
    p = pixels(spark, sf_dir)
    p = p.join(F.broadcast(p.agg((F.max("y") + 1).alias("h"))))  # one row
    w, h = F.lit(WIDTH), F.col("h")
    mirrored = flipped(p, "horizontal-flip", w, h).select("p_partkey", F.col("x").alias("mx"))
    turned = flipped(p, "clockwise", w, h).select("p_partkey", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return mirrored.join(turned, "p_partkey")


def cropped(df: DataFrame, left: int, right: int, top: int, bottom: int, w: Column, h: Column) -> DataFrame:
    inside = (F.col("x") >= left) & (F.col("x") < w - right) & (F.col("y") >= top) & (F.col("y") < h - bottom)
    return df.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


@query("i_videocrop", f"WITH {PIXELS_SQL} SELECT x - 3 AS x, y - 2 AS y, r FROM pixels WHERE x >= 3 AND x < {WIDTH} - 5 AND y >= 2")
def i_videocrop(spark, sf_dir):
    return cropped(pixels(spark, sf_dir), 3, 5, 2, 0, F.lit(WIDTH), F.lit(2**40)).select("x", "y", "r")


def boxed(df: DataFrame, border: int, fill: int, w: int) -> DataFrame:
    """A border of fill on all sides (of the rows that there are)."""
    rows = df.agg(F.max("y").alias("top")).where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") + 2 * border)).alias("y"))
    grid = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w + 2 * border - 1).cast("long"))))
    moved = df.withColumns({"x": F.col("x") + border, "y": F.col("y") + border})
    return grid.join(moved, ["x", "y"], "left").withColumn("r", F.coalesce("r", F.lit(fill)))


@query("i_videobox", f"WITH {PIXELS_SQL}, g AS (SELECT unnest(generate_series(0, max(y) + 4)) AS y FROM pixels), q AS (SELECT y, unnest(generate_series(0, {WIDTH} + 3)) AS x FROM g) SELECT q.x, q.y, coalesce(p.r, 7) AS r FROM q LEFT JOIN pixels p ON p.x = q.x - 2 AND p.y = q.y - 2")
def i_videobox(spark, sf_dir):
    return boxed(pixels(spark, sf_dir), 2, 7, WIDTH).select("x", "y", "r")


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601, limited range, 8-bit fixed point."""
    shift = lambda c: F.shiftright(c + 128, 8)
    return clamp8(shift(66 * r + 129 * g + 25 * b) + 16), clamp8(shift(-38 * r - 74 * g + 112 * b) + 128), clamp8(shift(112 * r - 94 * g - 18 * b) + 128)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    c, d, e = y - 16, u - 128, v - 128
    shift = lambda x: clamp8(F.shiftright(x + 128, 8))
    return shift(298 * c + 409 * e), shift(298 * c - 100 * d - 208 * e), shift(298 * c + 516 * d)


@query(
    "i_videoconvert",
    f"""WITH {PIXELS_SQL}, c AS (SELECT x, y, greatest(0, least(255, ((66 * r + 129 * g + 25 * b + 128) >> 8) + 16)) AS luma, greatest(0, least(255, ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128)) AS u, greatest(0, least(255, ((112 * r - 94 * g - 18 * b + 128) >> 8) + 128)) AS v FROM pixels)
    SELECT x, y, luma, u, v, greatest(0, least(255, (298 * (luma - 16) + 409 * (v - 128) + 128) >> 8)) AS r2, greatest(0, least(255, (298 * (luma - 16) - 100 * (u - 128) - 208 * (v - 128) + 128) >> 8)) AS g2, greatest(0, least(255, (298 * (luma - 16) + 516 * (u - 128) + 128) >> 8)) AS b2 FROM c""",
)
def i_videoconvert(spark, sf_dir):
    luma, u, v = rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))
    p = pixels(spark, sf_dir).select("x", "y", luma.alias("luma"), u.alias("u"), v.alias("v"))
    r, g, b = yuv_to_rgb(F.col("luma"), F.col("u"), F.col("v"))
    return p.select("*", r.alias("r2"), g.alias("g2"), b.alias("b2"))


def axis(out: str, dst: int | str, src: int | str) -> tuple[str, str, str]:
    """SQL of the two source places and the Q16 weight for a place on a scaled axis, centred on half pixels."""
    pos = f"greatest(0, least((cast({src} as bigint) - 1) * 65536, ((2 * {out} + 1) * {src} * 32768) div {dst} - 32768))"
    return f"({pos} div 65536)", f"least({pos} div 65536 + 1, {src} - 1)", f"({pos} % 65536)"


def scaled(df: DataFrame, channel: str, w: int, w2: int, size: DataFrame) -> DataFrame:
    """Bilinear to half the height and w2 columns. size: one row with h, the height. A weighted sum over at most four neighbours of each output pixel."""
    x0, x1, fx = axis("ox", w2, w)
    y0, y1, fy = axis("oy", "h2", "h")
    rows = size.withColumn("h2", F.expr("h div 2")).withColumn("oy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("h div 2") - 1)))
    grid = rows.withColumn("ox", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w2 - 1).cast("long"))))
    grid = grid.select("ox", "oy", F.expr(x0).alias("x0"), F.expr(x1).alias("x1"), F.expr(fx).alias("fx"), F.expr(y0).alias("y0"), F.expr(y1).alias("y1"), F.expr(fy).alias("fy"))
    corner = lambda x, y, wx, wy: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(f"({wx}) * ({wy})").alias("w"))
    near = grid.withColumn("n", F.explode(F.array(corner("x0", "y0", "65536 - fx", "65536 - fy"), corner("x1", "y0", "fx", "65536 - fy"), corner("x0", "y1", "65536 - fx", "fy"), corner("x1", "y1", "fx", "fy"))))
    near = near.select("ox", "oy", "n.x", "n.y", "n.w").join(df.select("x", "y", channel), ["x", "y"])
    return near.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(F.shiftright(F.sum(F.col("w") * F.col(channel)) + (1 << 31), 32).alias(channel))


W2 = 25


def _axis_sql(out: str, dst: str, src: str) -> str:
    return f"greatest(0, least(({src} - 1) * 65536, ((2 * {out} + 1) * {src} * 32768) // {dst} - 32768))"


@query(
    "i_videoscale",
    f"""WITH {PIXELS_SQL}, s AS (SELECT max(y) + 1 AS h, (max(y) + 1) // 2 AS h2 FROM pixels), g AS (SELECT h, h2, unnest(generate_series(0, h2 - 1)) AS oy FROM s), q AS (SELECT h, h2, oy, unnest(generate_series(0, {W2 - 1})) AS ox FROM g),
    p AS (SELECT ox, oy, h, {_axis_sql('ox', str(W2), str(WIDTH))} AS px, {_axis_sql('oy', 'h2', 'h')} AS py FROM q),
    a AS (SELECT ox, oy, px // 65536 AS x0, least(px // 65536 + 1, {WIDTH} - 1) AS x1, px % 65536 AS fx, py // 65536 AS y0, least(py // 65536 + 1, h - 1) AS y1, py % 65536 AS fy FROM p)
    SELECT a.ox AS x, a.oy AS y, CAST(((p00.r * (65536 - fx) + p10.r * fx) * (65536 - fy) + (p01.r * (65536 - fx) + p11.r * fx) * fy + 2147483648) >> 32 AS BIGINT) AS r FROM a
    JOIN pixels p00 ON p00.x = x0 AND p00.y = y0 JOIN pixels p10 ON p10.x = x1 AND p10.y = y0 JOIN pixels p01 ON p01.x = x0 AND p01.y = y1 JOIN pixels p11 ON p11.x = x1 AND p11.y = y1""",
)
def i_videoscale(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return scaled(p, "r", WIDTH, W2, p.agg((F.max("y") + 1).alias("h")))


def deinterlaced(df: DataFrame, channel: str, method: str, keep_top: bool = True) -> DataFrame:
    """linear: rows of the discarded field become the mean of their neighbours; blend: every row the mean with the next. Outer rows stay."""
    row = lambda d, n: df.select("x", (F.col("y") + d).alias("y"), F.col(channel).alias(n))
    j = df.join(row(1, "_above"), ["x", "y"], "left").join(row(-1, "_below"), ["x", "y"], "left")
    if method == "linear":
        lost = (F.col("y") % 2 == (1 if keep_top else 0)) & F.col("_above").isNotNull() & F.col("_below").isNotNull()
        value = F.when(lost, F.floor((F.col("_above") + F.col("_below")) / 2)).otherwise(F.col(channel))
    else:
        value = F.when(F.col("_below").isNotNull(), F.floor((F.col(channel) + F.col("_below")) / 2)).otherwise(F.col(channel))
    return j.withColumn(channel, value).drop("_above", "_below")


@query("i_deinterlace", f"WITH {PIXELS_SQL} SELECT p.x, p.y, CASE WHEN p.y % 2 = 1 AND b.r IS NOT NULL THEN (a.r + b.r) // 2 ELSE p.r END AS linear, CASE WHEN b.r IS NOT NULL THEN (p.r + b.r) // 2 ELSE p.r END AS blend FROM pixels p LEFT JOIN pixels a ON a.x = p.x AND a.y = p.y - 1 LEFT JOIN pixels b ON b.x = p.x AND b.y = p.y + 1")
def i_deinterlace(spark, sf_dir):
    p = pixels(spark, sf_dir).select("x", "y", "r")
    return deinterlaced(p, "r", "linear").withColumnRenamed("r", "linear").join(deinterlaced(p, "r", "blend").withColumnRenamed("r", "blend"), ["x", "y"])


@query("t_yuyv_to_i420", f"WITH {PIXELS_SQL}, c AS (SELECT x // 2 AS cx, y, max(CASE WHEN x % 2 = 0 THEN g END) AS u, max(CASE WHEN x % 2 = 0 THEN b END) AS v FROM pixels GROUP BY ALL) SELECT cx, y // 2 AS cy, CAST((sum(u) + 1) // 2 AS BIGINT) AS u, CAST((sum(v) + 1) // 2 AS BIGINT) AS v FROM c GROUP BY ALL HAVING count(*) = 2")
def t_yuyv_to_i420(spark, sf_dir):
    """Packed 4:2:2 to planar 4:2:0: luma stays; each pair of rows shares the rounded mean of its chroma."""
    even = lambda c: F.max(F.when(F.col("x") % 2 == 0, F.col(c)))
    c = pixels(spark, sf_dir).groupBy(F.expr("x div 2").alias("cx"), "y").agg(even("g").alias("u"), even("b").alias("v"))
    c = c.groupBy("cx", F.expr("y div 2").alias("cy")).agg(F.expr("(sum(u) + 1) div 2").alias("u"), F.expr("(sum(v) + 1) div 2").alias("v"), F.count(F.lit(1)).alias("n"))
    return c.where("n = 2").drop("n")
