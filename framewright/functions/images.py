"""Frames as NumPy arrays [height, width, channels] of uint8: conversion, geometry, drawing and masks, and the pandas functions that apply them to BINARY columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import containers


def unpack(data: bytes, fmt: str, width: int, height: int) -> np.ndarray:
    """RGBA of RGBA, BGRA, RGB, I420, NV12 or YUYV bytes."""
    raw = np.frombuffer(data, np.uint8)
    if fmt in ("RGBA", "BGRA"):
        px = raw.reshape(height, width, 4)
        return px if fmt == "RGBA" else px[..., [2, 1, 0, 3]]
    if fmt == "RGB":
        return np.dstack([raw.reshape(height, width, 3), np.full((height, width), 255, np.uint8)])
    n = width * height
    if fmt == "YUYV":
        px = raw.reshape(height, width // 2, 4).astype(np.int64)
        y = px[..., [0, 2]].reshape(height, width)
        u, v = (np.repeat(px[..., i], 2, axis=1) for i in (1, 3))
    else:
        y, chroma = raw[:n].reshape(height, width).astype(np.int64), raw[n:]
        half = (height // 2, width // 2)
        pair = chroma.reshape(*half, 2).transpose(2, 0, 1) if fmt == "NV12" else chroma.reshape(2, *half)
        u, v = (np.repeat(np.repeat(p.astype(np.int64), 2, axis=0), 2, axis=1) for p in pair)
    c, d, e = y - 16, u - 128, v - 128
    rgb = np.stack([298 * c + 409 * e, 298 * c - 100 * d - 208 * e, 298 * c + 516 * d], axis=-1) + 128 >> 8
    return np.dstack([np.clip(rgb, 0, 255).astype(np.uint8), np.full((height, width), 255, np.uint8)])


def pack(px: np.ndarray, fmt: str) -> bytes:
    """The bytes of RGBA pixels in a format; chroma is the rounded mean of its block."""
    if fmt in ("RGBA", "BGRA", "RGB"):
        return np.ascontiguousarray(px if fmt == "RGBA" else px[..., [2, 1, 0, 3]] if fmt == "BGRA" else px[..., :3]).tobytes()
    r, g, b = (px[..., i].astype(np.int64) for i in range(3))
    y = np.clip((66 * r + 129 * g + 25 * b + 128 >> 8) + 16, 0, 255).astype(np.uint8)
    u = np.clip((-38 * r - 74 * g + 112 * b + 128 >> 8) + 128, 0, 255)
    v = np.clip((112 * r - 94 * g - 18 * b + 128 >> 8) + 128, 0, 255)
    h, w = y.shape
    if fmt == "YUYV":
        mean = lambda p: (p.reshape(h, w // 2, 2).sum(axis=2) + 1) // 2
        return np.stack([y[:, 0::2], mean(u), y[:, 1::2], mean(v)], axis=-1).astype(np.uint8).tobytes()
    mean = lambda p: ((p.reshape(h // 2, 2, w // 2, 2).sum(axis=(1, 3)) + 2) // 4).astype(np.uint8)
    both = np.stack([mean(u), mean(v)], axis=-1 if fmt == "NV12" else 0)
    return y.tobytes() + both.tobytes()


def scale(px: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, centred on half pixels, with weights in 65536ths."""

    def axis(n_out: int, n_in: int):
        pos = np.clip(((2 * np.arange(n_out, dtype=np.int64) + 1) * n_in * 32768) // n_out - 32768, 0, (n_in - 1) << 16)
        low = pos >> 16
        return low, np.minimum(low + 1, n_in - 1), pos & 0xFFFF

    x0, x1, fx = axis(width, px.shape[1])
    y0, y1, fy = axis(height, px.shape[0])
    p, fx, fy, one = px.astype(np.int64), fx[None, :, None], fy[:, None, None], 1 << 16
    top = p[y0][:, x0] * (one - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (one - fx) + p[y1][:, x1] * fx
    return (top * (one - fy) + low * fy + (1 << 31) >> 32).astype(np.uint8)


def over(canvas: np.ndarray, picture: np.ndarray, x: int, y: int, alpha: int = 255) -> np.ndarray:
    """picture over canvas at (x, y), cut at the edges; alpha multiplies the picture's own."""
    out = canvas.copy()
    y0, x0, y1, x1 = max(0, y), max(0, x), min(canvas.shape[0], y + picture.shape[0]), min(canvas.shape[1], x + picture.shape[1])
    if y0 < y1 and x0 < x1:
        src = picture[y0 - y : y1 - y, x0 - x : x1 - x].astype(np.int64)
        a = (src[..., 3:] * alpha + 127) // 255
        dst = out[y0:y1, x0:x1].astype(np.int64)
        out[y0:y1, x0:x1, :3] = (src[..., :3] * a + dst[..., :3] * (255 - a) + 127) // 255
        out[y0:y1, x0:x1, 3:] = a + (dst[..., 3:] * (255 - a) + 127) // 255
    return out


def draw_box(px: np.ndarray, box: tuple[float, float, float, float], colour: tuple[int, int, int], thick: int = 2) -> np.ndarray:
    """The outline of a box x, y, w, h in parts of the picture."""
    h, w = px.shape[:2]
    x0, y0, x1, y1 = (int(round(v)) for v in (box[0] * w, box[1] * h, (box[0] + box[2]) * w, (box[1] + box[3]) * h))
    x0, x1, y0, y1 = max(0, x0), min(w, x1), max(0, y0), min(h, y1)
    out = px.copy()
    for part in (np.s_[y0 : y0 + thick, x0:x1], np.s_[max(y0, y1 - thick) : y1, x0:x1], np.s_[y0:y1, x0 : x0 + thick], np.s_[y0:y1, max(x0, x1 - thick) : x1]):
        out[part][..., :3] = colour
    return out


# A 3x5 font of digits and the signs of a clock, row by row.
GLYPHS = {c: rows.split() for c, rows in {"0": "111 101 101 101 111", "1": "010 110 010 010 111", "2": "111 001 111 100 111", "3": "111 001 111 001 111", "4": "101 101 111 001 001", "5": "111 100 111 001 111", "6": "111 100 111 101 111", "7": "111 001 010 010 010", "8": "111 101 111 101 111", "9": "111 101 111 001 111", ":": "000 010 000 010 000", ".": "000 000 000 000 010", "-": "000 000 111 000 000"}.items()}


def draw_text(px: np.ndarray, text: str, x: int, y: int, size: int = 2, colour: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Digits and clock signs; others leave a gap."""
    out = px.copy()
    for i, c in enumerate(text):
        for r, row in enumerate(GLYPHS.get(c, ())):
            for k, bit in enumerate(row):
                if bit == "1":
                    out[y + r * size : y + (r + 1) * size, x + (4 * i + k) * size : x + (4 * i + k + 1) * size, :3] = colour
    return out


def clock_text(ns: int) -> str:
    ms = ns // 1_000_000
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def mask_of(coefficients: np.ndarray, prototypes: np.ndarray, coverage: float) -> np.ndarray:
    """Where the sigmoid of the prototypes' weighted sum ([k] by [k, h, w]) reaches the coverage."""
    return 1 / (1 + np.exp(-np.tensordot(coefficients, prototypes, axes=1))) >= coverage


def mask_bounds(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the covered part; None if there is none."""
    ys, xs = np.nonzero(mask)
    return (int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1) if len(xs) else None


def nchw(px: np.ndarray, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """A picture as a normalised tensor, channels first."""
    return ((px[..., :3] / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)


def map_frames(df: DataFrame, f: Callable[[np.ndarray, pd.Series], np.ndarray], fmt: str = "RGBA", out: str | None = None) -> DataFrame:
    """f on the picture of each row (payload, width, height and what else the row has). Steps compose in f: one pass through Python for all of them."""
    out = out or fmt
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payload, width, height = [], [], []
            for _, row in b.iterrows():
                px = f(unpack(bytes(row["payload"]), fmt, int(row["width"]), int(row["height"])), row)
                payload.append(pack(px, out))
                height.append(px.shape[0])
                width.append(px.shape[1])
            yield b.assign(payload=payload, width=width, height=height)[columns]

    return df.mapInPandas(run, df.schema)


def png_encode(df: DataFrame) -> DataFrame:
    """payload: RGBA to PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            png = [containers.write_png(unpack(bytes(p), "RGBA", int(w), int(h))) for p, w, h in zip(b["payload"], b["width"], b["height"], strict=True)]
            yield b.assign(payload=png)

    return df.mapInPandas(run, df.schema)


def png_decode(df: DataFrame, payload: str = "payload") -> DataFrame:
    """payload: PNG to RGBA, with width and height."""
    columns = [c for c in df.columns if c not in ("width", "height", payload)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            px = [containers.read_png(bytes(p)) for p in b[payload]]
            yield b[columns].assign(width=[p.shape[1] for p in px], height=[p.shape[0] for p in px], payload=[p.tobytes() for p in px])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.select(*columns, payload).mapInPandas(run, f"{schema}, width int, height int, payload binary")


def raster(df: DataFrame) -> DataFrame:
    """Pixels (sequence, x, y, r, g, b) as RGBA frames: sequence, width, height, payload. A frame is one row."""
    px = F.struct("y", "x", "r", "g", "b")
    rows = df.groupBy("sequence").agg(F.array_sort(F.collect_list(px)).alias("p"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payload = [np.asarray([[q["r"], q["g"], q["b"], 255] for q in p], np.uint8).tobytes() for p in b["p"]]
            yield b[["sequence", "width", "height"]].assign(payload=payload)

    return rows.mapInPandas(run, "sequence long, width int, height int, payload binary")
