"""Image jobs on Spark's ``image`` source struct (BGR, HWC bytes).

Pixel work runs in NumPy inside Arrow-batched pandas UDFs; crop boxes are
plain SQL columns from a seeded hash so they are reproducible per path.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studybank import constants as K

# DataType objects (not DDL strings): module-level UDFs are re-created on the
# Python workers, where no session exists to parse a DDL string.
IMAGE_TYPE = T.StructType([T.StructField("height", T.IntegerType()),
                           T.StructField("width", T.IntegerType()),
                           T.StructField("nChannels", T.IntegerType()),
                           T.StructField("data", T.BinaryType())])


def png_bytes(px: np.ndarray) -> bytes:
    """Encode an ``(h, w)`` or ``(h, w, 3)`` uint8 array as PNG (test inputs)."""
    px = np.asarray(px, dtype=np.uint8)
    colour = 0 if px.ndim == 2 else 2
    h, w = px.shape[:2]
    raw = b"".join(b"\x00" + px[r].tobytes() for r in range(h))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return (struct.pack(">I", len(data)) + tag + data
                + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _groups(*columns: pd.Series):
    """(places, values) of the rows that agree in all columns."""
    found: dict[tuple, list[int]] = {}
    for r, values in enumerate(zip(*columns)):
        found.setdefault(tuple(int(v) for v in values), []).append(r)
    for values, rows in found.items():
        yield np.array(rows), values


def _stack(data: pd.Series, rows: np.ndarray, h: int, w: int, c: int) -> np.ndarray:
    """Pixels of images of one shape as one array (image, row, column, channel)."""
    raw = b"".join(bytes(data.iloc[r]) for r in rows)
    return np.frombuffer(raw, dtype=np.uint8).reshape(len(rows), h, w, c)


class _Images:
    """Images of a batch, put together from groups of one shape."""

    def __init__(self, n: int):
        self.rows: list[tuple | None] = [None] * n

    def put(self, places: np.ndarray, px: np.ndarray) -> None:
        px = np.ascontiguousarray(px)
        for r, one in zip(places, px):
            self.rows[r] = (*px.shape[1:], one.tobytes())

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.rows, columns=["height", "width", "nChannels", "data"])


@F.pandas_udf(IMAGE_TYPE)
def _to_rgb(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.DataFrame:
    out = _Images(len(h))
    for rows, (hh, ww, cc) in _groups(h, w, c):
        px = _stack(data, rows, hh, ww, cc)
        out.put(rows, np.repeat(px, 3, axis=3) if cc == 1 else px[..., 2::-1])   # BGR[A] -> RGB
    return out.frame()


def to_rgb(df: DataFrame) -> DataFrame:
    """Any channel count -> 3-channel RGB (grey repeated, alpha dropped)."""
    return df.withColumn("img", _to_rgb("height", "width", "nChannels", "data")).select(
        *[c for c in df.columns if c not in ("height", "width", "nChannels", "data", "mode")],
        "img.height", "img.width", "img.nChannels", "img.data")


def _bilinear(px: np.ndarray, nh: int, nw: int) -> np.ndarray:
    """Images of one shape (image, row, column, channel) resized, rounded to bytes."""
    h, w = px.shape[1:3]
    ys = (np.arange(nh) + 0.5) * h / nh - 0.5
    xs = (np.arange(nw) + 0.5) * w / nw - 0.5
    y0 = np.clip(np.floor(ys).astype(int), 0, h - 1)
    x0 = np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1, x1 = np.clip(y0 + 1, 0, h - 1), np.clip(x0 + 1, 0, w - 1)
    wy = np.clip(ys - y0, 0, 1)[None, :, None, None]
    wx = np.clip(xs - x0, 0, 1)[None, None, :, None]
    f = px.astype(np.float64)
    top = f[:, y0][:, :, x0] * (1 - wx) + f[:, y0][:, :, x1] * wx
    bot = f[:, y1][:, :, x0] * (1 - wx) + f[:, y1][:, :, x1] * wx
    return np.clip(np.rint(top * (1 - wy) + bot * wy), 0, 255).astype(np.uint8)


def _resize_udf(size: int):
    @F.pandas_udf(IMAGE_TYPE)
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = _Images(len(h))
        for rows, (hh, ww, cc) in _groups(h, w, c):
            s = size / min(hh, ww)
            out.put(rows, _bilinear(_stack(data, rows, hh, ww, cc), max(1, round(hh * s)), max(1, round(ww * s))))
        return out.frame()
    return run


def resize(df: DataFrame, size: int = K.RESIZE_SHORTER_SIDE) -> DataFrame:
    """Shorter side -> ``size`` (aspect ratio kept), bilinear."""
    return df.withColumn("img", _resize_udf(size)("height", "width", "nChannels", "data")).select(
        *[c for c in df.columns if c not in ("height", "width", "nChannels", "data")],
        "img.height", "img.width", "img.nChannels", "img.data")


def _unit(seed: int, key: Column, tag: str) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.lit(tag)))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))


def crop_boxes(df: DataFrame, scale=K.CROP_SCALE, seed: int = 42, mode: str = "random",
               key: str = "path") -> DataFrame:
    """Square crop boxes ``(box_x, box_y, box_side)``: ``center`` takes the
    largest centred square; ``random`` draws an area share in ``scale`` and a
    position from a seeded hash of ``key`` (reproducible)."""
    h, w = F.col("height"), F.col("width")
    short = F.least(h, w)
    if mode == "center":
        side = short
        x = F.floor((w - side) / 2)
        y = F.floor((h - side) / 2)
    else:
        share = F.lit(scale[0]) + (F.lit(scale[1]) - F.lit(scale[0])) * _unit(seed, F.col(key), "s")
        side = F.least(short, F.greatest(F.lit(1), F.floor(F.sqrt(share * h * w))))
        x = F.floor(_unit(seed, F.col(key), "x") * (w - side + 1))
        y = F.floor(_unit(seed, F.col(key), "y") * (h - side + 1))
    return df.withColumn("box_x", x.cast("int")).withColumn("box_y", y.cast("int")) \
             .withColumn("box_side", side.cast("int"))


def _tensor_udf(size: int, mean, std):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(h: pd.Series, w: pd.Series, c: pd.Series, data: pd.Series, bx: pd.Series,
            by: pd.Series, bs: pd.Series) -> pd.Series:
        m = np.asarray(mean).reshape(1, 3, 1, 1)
        s = np.asarray(std).reshape(1, 3, 1, 1)
        out: list = [None] * len(h)
        for rows, (hh, ww, cc, x, y, side) in _groups(h, w, c, bx, by, bs):
            px = _stack(data, rows, hh, ww, cc)[:, y:y + side, x:x + side]
            px = _bilinear(px, size, size).astype(np.float32) / 255.0
            chw = ((np.transpose(px, (0, 3, 1, 2)) - m) / s).astype(np.float32).reshape(len(rows), -1)
            for r, one in zip(rows, chw):
                out[r] = one
        return pd.Series(out)
    return run


def to_tensor(df: DataFrame, size: int = K.CROP_SIZE, mean=K.IMAGE_MEAN, std=K.IMAGE_STD,
              out: str = "tensor") -> DataFrame:
    """Crop the box, resize to ``size``², scale to [0, 1], normalise per channel
    and flatten channel-first (expects RGB input)."""
    return df.withColumn(out, _tensor_udf(size, mean, std)(
        "height", "width", "nChannels", "data", "box_x", "box_y", "box_side"))


def image_struct(df: DataFrame) -> Column:
    return F.struct("height", "width", "nChannels", "data")
