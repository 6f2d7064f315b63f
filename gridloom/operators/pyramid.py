"""Tiles of a zoom level cut from georeferenced chunks.

Each chunk goes to the tiles its box reaches; a tile takes, for every pixel, the first chunk
in order that covers it.  A task holds one tile and the few chunks that meet it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import ORIGIN, TILE_PIXELS, num
from gridloom.operators.raster import SIGNATURE, decode_png, encode_png
from gridloom.sources import tiff


def decode_image(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG or a plain TIFF."""
    return decode_png(data) if data.startswith(SIGNATURE) else tiff.pixels(data).transpose(1, 2, 0)


def tile_span(zoom: int) -> float:
    """Meters across a tile."""
    return 2 * ORIGIN / 2**zoom


def flipped(zoom: int, y: Column) -> Column:
    """Between rows counted from the north and from the south."""
    return F.lit(2**zoom - 1).cast("long") - y


def tiles_of(chunks: DataFrame, zoom: int) -> DataFrame:
    """Chunks (``xmin, ymin, xmax, ymax`` in meters) with each ``x, y`` of the tiles that their interior meets."""
    span, tiny = num(tile_span(zoom)), num(1e-9)
    first = lambda v: F.floor(v / span + tiny).cast("long")
    last = lambda v: F.ceil(v / span - tiny).cast("long") - 1
    west, east = F.col("xmin") + num(ORIGIN), F.col("xmax") + num(ORIGIN)
    north, south = num(ORIGIN) - F.col("ymax"), num(ORIGIN) - F.col("ymin")
    upto = lambda a, b: F.explode(F.sequence(a, F.greatest(a, b)))
    return chunks.withColumn("x", upto(first(west), last(east))).withColumn("y", upto(first(north), last(south)))


def _sampled(image: np.ndarray, u: np.ndarray, v: np.ndarray, how: str) -> np.ndarray:
    h, w = image.shape[:2]
    if how == "near":
        return image[np.clip(np.floor(v).astype(int), 0, h - 1), np.clip(np.floor(u).astype(int), 0, w - 1)]
    u, v = np.clip(u - 0.5, 0, w - 1), np.clip(v - 0.5, 0, h - 1)
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fu, fv = (u - x0)[..., None], (v - y0)[..., None]
    mixed = (image[y0, x0] * (1 - fu) + image[y0, x1] * fu) * (1 - fv) + (image[y1, x0] * (1 - fu) + image[y1, x1] * fu) * fv
    return np.rint(mixed).astype(image.dtype)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


#: Kernels that are widened where a tile's pixels are larger than a chunk's.
KERNELS = {"average": lambda x: np.where(np.abs(x) <= 0.5, 1.0, 0.0), "cubic": _cubic, "lanczos": _lanczos}
RESAMPLING = ("near", "bilinear", *KERNELS)


def _weights(kernel, places: np.ndarray, size: int) -> np.ndarray:
    """(places, size): each place's share of every pixel; places are in the chunk's pixels."""
    step = max(float(places[1] - places[0]) if len(places) > 1 else 1.0, 1.0)
    w = kernel((np.arange(size)[None, :] + 0.5 - np.clip(places, 0.5, size - 0.5)[:, None]) / step)
    total = w.sum(axis=1, keepdims=True)
    nearest = np.clip(np.floor(places), 0, size - 1)[:, None] == np.arange(size)
    return np.where(np.abs(total) > 1e-9, w / np.where(np.abs(total) > 1e-9, total, 1), nearest)


def _filtered(image: np.ndarray, u: np.ndarray, v: np.ndarray, how: str) -> np.ndarray:
    """(len(v), len(u), channels): the chunk at a grid of places, by a separable kernel."""
    rows = np.tensordot(_weights(KERNELS[how], v, image.shape[0]), image.astype(float), (1, 0))
    both = np.tensordot(rows, _weights(KERNELS[how], u, image.shape[1]), (1, 1)).transpose(0, 2, 1)
    return np.clip(np.rint(both), 0, np.iinfo(image.dtype).max if image.dtype.kind == "u" else np.inf).astype(image.dtype)


def pyramid_tiles(chunks: DataFrame, zoom: int, resampling: str = "lanczos", pixels: int = TILE_PIXELS) -> DataFrame:
    """``z, x, y, content`` (RGBA PNG, transparent where no chunk reaches) from chunks with ``row, col`` and PNG or TIFF ``content``."""
    if resampling not in RESAMPLING:
        raise ValueError(f"resampling is one of {', '.join(RESAMPLING)}")

    def cut(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = (int(k) for k in key)
        span = tile_span(zoom)
        step = span / pixels
        east, north = np.meshgrid(-ORIGIN + x * span + (np.arange(pixels) + 0.5) * step, ORIGIN - y * span - (np.arange(pixels) + 0.5) * step)
        out, empty = np.zeros((pixels, pixels, 4), np.uint8), np.ones((pixels, pixels), bool)
        for c in frame.sort_values(["row", "col"]).itertuples(index=False):
            image = decode_image(c.content)
            image = np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]
            inside = empty & (east >= c.xmin) & (east < c.xmax) & (north > c.ymin) & (north <= c.ymax)
            if inside.any():
                u = (east[inside] - c.xmin) / (c.xmax - c.xmin) * image.shape[1]
                v = (c.ymax - north[inside]) / (c.ymax - c.ymin) * image.shape[0]
                if resampling in KERNELS:
                    rows, cols = inside.any(axis=1), inside.any(axis=0)
                    across = (east[0, cols] - c.xmin) / (c.xmax - c.xmin) * image.shape[1]
                    down = (c.ymax - north[rows, 0]) / (c.ymax - c.ymin) * image.shape[0]
                    whole = _filtered(image, across, down, resampling)
                    out[inside, :3] = whole[inside[np.ix_(rows, cols)]]
                else:
                    out[inside, :3] = _sampled(image, u, v, resampling)
                out[inside, 3] = 255
                empty &= ~inside
        return pd.DataFrame([(zoom, x, y, encode_png(out))], columns=["z", "x", "y", "content"])

    dealt = tiles_of(chunks, zoom).select("x", "y", "row", "col", "xmin", "ymin", "xmax", "ymax", "content")
    return dealt.groupBy("x", "y").applyInPandas(cut, "z int, x long, y long, content binary")
