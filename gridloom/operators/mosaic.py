"""Elevation mosaics: the target grid, bilinear reprojection of blocks, first valid value wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import crs
from gridloom.functions.geo import num, pixels_across


def target_resolution(rasters: DataFrame) -> DataFrame:
    """One row: the finest pixel width and height over all sources, each by itself, 1e-4 where unusable.

    ``rasters`` has ``px, py`` in degrees.
    """
    finest = rasters.agg(F.min(F.abs("px")).alias("px"), F.min(F.abs("py")).alias("py"))
    usable = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c), F.col(c)).otherwise(num(1e-4)).alias(c)
    return finest.select(usable("px"), usable("py"))


def target_size(west: float, south: float, east: float, north: float, resolution: DataFrame) -> DataFrame:
    """``width, height`` of the mosaic, halves to even; an area under a pixel is an error."""
    return resolution.select(pixels_across(num(west), num(east), F.col("px")).alias("width"), pixels_across(num(south), num(north), F.col("py")).alias("height"))


def first_valid(pixels: DataFrame, *keys: str, value: str = "v", order: str = "src_seq") -> DataFrame:
    """For each pixel the value of the first source, by ``order``, that has one; null if none has.

    A min_by that skips nulls: it combines before the shuffle, so many sources of one pixel
    don't meet in one task.
    """
    valid = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(order))
    return pixels.groupBy(*keys).agg(F.min_by(F.when(valid.isNotNull(), F.col(value)), valid).alias(value))


def resample(values: np.ndarray, left: float, top: float, px: float, py: float, epsg: int, lat: np.ndarray, lon: np.ndarray, nodata: float = np.nan) -> np.ndarray:
    """Bilinear values of one band at the given places; NaN outside, and where a neighbour that counts has no data."""
    x, y = crs.projected(epsg, lat, lon)
    u, v = (x - left) / px - 0.5, (top - y) / py - 0.5
    h, w = values.shape
    inside = (u >= -0.5) & (u <= w - 0.5) & (v >= -0.5) & (v <= h - 0.5)
    u, v = np.clip(u, 0, w - 1), np.clip(v, 0, h - 1)
    c0, r0 = np.floor(u).astype(int), np.floor(v).astype(int)
    c1, r1 = np.minimum(c0 + 1, w - 1), np.minimum(r0 + 1, h - 1)
    fu, fv = u - c0, v - r0
    band = values.astype(float)
    if not np.isnan(nodata):
        band[band == nodata] = np.nan
    out = np.zeros(lat.shape)
    for r, c, f in ((r0, c0, (1 - fv) * (1 - fu)), (r0, c1, (1 - fv) * fu), (r1, c0, fv * (1 - fu)), (r1, c1, fv * fu)):
        out += np.where(f > 0, band[r, c] * f, 0.0)
    return np.where(inside, out, np.nan)


RASTER = "path string, src_seq long, band int, epsg int, left double, top double, px double, py double, width int, height int, dtype string, nodata double, data binary"


def reprojected(rasters: DataFrame, west: float, north: float, px: float, py: float, width: int, height: int, block: int = 256) -> DataFrame:
    """Blocks of the target grid from each raster (of ``RASTER``): ``band, block_y, block_x, src_seq, data``.

    ``data`` holds float64 values, NaN where the source has none.  A raster makes only the blocks
    its box reaches.
    """

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                values = np.frombuffer(r.data, r.dtype).reshape(r.height, r.width)
                rows = []
                for by in range(0, -(-height // block)):
                    for bx in range(0, -(-width // block)):
                        ys, xs = np.arange(by * block, min(height, (by + 1) * block)), np.arange(bx * block, min(width, (bx + 1) * block))
                        lat, lon = np.meshgrid(north - (ys + 0.5) * py, west + (xs + 0.5) * px, indexing="ij")
                        out = resample(values, r.left, r.top, r.px, r.py, r.epsg, lat, lon, r.nodata)
                        if not np.isnan(out).all():
                            rows.append((r.band, by, bx, r.src_seq, len(ys), len(xs), out.tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["band", "block_y", "block_x", "src_seq", "h", "w", "data"])

    return rasters.mapInPandas(blocks, "band int, block_y int, block_x int, src_seq long, h int, w int, data binary")


def mosaic_blocks(blocks: DataFrame) -> DataFrame:
    """Each block with its first valid values by source order.

    Blocks come sorted by source and are merged as they stream by, so a block that many
    sources reach needs the memory of two.
    """

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, shape = None, None, (0, 0)
        for frame in frames:
            for r in frame.itertuples(index=False):
                values = np.frombuffer(r.data).reshape(r.h, r.w)
                if (r.band, r.block_y, r.block_x) != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, *shape, held.tobytes())], columns=["band", "block_y", "block_x", "h", "w", "data"])
                    key, held, shape = (r.band, r.block_y, r.block_x), values.copy(), (r.h, r.w)
                else:
                    held = np.where(np.isnan(held), values, held)
        if key is not None:
            yield pd.DataFrame([(*key, *shape, held.tobytes())], columns=["band", "block_y", "block_x", "h", "w", "data"])

    keys = ("band", "block_y", "block_x")
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "src_seq")
    return dealt.mapInPandas(merged, "band int, block_y int, block_x int, h int, w int, data binary")


def check_sources(rasters: DataFrame) -> None:
    """ValueError unless all sources agree in their bands and types."""
    kinds = rasters.groupBy("path").agg(F.count_distinct("band").alias("bands"), F.first("dtype").alias("dtype")).select("bands", "dtype").distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"sources differ in bands or type: {[tuple(k) for k in kinds]}")
