"""Images: decode and encode PNG, Lanczos reduction, composites of windows, splits.

Pixels are numpy arrays in Arrow-fed Python functions; which tiles go where is planned by
ordinary joins and aggregations before.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import split_axis

MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}
_COLOR = {1: 0, 2: 4, 3: 2, 4: 6}
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"
REDUCE_FROM = 0.25  # scale from which a box filter shrinks first
GAP = 2.0


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of (height, width, channels), 8 or 16 bits."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    height, width, channels = pixels.shape
    deep = pixels.dtype == np.uint16
    raw = pixels.astype(">u2" if deep else np.uint8).tobytes()
    stride = width * channels * (2 if deep else 1)
    lines = b"".join(b"\0" + raw[i * stride : (i + 1) * stride] for i in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 16 if deep else 8, _COLOR[channels], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of a non-interlaced PNG of 8 or 16 bits; palettes become RGB or RGBA."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    at, body, palette, alpha, head = 8, b"", b"", b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = part
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body += part
    if head is None or head[6] or head[2] not in (8, 16):
        raise ValueError("unsupported PNG: interlaced, or neither 8 nor 16 bits")
    width, height, depth, color = head[:4]
    step = _CHANNELS[color] * depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * step + 1)
    pixels = _unfilter(lines, step)
    if depth == 16:
        return np.ascontiguousarray(pixels).view(">u2").astype(np.uint16).reshape(height, width, -1)
    pixels = pixels.reshape(height, width, -1)
    if color == 3:
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette) // 3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        out = table[pixels[:, :, 0]]
        if alpha:
            a = np.full(256, 255, np.uint8)
            a[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            out = np.dstack((out, a[pixels[:, :, 0]]))
        return out
    return pixels


def _unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((lines.shape[0], lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(lines[:, 0], lines[:, 1:], strict=True)):
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            row = np.zeros_like(line)
            for x in range(0, len(line), step):
                left = row[x - step : x].astype(int) if x else np.zeros(step, int)
                up = above[x : x + step].astype(int)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    corner = above[x - step : x].astype(int) if x else np.zeros(step, int)
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x : x + step] = (line[x : x + step] + guess).astype(np.uint8)
        out[y] = above = row
    return out


def _kernel(size: int, out: int, support: float = 3.0) -> np.ndarray:
    """(out, size) weights of a Lanczos-3 filter that is widened by the reduction."""
    scale = max(size / out, 1.0)
    center = (np.arange(out) + 0.5) * size / out
    x = (np.arange(size)[None, :] + 0.5 - center[:, None]) / scale
    w = np.where(np.abs(x) < support, np.sinc(x) * np.sinc(x / support), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int, reducing_gap: float | None = None) -> np.ndarray:
    """Lanczos reduction; with a gap, a box filter first shrinks to about that multiple of the target.

    Color is weighted by alpha, so transparent pixels don't shine through.
    """
    if pixels.shape[:2] == (height, width):
        return pixels
    values = pixels.astype(float)
    alpha = pixels.shape[2] in (2, 4)
    if alpha:
        values[:, :, :-1] *= values[:, :, -1:] / np.iinfo(pixels.dtype).max
    if reducing_gap:
        fx, fy = max(1, int(values.shape[1] / width / reducing_gap)), max(1, int(values.shape[0] / height / reducing_gap))
        if fx > 1 or fy > 1:
            h, w = -(-values.shape[0] // fy), -(-values.shape[1] // fx)
            values = np.pad(values, ((0, h * fy - values.shape[0]), (0, w * fx - values.shape[1]), (0, 0)), mode="edge")
            values = values.reshape(h, fy, w, fx, -1).mean(axis=(1, 3))
    out = np.tensordot(_kernel(values.shape[0], height), values, (1, 0))
    out = np.tensordot(_kernel(values.shape[1], width), out, (1, 1)).transpose(1, 0, 2)
    if alpha:
        share = out[:, :, -1:] / np.iinfo(pixels.dtype).max
        out[:, :, :-1] = np.divide(out[:, :, :-1], share, out=np.zeros_like(out[:, :, :-1]), where=share > 1e-9)
    return np.clip(np.rint(out), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype)


def scaled(pixels: np.ndarray, scale: float) -> np.ndarray:
    """Reduced by ``scale``: below or at a quarter with a box filter first, else by Lanczos alone."""
    if not 0 < scale <= 1:
        raise ValueError("images are only reduced: 0 < scale <= 1")
    if scale == 1:
        return pixels
    h, w = (max(1, int(n * scale)) for n in pixels.shape[:2])
    return resize(pixels, w, h, GAP if scale <= REDUCE_FROM else None)


def as_channels(pixels: np.ndarray, channels: int) -> np.ndarray:
    """Converted to gray (1), gray and alpha (2), RGB (3) or RGBA (4)."""
    have = pixels.shape[2]
    if have == channels:
        return pixels
    top = np.iinfo(pixels.dtype).max
    color = pixels[:, :, : have - (have in (2, 4))]
    alpha = pixels[:, :, -1:] if have in (2, 4) else np.full((*pixels.shape[:2], 1), top, pixels.dtype)
    gray_out = channels < 3
    if gray_out and color.shape[2] == 3:
        color = np.rint(color @ np.array([0.299, 0.587, 0.114])).astype(pixels.dtype)[:, :, None]
    elif not gray_out and color.shape[2] == 1:
        color = np.repeat(color, 3, axis=2)
    return np.dstack((color, alpha)) if channels in (2, 4) else color


def paste(canvas: np.ndarray, tile: np.ndarray, x: int, y: int) -> None:
    """Onto the canvas; a tile's own alpha is its mask.  What lies outside is cut off."""
    h, w = min(tile.shape[0], canvas.shape[0] - y), min(tile.shape[1], canvas.shape[1] - x)
    if h <= 0 or w <= 0:
        return
    tile = tile[:h, :w]
    spot = canvas[y : y + h, x : x + w]
    fitted = as_channels(tile, canvas.shape[2])
    if tile.shape[2] in (2, 4):
        mask = tile[:, :, -1:].astype(float) / np.iinfo(tile.dtype).max
        spot[:] = np.rint(fitted * mask + spot * (1 - mask)).astype(canvas.dtype)
    else:
        spot[:] = fitted


IMAGE = "height int, width int, channels int, depth int, data binary"


def read_images(files: DataFrame) -> DataFrame:
    """Binary PNG files (``path, content`` and other columns) as ``height, width, channels, depth, data``; broken ones are errors that name the file."""
    kept = [c for c in files.columns if c != "content"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in kept), IMAGE])

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    p = decode_png(content)
                except (ValueError, zlib.error, KeyError) as e:
                    raise ValueError(f"cannot open image {path}: {e}") from e
                rows.append((*p.shape, p.dtype.itemsize * 8, p.tobytes()))
            yield pd.concat([frame[kept].reset_index(drop=True), pd.DataFrame(rows, columns=["height", "width", "channels", "depth", "data"])], axis=1)

    return files.mapInPandas(decoded, schema)


def to_array(height: int, width: int, channels: int, depth: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if depth == 16 else np.uint8).reshape(height, width, channels)


def composite(tiles: DataFrame, dimension: int, scale: float = 1.0, strip_rows: int | None = None) -> DataFrame:
    """PNGs of windows: ``origin_r, origin_c, strip, content``.

    ``tiles`` has ``r, c, path, content``.  A window's canvas takes the mode and cell size of its
    root tile; a tile is pasted at (c * width, r * height) from the window's origin.  With
    ``strip_rows``, bands of that many tile rows are tasks of their own, and their images are
    parts of the window from north to south; a task holds one band's tiles.
    """
    at = lambda k: (F.floor(F.col(k) / dimension) * dimension).cast("long")
    keyed = tiles.withColumns({"origin_r": at("r"), "origin_c": at("c")})
    heads = keyed.groupBy("origin_r", "origin_c").agg(F.min_by("path", F.struct("r", "c")).alias("root"), F.max("r").alias("last_r"), F.max("c").alias("last_c"))
    rooted = heads.join(tiles.select(F.col("path").alias("root"), F.substring("content", 1, 33).alias("root_head")), "root")
    band = F.floor((F.col("r") - F.col("origin_r")) / strip_rows).cast("long") if strip_rows else F.lit(0).cast("long")
    planned = keyed.join(rooted.drop("root"), ["origin_r", "origin_c"]).withColumn("strip", band)

    def stitched(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        origin_r, origin_c, strip = (int(k) for k in key)
        width, height, depth, color = struct.unpack(">IIBB", frame["root_head"].iloc[0][16:26])
        channels = 3 if color == 3 else _CHANNELS[color]
        w, h = (max(1, int(n * scale)) for n in (width, height))
        rows, cols = int(frame["last_r"].iloc[0]) - origin_r + 1, int(frame["last_c"].iloc[0]) - origin_c + 1
        first = strip * strip_rows if strip_rows else 0
        rows = min(rows - first, strip_rows) if strip_rows else rows
        canvas = np.zeros((rows * h, cols * w, channels), np.uint16 if depth == 16 else np.uint8)
        for t in frame.sort_values(["r", "c", "path"]).itertuples(index=False):
            paste(canvas, scaled(decode_png(t.content), scale), (int(t.c) - origin_c) * w, (int(t.r) - origin_r - first) * h)
        return pd.DataFrame([(origin_r, origin_c, strip, encode_png(canvas))], columns=["origin_r", "origin_c", "strip", "content"])

    return planned.groupBy("origin_r", "origin_c", "strip").applyInPandas(stitched, "origin_r long, origin_c long, strip long, content binary")


def split_images(images: DataFrame, axis: str = "auto") -> DataFrame:
    """Both halves of PNGs (``name, content``): ``name, half, width, height, content``; the second has the odd pixel."""

    def halved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["name"], frame["content"], strict=True):
                p = decode_png(content)
                way = axis if axis != "auto" else "horizontal" if p.shape[0] > p.shape[1] else "vertical"
                cut = p.shape[0 if way == "horizontal" else 1] // 2
                parts = (p[:cut], p[cut:]) if way == "horizontal" else (p[:, :cut], p[:, cut:])
                rows += [(name, half, x.shape[1], x.shape[0], encode_png(np.ascontiguousarray(x))) for half, x in zip("ab", parts, strict=True)]
            yield pd.DataFrame(rows, columns=["name", "half", "width", "height", "content"])

    return images.select("name", "content").mapInPandas(halved, "name string, half string, width int, height int, content binary")


def planned_axis(width: str = "width", height: str = "height"):
    return split_axis(F.col(width), F.col(height))


def first_image(archive: bytes) -> tuple[str, bytes]:
    """The first image entry of a zip, by the archive's own order."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        for name in z.namelist():
            if name.lower().endswith((".tif", ".tiff", ".png")):
                return name, z.read(name)
    raise ValueError("no image in the archive")


def unzip_images(archives: DataFrame) -> DataFrame:
    """``path, entry, content`` of zip files (``path, content``)."""

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *first_image(content)) for path, content in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "entry", "content"])

    return archives.select("path", "content").mapInPandas(opened, "path string, entry string, content binary")


def zip_tiles(tiles: DataFrame) -> DataFrame:
    """``name, content``: a deflated zip of each tile (``name, entry, content``)."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, entry, content in zip(frame["name"], frame["entry"], frame["content"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(entry), content, zipfile.ZIP_DEFLATED)
                rows.append((name, held.getvalue()))
            yield pd.DataFrame(rows, columns=["name", "content"])

    return tiles.select("name", "entry", "content").mapInPandas(packed, "name string, content binary")
