"""GeoTIFFs without a native library: headers, pixels of plain files, and a writer.

Read: strips or tiles, uncompressed, deflate or LZW, horizontal predictor or none, 8 to 64 bits.
Written: deflate strips with pixel scale, tie point and EPSG key.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions import crs

# TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    found = {}
    count = struct.unpack(order + "H", data[at : at + 2])[0]
    if len(data) < at + 2 + 12 * count:
        raise ValueError("the TIFF is cut off")
    for i in range(count):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _TYPES:
            continue
        size = struct.calcsize(_TYPES[kind]) * n
        where = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        found[tag] = struct.unpack(f"{order}{n}{_TYPES[kind]}", data[where : where + size])
    return order, found


def _epsg(found: dict[int, tuple]) -> int:
    keys = found.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    return codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY) or 0


def header(data: bytes) -> dict:
    """Size, type, affine frame, EPSG code (0 if unknown) and NoData value."""
    _, t = tags(data)
    if PIXEL_SCALE not in t or TIE_POINT not in t:
        raise ValueError("the TIFF has no pixel scale or tie point")
    px, py = t[PIXEL_SCALE][:2]
    i, j, _, x, y, _ = t[TIE_POINT][:6]
    bits = t.get(BITS, (1,))[0]
    nodata = b"".join(t[NODATA]).rstrip(b"\0 ").decode() if NODATA in t else ""
    return {
        "width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "dtype": np.dtype(f"{_KINDS[t.get(FORMAT, (1,))[0]]}{bits // 8}").name,
        "left": x - i * px, "top": y + j * py, "px": px, "py": py, "epsg": _epsg(t), "nodata": float(nodata) if nodata else math.nan,
    }


def world_bounds(h: dict) -> tuple[float, float, float, float]:
    """min_lat, min_lon, max_lat, max_lon; an unknown system is taken as degrees."""
    x0, y0, x1, y1 = h["left"], h["top"] - h["height"] * h["py"], h["left"] + h["width"] * h["px"], h["top"]
    if h["epsg"] in crs.DEGREES:
        return y0, x0, y1, x1
    # edges are bent: points along them
    along = np.linspace(0, 1, 22)
    x = np.concatenate([x0 + (x1 - x0) * along] * 2 + [np.full(22, x0), np.full(22, x1)])
    y = np.concatenate([np.full(22, y0), np.full(22, y1)] + [y0 + (y1 - y0) * along] * 2)
    lat, lon = crs.degrees(h["epsg"], x, y)
    return float(lat.min()), float(lon.min()), float(lat.max()), float(lon.max())


def _lzw(data: bytes) -> bytes:
    out, table, width, value, bits, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        value, bits = value << 8 | byte, bits + 8
        while bits >= width:
            code = value >> (bits - width) & ((1 << width) - 1)
            bits -= width
            value &= (1 << bits) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = max(9, (len(table) + 1).bit_length())
    return bytes(out)


def pixels(data: bytes) -> np.ndarray:
    """(bands, height, width) of the first image."""
    order, t = tags(data)
    h, w, n = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{_KINDS[t.get(FORMAT, (1,))[0]]}{t.get(BITS, (1,))[0] // 8}")
    tiled = TILES in t
    part_w, part_h = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (w, min(h, t.get(STRIP_ROWS, (h,))[0]))
    planar = t.get(PLANAR, (1,))[0] == 2
    depth = 1 if planar else n
    across, down = -(-w // part_w), -(-h // part_h)
    out = np.zeros((n, down * part_h, across * part_w), kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(t[TILES if tiled else STRIPS], t[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        raw, how = data[at : at + size], t.get(COMPRESSION, (1,))[0]
        if how == 5:
            raw = _lzw(raw)
        elif how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how != 1:
            raise ValueError(f"TIFF compression {how} is not supported")
        plane, k = divmod(k, across * down) if planar else (0, k)
        y, x = divmod(k, across)
        rows = part_h if tiled else min(part_h, h - y * part_h)
        part = np.frombuffer(raw, kind, rows * part_w * depth).reshape(rows, part_w, depth).astype(out.dtype)
        if t.get(PREDICTOR, (1,))[0] == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        elif t.get(PREDICTOR, (1,))[0] == 3:
            raise ValueError("the floating-point predictor is not supported")
        bands = slice(plane, plane + 1) if planar else slice(0, n)
        out[bands, y * part_h : y * part_h + rows, x * part_w : (x + 1) * part_w] = part.transpose(2, 0, 1)
    return out[:, :h, :w]


def encode(values: np.ndarray, left: float, top: float, px: float, py: float, epsg: int = 4326, nodata: float | None = None, deflate: bool = True) -> bytes:
    """A little-endian GeoTIFF of (bands, height, width); NoData is recorded for float types only."""
    bands, height, width = values.shape
    kind = values.dtype
    rows = max(1, min(height, (1 << 18) // max(1, width * bands * kind.itemsize)))
    raw = (np.ascontiguousarray(values[:, y : y + rows].transpose(1, 2, 0)).astype(kind.newbyteorder("<")).tobytes() for y in range(0, height, rows))
    parts = [zlib.compress(x) if deflate else x for x in raw]
    entries = _entries(width, height, bands, kind, left, top, px, py, epsg, nodata)
    entries |= {COMPRESSION: ("H", (8 if deflate else 1,)), STRIP_ROWS: ("I", (rows,)), STRIP_BYTES: ("I", tuple(map(len, parts))), PLANAR: ("H", (1,)), STRIPS: ("I", (0,) * len(parts))}
    start = 8 + len(_directory(entries, 8))
    ends = np.cumsum([0, *map(len, parts)])
    entries[STRIPS] = ("I", tuple(int(start + e) for e in ends[:-1]))
    return struct.pack("<2sHI", b"II", 42, 8) + _directory(entries, 8) + b"".join(parts)


def _entries(width: int, height: int, bands: int, kind: np.dtype, left: float, top: float, px: float, py: float, epsg: int, nodata: float | None) -> dict[int, tuple]:
    """The tags that don't depend on how pixels are laid out."""
    flat = epsg not in crs.DEGREES
    geo = (1, 1, 0, 2, 1024, 0, 1, 1 if flat else 2, PROJECTED_KEY if flat else GEOGRAPHIC_KEY, 0, 1, epsg)
    out = {
        WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (kind.itemsize * 8,) * bands), 262: ("H", (2 if bands >= 3 and kind == np.uint8 else 1,)), SAMPLES: ("H", (bands,)),
        FORMAT: ("H", ({"u": 1, "i": 2, "f": 3}[kind.kind],) * bands), PIXEL_SCALE: ("d", (px, py, 0.0)), TIE_POINT: ("d", (0.0, 0.0, 0.0, left, top, 0.0)), GEO_KEYS: ("H", geo),
    }
    if kind.kind == "f" and nodata is not None:
        out[NODATA] = ("c", tuple(bytes([b]) for b in f"{nodata:g}\0".encode()))
    return out


def _directory(entries: dict[int, tuple], at: int) -> bytes:
    """The image's directory and what doesn't fit into it, for a place ``at`` in the file."""
    codes = {v: k for k, v in _TYPES.items()}
    body, extra = b"", b""
    base = at + 2 + 12 * len(entries) + 4
    for tag in sorted(entries):
        code, numbers = entries[tag]
        packed = struct.pack(f"<{len(numbers)}{code}", *numbers)
        if len(packed) <= 4:
            place = packed.ljust(4, b"\0")
        else:
            place = struct.pack("<I", base + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
        body += struct.pack("<HHI", tag, codes[code], len(numbers)) + place
    return struct.pack("<H", len(entries)) + body + b"\0\0\0\0" + extra


class TiledFile:
    """A tiled GeoTIFF, written aside tile by tile in any order and renamed when it is whole.

    Tiles come deflated (``deflated``), bands apart.  The writer holds a place and a length for each
    tile; what never comes is one shared empty tile.
    """

    def __init__(self, path: str, width: int, height: int, bands: int, dtype: str, left: float, top: float, px: float, py: float, epsg: int, empty: float, nodata: float | None = None, tile: int = 256):
        self.path, self.tile, kind = path, tile, np.dtype(dtype)
        self.across, self.down = -(-width // tile), -(-height // tile)
        self.places, self.sizes = np.zeros((2, bands * self.across * self.down), np.int64)
        self.entries = _entries(width, height, bands, kind, left, top, px, py, epsg, nodata)
        self.empty = zlib.compress(np.full((tile, tile), empty, kind.newbyteorder("<")).tobytes())
        self.aside = f"{path}.{os.getpid()}.tmp"
        self.file = open(self.aside, "wb")  # noqa: SIM115  closed by __exit__
        self.file.write(b"\0" * 8)

    def __enter__(self) -> TiledFile:
        return self

    def add(self, band: int, y: int, x: int, content: bytes) -> None:
        at = (band * self.down + y) * self.across + x
        self.places[at], self.sizes[at] = self.file.tell(), len(content)
        self.file.write(content)

    def __exit__(self, kind, *_) -> None:
        with self.file:
            if kind is None:
                missing = self.sizes == 0
                self.places[missing], self.sizes[missing] = self.file.tell(), len(self.empty)
                self.file.write(self.empty)
                at = self.file.tell() + self.file.tell() % 2
                if at >= 1 << 32:
                    raise ValueError(f"{self.path}: more than the 4 GB that a TIFF holds")
                tiles = {TILE_WIDTH: ("I", (self.tile,)), TILE_HEIGHT: ("I", (self.tile,)), TILES: ("I", tuple(self.places.tolist())), TILE_BYTES: ("I", tuple(self.sizes.tolist()))}
                self.file.seek(at)
                self.file.write(_directory(self.entries | tiles | {COMPRESSION: ("H", (8,)), PLANAR: ("H", (2,))}, at))
                self.file.seek(0)
                self.file.write(struct.pack("<2sHI", b"II", 42, at))
        if kind is None:
            os.replace(self.aside, self.path)
        else:
            os.remove(self.aside)


def deflated(values: np.ndarray, dtype: str, empty: float, tile: int = 256) -> bytes:
    """One band's tile, filled up with ``empty``."""
    whole = np.full((tile, tile), empty, np.dtype(dtype).newbyteorder("<"))
    whole[: values.shape[0], : values.shape[1]] = values
    return zlib.compress(whole.tobytes())


HEADER = "path string, width int, height int, bands int, dtype string, left double, top double, px double, py double, epsg int, nodata double, min_lat double, min_lon double, max_lat double, max_lon double"


def headers(files: DataFrame) -> DataFrame:
    """``HEADER`` of binary files (``path, content``)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HEADER.split(", ")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    h = header(content)
                    b = dict(zip(("min_lat", "min_lon", "max_lat", "max_lon"), world_bounds(h), strict=True))
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                rows.append([{"path": path, **h, **b}[n] for n in names])
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, HEADER)


def bands(files: DataFrame) -> DataFrame:
    """A row a band of binary files, with ``src_seq`` from their column of that name (see ``mosaic.RASTER``)."""
    from gridloom.operators.mosaic import RASTER

    names = [c.split()[0] for c in RASTER.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, seq, content in zip(frame["path"], frame["src_seq"], frame["content"], strict=True):
                h, values = header(content), pixels(content)
                for i, band in enumerate(values):
                    rows.append([{"path": path, "src_seq": seq, "band": i + 1, "data": np.ascontiguousarray(band).tobytes(), **h}[n] for n in names])
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "src_seq", "content").mapInPandas(read, RASTER)
