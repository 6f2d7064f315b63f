"""The predicates: three kinds of overlap, containment, and guards that raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geo import area, native_lod, shared_area

Box = dict[str, Column]


def overlaps_closed(a: Box, b: Box) -> Column:
    """Boxes ``x0, y0, x1, y1`` that overlap, or touch at an edge or corner."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def overlaps_open(a: Box, b: Box) -> Column:
    """Boxes whose interiors overlap."""
    return (a["x0"] < b["x1"]) & (a["x1"] > b["x0"]) & (a["y0"] < b["y1"]) & (a["y1"] > b["y0"])


def overlap_ratio(a: Box, b: Box) -> Column:
    """Shared area over the smaller box's; null where a box has no area."""
    smaller = F.least(area(a["x0"], a["y0"], a["x1"], a["y1"]), area(b["x0"], b["y0"], b["x1"], b["y1"]))
    return F.when(smaller > 0, shared_area(a, b) / smaller)


def contains_point(box: Box, x: Column, y: Column) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def contains_box(box: Box, inner: Box) -> Column:
    return (box["x0"] <= inner["x0"]) & (box["x1"] >= inner["x1"]) & (box["y0"] <= inner["y0"]) & (box["y1"] >= inner["y1"])


def supports_kind(kinds: Column, kind: str) -> Column:
    return F.array_contains(kinds, kind)


def lod_allowed(zoom: Column, native_pixel: Column) -> Column:
    """A level no finer than the service's own pixels."""
    return zoom <= native_lod(native_pixel)


def checked_lod(zoom: Column, native_pixel: Column) -> Column:
    message = F.concat(F.lit("level "), zoom.cast("string"), F.lit(" is finer than the native level "), native_lod(native_pixel).cast("string"))
    return F.when(lod_allowed(zoom, native_pixel), zoom).otherwise(F.raise_error(message).cast("int"))


def tiff_intact(content: Column, length: Column) -> Column:
    """A TIFF header of either byte order, and more than a kilobyte."""
    return F.hex(F.substring(content, 1, 4)).isin("49492A00", "4D4D002A") & (length > 1024)


def aerial(keywords: Column) -> Column:
    return keywords.isNotNull() & keywords.contains("Aerial")


def check_arguments(dimension: int = 1, scale: float = 1.0, workers: int | None = None, axis: str = "auto", least_dimension: int = 1) -> None:
    """Guards of the entry points; a wrong argument is a ValueError."""
    if dimension < least_dimension:
        raise ValueError(f"dimension must be at least {least_dimension}")
    if not 0.0 < scale <= 1.0:
        raise ValueError("scale must be above 0 and at most 1")
    if workers is not None and workers < 1:
        raise ValueError("workers must be at least 1")
    if axis not in ("auto", "horizontal", "vertical"):
        raise ValueError("axis must be auto, horizontal or vertical")
