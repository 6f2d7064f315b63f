"""Tile footprints, level selection, N x N windows and their envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import ORIGIN, TILE_PIXELS, corners, extremes, num, point, tile_footprint
from gridloom.functions.parse import window_name


def with_footprints(tiles: DataFrame, levels: DataFrame, origin_x: float = -ORIGIN, origin_y: float = ORIGIN, pixels: int = TILE_PIXELS, strict: bool = True) -> DataFrame:
    """Tiles (``level, row, col``) with ``west_x, east_x, south_y, north_y``.

    ``levels`` (``level_id, resolution``) has a row a level of detail, 24 in the usual scheme.
    A level it doesn't declare is an error, or with ``strict=False`` the tile is left out.
    """
    known = F.broadcast(levels.select(F.col("level_id").cast("int").alias("level"), "resolution").dropDuplicates(["level"]))
    joined = tiles.join(known, "level", "left" if strict else "inner")
    resolution = F.col("resolution")
    if strict:
        message = F.concat(F.lit("No level-of-detail declared for level "), F.col("level").cast("string"))
        resolution = F.when(resolution.isNotNull(), resolution).otherwise(F.raise_error(message).cast("double"))
    return joined.withColumn("resolution", resolution).withColumns(tile_footprint(F.col("row"), F.col("col"), F.col("resolution"), origin_x, origin_y, pixels)).drop("resolution")


def inside_area(min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """Footprints that overlap or touch a box."""
    return (F.col("west_x") <= num(max_x)) & (F.col("east_x") >= num(min_x)) & (F.col("south_y") <= num(max_y)) & (F.col("north_y") >= num(min_y))


class EmptyLevelError(ValueError):
    """A level that was asked for has no tile left; ``level`` and ``available`` tell which ones have."""

    def __init__(self, level: int, available: list[int]):
        self.level, self.available = level, available
        super().__init__(f"level {level} has no tiles in the area; levels with tiles: {available}")


def available_levels(tiles: DataFrame) -> list[int]:
    return [r[0] for r in tiles.select("level").distinct().orderBy("level").collect()]


def select_level(tiles: DataFrame, level: int | None = None) -> DataFrame:
    """Tiles of one level: the asked one, or the highest that has any.

    An asked level without tiles is an EmptyLevelError that names the available ones.
    """
    if level is None:
        highest = tiles.agg(F.max("level").alias("__top"))
        return tiles.join(F.broadcast(highest), F.col("level") == F.col("__top")).drop("__top")
    kept = tiles.where(F.col("level") == level)
    if kept.isEmpty():
        raise EmptyLevelError(level, available_levels(tiles))
    return kept


def normalized(tiles: DataFrame) -> DataFrame:
    """Rows and columns from the least of each: ``r, c``; one row of minima is broadcast."""
    least = tiles.agg(F.min("row").alias("__r0"), F.min("col").alias("__c0"))
    joined = tiles.join(F.broadcast(least))
    return joined.withColumns({"r": F.col("row") - F.col("__r0"), "c": F.col("col") - F.col("__c0")}).drop("__r0", "__c0")


def _origin(position: Column, dimension: int) -> Column:
    return (F.floor(position / num(dimension)) * dimension).cast("long")


def windows(placed: DataFrame, dimension: int, name: str | None = None) -> DataFrame:
    """Non-empty N x N windows of tiles placed at ``r, c``, one row each.

    Counts and extents combine before the shuffle.  ``root`` is the tile first by row and
    column; ``rows`` and ``cols`` run from the window's origin to its last tile, while
    ``min_r`` and ``min_c`` tell where its first tile is.
    """
    keyed = placed.withColumns({"origin_r": _origin(F.col("r"), dimension), "origin_c": _origin(F.col("c"), dimension)})
    extra = [F.min_by(name, F.struct("r", "c")).alias("root")] if name else []
    columns = [F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max")] if "row" in placed.columns else []
    grouped = keyed.groupBy("origin_r", "origin_c").agg(F.count("*").alias("n"), F.min("r").alias("min_r"), F.max("r").alias("__r"), F.min("c").alias("min_c"), F.max("c").alias("__c"), *columns, *extra)
    return grouped.withColumns({"rows": F.col("__r") - F.col("origin_r") + 1, "cols": F.col("__c") - F.col("origin_c") + 1}).drop("__r", "__c")


def window_footprint(resolution: float, origin_x: float = -ORIGIN, origin_y: float = ORIGIN, pixels: int = TILE_PIXELS) -> dict[str, Column]:
    """Projected envelope of the tiles present in a window."""
    first = tile_footprint(F.col("row_min"), F.col("col_min"), num(resolution), origin_x, origin_y, pixels)
    last = tile_footprint(F.col("row_max"), F.col("col_max"), num(resolution), origin_x, origin_y, pixels)
    return {"west_x": first["west_x"], "east_x": last["east_x"], "south_y": last["south_y"], "north_y": first["north_y"]}


def window_bounds(resolution: float, origin_x: float = -ORIGIN, origin_y: float = ORIGIN, pixels: int = TILE_PIXELS) -> Column:
    """Five-corner bounds of that envelope; its center is the projected midpoint."""
    return corners(**window_footprint(resolution, origin_x, origin_y, pixels))


def output_name() -> Column:
    return window_name(F.col("origin_r"), F.col("origin_c"))


def merged_bounds(tiles: DataFrame, *keys: str, bounds: str = "bounds") -> DataFrame:
    """Envelope of all corners of all tiles of a group; its center is the plain midpoint."""
    edge = {k: v for k, v in extremes(F.col(bounds)).items()}
    grouped = tiles.select(*keys, *(v.alias(k) for k, v in edge.items())).groupBy(*keys)
    out = grouped.agg(F.max("max_lat").alias("n"), F.min("min_lat").alias("s"), F.min("min_lon").alias("w"), F.max("max_lon").alias("e"))
    n, s, w, e = (F.col(k) for k in "nswe")
    mid = point((n + s) / num(2), (w + e) / num(2))
    merged = F.struct(mid.alias("center"), point(n, e).alias("northEast"), point(s, e).alias("southEast"), point(s, w).alias("southWest"), point(n, w).alias("northWest"))
    return out.select(*keys, merged.alias("bounds"))


def strips(rows: int, workers: int, tiles: int, canvas_bytes: int, least_tiles: int = 64, most_bytes: int = 512 << 20) -> list[tuple[int, int]]:
    """Row bands (first, past last) of a window's canvas; the first bands take the remainder.

    One band if the window has few tiles, or a canvas that is too large to hold twice.
    """
    if workers <= 1 or tiles < least_tiles or canvas_bytes > most_bytes or rows <= 1:
        return [(0, rows)]
    each, rest = divmod(rows, min(workers, rows))
    out, at = [], 0
    for i in range(min(workers, rows)):
        out.append((at, at := at + each + (i < rest)))
    return out
