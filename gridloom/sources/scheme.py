"""Tiling schemes: read from a cache's conf.xml, or the usual Web Mercator one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import METERS_PER_INCH, ORIGIN, TILE_PIXELS, WORLD_RESOLUTION, num

_XML = (
    "SpatialReference struct<WKID:string,LatestWKID:string>, TileOrigin struct<X:string,Y:string>, TileCols string, TileRows string, "
    "DPI string, PreciseDPI string, LODInfos struct<LODInfo:array<struct<LevelID:int,Scale:double,Resolution:double>>>"
)


@dataclass(frozen=True)
class TileScheme:
    wkid: int
    latest_wkid: int
    origin_x: float
    origin_y: float
    tile_cols: int
    tile_rows: int
    dpi: int
    format: str
    levels: DataFrame  # level_id, scale, resolution
    storage_format: str = ""
    precise_dpi: float | None = None

    def resolution(self, level: int) -> float:
        row = self.levels.where(F.col("level_id") == level).first()
        if row is None:
            raise KeyError(f"No level-of-detail declared for level {level}")
        return row["resolution"]


def web_mercator(spark: SparkSession, min_level: int = 0, max_level: int = 23, tile_size: int = TILE_PIXELS, dpi: int = 96, image_format: str = "png") -> TileScheme:
    if min_level < 0 or max_level < min_level:
        raise ValueError("levels must be 0 <= min_level <= max_level")
    if tile_size <= 0 or dpi <= 0:
        raise ValueError("tile_size and dpi must be positive")
    return TileScheme(102100, 3857, -ORIGIN, ORIGIN, tile_size, tile_size, dpi, image_format.lower(), web_mercator_levels(spark, min_level, max_level, tile_size, dpi), "exploded", float(dpi))


def web_mercator_levels(spark: SparkSession, min_level: int, max_level: int, tile_size: int = TILE_PIXELS, dpi: int = 96) -> DataFrame:
    """``level_id, scale, resolution``: each level has half the pixel size of the one before."""
    z = spark.range(min_level, max_level + 1, numPartitions=1).select(F.col("id").cast("int").alias("level_id"))
    resolution = num(WORLD_RESOLUTION * TILE_PIXELS / tile_size) / F.pow(num(2), F.col("level_id").cast("double"))
    return z.select("level_id", (resolution * num(dpi / METERS_PER_INCH)).alias("scale"), resolution.alias("resolution"))


def read_conf(spark: SparkSession, path: str) -> TileScheme:
    """The scheme of a ``conf.xml``; a missing required element is a ValueError that names it."""
    doc = spark.read.format("xml").option("rowTag", "TileCacheInfo").schema(_XML)
    rows = doc.load(path).collect()
    if not rows:
        raise ValueError(f"{path}: TileCacheInfo is missing")
    r = rows[0]

    def need(value, name: str):
        if value is None or value == "":
            raise ValueError(f"{path}: {name} is missing")
        return value

    sr, origin = need(r["SpatialReference"], "SpatialReference"), need(r["TileOrigin"], "TileOrigin")
    wkid = int(need(sr["WKID"], "WKID"))
    lods = (r["LODInfos"]["LODInfo"] if r["LODInfos"] else None) or []
    levels = spark.createDataFrame([(x["LevelID"], x["Scale"], x["Resolution"]) for x in lods], "level_id int, scale double, resolution double")
    image = _element(spark, path, "TileImageInfo", "CacheTileFormat")
    return TileScheme(
        wkid, int(sr["LatestWKID"] or wkid), float(need(origin["X"], "X")), float(need(origin["Y"], "Y")), int(need(r["TileCols"], "TileCols")), int(need(r["TileRows"], "TileRows")),
        int(need(r["DPI"], "DPI")), (image or "").lower(), levels, _element(spark, path, "CacheStorageInfo", "StorageFormat") or "", float(r["PreciseDPI"]) if r["PreciseDPI"] else None,
    )


def _element(spark: SparkSession, path: str, tag: str, name: str) -> str | None:
    found = spark.read.format("xml").option("rowTag", tag).schema(f"{name} string").load(path).first()
    return found[name] if found else None
