"""Imagery services: building the registry, and choosing one that covers an area of interest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geo import latitude, longitude
from gridloom.functions.parse import endpoint, known_kinds, native_pixel, service_key, service_label
from gridloom.functions.predicates import contains_box, contains_point, supports_kind

SCHEMA = "key string, label string, base_url string, native_pixel_size_m double, srs int, coverage array<double>, kinds array<string>"
METADATA = (
    "fullExtent struct<xmin:double,ymin:double,xmax:double,ymax:double,spatialReference:struct<wkid:int,latestWkid:int>>, "
    "tileInfo struct<lods:array<struct<resolution:double>>>, minPixelSize double, pixelSizeX double, meanPixelSize double"
)

class AmbiguousServiceError(ValueError):
    """Several services cover the area; ``candidates`` are their keys in order."""

    def __init__(self, candidates: list[str], kind: str):
        self.candidates = candidates
        super().__init__(f"several {kind} services cover this area; choose one by index: " + ", ".join(f"[{i}] {k}" for i, k in enumerate(candidates)))


@dataclass(frozen=True)
class Coverage:
    """Columns of a service's coverage (min_lat, min_lon, max_lat, max_lon) as a box: x is the longitude."""

    column: Column

    def box(self) -> dict[str, Column]:
        at = lambda i: F.get(self.column, F.lit(i))
        return {"y0": at(0), "x0": at(1), "y1": at(2), "x1": at(3)}


def last_of_key(services: DataFrame, position: str) -> DataFrame:
    """A registry has a service a key: of duplicates the last."""
    rest = [c for c in services.columns if c != position]
    return services.groupBy("key").agg(F.max_by(F.struct(*rest), F.col(position)).alias("s")).select("s.*")


def coverage_of_extent(extent: Column) -> Column:
    """min_lat, min_lon, max_lat, max_lon of an extent in 4326 or Web Mercator, by its four corners; null for others."""
    sr = extent["spatialReference"]
    wkid = F.coalesce(F.nullif(sr["latestWkid"], F.lit(0)), F.nullif(sr["wkid"], F.lit(0)), F.lit(3857))
    x0, y0, x1, y1 = (extent[k] for k in ("xmin", "ymin", "xmax", "ymax"))
    complete = x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull()
    degrees = F.array(F.least(y0, y1), F.least(x0, x1), F.greatest(y0, y1), F.greatest(x0, x1))
    lats, lons = [latitude(y0), latitude(y1)], [longitude(x0), longitude(x1)]
    meters = F.array(F.least(*lats), F.least(*lons), F.greatest(*lats), F.greatest(*lons))
    return F.when(complete & (wkid == 4326), degrees).when(complete & wkid.isin(3857, 102100, 102113, 900913), meters)


def harvest(items: DataFrame) -> DataFrame:
    """A registry from scanned endpoints: ``pos, url, pixel_size, kinds, metadata`` (of ``METADATA``).

    Of equal keys the first is seen and later ones are left out, also if the first can't be
    registered; entries without a usable extent or resolution are left out.
    """
    meta = F.col("metadata")
    sr = meta["fullExtent"]["spatialReference"]
    declared = native_pixel(meta["tileInfo"]["lods"], meta["minPixelSize"], meta["pixelSizeX"], meta["meanPixelSize"])
    named = items.withColumns({"key": service_key(F.col("url")), "label": service_label(F.col("url")), "base_url": F.concat(endpoint(F.col("url")), F.lit("/exportImage"))})
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy("pos"))).where("__n = 1")
    built = first.select(
        "pos", "key", "label", "base_url",
        F.coalesce("pixel_size", declared).alias("native_pixel_size_m"),
        F.coalesce(F.nullif(sr["latestWkid"], F.lit(0)), F.nullif(sr["wkid"], F.lit(0)), F.lit(3857)).cast("int").alias("srs"),
        coverage_of_extent(meta["fullExtent"]).alias("coverage"),
        known_kinds(F.col("kinds")).alias("kinds"),
    )
    return built.where(F.col("coverage").isNotNull() & F.col("native_pixel_size_m").isNotNull())


def _candidates(aois: DataFrame, services: DataFrame, kind: str) -> DataFrame:
    """Pairs of areas and services of the kind whose coverage holds the area's center: an equi-join on ten-degree cells."""
    offered = services.where(supports_kind(F.col("kinds"), kind)).select("key", "coverage")
    box = Coverage(F.col("coverage")).box()
    center_x, center_y = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    area = {"x0": F.col("min_lon"), "y0": F.col("min_lat"), "x1": F.col("max_lon"), "y1": F.col("max_lat")}
    proper = offered.where((box["x0"] <= box["x1"]) & (box["y0"] <= box["y1"]))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 10).cast("long"), F.floor(hi / 10).cast("long")))
    by_cell = proper.withColumn("cx", cells(box["x0"], box["x1"])).withColumn("cy", cells(box["y0"], box["y1"]))
    located = aois.withColumns({"cx": F.floor(center_x / 10).cast("long"), "cy": F.floor(center_y / 10).cast("long")})
    met = located.join(by_cell, ["cx", "cy"]).where(contains_point(box, center_x, center_y)).drop("cx", "cy")
    return met.withColumn("inside", contains_box(box, area))


def choose(aois: DataFrame, services: DataFrame, kind: str = "imagery", index: int | None = None) -> DataFrame:
    """For each area (``id, min_lat, min_lon, max_lat, max_lon``): ``id, n_candidates, key, status``.

    Candidates hold the whole area, in order of their keys.  ``status`` is ``ok``, ``no_service``
    (no service of the kind, or none at the center), ``straddles`` (the area leaves every service
    at its center), ``ambiguous`` or ``index_out_of_range``.
    """
    met = _candidates(aois, services, kind)
    found = met.groupBy("id").agg(F.count_if("inside").alias("n"), F.sort_array(F.collect_set(F.when(F.col("inside"), F.col("key")))).alias("keys"))
    out = aois.select("id").join(found, "id", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    at = F.lit(0 if index is None else index)
    status = F.when(F.col("n").isNull(), "no_service").when(n == 0, "straddles")
    if index is None:
        status = status.when(n > 1, "ambiguous")
    else:
        status = status.when(~at.between(F.lit(0), n - 1), "index_out_of_range")
    status = status.otherwise("ok")
    return out.select("id", n.alias("n_candidates"), F.when(status == "ok", F.get("keys", at)).alias("key"), status.alias("status"))


def select_service(aoi: DataFrame, services: DataFrame, kind: str = "imagery", index: int | None = None) -> str:
    """The key of the service for a single area, or the error that its status stands for."""
    if services.where(supports_kind(F.col("kinds"), kind)).isEmpty():
        raise ValueError(f"the registry has no {kind} service; refresh it")
    row = choose(aoi, services, kind, index).first()
    if row["status"] == "ok":
        return row["key"]
    keys = [r["key"] for r in _candidates(aoi, services, kind).where("inside").select("key").distinct().orderBy("key").collect()]
    if row["status"] == "ambiguous":
        raise AmbiguousServiceError(keys, kind)
    raise ValueError(
        {
            "no_service": f"no {kind} service of the registry holds the area's center",
            "straddles": f"every {kind} service at the center ends within the area; make the area smaller or move it",
            "index_out_of_range": f"there is no candidate {index}; from 0 on there are {', '.join(keys)}",
        }[row["status"]]
    )
