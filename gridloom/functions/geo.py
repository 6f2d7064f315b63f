"""Geographic arithmetic as columns: Web Mercator, areas of interest, tile and window envelopes.

All of it is double arithmetic inside whole-stage codegen.  Literals are doubles throughout,
because a decimal literal would turn a product into a decimal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sphere of EPSG:3857, the usual tiling scheme and the two miles-to-degrees rules.
EARTH_RADIUS = 6378137.0
ORIGIN = 20037508.342787001
WORLD_RESOLUTION = 156543.03392804097
METERS_PER_INCH = 0.0254
TILE_PIXELS = 256
MILES_PER_DEGREE = 69.0
METERS_PER_MILE = 1609.344
METERS_PER_DEGREE = 111320.0


def num(value: float) -> Column:
    return F.lit(float(value))


def mercator_x(lon: Column) -> Column:
    """Degrees of longitude to meters east."""
    return num(EARTH_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """Degrees of latitude to meters north."""
    return num(EARTH_RADIUS) * F.ln(F.tan(F.pi() / num(4) + F.radians(lat) / num(2)))


def longitude(x: Column) -> Column:
    return F.degrees(x / num(EARTH_RADIUS))


def latitude(y: Column) -> Column:
    return F.degrees(num(2) * F.atan(F.exp(y / num(EARTH_RADIUS))) - F.pi() / num(2))


def checked_latitude(value: Column) -> Column:
    """A double in [-90, 90] from a number or its text, or an error."""
    return _checked(value, 90.0, "latitude")


def checked_longitude(value: Column) -> Column:
    """A double in [-180, 180] from a number or its text, or an error."""
    return _checked(value, 180.0, "longitude")


def _checked(value: Column, most: float, what: str) -> Column:
    parsed = value.cast("string").try_cast("double")
    wrong = F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(F.abs(parsed) <= num(most), parsed).otherwise(wrong.cast("double"))


def box_around(lat: Column, lon: Column, miles: Column) -> dict[str, Column]:
    """The area of interest of a tile gather: 69 miles a degree."""
    dlat = miles / num(MILES_PER_DEGREE)
    dlon = miles / (num(MILES_PER_DEGREE) * F.cos(F.radians(lat)))
    return {"min_lat": lat - dlat, "min_lon": lon - dlon, "max_lat": lat + dlat, "max_lon": lon + dlon}


def box_by_meters(lat: Column, lon: Column, miles: Column) -> dict[str, Column]:
    """The area of interest of a download: meters over 111320 a degree (a little smaller)."""
    dlat = miles * num(METERS_PER_MILE) / num(METERS_PER_DEGREE)
    dlon = miles * num(METERS_PER_MILE) / (num(METERS_PER_DEGREE) * F.cos(F.radians(lat)))
    return {"min_lat": lat - dlat, "min_lon": lon - dlon, "max_lat": lat + dlat, "max_lon": lon + dlon}


def projected(box: dict[str, Column]) -> dict[str, Column]:
    """A box of degrees in meters."""
    return {"xmin": mercator_x(box["min_lon"]), "ymin": mercator_y(box["min_lat"]), "xmax": mercator_x(box["max_lon"]), "ymax": mercator_y(box["max_lat"])}


def pixel_size(zoom: Column) -> Column:
    return num(2 * math.pi * EARTH_RADIUS) / (num(TILE_PIXELS) * F.pow(num(2), zoom.cast("double")))


def native_lod(native_pixel: Column) -> Column:
    """The level of detail next to a service's own pixels, halves to even."""
    return F.rint(F.log2(num(2 * math.pi * EARTH_RADIUS / TILE_PIXELS) / native_pixel)).cast("int")


def tile_footprint(row: Column, col: Column, resolution: Column, origin_x: float = -ORIGIN, origin_y: float = ORIGIN, pixels: int = TILE_PIXELS) -> dict[str, Column]:
    """West, east, south and north edge of a tile in projected units; rows go south."""
    span = resolution * num(pixels)
    c, r = col.cast("double"), row.cast("double")
    return {
        "west_x": num(origin_x) + c * span,
        "east_x": num(origin_x) + (c + num(1)) * span,
        "south_y": num(origin_y) - (r + num(1)) * span,
        "north_y": num(origin_y) - r * span,
    }


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def corners(west_x: Column, east_x: Column, south_y: Column, north_y: Column) -> Column:
    """Five-corner bounds in degrees; the center is the midpoint of the projected box."""
    w, e, s, n = longitude(west_x), longitude(east_x), latitude(south_y), latitude(north_y)
    mid = point(latitude((south_y + north_y) / num(2)), longitude((west_x + east_x) / num(2)))
    return F.struct(mid.alias("center"), point(n, e).alias("northEast"), point(s, e).alias("southEast"), point(s, w).alias("southWest"), point(n, w).alias("northWest"))


def ring(bounds: Column) -> Column:
    """The closed ring NW, NE, SE, SW, NW."""
    return F.array(bounds["northWest"], bounds["northEast"], bounds["southEast"], bounds["southWest"], bounds["northWest"])


def valid_bounds(bounds: Column) -> Column:
    """True if all four named corners have both coordinates."""
    ok = F.lit(True)
    for corner in ("northEast", "southEast", "southWest", "northWest"):
        ok = ok & bounds[corner]["lat"].isNotNull() & bounds[corner]["lon"].isNotNull()
    return F.coalesce(ok, F.lit(False))


def edges(bounds: Column) -> dict[str, Column]:
    """North and south edge by the western corners, east and west by the northern ones."""
    return {"north": bounds["northWest"]["lat"], "south": bounds["southWest"]["lat"], "west": bounds["northWest"]["lon"], "east": bounds["northEast"]["lon"]}


def extremes(bounds: Column) -> dict[str, Column]:
    """Least and greatest coordinates over the four corners, for rotated quadrilaterals."""
    names = ("northEast", "southEast", "southWest", "northWest")
    lats, lons = [bounds[c]["lat"] for c in names], [bounds[c]["lon"] for c in names]
    return {"min_lat": F.least(*lats), "max_lat": F.greatest(*lats), "min_lon": F.least(*lons), "max_lon": F.greatest(*lons)}


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, num(0)) * F.greatest(y1 - y0, num(0))


def shared_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of two axis-aligned boxes ``x0, y0, x1, y1``; zero if they only touch or are apart."""
    return area(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def padded(box: dict[str, Column], degrees: float) -> dict[str, Column]:
    pad = num(degrees)
    return {"min_lat": box["min_lat"] - pad, "min_lon": box["min_lon"] - pad, "max_lat": box["max_lat"] + pad, "max_lon": box["max_lon"] + pad}


def pixels_across(low: Column, high: Column, resolution: Column) -> Column:
    """Output size of a raster axis, halves to even; not positive is an error."""
    n = F.rint((high - low) / resolution).cast("long")
    return F.when(n > 0, n).otherwise(F.raise_error(F.lit("the target area is smaller than a pixel")).cast("long"))


def scaled_cell(pixels: Column, scale: float) -> Column:
    """A cell's size after scaling, rounded down but at least one pixel."""
    return pixels if scale == 1.0 else F.greatest(F.floor(pixels * num(scale)).cast("int"), F.lit(1))


def nodata(dtype: Column) -> Column:
    """The internal NoData value of a raster type: NaN for floats, else the type's least value."""
    least = {"int8": -128.0, "int16": -32768.0, "int32": -2147483648.0, "uint8": 0.0, "uint16": 0.0, "uint32": 0.0}
    out = F.when(dtype.isin("float32", "float64"), num(float("nan")))
    for name, value in least.items():
        out = out.when(dtype == name, num(value))
    return out


def split_axis(width: Column, height: Column) -> Column:
    """Where ``auto`` splits: tall images horizontally, others vertically."""
    return F.when(height > width, "horizontal").otherwise("vertical")


def middle_latitude(north: Column, south: Column) -> Column:
    """The latitude halfway between two others on the projected map; the plain midpoint where the map has no such latitude.

    It ends short of the poles, and beyond them its formula has no value or, by its period, another latitude's.
    """
    on_map = (F.abs(north) < num(90)) & (F.abs(south) < num(90))
    return F.when(on_map, latitude((mercator_y(north) + mercator_y(south)) / num(2))).otherwise((north + south) / num(2))


def middle_longitude(west: Column, east: Column) -> Column:
    return longitude((mercator_x(west) + mercator_x(east)) / num(2))


def box_bounds(north: Column, south: Column, west: Column, east: Column) -> Column:
    """Five-corner bounds of a box in degrees, with the projected midpoint as center."""
    mid = point(middle_latitude(north, south), middle_longitude(west, east))
    return F.struct(mid.alias("center"), point(north, east).alias("northEast"), point(south, east).alias("southEast"), point(south, west).alias("southWest"), point(north, west).alias("northWest"))


def halves(bounds: Column, axis: Column) -> Column:
    """Both halves of a split, as an array of ``half, bounds``: first the north or west one.

    The cut is at the projected midpoint.  Edges come from the NW, NE and SW corners alone.
    """
    north, south = bounds["northWest"]["lat"], bounds["southWest"]["lat"]
    west, east = bounds["northWest"]["lon"], bounds["northEast"]["lon"]
    lat, lon = middle_latitude(north, south), middle_longitude(west, east)
    across = axis == "horizontal"
    first = F.when(across, box_bounds(north, lat, west, east)).otherwise(box_bounds(north, south, west, lon))
    second = F.when(across, box_bounds(lat, south, west, east)).otherwise(box_bounds(north, south, lon, east))
    return F.array(F.struct(F.lit("a").alias("half"), first.alias("bounds")), F.struct(F.lit("b").alias("half"), second.alias("bounds")))


def half_pixels(pixels: Column) -> dict[str, Column]:
    """Sizes of both halves; the second gets the odd pixel."""
    first = F.floor(pixels / 2).cast("int")
    return {"a": first, "b": pixels - first}
