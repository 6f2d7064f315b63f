"""Names and paths as columns: tile paths, chunk names, endpoints, catalogue fields.

A parser returns null where its input doesn't fit; ``strict`` ones raise instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A cache path, an XYZ path, a chunk's file name.
CACHE_PATH = r"(?:^|/)L([0-9]+)/R([0-9A-Fa-f]+)/C([0-9A-Fa-f]+)\.[Pp][Nn][Gg]$"
XYZ_PATH = r"(?:^|/)([0-9]+)/([0-9]+)/([0-9]+)\.[Pp][Nn][Gg]$"
CHUNK_FILE = r"(?:^|/)chunk_([0-9]+)_([0-9]+)\.tif$"

KINDS = ("imagery", "elevation")


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def _or_raise(ok: Column, value: Column, path: Column, kind: str, strict: bool) -> Column:
    if not strict:
        return F.when(ok, value)
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit("not a tile path: "), F.coalesce(path, F.lit("null")))).cast(kind))


def tile_of_cache_path(path: Column, strict: bool = False) -> dict[str, Column]:
    """``level`` (decimal), ``row`` and ``col`` (hexadecimal) of ``L../R../C...png``."""
    ok = path.rlike(CACHE_PATH)
    return {
        "level": _or_raise(ok, F.regexp_extract(path, CACHE_PATH, 1).try_cast("int"), path, "int", strict),
        "row": _or_raise(ok, _hex(F.regexp_extract(path, CACHE_PATH, 2)), path, "long", strict),
        "col": _or_raise(ok, _hex(F.regexp_extract(path, CACHE_PATH, 3)), path, "long", strict),
    }


def tile_of_cache_parts(path: Column) -> dict[str, Column]:
    """The bulk variant: the last three parts are taken as they come, first characters unchecked."""
    parts = F.split(path, "/")
    last = lambda n: F.element_at(parts, -n)
    stem = F.substring_index(last(1), ".", 1)
    return {"level": F.substring(last(3), 2, 100).try_cast("int"), "row": _hex(F.substring(last(2), 2, 100)), "col": _hex(F.substring(stem, 2, 100))}


def tile_of_xyz_path(path: Column, strict: bool = False) -> dict[str, Column]:
    """``level``, ``row`` and ``col`` of ``<z>/<x>/<y>.png``: x is the column, y the row."""
    ok = path.rlike(XYZ_PATH)
    return {
        "level": _or_raise(ok, F.regexp_extract(path, XYZ_PATH, 1).try_cast("int"), path, "int", strict),
        "row": _or_raise(ok, F.regexp_extract(path, XYZ_PATH, 3).try_cast("long"), path, "long", strict),
        "col": _or_raise(ok, F.regexp_extract(path, XYZ_PATH, 2).try_cast("long"), path, "long", strict),
    }


def level_of_folder(folder: Column) -> Column:
    """``L23`` or ``23`` as a number."""
    return F.regexp_replace(folder, "^[Ll]", "").try_cast("int")


def hex8(value: Column) -> Column:
    """At least eight lower-case hexadecimal digits."""
    digits = F.lower(F.hex(value))
    return F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))


def cache_path(row: Column, col: Column) -> Column:
    return F.concat(F.lit("R"), hex8(row), F.lit("/C"), hex8(col), F.lit(".png"))


def xyz_path(level: Column, row: Column, col: Column) -> Column:
    return F.concat(level.cast("string"), F.lit("/"), col.cast("string"), F.lit("/"), row.cast("string"), F.lit(".png"))


def tile_name(level: Column, row: Column, col: Column) -> Column:
    """``L18_R0000..._C0000...``."""
    digits = level.cast("string")
    return F.concat(F.lit("L"), F.when(F.length(digits) >= 2, digits).otherwise(F.lpad(digits, 2, "0")), F.lit("_R"), hex8(row), F.lit("_C"), hex8(col))


def window_name(origin_row: Column, origin_col: Column) -> Column:
    return F.concat(F.lit("gathered_r"), origin_row.cast("string"), F.lit("_c"), origin_col.cast("string"))


def chunk_key(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def chunk_of_file(path: Column) -> dict[str, Column]:
    """Row and column of ``chunk_<col>_<row>.tif``; zeros where the name doesn't fit."""
    part = lambda i: F.coalesce(F.regexp_extract(path, CHUNK_FILE, i).try_cast("long"), F.lit(0).cast("long"))
    return {"row": part(2), "col": part(1)}


def endpoint(url: Column) -> Column:
    """A service's base URL: without trailing slashes and ``/exportImage``."""
    return F.regexp_replace(F.regexp_replace(url, "/+$", ""), "/exportImage$", "")


def service_key(url: Column) -> Column:
    return F.replace(F.regexp_replace(endpoint(url), "^[A-Za-z]+://", ""), F.lit("/"), F.lit("__"))


def service_label(url: Column) -> Column:
    """The last part of the URL, as words in title case."""
    return F.initcap(F.lower(F.replace(F.substring_index(endpoint(url), "/", -1), F.lit("_"), F.lit(" "))))


def known_kinds(kinds: Column) -> Column:
    """Kinds that are known; imagery where none is."""
    kept = F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda k: k.isin(*KINDS))
    return F.when(F.size(kept) == 0, F.array(F.lit("imagery"))).otherwise(kept)


def native_pixel(lods: Column, min_pixel: Column, pixel_x: Column, mean_pixel: Column) -> Column:
    """A service's pixel size: the finest level's, else the first declared one that isn't zero."""
    zero = F.lit(0.0)
    return F.coalesce(F.array_min(F.transform(lods, lambda x: x["resolution"])), F.nullif(min_pixel, zero), F.nullif(pixel_x, zero), F.nullif(mean_pixel, zero))


def metadata_value(metadata: Column, field: str) -> Column:
    """The first value that isn't null under a name, of an array of ``fieldName, value``."""
    return F.get(F.filter(metadata, lambda m: (m["fieldName"] == field) & m["value"].isNotNull()), F.lit(0))["value"]


def corner_fields(metadata: Column) -> dict[str, Column]:
    """Latitude and longitude of the four corners and the center of a scene, as doubles (null if missing)."""
    out = {}
    for corner in ("NW", "NE", "SE", "SW"):
        for axis, name in (("Lat", "lat"), ("Long", "lon")):
            out[f"{corner.lower()}_{name}"] = metadata_value(metadata, f"{corner} Corner {axis} dec").try_cast("double")
    out["center_lat"] = metadata_value(metadata, "Center Latitude dec").try_cast("double")
    out["center_lon"] = metadata_value(metadata, "Center Longitude dec").try_cast("double")
    return out


def extension(path: Column) -> Column:
    """With its dot, lower-cased."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def has_extension(path: Column, *wanted: str) -> Column:
    return extension(path).isin(*(w.lower() if w.startswith(".") else f".{w.lower()}" for w in wanted))


def scene_file(dataset: Column, entity: Column) -> Column:
    return F.concat(dataset, F.lit("-"), entity, F.lit(".txt"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bounds_type(name: Column) -> Column:
    """The kinds of area there are: POINT alone."""
    return F.when(F.upper(name) == "POINT", "POINT").otherwise(F.raise_error(F.concat(F.lit("unknown bounds type: "), F.coalesce(name, F.lit("null")))).cast("string"))


def resample_label(scale: float) -> str:
    if scale == 1.0:
        return "none"
    return "reducing lanczos" if scale <= 0.25 else "lanczos"
