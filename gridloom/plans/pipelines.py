"""The composite jobs: gather, stitch, split, elevation merge, downloads, scenes, the full pass."""

from __future__ import annotations

import os
import shutil
import struct
import time
import zlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import crs
from gridloom.functions.geo import METERS_PER_DEGREE, box_around, box_bounds, box_by_meters, corners, extremes, halves, native_lod, num, pixel_size, projected, scaled_cell
from gridloom.functions.parse import basename, chunk_key, corner_fields, tile_name, xyz_path
from gridloom.functions.predicates import check_arguments, checked_lod, overlaps_open
from gridloom.operators import chunks, coverage, grid, mosaic, pyramid, raster, services, spatial_join, windows
from gridloom.sources import manifest, remote, scan, tiff
from gridloom.sources.scheme import TileScheme, read_conf, web_mercator
from gridloom.staging import stage


# -- writing files by tasks -----------------------------------------------------------------


def write_files(images: DataFrame, folder: str) -> int:
    """Write ``name, content`` rows as files, each by the task that holds it, aside and then renamed.

    The folder must be one that all executors share.
    """

    def written(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(aside := f"{path}.{os.getpid()}.tmp", "wb") as f:
                    f.write(content)
                os.replace(aside, path)
            yield pd.DataFrame({"n": [len(frame)]})

    done = images.select("name", "content").mapInPandas(written, "n long").agg(F.sum("n")).first()[0]
    return int(done or 0)


# -- tile gather --------------------------------------------------------------------------------


def survivors(tiles: DataFrame, scheme: TileScheme, area: dict[str, float] | None = None, level: int | None = None) -> DataFrame:
    """Tiles of one level that overlap or touch the area (projected ``xmin, ymin, xmax, ymax``).

    Levels that the scheme doesn't declare are left out before their footprints are asked for.
    """
    footed = windows.with_footprints(tiles, scheme.levels, scheme.origin_x, scheme.origin_y, scheme.tile_cols, strict=False)
    if area:
        footed = footed.where(windows.inside_area(area["xmin"], area["ymin"], area["xmax"], area["ymax"]))
    return windows.select_level(footed, level)


def area_of_shape(spark: SparkSession, path: str) -> dict[str, float]:
    """The projected box of a shape document's tile-gather area."""
    shape = manifest.read_shape(spark, path)
    box = projected(box_around(F.col("lat"), F.col("lon"), F.col("miles")))
    return shape.select(*(c.alias(k) for k, c in box.items())).first().asDict()


def gather(tiles: DataFrame, scheme: TileScheme, dimension: int, level: int | None = None, area: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows with ``name`` and ``bounds``, placed tiles): the plan of a gather, without pixels."""
    check_arguments(dimension=dimension)
    kept = survivors(tiles, scheme, area, level)
    placed = windows.normalized(kept)
    plan = windows.windows(placed, dimension, "path" if "path" in placed.columns else None)
    leveled = kept.agg(F.max("level").alias("level"))
    top = leveled.first()["level"]
    if top is None:
        return plan.withColumn("name", windows.output_name()).limit(0), placed
    bounds = windows.window_bounds(scheme.resolution(top), scheme.origin_x, scheme.origin_y, scheme.tile_cols)
    return plan.withColumn("name", windows.output_name()).withColumn("bounds", bounds), placed


def import_cache(spark: SparkSession, cache_dir: str, output_dir: str, shape: str | None = None, dimension: int = 1, scale: float = 1.0, level: int | None = None, resume: bool = False, elevation_dir: str | None = None, padding: float = 0.0) -> DataFrame:
    """Gather an exploded cache into N x N images and a manifest; returns the windows."""
    check_arguments(dimension=dimension, scale=scale)
    scheme = read_conf(spark, f"{cache_dir}/conf.xml")
    tiles = scan.cache_tiles(spark, cache_dir, scheme.format, contents=True)
    return _gather_to(spark, tiles, scheme, output_dir, shape, dimension, scale, level, resume, elevation_dir, padding)


def import_pyramid(spark: SparkSession, folder: str, output_dir: str, shape: str | None = None, dimension: int = 1, scale: float = 1.0, level: int | None = None, min_level: int = 0, max_level: int = 23, resume: bool = False, elevation_dir: str | None = None, padding: float = 0.0) -> DataFrame:
    """The same for a downloaded XYZ pyramid; without a level, the highest one is taken."""
    check_arguments(dimension=dimension, scale=scale)
    tiles = scan.xyz_tiles(spark, folder, contents=True)
    return _gather_to(spark, tiles, web_mercator(spark, min_level, max_level), output_dir, shape, dimension, scale, level, resume, elevation_dir, padding)


def _gather_to(spark, tiles, scheme, output_dir, shape, dimension, scale, level, resume, elevation_dir, padding) -> DataFrame:
    os.makedirs(output_dir, exist_ok=True)
    area = area_of_shape(spark, shape) if shape else None
    elevation = None
    if elevation_dir:
        if not shape:
            raise ValueError("merging elevation needs a shape")
        elevation = [merge_elevation(spark, elevation_dir, shape, output_dir, padding)]
    plan, placed = gather(tiles, scheme, dimension, level, area)
    plan = stage(plan, "windows")
    wanted = plan
    if resume:
        present = scan.files(spark, output_dir, recursive=False).where("length > 0").select(F.regexp_replace(basename(F.col("path")), r"\.png$", "").alias("name"))
        wanted = plan.join(present, "name", "left_anti")
    at = lambda k: (F.floor(F.col(k) / dimension) * dimension).cast("long")
    needed = placed.withColumns({"origin_r": at("r"), "origin_c": at("c")}).join(wanted.select("origin_r", "origin_c"), ["origin_r", "origin_c"], "left_semi")
    made = raster.composite(needed.select("r", "c", "path", "content"), dimension, scale)
    write_files(made.select(F.concat(windows.output_name(), F.lit(".png")).alias("name"), "content"), output_dir)
    entries = plan.select(F.struct("origin_r", "origin_c").alias("pos"), "name", "bounds")
    manifest.write_document(manifest.to_manifest(entries, elevation), f"{output_dir}/{manifest.NAME}")
    return plan


# -- stitch by manifest --------------------------------------------------------------------------


def placed_images(entries: DataFrame) -> DataFrame:
    """Manifest entries on a grid: ``r, c, pos, name, bounds``, one a cell.

    An entry without a center counts by the midpoint of its corners; one without either is an error that names it.
    """
    e = extremes(F.col("bounds"))
    place = {}
    for k in ("lat", "lon"):
        given = F.col("bounds")["center"][k]
        between = (e[f"min_{k}"] + e[f"max_{k}"]) / num(2)
        known = [F.when(~F.isnan(v), v) for v in (given, between)]
        place[f"center_{k}"] = F.coalesce(*known, F.raise_error(F.concat(F.lit("no place for the image "), "name")).cast("double"))
    centers = entries.withColumns(place)
    return grid.cells(grid.place(centers).drop("center_lat", "center_lon"))


def entry_boxes(entries: DataFrame) -> DataFrame:
    """``id, name`` and the box of each entry."""
    e = extremes(F.col("bounds"))
    return entries.select(F.col("pos").alias("id"), "name", e["min_lon"].alias("x0"), e["min_lat"].alias("y0"), e["max_lon"].alias("x1"), e["max_lat"].alias("y1"))


def stitch(spark: SparkSession, input_dir: str, output_dir: str, dimension: int = 1, scale: float = 1.0, verify: bool = True, resume: bool = False) -> DataFrame:
    """Composite the images of a manifest into N x N windows and write a new manifest."""
    check_arguments(dimension=dimension, scale=scale)
    os.makedirs(output_dir, exist_ok=True)
    doc = manifest.read_manifest(spark, f"{input_dir}/{manifest.NAME}")
    entries = stage(manifest.images(doc), "entries")
    if verify:
        spatial_join.refuse_overlaps(entry_boxes(entries))
    placed = stage(placed_images(entries), "placed")
    listing = scan.files(spark, input_dir, recursive=False)
    file_of = F.concat("name", F.lit(".png"))
    expected = placed.select(file_of.alias("path"))
    bad = scan.damaged_images(expected, listing.select(basename(F.col("path")).alias("path"), "length")).orderBy("path").limit(20).collect()
    if bad:
        raise FileNotFoundError("tile images: " + ", ".join(f"{r['path']} ({r['problem']})" for r in bad))
    plan = windows.windows(placed, dimension, "name").withColumn("name", windows.output_name())
    at = lambda k: (F.floor(F.col(k) / dimension) * dimension).cast("long")
    grouped = placed.withColumns({"origin_r": at("r"), "origin_c": at("c")})
    merged = windows.merged_bounds(grouped, "origin_r", "origin_c")
    plan = stage(plan.join(merged, ["origin_r", "origin_c"]), "plan")
    wanted = grouped
    if resume:
        present = scan.files(spark, output_dir, recursive=False).where("length > 0").select(F.regexp_replace(basename(F.col("path")), r"\.png$", "").alias("done"))
        wanted = grouped.join(present, windows.output_name() == F.col("done"), "left_anti")
    contents = listing.select(F.regexp_replace(basename(F.col("path")), r"\.png$", "").alias("name"), "path", "content")
    made = raster.composite(wanted.join(contents, "name").select("r", "c", "path", "content"), dimension, scale)
    write_files(made.select(F.concat(windows.output_name(), F.lit(".png")).alias("name"), "content"), output_dir)
    entries_out = plan.select(F.struct("origin_r", "origin_c").alias("pos"), "name", "bounds")
    manifest.write_document(manifest.to_manifest(entries_out, manifest.elevation_files(doc)), f"{output_dir}/{manifest.NAME}")
    copy_others(spark, input_dir, output_dir, entries)
    return plan


def copy_others(spark: SparkSession, input_dir: str, output_dir: str, entries: DataFrame) -> int:
    """Copy the files that are neither the manifest nor a tile's image."""
    named = scan.files(spark, input_dir, recursive=False).select(basename(F.col("path")).alias("name"), "content").where(F.col("name") != manifest.NAME)
    others = named.join(entries.select(F.concat("name", F.lit(".png")).alias("name")), "name", "left_anti")
    return write_files(others, output_dir)


def split(spark: SparkSession, input_dir: str, output_dir: str, axis: str = "auto") -> DataFrame:
    """Cut the manifest's images in two; entries without an image pass through."""
    check_arguments(axis=axis)
    os.makedirs(output_dir, exist_ok=True)
    doc = manifest.read_manifest(spark, f"{input_dir}/{manifest.NAME}")
    entries = stage(manifest.images(doc), "entries")
    files = scan.files(spark, input_dir, recursive=False).select(F.regexp_replace(basename(F.col("path")), r"\.png$", "").alias("name"), "content", F.endswith("path", F.lit(".png")).alias("png")).where("png")
    having = files.join(entries.select("name"), "name", "left_semi").select("name", "content")
    parts = stage(raster.split_images(having, axis), "halves")
    write_files(parts.select(F.concat("name", F.lit("_"), "half", F.lit(".png")).alias("name"), "content"), output_dir)
    sized = having.select("name", F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("int").alias("width"), F.conv(F.hex(F.substring("content", 21, 4)), 16, 10).cast("int").alias("height"))
    chosen = F.lit(axis) if axis != "auto" else raster.planned_axis()
    cut = entries.join(sized, "name").select("name", F.explode(halves(F.col("bounds"), chosen)).alias("h")).select("name", "h.half", "h.bounds")
    merged = manifest.merge_splits(entries, cut)
    manifest.write_document(manifest.to_manifest(merged, manifest.elevation_files(doc)), f"{output_dir}/{manifest.NAME}")
    copy_others(spark, input_dir, output_dir, entries)
    return merged


# -- elevation -----------------------------------------------------------------------------------


def elevation_plan(headers: DataFrame, area: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(rasters inside the area with their region's ``group``, regions with ``covered``)."""
    boxes = headers.select("path", "px", "py", "epsg", F.col("min_lon").alias("x0"), F.col("min_lat").alias("y0"), F.col("max_lon").alias("x1"), F.col("max_lat").alias("y1"))
    target = {"x0": num(area["min_lon"]), "y0": num(area["min_lat"]), "x1": num(area["max_lon"]), "y1": num(area["max_lat"])}
    near = boxes.where(overlaps_open({k: F.col(k) for k in target}, target)).withColumn("id", F.xxhash64("path"))
    near = stage(near, "elevation")
    linked = spatial_join.touching_groups(near)
    grouped = near.join(linked, "id")
    aims = grouped.select("group").distinct().select("group", *(c.alias(k) for k, c in target.items()))
    return grouped, coverage.areas_covered(grouped.select("group", "x0", "y0", "x1", "y1"), aims, "group")


def merge_elevation(spark: SparkSession, folder: str, shape: str, output_dir: str, padding: float = 0.0) -> str:
    """Mosaic the GeoTIFFs that reach the shape's area into one; returns its name.

    Sources go in the order of their paths.  A region that doesn't cover the area is a warning.
    """
    import warnings

    import numpy as np

    row = manifest.read_shape(spark, shape)
    box = box_around(F.col("lat"), F.col("lon"), F.col("miles"))
    area = row.select(*(c.alias(k) for k, c in box.items())).first().asDict()
    area = {k: v - padding if k.startswith("min") else v + padding for k, v in area.items()}
    files = scan.elevation_files(spark, folder)
    heads = stage(tiff.headers(files), "headers")
    near, regions = elevation_plan(heads, area)
    if near.isEmpty():
        raise ValueError("no elevation file reaches the area")
    if not regions.where("covered").limit(1).count():
        warnings.warn("no region of elevation files covers the whole area", stacklevel=2)
    in_degrees = lambda c: F.when(F.col("epsg").isin(*crs.DEGREES), F.col(c)).otherwise(F.col(c) / num(METERS_PER_DEGREE)).alias(c)
    fine = mosaic.target_resolution(near.select(in_degrees("px"), in_degrees("py")))
    px, py = fine.first()
    size = mosaic.target_size(area["min_lon"], area["min_lat"], area["max_lon"], area["max_lat"], fine).first()
    order = near.select("path", F.row_number().over(Window.orderBy("path")).cast("long").alias("src_seq"))
    sources = files.join(order, "path").select("path", "src_seq", "content")
    bands = tiff.bands(sources)
    blocks = mosaic.mosaic_blocks(mosaic.reprojected(bands, area["min_lon"], area["max_lat"], px, py, size["width"], size["height"]))
    first = heads.join(order.where("src_seq = 1"), "path").first()
    dtype = np.dtype(first["dtype"])
    empty = np.nan if dtype.kind == "f" else np.iinfo(dtype).min

    def packed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            out = []
            for b in frame.itertuples(index=False):
                values = np.frombuffer(b.data).reshape(b.h, b.w)
                values = values if dtype.kind == "f" else np.where(np.isnan(values), empty, np.rint(values))
                out.append((b.band, b.block_y, b.block_x, tiff.deflated(values, dtype.name, empty)))
            yield pd.DataFrame(out, columns=["band", "y", "x", "content"])

    # tasks deflate the tiles; the driver writes them as they come, a partition at a time
    tiles = blocks.mapInPandas(packed, "band int, y int, x int, content binary")
    name = "merged_elevation.tif"
    with tiff.TiledFile(os.path.join(output_dir, name), size["width"], size["height"], first["bands"], dtype.name, area["min_lon"], area["max_lat"], px, py, 4326, empty, float("nan")) as merged:
        for t in tiles.toLocalIterator():
            merged.add(t["band"] - 1, t["y"], t["x"], t["content"])
    with open(os.path.join(output_dir, ".star_ignore_merged_elevation"), "w"):
        pass
    return name


# -- downloads -----------------------------------------------------------------------------------


def download_plan(spark: SparkSession, lat: float, lon: float, miles: float, registry: DataFrame, level: int | None = None, kind: str = "imagery", index: int | None = None, resolution: float | None = None, padding: float = 0.0, chunk: int = 256) -> tuple[dict, DataFrame]:
    """(the chosen service, the grid of chunks) of an imagery or elevation download.

    Imagery takes its pixel size from the level, which may not be finer than the service's own;
    elevation takes ``resolution`` or the service's.
    """
    one = spark.range(1).select("id", *(c.alias(k) for k, c in box_by_meters(num(lat), num(lon), num(miles)).items()))
    one = one.select("id", *(F.col(k) + num(-padding if k.startswith("min") else padding) for k in ("min_lat", "min_lon", "max_lat", "max_lon"))).toDF("id", "min_lat", "min_lon", "max_lat", "max_lon")
    key = services.select_service(one, registry, kind, index)
    service = registry.where(F.col("key") == key).first().asDict()
    if kind == "elevation":
        if resolution is not None and resolution <= 0:
            raise ValueError("resolution must be positive")
        pixel = num(resolution or service["native_pixel_size_m"])
    else:
        wanted = F.lit(level) if level is not None else native_lod(num(service["native_pixel_size_m"]))
        pixel = pixel_size(checked_lod(wanted, num(service["native_pixel_size_m"])))
    area = one.select(*(c.alias(k) for k, c in projected({k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}).items()), pixel.alias("pixel"))
    native = spark.range(1).select(native_lod(num(service["native_pixel_size_m"]))).first()[0]
    return service | {"native_lod": native}, chunks.chunk_grid(area, chunk)


LEDGER = "manifest.json"


def fetch_missing(spark: SparkSession, plan: DataFrame, service: dict, folder: str, pixel_type: str = "U8", retries: int = 5, timeout: float = 60, transport: str = "gridloom.sources.remote:http_get") -> DataFrame:
    """Fetch the chunks that the folder's ledger lacks, or whose files are damaged; returns the new ledger.

    A folder belongs to one area and level.  A missing or broken ledger is made anew from the
    names of the files that are there.
    """
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, LEDGER)
    present = scan.files(spark, folder, recursive=False).where(F.endswith("path", F.lit(".tif")))
    named = present.withColumn("path", basename(F.col("path")))
    ledger = manifest.read_ledger(spark, path)
    if ledger.isEmpty():
        ledger = chunks.recovered(named.select("path"))
    ledger = stage(ledger, "ledger")
    left = stage(chunks.remaining(plan, ledger, chunks.verified(named)), "left")
    got = stage(remote.fetch_chunks(left, service["base_url"], service["srs"], pixel_type=pixel_type, retries=retries, timeout=timeout, transport=transport), "fetched")
    name = F.concat(F.lit("chunk_"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"), F.lit(".tif"))
    write_files(georeferenced(got.where("status = 'downloaded'").withColumn("name", name)), folder)
    news = got.select(chunk_key(F.col("row"), F.col("col")).alias("key"), "status", F.when(F.col("status") == "downloaded", name).alias("file"))
    whole = stage(chunks.updated(ledger, news), "ledger")
    manifest.write_document(manifest.ledger_document(whole), path)
    return whole


def georeferenced(got: DataFrame) -> DataFrame:
    """``name, content``: fetched images (with their boxes) as plain GeoTIFFs in Web Mercator; what can't be decoded stays as it came."""
    columns = ["name", "xmin", "ymin", "xmax", "ymax", "content"]

    def placed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    values = pyramid.decode_image(r.content).transpose(2, 0, 1)
                    content = tiff.encode(values, r.xmin, r.ymax, (r.xmax - r.xmin) / values.shape[2], (r.ymax - r.ymin) / values.shape[1], 3857, deflate=False)
                except (ValueError, KeyError, struct.error, zlib.error):
                    content = r.content
                out.append((r.name, content))
            yield pd.DataFrame(out, columns=["name", "content"])

    return got.select(*columns).mapInPandas(placed, "name string, content binary")


def write_mosaic(spark: SparkSession, plan: DataFrame, folder: str, chunk: int = 256) -> str:
    """Virtual mosaics over the folder's chunk files: one document, or one a part and one over the parts. Returns the top one's path."""
    have = scan.chunk_files(spark, folder).select("row", "col", F.substring("content", 1, 1 << 16).alias("head"))
    first = have.limit(1).select("head").first()
    if first is None:
        raise ValueError(f"{folder} has no chunk files")
    _, tags = tiff.tags(bytes(first["head"]))
    kind = tiff.header(bytes(first["head"]))["dtype"]
    docs = chunks.vrt_documents(plan.join(have.select("row", "col"), ["row", "col"], "left_semi"), tags[tiff.SAMPLES][0], kind, chunk)
    write_files(docs.select("name", F.col("value").cast("binary").alias("content")), folder)
    return os.path.join(folder, chunks.TOP_VRT)


def mosaic_file(spark: SparkSession, plan: DataFrame, folder: str, path: str, chunk: int = 256) -> str:
    """One tiled GeoTIFF of the folder's chunks (``chunk`` a multiple of 16): a chunk is a tile, deflated by its task."""
    import numpy as np

    have = scan.chunk_files(spark, folder).select("row", "col", "content")
    met = stage(plan.join(have, ["row", "col"]), "mosaic")
    found = met.agg(F.min("xmin").alias("left"), F.max("ymax").alias("top"), F.min("row").alias("row"), F.min("col").alias("col")).first()
    first = met.orderBy("row", "col").first()
    if first is None:
        raise ValueError(f"{folder} has no chunk files")
    image = pyramid.decode_image(bytes(first["content"]))
    px, py = (first["xmax"] - first["xmin"]) / first["w"], (first["ymax"] - first["ymin"]) / first["h"]
    size = met.agg(F.max((F.col("col") - found["col"]) * chunk + F.col("w")).alias("w"), F.max((F.col("row") - found["row"]) * chunk + F.col("h")).alias("h")).first()
    dtype, bands = image.dtype.name, image.shape[2]
    empty = np.nan if image.dtype.kind == "f" else 0

    def packed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                values = pyramid.decode_image(r.content).transpose(2, 0, 1)
                out += [(b, int(r.row) - found["row"], int(r.col) - found["col"], tiff.deflated(values[b], dtype, empty, chunk)) for b in range(bands)]
            yield pd.DataFrame(out, columns=["band", "y", "x", "content"])

    tiles = met.select("row", "col", "content").mapInPandas(packed, "band int, y long, x long, content binary")
    with tiff.TiledFile(path, size["w"], size["h"], bands, dtype, found["left"], found["top"], px, py, 3857, empty, empty if image.dtype.kind == "f" else None, chunk) as out:
        for t in tiles.toLocalIterator():
            out.add(t["band"], t["y"], t["x"], t["content"])
    return path


def build_pyramid(spark: SparkSession, plan: DataFrame, folder: str, level: int, output_dir: str, resampling: str = "lanczos", tms: bool = False) -> int:
    """Cut the folder's chunks into the level's tiles, ``<z>/<x>/<y>.png``, rows counted from the north or (``tms``) the south."""
    have = scan.chunk_files(spark, folder).select("row", "col", "content")
    tiles = pyramid.pyramid_tiles(plan.join(have, ["row", "col"]), level, resampling)
    y = pyramid.flipped(level, F.col("y")) if tms else F.col("y")
    return write_files(tiles.select(xyz_path(F.col("z"), y, F.col("x")).alias("name"), "content"), output_dir)


def download_imagery(spark: SparkSession, lat: float, lon: float, miles: float, registry: DataFrame, output_dir: str, level: int | None = None, index: int | None = None, resampling: str = "lanczos", tms: bool = False, skip_mosaic: bool = False, chunk: int = 256, **fetching) -> DataFrame:
    """Chunks of the covering service, then its pyramid level; the chunks stay if some failed. Returns the ledger."""
    service, plan = download_plan(spark, lat, lon, miles, registry, level, "imagery", index, chunk=chunk)
    zoom = level if level is not None else service["native_lod"]
    folder = os.path.join(output_dir, f"chunks_{zoom}")
    plan = stage(plan, "chunks")
    ledger = fetch_missing(spark, plan, service, folder, "U8", **fetching)
    if ledger.where("status = 'downloaded'").isEmpty():
        raise RuntimeError("no chunk could be fetched")
    write_mosaic(spark, plan, folder, chunk)
    if not skip_mosaic:
        build_pyramid(spark, plan, folder, zoom, output_dir, resampling, tms)
        if ledger.where("status <> 'downloaded'").isEmpty():
            shutil.rmtree(folder)
    return ledger


def download_elevation(spark: SparkSession, lat: float, lon: float, miles: float, registry: DataFrame, output_dir: str, resolution: float | None = None, padding: float = 0.0, index: int | None = None, chunk: int = 256, **fetching) -> DataFrame:
    """Float chunks of the covering elevation service, as GeoTIFFs in Web Mercator. Returns the ledger."""
    import warnings

    service, plan = download_plan(spark, lat, lon, miles, registry, None, "elevation", index, resolution, padding, chunk)
    if resolution is not None and resolution < service["native_pixel_size_m"]:
        warnings.warn("the resolution is finer than the service's own", stacklevel=2)
    ledger = fetch_missing(spark, stage(plan, "chunks"), service, output_dir, "F32", **fetching)
    if ledger.where("status = 'downloaded'").isEmpty():
        raise RuntimeError("no chunk could be fetched")
    return ledger


def tiers(level: int) -> list[int]:
    """Levels of a full pass: 17 and 18, and 19 where it is asked for."""
    return [17, 18, 19] if level >= 19 else [17, 18]


def _gathered(level: int, gather_level: Callable[[int], DataFrame]) -> DataFrame | None:
    """The level's windows; None if it has no tiles."""
    try:
        return gather_level(level)
    except windows.EmptyLevelError:
        return None


def full_pass(tier_levels: list[int], gather_level: Callable[[int], DataFrame], download: Callable[[int], None], dimension: int = 2) -> dict[int, DataFrame]:
    """Windows of every tier, from one download at the highest level and one more for each tier that it left empty."""
    check_arguments(dimension=dimension, least_dimension=2)
    download(max(tier_levels))
    made = {level: _gathered(level, gather_level) for level in tier_levels}
    for level in [k for k, plan in made.items() if plan is None]:
        download(level)
        made[level] = gather_level(level)
    return made


def process_terrain(spark: SparkSession, lat: float, lon: float, miles: float, registry: DataFrame, output_dir: str, dimension: int = 2, scale: float = 1.0, ultra: bool = False, with_elevation: bool = False, keep_tiles: bool = False, resume: bool = False, index: int | None = None, **fetching) -> dict[int, DataFrame]:
    """Download once at the highest tier, merge elevation if asked, and gather each tier into its folder."""
    check_arguments(dimension=dimension, scale=scale, least_dimension=2)
    os.makedirs(output_dir, exist_ok=True)
    shape, tiles, heights = (os.path.join(output_dir, n) for n in ("shape.json", "tiles", "elevation"))
    with open(shape, "w") as f:
        f.write(manifest.shape_document(lat, lon, miles))
    if with_elevation:
        download_elevation(spark, lat, lon, miles, registry, heights, **fetching)

    def load(level: int) -> None:
        download_imagery(spark, lat, lon, miles, registry, tiles, level, index, **fetching)

    def gather_level(level: int) -> DataFrame:
        folder = os.path.join(output_dir, f"tier_{level}")
        return import_pyramid(spark, tiles, folder, shape, dimension, scale, level, resume=resume, elevation_dir=heights if with_elevation else None)

    out = full_pass(tiers(19 if ultra else 18), gather_level, load, dimension)
    if not keep_tiles:
        shutil.rmtree(tiles, ignore_errors=True)
    return out


# -- scenes --------------------------------------------------------------------------------------


def scene_boxes(scenes: DataFrame) -> DataFrame:
    """``id`` and box of scenes (``id, metadata``) that name all four corners."""
    c = corner_fields(F.col("metadata"))
    flat = scenes.select("id", *(v.alias(k) for k, v in c.items()))
    corners = [f"{k}_{axis}" for k in ("nw", "ne", "se", "sw") for axis in ("lat", "lon")]
    whole = flat.dropna(subset=corners)
    lons, lats = [F.col(k) for k in corners if k.endswith("lon")], [F.col(k) for k in corners if k.endswith("lat")]
    return whole.select("id", F.least(*lons).alias("x0"), F.least(*lats).alias("y0"), F.greatest(*lons).alias("x1"), F.greatest(*lats).alias("y1"))


def scene_representatives(boxes: DataFrame, threshold: float = 0.9, criteria: str = "min_index") -> DataFrame:
    """One scene of each group that overlaps by ``threshold`` or more."""
    boxes = stage(boxes, "scenes")
    grouped = spatial_join.overlap_groups(boxes, threshold)
    return spatial_join.representatives(boxes, grouped, criteria)


def download_scenes(spark: SparkSession, client: remote.CatalogueClient, lat: float, lon: float, miles: float, output_dir: str, start: str | None = None, end: str | None = None, threshold: float = 0.9, criteria: str = "min_index", label: str = "gridloom", transport: str = "gridloom.sources.remote:http_file", sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Search, thin out, ask for and download scenes: ``entityId, file, error`` of the scenes that were kept.

    The first aerial dataset at the area is searched; of scenes that overlap by ``threshold`` or more one
    is kept, and its bounds are written beside its file.
    """
    one = spark.range(1).select(*(c.alias(k) for k, c in box_around(num(lat), num(lon), num(miles)).items())).first()
    box = tuple(one[k] for k in ("min_lat", "min_lon", "max_lat", "max_lon"))
    dataset = next((d["datasetAlias"] for d in client.datasets(box) if "Aerial" in (d.get("keywords") or "")), None)
    if dataset is None:
        raise ValueError("no aerial dataset at the area")
    found = client.scenes(dataset, box, start, end)
    rows = [(i, s["entityId"], [(m.get("fieldName"), None if m.get("value") is None else str(m["value"])) for m in s.get("metadata", [])]) for i, s in enumerate(found)]
    scenes = spark.createDataFrame(rows, "id long, entityId string, metadata array<struct<fieldName:string,value:string>>")
    boxes = stage(scene_boxes(scenes), "scene-boxes")
    kept = scene_representatives(boxes, threshold, criteria).select("id").join(scenes, "id").join(boxes, "id")
    kept = stage(kept.select("entityId", "x0", "y0", "x1", "y1"), "scenes-kept")
    asked = [r["entityId"] for r in kept.select("entityId").collect()]  # a search gives 3000 scenes at most
    ready = [(d.get("entityId") or d.get("displayId"), d["url"]) for d in remote.request_scenes(client, dataset, asked, label, sleep)] if asked else []
    got = stage(remote.fetch_files(spark.createDataFrame(ready, "entityId string, url string").repartition(max(1, len(ready) // 8)), output_dir, transport=transport), "scene-files")
    bounds = box_bounds(F.col("y1"), F.col("y0"), F.col("x0"), F.col("x1"))
    sides = kept.join(got.where("file IS NOT NULL"), "entityId").select(F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(".json")).alias("name"), manifest.sidecar(bounds, F.col("file")).cast("binary").alias("content"))
    write_files(sides, output_dir)
    return got


# -- archives ------------------------------------------------------------------------------------


def prepare_archives(spark: SparkSession, folder: str, output_dir: str, scale: float = 1.0) -> int:
    """Zips of PNG scenes with sidecars into images and a manifest; no archive gives an empty manifest."""
    check_arguments(scale=scale)
    os.makedirs(output_dir, exist_ok=True)
    opened = raster.unzip_images(scan.archives(spark, folder))
    stem = F.regexp_replace(basename(F.col("path")), r"(?i)\.zip$", "")

    def reduced(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, content in zip(frame["name"], frame["content"], strict=True):
                p = raster.decode_png(content)
                w, h = (max(1, int(n * scale)) for n in (p.shape[1], p.shape[0]))
                out.append((name, raster.encode_png(raster.resize(p, w, h))))
            yield pd.DataFrame(out, columns=["name", "content"])

    made = stage(opened.select(stem.alias("name"), "content").mapInPandas(reduced, "name string, content binary"), "prepared")
    n = write_files(made.select(F.concat("name", F.lit(".png")).alias("name"), "content"), output_dir)
    sides = manifest.read_sidecars(spark, folder)
    entries = made.select("name").join(sides.withColumnRenamed("stem", "name"), "name").select(F.col("name").alias("pos"), "name", "bounds")
    manifest.write_document(manifest.to_manifest(entries), f"{output_dir}/{manifest.NAME}")
    return n


def export_tiles(tiles: DataFrame, scheme: TileScheme, output_dir: str) -> int:
    """A zip and a sidecar for each tile (``path, content, level, row, col``); returns how many."""
    footed = windows.with_footprints(tiles, scheme.levels, scheme.origin_x, scheme.origin_y, scheme.tile_cols)
    named = footed.select(tile_name(F.col("level"), F.col("row"), F.col("col")).alias("name"), basename(F.col("path")).alias("entry"), "content", corners(F.col("west_x"), F.col("east_x"), F.col("south_y"), F.col("north_y")).alias("bounds"))
    zipped = raster.zip_tiles(named)
    n = write_files(zipped.select(F.concat("name", F.lit(".zip")).alias("name"), "content"), output_dir)
    write_files(named.select(F.concat("name", F.lit(".json")).alias("name"), manifest.sidecar(F.col("bounds"), F.col("entry")).cast("binary").alias("content")), output_dir)
    return n


def scaled_size(width: int, height: int, scale: float) -> tuple:
    """Columns of a cell's size after scaling."""
    return scaled_cell(F.lit(width), scale), scaled_cell(F.lit(height), scale)
