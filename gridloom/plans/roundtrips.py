"""Queries that write files by the engine's sinks, read them back by its scans, and return what was read.

Their inputs are whole small tables, by key arithmetic; the SQL says what must come back.  Files
go to the folder that the cluster shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo, parse
from gridloom.functions.geo import num
from gridloom.functions.predicates import aerial
from gridloom.operators import chunks, grid, ordering, polygon, pyramid, raster, services, spatial_join, windows
from gridloom.plans import derived as d
from gridloom.plans import pipelines
from gridloom.plans.queries import CHUNKS_SQL, O, R, WORLD, _bbox, _chunks, _pairs_sql, lat_sql, lon_sql, mx_sql, my_sql, query, r
from gridloom.sources import manifest, remote, scan, tiff
from gridloom.sources.scheme import read_conf, web_mercator
from gridloom.staging import claim


def _folder(spark, name: str) -> str:
    """A new path in the shared folder, as the file functions of tasks name it."""
    return claim(spark, name).removeprefix("file://")


def _bytes(n: Column) -> Column:
    return F.repeat(F.lit("x"), n.cast("int")).cast("binary")


def text(c: Column) -> Column:
    return c.cast("string")


# -- tile trees, schemes, listings -------------------------------------------------------------------

KEYS = 'keys AS (SELECT (10 + s_suppkey % 5)::INTEGER AS level, (s_suppkey * 17)::BIGINT AS "row", (s_suppkey * 31)::BIGINT AS col, (1 + s_suppkey % 50)::BIGINT AS length FROM supplier)'


def _keys(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return d.table(spark, sf_dir, "supplier").select((10 + k % 5).cast("int").alias("level"), (k * 17).alias("row"), (k * 31).alias("col"), (1 + k % 50).alias("length"))


def _cache(spark, sf_dir) -> str:
    """An exploded cache, with a file of another kind beside every tile."""
    folder = _folder(spark, "cache")
    at = F.concat(F.lit("_alllayers/L"), F.lpad(text(F.col("level")), 2, "0"), F.lit("/"), parse.cache_path(F.col("row"), F.col("col")))
    tiles = _keys(spark, sf_dir).select(at.alias("name"), _bytes(F.col("length")).alias("content"))
    pipelines.write_files(tiles.unionByName(tiles.withColumn("name", F.concat("name", F.lit(".txt")))), folder)
    return folder


@query("cache_scan", f'WITH {KEYS} SELECT level, "row", col, length FROM keys')
def cache_scan(spark, sf_dir):
    return scan.cache_tiles(spark, _cache(spark, sf_dir)).select("level", "row", "col", "length")


@query("cache_row_folders", f"""WITH {KEYS}, f AS (SELECT DISTINCT printf('L%02d', level) AS level_folder, printf('R%08x', "row") AS row_folder FROM keys)
SELECT CAST(row_number() OVER (ORDER BY level_folder, row_folder) - 1 AS BIGINT) AS place, level_folder, row_folder FROM f""")
def cache_row_folders(spark, sf_dir):
    folders = scan.row_folders(scan.cache_tiles(spark, _cache(spark, sf_dir)))
    return ordering.ordered(folders, "level_folder", "row_folder").numbered("place").rows().select("place", "level_folder", "row_folder")


@query("xyz_scan", f'WITH {KEYS} SELECT level, "row", col, length FROM keys')
def xyz_scan(spark, sf_dir):
    folder = _folder(spark, "xyz")
    tiles = _keys(spark, sf_dir).select(parse.xyz_path(F.col("level"), F.col("row"), F.col("col")).alias("name"), _bytes(F.col("length")).alias("content"))
    pipelines.write_files(tiles, folder)
    return scan.xyz_tiles(spark, folder).select("level", "row", "col", "length")


def _conf(levels: DataFrame, folder: str) -> str:
    """Write conf.xml for ``level_id, scale, resolution``."""
    lod = F.concat(F.lit("<LODInfo><LevelID>"), text(F.col("level_id")), F.lit("</LevelID><Scale>"), text(F.col("scale")), F.lit("</Scale><Resolution>"), text(F.col("resolution")), F.lit("</Resolution></LODInfo>"))
    head = (
        "<CacheInfo><TileCacheInfo><SpatialReference><WKID>102100</WKID><LatestWKID>3857</LatestWKID></SpatialReference>"
        f"<TileOrigin><X>{-O}</X><Y>{O}</Y></TileOrigin><TileCols>256</TileCols><TileRows>256</TileRows><DPI>96</DPI><LODInfos>"
    )
    tail = "</LODInfos></TileCacheInfo><TileImageInfo><CacheTileFormat>PNG</CacheTileFormat></TileImageInfo><CacheStorageInfo><StorageFormat>esriMapCacheStorageModeExploded</StorageFormat></CacheStorageInfo></CacheInfo>"
    doc = levels.agg(F.concat(F.lit(head), F.concat_ws("", F.sort_array(F.collect_list(lod))), F.lit(tail)).alias("value"))
    pipelines.write_files(doc.select(F.lit("conf.xml").alias("name"), F.col("value").cast("binary").alias("content")), folder)
    return f"{folder}/conf.xml"


@query("conf_scheme", "SELECT n_nationkey::INTEGER AS level_id, (5000 - n_nationkey * 7)::DOUBLE AS scale, round(1000.0::DOUBLE / (1 + n_nationkey), 9) AS resolution, 102100::INTEGER AS wkid, 'png' AS format FROM nation")
def conf_scheme(spark, sf_dir):
    k = F.col("n_nationkey")
    levels = d.table(spark, sf_dir, "nation").select(k.cast("int").alias("level_id"), (5000 - k * 7).cast("double").alias("scale"), (num(1000) / (1 + k).cast("double")).alias("resolution"))
    scheme = read_conf(spark, _conf(levels, _folder(spark, "conf")))
    return scheme.levels.select("level_id", "scale", r(F.col("resolution"), 9).alias("resolution"), F.lit(scheme.wkid).alias("wkid"), F.lit(scheme.format).alias("format"))


@query("folder_listing", "SELECT 'f_' || s_suppkey || '.bin' AS name, (1 + s_suppkey % 50)::BIGINT AS length FROM supplier")
def folder_listing(spark, sf_dir):
    folder, k = _folder(spark, "listing"), F.col("s_suppkey")
    files = d.table(spark, sf_dir, "supplier").select(F.concat(F.lit("f_"), text(k), F.lit(".bin")).alias("name"), _bytes(1 + k % 50).alias("content"))
    pipelines.write_files(files.unionByName(files.withColumn("name", F.concat(F.lit("below/"), "name"))), folder)
    return scan.folder_files(spark, folder).select(parse.basename(F.col("path")).alias("name"), "length")


# -- GeoTIFFs ------------------------------------------------------------------------------------------

RASTERS = """rasters AS (SELECT n_nationkey::BIGINT AS k, n_nationkey % 5 = 0 AS flat, (20 + n_nationkey)::INTEGER AS width, (10 + n_nationkey)::INTEGER AS height, (1 + n_nationkey % 2)::INTEGER AS bands,
  CASE n_nationkey % 3 WHEN 0 THEN 'float32' WHEN 1 THEN 'int16' ELSE 'uint8' END AS dtype FROM nation),
framed AS (SELECT *, CASE WHEN flat THEN k * 10000.0::DOUBLE ELSE -100.0::DOUBLE + k END AS "left", CASE WHEN flat THEN 5000000.0::DOUBLE - k * 1000 ELSE 50.0::DOUBLE - k END AS top,
  CASE WHEN flat THEN 30.0::DOUBLE ELSE 0.015625::DOUBLE END AS px, CASE WHEN flat THEN 20.0::DOUBLE ELSE 0.03125::DOUBLE END AS py, CASE WHEN flat THEN 3857 ELSE 4326 END AS epsg FROM rasters)"""


def _rasters(spark, sf_dir) -> str:
    folder = _folder(spark, "rasters")

    def made(frames):
        for frame in frames:
            out = []
            for k in frame["k"].tolist():
                flat, dtype = k % 5 == 0, ("float32", "int16", "uint8")[k % 3]
                values = np.full((1 + k % 2, 10 + k, 20 + k), k, dtype)
                frame_ = (k * 10000.0, 5e6 - k * 1000, 30.0, 20.0, 3857) if flat else (-100.0 + k, 50.0 - k, 0.015625, 0.03125, 4326)
                out.append((f"{'deep/' if k % 2 else ''}r_{k}.tif", tiff.encode(values, *frame_)))
                out.append((f"r_{k}.TIF", b"not read: the suffix is in capitals"))
            yield pd.DataFrame(out, columns=["name", "content"])

    keys = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pipelines.write_files(keys.mapInPandas(made, "name string, content binary"), folder)
    return folder


@query("tiff_headers", f"""WITH {RASTERS} SELECT 'r_' || k || '.tif' AS name, width, height, bands, dtype, "left", top, px, py, epsg,
  round(CASE WHEN flat THEN {lat_sql("top - height * py")} ELSE top - height * py END, 9) AS min_lat, round(CASE WHEN flat THEN {lon_sql('"left" + width * px')} ELSE "left" + width * px END, 9) AS max_lon FROM framed""")
def tiff_headers(spark, sf_dir):
    heads = tiff.headers(scan.elevation_files(spark, _rasters(spark, sf_dir)))
    return heads.select(parse.basename(F.col("path")).alias("name"), "width", "height", "bands", "dtype", "left", "top", "px", "py", "epsg", r(F.col("min_lat"), 9).alias("min_lat"), r(F.col("max_lon"), 9).alias("max_lon"))


@query("tiff_flat_scan", f"WITH {RASTERS} SELECT 'r_' || k || '.tif' AS name FROM rasters WHERE k % 2 = 0")
def tiff_flat_scan(spark, sf_dir):
    return scan.elevation_files(spark, _rasters(spark, sf_dir), recursive=False).select(parse.basename(F.col("path")).alias("name"))


@query("tiff_bands", f"WITH {RASTERS} SELECT 'r_' || k || '.tif' AS name, unnest(range(1, bands + 1))::INTEGER AS band, k::DOUBLE AS value, (width * height)::BIGINT AS n FROM rasters")
def tiff_bands(spark, sf_dir):
    files = scan.elevation_files(spark, _rasters(spark, sf_dir)).withColumn("src_seq", F.lit(1).cast("long"))

    def summed(frames):
        for frame in frames:
            rows = []
            for x in frame.itertuples(index=False):
                v = np.frombuffer(x.data, x.dtype)
                rows.append((x.path.rpartition("/")[2], x.band, float(v.mean()), len(v)))
            yield pd.DataFrame(rows, columns=["name", "band", "value", "n"])

    return tiff.bands(files).mapInPandas(summed, "name string, band int, value double, n long")


@query("merged_elevation", "SELECT n_nationkey::BIGINT AS k, n_nationkey::DOUBLE AS height FROM nation")
def merged_elevation(spark, sf_dir):
    """25 rasters of one height each, five by five, merged into one file: the heights at their centers."""
    folder, out = _folder(spark, "heights"), _folder(spark, "merged")

    def made(frames):
        for frame in frames:
            rows = [(f"h_{k:02d}.tif", tiff.encode(np.full((1, 10, 10), k, "float32"), -80 + 0.1 * (k % 5), 40 - 0.1 * (k // 5), 0.01, 0.01)) for k in frame["k"].tolist()]
            yield pd.DataFrame(rows, columns=["name", "content"])

    keys = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pipelines.write_files(keys.mapInPandas(made, "name string, content binary"), folder)
    shape = manifest.shape_document(39.75, -79.75, 3)
    pipelines.write_files(spark.createDataFrame([("shape.json", bytearray(shape.encode()))], "name string, content binary"), out)
    pipelines.merge_elevation(spark, folder, f"{out}/shape.json", out, 0.2)

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                h, values = tiff.header(content), tiff.pixels(content)[0]
                at = [(k, 39.95 - 0.1 * (k // 5), -79.95 + 0.1 * (k % 5)) for k in range(25)]
                yield pd.DataFrame([(k, float(values[int((h["top"] - lat) / h["py"]), int((lon - h["left"]) / h["px"])])) for k, lat, lon in at], columns=["k", "height"])

    return scan.elevation_files(spark, out).select("content").mapInPandas(read, "k long, height double")


@query("raster_sizes", "SELECT p_partkey AS id, greatest(1, round_even(p_size::DOUBLE / 7 / 0.03125::DOUBLE, 0))::BIGINT AS width FROM part")
def raster_sizes(spark, sf_dir):
    size = F.col("p_size").cast("double") / num(7)
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.pixels_across(num(0), size, num(0.03125)).alias("width"))


# -- images ---------------------------------------------------------------------------------------------


def _painted(spark, sf_dir, size=lambda k: (8, 8)) -> DataFrame:
    """A tile a supplier: ``k, r, c, name, path, content``, in rows of ten, of one color each."""

    def paint(frames):
        for frame in frames:
            out = []
            for k in frame["k"].tolist():
                w, h = size(k)
                tile = np.full((h, w, 3), (k % 250, k * 7 % 250, 90), np.uint8)
                out.append((k, k // 10, k % 10, f"t_{k:06d}", f"t_{k:06d}.png", raster.encode_png(tile)))
            yield pd.DataFrame(out, columns=["k", "r", "c", "name", "path", "content"])

    keys = d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    return keys.mapInPandas(paint, "k long, r long, c long, name string, path string, content binary")


PAINTED = "tiles AS (SELECT s_suppkey::BIGINT AS k, s_suppkey::BIGINT // 10 AS r, s_suppkey::BIGINT % 10 AS c FROM supplier)"


@query("composite_pixels", f"WITH {PAINTED} SELECT r // 4 * 4 AS origin_r, c // 4 * 4 AS origin_c, r, c, (k % 250)::INTEGER AS red, (k * 7 % 250)::INTEGER AS green FROM tiles")
def composite_pixels(spark, sf_dir):
    """The color in the middle of every tile of the composites."""

    def read(frames):
        for frame in frames:
            out = []
            for x in frame.itertuples(index=False):
                p = raster.decode_png(x.content)
                out += [(x.origin_r, x.origin_c, x.origin_r + i, x.origin_c + j, *p[8 * i + 4, 8 * j + 4, :2].tolist()) for i in range(p.shape[0] // 8) for j in range(p.shape[1] // 8) if p[8 * i + 4, 8 * j + 4, 2] == 90]
            yield pd.DataFrame(out, columns=["origin_r", "origin_c", "r", "c", "red", "green"])

    made = raster.composite(_painted(spark, sf_dir).select("r", "c", "path", "content"), 4)
    return made.select("origin_r", "origin_c", "content").mapInPandas(read, "origin_r long, origin_c long, r long, c long, red int, green int")


@query("composite_sizes", f"WITH {PAINTED} SELECT r // 4 * 4 AS origin_r, c // 4 * 4 AS origin_c, ((max(r) - r // 4 * 4 + 1) * 4)::INTEGER AS height, ((max(c) - c // 4 * 4 + 1) * 4)::INTEGER AS width FROM tiles GROUP BY r // 4 * 4, c // 4 * 4")
def composite_sizes(spark, sf_dir):
    """Composites at half scale, by the headers of their images."""
    made = raster.composite(_painted(spark, sf_dir).select("r", "c", "path", "content"), 4, 0.5)
    return raster.read_images(made.withColumn("path", windows.output_name())).select("origin_r", "origin_c", "height", "width")


@query("image_headers", "SELECT printf('t_%06d.png', s_suppkey) AS path, (2 + s_suppkey % 7)::INTEGER AS height, (3 + s_suppkey % 9)::INTEGER AS width, 3::INTEGER AS channels, 8::INTEGER AS depth FROM supplier")
def image_headers(spark, sf_dir):
    images = raster.read_images(_painted(spark, sf_dir, lambda k: (3 + k % 9, 2 + k % 7)).select("path", "content"))
    return images.select("path", "height", "width", "channels", "depth")


@query(
    "image_halves",
    """WITH t AS (SELECT printf('t_%06d', s_suppkey) AS name, 3 + s_suppkey % 9 AS w, 2 + s_suppkey % 7 AS h FROM supplier)
SELECT name, half, (CASE WHEN h > w THEN w WHEN half = 'a' THEN w // 2 ELSE w - w // 2 END)::INTEGER AS width, (CASE WHEN h <= w THEN h WHEN half = 'a' THEN h // 2 ELSE h - h // 2 END)::INTEGER AS height FROM t, (VALUES ('a'), ('b')) v(half)""",
)
def image_halves(spark, sf_dir):
    return raster.split_images(_painted(spark, sf_dir, lambda k: (3 + k % 9, 2 + k % 7)).select("name", "content")).select("name", "half", "width", "height")


@query("archive_entries", "SELECT printf('t_%06d', s_suppkey) AS name, printf('img_%d.PNG', s_suppkey) AS entry, (1 + s_suppkey % 20)::INTEGER AS bytes FROM supplier")
def archive_entries(spark, sf_dir):
    folder, k = _folder(spark, "archives"), F.col("s_suppkey")
    tiles = d.table(spark, sf_dir, "supplier").select(F.format_string("t_%06d", k).alias("name"), F.concat(F.lit("img_"), text(k), F.lit(".PNG")).alias("entry"), _bytes(1 + k % 20).alias("content"))
    zipped = raster.zip_tiles(tiles)
    pipelines.write_files(zipped.select(F.concat("name", F.when(F.endswith("name", F.lit("3")), ".ZIP").otherwise(".zip")).alias("name"), "content"), folder)
    opened = raster.unzip_images(scan.archives(spark, folder))
    return opened.select(F.regexp_replace(parse.basename(F.col("path")), r"(?i)\.zip$", "").alias("name"), "entry", F.length("content").alias("bytes"))


# -- documents --------------------------------------------------------------------------------------------


def _side_bounds(shift: float = 0.0) -> Column:
    k = F.col("k")
    lat, lon = (k % 70).cast("double") + num(shift), (k % 170).cast("double")
    return geo.box_bounds(lat + num(1), lat, lon, lon + num(1))


def _suppliers(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return d.table(spark, sf_dir, "supplier").select(k.alias("k"), F.concat(F.lit("s"), text(k)).alias("name"))


@query("sidecar_scan", "SELECT 's' || s_suppkey AS stem, 's' || s_suppkey || '.png' AS image, (s_suppkey % 70)::DOUBLE + CASE WHEN s_suppkey % 3 <> 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS north FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0")
def sidecar_scan(spark, sf_dir):
    """Of a name's sidecars the .json one counts before the .txt one."""
    folder = _folder(spark, "sidecars")
    rows = _suppliers(spark, sf_dir)
    side = lambda shift: manifest.sidecar(_side_bounds(shift), F.concat("name", F.lit(".png"))).cast("binary").alias("content")
    json_ = rows.where("k % 3 <> 0").select(F.concat("name", F.lit(".json")).alias("name"), side(0.0))
    txt = rows.where("k % 2 = 0").select(F.concat("name", F.lit(".txt")).alias("name"), side(0.5))
    pipelines.write_files(json_.unionByName(txt), folder)
    return manifest.read_sidecars(spark, folder).select("stem", F.col("imageFileName").alias("image"), F.col("bounds")["northWest"]["lat"].alias("north"))


@query("manifest_scan", "SELECT 's' || s_suppkey AS name, (s_suppkey % 70 + 1)::DOUBLE AS north, (s_suppkey % 170)::DOUBLE AS west, 'a.tif,b.tif' AS elevation FROM supplier")
def manifest_scan(spark, sf_dir):
    path = f"{_folder(spark, 'manifest')}/{manifest.NAME}"
    manifest.write_document(manifest.to_manifest(_suppliers(spark, sf_dir).select(F.col("k").alias("pos"), "name", _side_bounds().alias("bounds")), ["a.tif", "b.tif"]), path)
    doc = manifest.read_manifest(spark, path)
    corner = F.col("bounds")["northWest"]
    return manifest.images(doc).select("name", corner["lat"].alias("north"), corner["lon"].alias("west"), F.lit(",".join(manifest.elevation_files(doc) or [])).alias("elevation"))


@query("registry_documents", "SELECT 'key_' || s_suppkey AS key, 'b' AS label, (1 + s_suppkey % 9)::DOUBLE / 4 AS native, 3857::INTEGER AS srs, (s_suppkey % 50)::DOUBLE AS min_lat, CASE WHEN s_suppkey % 2 = 0 THEN 'elevation' ELSE 'imagery' END AS kinds FROM supplier")
def registry_documents(spark, sf_dir):
    """A registry written with each service twice; of equal keys the last is read."""
    k, path = F.col("k"), f"{_folder(spark, 'registry')}/services.json"
    lat = (k % 50).cast("double")
    kinds = F.when(k % 2 == 0, F.array(F.lit("elevation")))
    rows = _suppliers(spark, sf_dir).withColumn("label", F.explode(F.array(F.lit("a"), F.lit("b")))).select(
        F.concat(F.lit("key_"), text(k)).alias("key"), "label", F.lit("https://host/x").alias("base_url"), ((1 + k % 9).cast("double") / num(4)).alias("native_pixel_size_m"), F.lit(3857).alias("srs"),
        F.array(lat, lat, lat + num(5), lat + num(5)).alias("coverage"), kinds.alias("kinds"),
    )
    manifest.write_document(manifest.registry_document(rows), path)
    return manifest.read_registry(spark, path).select("key", "label", F.col("native_pixel_size_m").alias("native"), "srs", F.get("coverage", F.lit(0)).alias("min_lat"), F.array_join("kinds", ",").alias("kinds"))


@query("ledger_documents", "SELECT (event_id % 97)::VARCHAR || '_0' AS key, CASE WHEN bool_or(event_type = 'click') THEN 'downloaded' ELSE 'failed' END AS status FROM events GROUP BY 1")
def ledger_documents(spark, sf_dir):
    path = f"{_folder(spark, 'ledger')}/manifest.json"
    news = d.table(spark, sf_dir, "events").select(F.concat(text(F.col("event_id") % 97), F.lit("_0")).alias("key"), F.when(F.col("event_type") == "click", "downloaded").otherwise("failed").alias("status"), F.lit("f").alias("file"))
    manifest.write_document(manifest.ledger_document(chunks.updated(news.limit(0), news)), path)
    return manifest.read_ledger(spark, path).select("key", "status")


@query("ledger_recovery", "SELECT o_orderkey % 300 || '_' || o_custkey % 200 AS key, 'downloaded' AS status, 'chunk_' || o_custkey % 200 || '_' || o_orderkey % 300 || '.tif' AS file FROM orders WHERE o_orderkey % 5 <> 0")
def ledger_recovery(spark, sf_dir):
    """Entries from file names; other names, of every fifth order, are ignored."""
    row, col = text(F.col("o_orderkey") % 300), text(F.col("o_custkey") % 200)
    name = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "note_").otherwise("chunk_"), col, F.lit("_"), row, F.lit(".tif"))
    return chunks.recovered(d.table(spark, sf_dir, "orders").select(name.alias("path")))


# -- names, values and guards --------------------------------------------------------------------------------


@query("path_extensions", r"SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS extension, lower(regexp_extract(url, '(\.[^./]+)$', 1)) IN ('.html', '.png') AS wanted FROM pages")
def path_extensions(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").select("page_id", parse.extension(F.col("url")).alias("extension"), parse.has_extension(F.col("url"), "HTML", ".png").alias("wanted"))


@query("scene_files", "SELECT c_custkey AS id, 'set_' || c_nationkey || '-' || c_custkey || '.txt' AS file FROM customer")
def scene_files(spark, sf_dir):
    return d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), parse.scene_file(F.concat(F.lit("set_"), text(F.col("c_nationkey"))), text(F.col("c_custkey"))).alias("file"))


@query("bounds_kinds", "SELECT r_regionkey AS id, 'POINT' AS kind FROM region")
def bounds_kinds(spark, sf_dir):
    k = F.col("r_regionkey")
    return d.table(spark, sf_dir, "region").select(k.alias("id"), parse.bounds_type(F.when(k % 2 == 0, "Point").otherwise("POINT")).alias("kind"))


@query("resample_labels", "SELECT n_nationkey AS id, CASE WHEN (n_nationkey + 1) % 25 = 0 THEN 'none' WHEN (n_nationkey % 25 + 1) / 25.0 <= 0.25 THEN 'reducing lanczos' ELSE 'lanczos' END AS label FROM nation")
def resample_labels(spark, sf_dir):
    labels = F.array(*(F.lit(parse.resample_label((i + 1) / 25)) for i in range(25)))
    return d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.get(labels, (F.col("n_nationkey") % 25).cast("int")).alias("label"))


@query("scaled_cells", "SELECT p_partkey AS id, greatest(floor(p_size * 0.3::DOUBLE)::INTEGER, 1) AS scaled, p_size AS same FROM part")
def scaled_cells(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.scaled_cell(F.col("p_size"), 0.3).alias("scaled"), geo.scaled_cell(F.col("p_size"), 1.0).alias("same"))


@query("nodata_values", """WITH t AS (SELECT p_partkey AS id, ['float32', 'float64', 'int8', 'int16', 'int32', 'uint8', 'uint16', 'uint32'][p_partkey % 8 + 1] AS dtype FROM part)
SELECT id, dtype, dtype LIKE 'float%' AS nan, CASE dtype WHEN 'int8' THEN -128.0::DOUBLE WHEN 'int16' THEN -32768.0::DOUBLE WHEN 'int32' THEN -2147483648.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM t""")
def nodata_values(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("float32", "float64", "int8", "int16", "int32", "uint8", "uint16", "uint32")))
    rows = d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(kinds, (F.col("p_partkey") % 8).cast("int")).alias("dtype"))
    return rows.withColumn("v", geo.nodata(F.col("dtype"))).select("id", "dtype", F.isnan("v").alias("nan"), F.when(F.isnan("v"), num(0)).otherwise(F.col("v")).alias("value"))


@query("ring_areas", f"WITH {d.BOXES_SQL} SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area, 5::INTEGER AS points FROM boxes")
def ring_areas(spark, sf_dir):
    ring = geo.ring(geo.box_bounds(F.col("y1"), F.col("y0"), F.col("x0"), F.col("x1")))
    return d.boxes(spark, sf_dir).select("id", ring.alias("ring")).select("id", r(polygon.ring_area(F.col("ring"))).alias("area"), F.size("ring").alias("points"))


@query("quad_overlaps", f"WITH {d.BOXES_SQL}, {_pairs_sql(0.3001234)} SELECT i, j, round(ratio, 6) AS ratio FROM pairs")
def quad_overlaps(spark, sf_dir):
    """Footprints as polygons that are clipped by each other."""
    ring = geo.ring(geo.box_bounds(F.col("y1"), F.col("y0"), F.col("x0"), F.col("x1")))
    return polygon.quad_pairs(d.boxes(spark, sf_dir).select("id", ring.alias("ring")), 0.3001234).select("i", "j", r(F.col("ratio")).alias("ratio"))


@query("bounds_edges", f"WITH {d.BOXES_SQL} SELECT id, y1 AS north, y0 AS south, x0 AS west, x1 AS east, id % 7 <> 0 AS valid, round(y0 - 0.25, 6) AS padded_south, round(x1 + 0.25, 6) AS padded_east FROM boxes")
def bounds_edges(spark, sf_dir):
    rows = d.boxes(spark, sf_dir).withColumn("bounds", geo.box_bounds(F.col("y1"), F.col("y0"), F.col("x0"), F.col("x1")))
    b = F.col("bounds")
    broken = F.when(F.col("id") % 7 != 0, b["southEast"]["lon"])
    partly = F.struct(b["northEast"].alias("northEast"), geo.point(b["southEast"]["lat"], broken).alias("southEast"), b["southWest"].alias("southWest"), b["northWest"].alias("northWest"))
    padded = geo.padded({"min_lat": F.col("y0"), "min_lon": F.col("x0"), "max_lat": F.col("y1"), "max_lon": F.col("x1")}, 0.25)
    return rows.select("id", *(c.alias(k) for k, c in geo.edges(b).items()), geo.valid_bounds(partly).alias("valid"), r(padded["min_lat"]).alias("padded_south"), r(padded["max_lon"]).alias("padded_east"))


@query("tiff_integrity", "SELECT 'f' || o_orderkey AS file, o_orderkey % 4 < 2 AND 1000 + o_orderkey % 50 > 1024 AS intact FROM orders")
def tiff_integrity(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.unhex(F.get(F.array(*map(F.lit, ("49492A00", "4D4D002A", "504B0304", "49492B00"))), (k % 4).cast("int")))
    files = d.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), text(k)).alias("path"), F.concat(head, F.lit("rest").cast("binary")).alias("content"), (1000 + k % 50).alias("length"))
    return chunks.verified(files)


@query("damaged_files", "SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'empty' END AS problem FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0")
def damaged_files(spark, sf_dir):
    k = F.col("o_orderkey")
    files = d.table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), text(k)).alias("path"), (k % 3).alias("length"), (k % 5).alias("fifth"))
    return scan.damaged_images(files, files.where("fifth <> 0"))


@query("aerial_datasets", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0")
def aerial_datasets(spark, sf_dir):
    k = F.col("p_partkey")
    rows = d.table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 3 == 0, "USGS Aerial photos").when(k % 3 == 1, "Elevation").alias("keywords"))
    return rows.where(aerial(F.col("keywords"))).select("id")


@query("downloads_ready", "SELECT o_orderkey AS download FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def downloads_ready(spark, sf_dir):
    """Prepared downloads that were asked for (the even ones, some twice) and aren't handled yet (every third)."""
    ids = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("downloadId"))
    options = ids.withColumn("available", F.col("downloadId") % 2 == 0)
    asked = remote.available_products(options).select("downloadId")
    ready = remote.ready_downloads(ids, asked.unionByName(asked), ids.where("downloadId % 3 = 0"))
    return ready.select(F.col("downloadId").alias("download"))


@query("published_dates", "SELECT DISTINCT printf('2020-01-%02d', 1 + o_orderkey % 28) AS day FROM orders WHERE o_orderkey % 4 <> 0")
def published_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    scenes = d.table(spark, sf_dir, "orders").select(F.when(k % 4 != 0, F.format_string("2020-01-%02d", 1 + k % 28)).alias("publishDate"))
    return remote.published_dates(scenes).select(F.col("publishDate").alias("day"))


@query("cell_collisions", "SELECT (c_custkey % 20)::BIGINT AS r, (c_custkey % 30)::BIGINT AS c, max(c_custkey) AS pos FROM customer GROUP BY 1, 2")
def cell_collisions(spark, sf_dir):
    k = F.col("c_custkey")
    return grid.cells(d.table(spark, sf_dir, "customer").select((k % 20).cast("long").alias("r"), (k % 30).cast("long").alias("c"), k.alias("pos"))).select("r", "c", "pos")


@query("overlaps_by_ratio", f"WITH {d.BOXES_SQL}, {_pairs_sql(0.5001234)} SELECT CAST(row_number() OVER (ORDER BY round(ratio, 6) DESC, i, j) - 1 AS BIGINT) AS place, i, j FROM pairs")
def overlaps_by_ratio(spark, sf_dir):
    pairs = spatial_join.overlap_pairs(d.boxes(spark, sf_dir), 0.5001234).select("i", "j", r(F.col("ratio")).alias("ratio"))
    return ordering.ordered(pairs, F.desc("ratio"), "i", "j").numbered("place").rows().select("place", "i", "j")


# -- composite jobs -----------------------------------------------------------------------------------------------


@query("exported_tiles", f"WITH {KEYS}, n AS (SELECT printf('L%02d_R%08x_C%08x', level, \"row\", col) AS name FROM keys) SELECT name || '.zip' AS file FROM n UNION ALL SELECT name || '.json' FROM n")
def exported_tiles(spark, sf_dir):
    out = _folder(spark, "exported")
    k = _keys(spark, sf_dir)
    tiles = k.select("level", "row", "col", F.concat(F.lit("x/"), parse.cache_path(F.col("row"), F.col("col"))).alias("path"), _bytes(F.col("length")).alias("content"))
    pipelines.export_tiles(tiles, web_mercator(spark), out)
    return scan.files(spark, out, recursive=False).select(parse.basename(F.col("path")).alias("file"))


TILED = """cells AS (SELECT s_suppkey::BIGINT AS k, s_suppkey::BIGINT // 10 AS r, s_suppkey::BIGINT % 10 AS c FROM supplier),
placed AS (SELECT *, dense_rank() OVER (ORDER BY r) - 1 AS pr, dense_rank() OVER (ORDER BY c) - 1 AS pc FROM cells)"""


def _tiled(spark, sf_dir) -> str:
    """A folder with a manifest, an image a supplier and a text beside each: tiles of half a degree that touch."""
    folder = _folder(spark, "tiled")
    tiles = _painted(spark, sf_dir)
    north, west = num(60) - F.col("r").cast("double") / 2, num(-80) + F.col("c").cast("double") / 2
    bounds = geo.box_bounds(north, north - num(0.5), west, west + num(0.5))
    manifest.write_document(manifest.to_manifest(tiles.select(F.col("k").alias("pos"), "name", bounds.alias("bounds"))), f"{folder}/{manifest.NAME}")
    notes = tiles.select(F.concat("name", F.lit(".txt")).alias("name"), F.lit("note").cast("binary").alias("content"))
    pipelines.write_files(tiles.select(F.col("path").alias("name"), "content").unionByName(notes), folder)
    return folder


@query(
    "stitched_manifest",
    f"""WITH {TILED} SELECT 'gathered_r' || pr // 2 * 2 || '_c' || pc // 2 * 2 AS name, 60 - min(r)::DOUBLE / 2 AS north, 60 - max(r)::DOUBLE / 2 - 0.5 AS south, -80 + min(c)::DOUBLE / 2 AS west, -80 + max(c)::DOUBLE / 2 + 0.5 AS east
FROM placed GROUP BY pr // 2, pc // 2""",
)
def stitched_manifest(spark, sf_dir):
    out = _folder(spark, "stitched")
    pipelines.stitch(spark, _tiled(spark, sf_dir), out, 2)
    b = F.col("bounds")
    sides = {"north": b["northWest"]["lat"], "south": b["southEast"]["lat"], "west": b["northWest"]["lon"], "east": b["southEast"]["lon"]}
    return manifest.images(manifest.read_manifest(spark, f"{out}/{manifest.NAME}")).select("name", *(c.alias(k) for k, c in sides.items()))


@query("stitched_files", f"WITH {TILED} SELECT DISTINCT 'gathered_r' || pr // 2 * 2 || '_c' || pc // 2 * 2 || '.png' AS file FROM placed UNION ALL SELECT printf('t_%06d.txt', k) FROM cells UNION ALL SELECT 'height_info.json'")
def stitched_files(spark, sf_dir):
    """Images, the manifest, and the other files that were passed on; a second run with ``resume`` adds nothing."""
    out, folder = _folder(spark, "stitched"), _tiled(spark, sf_dir)
    for resume in (False, True):
        pipelines.stitch(spark, folder, out, 2, resume=resume)
    return scan.files(spark, out, recursive=False).select(parse.basename(F.col("path")).alias("file"))


@query("split_folder", f"WITH {TILED} SELECT printf('t_%06d_', k) || half AS name, round(-80 + c::DOUBLE / 2 + CASE half WHEN 'a' THEN 0 ELSE 0.25 END, 9) AS west FROM cells, (VALUES ('a'), ('b')) v(half)")
def split_folder(spark, sf_dir):
    out = _folder(spark, "split")
    pipelines.split(spark, _tiled(spark, sf_dir), out)
    files = scan.files(spark, out, recursive=False).select(F.regexp_replace(parse.basename(F.col("path")), r"\.png$", "").alias("name"))
    entries = manifest.images(manifest.read_manifest(spark, f"{out}/{manifest.NAME}"))
    return entries.join(files, "name", "left_semi").select("name", r(F.col("bounds")["northWest"]["lon"], 9).alias("west"))


GATHERED = f"""cells AS (SELECT s_suppkey::BIGINT AS k, s_suppkey::BIGINT // 10 AS r, s_suppkey::BIGINT % 10 AS c FROM supplier),
placed AS (SELECT *, r - min(r) OVER () AS pr, c - min(c) OVER () AS pc FROM cells),
grouped AS (SELECT pr // 2 * 2 AS origin_r, pc // 2 * 2 AS origin_c, min(r) AS r0, min(c) AS c0 FROM placed GROUP BY ALL)
SELECT 'gathered_r' || origin_r || '_c' || origin_c AS name, round({lat_sql(f"{O}::DOUBLE - (99000 + r0) * ({WORLD} / 262144 * 256)")}, 9) AS north, round({lon_sql(f"-{O}::DOUBLE + (70000 + c0) * ({WORLD} / 262144 * 256)")}, 9) AS west FROM grouped"""


def _gathered(spark, out: str) -> DataFrame:
    corner = F.col("bounds")["northWest"]
    return manifest.images(manifest.read_manifest(spark, f"{out}/{manifest.NAME}")).select("name", r(corner["lat"], 9).alias("north"), r(corner["lon"], 9).alias("west"))


@query("gathered_cache", f"WITH {GATHERED}")
def gathered_cache(spark, sf_dir):
    """An exploded cache with its conf.xml, gathered two by two."""
    folder, out = _folder(spark, "cache"), _folder(spark, "gathered")
    at = F.concat(F.lit("_alllayers/L18/"), parse.cache_path(99000 + F.col("r"), 70000 + F.col("c")))
    pipelines.write_files(_painted(spark, sf_dir).select(at.alias("name"), "content"), folder)
    _conf(d.levels(spark), folder)
    pipelines.import_cache(spark, folder, out, None, 2)
    return _gathered(spark, out)


@query("gathered_pyramid", f"WITH {GATHERED}")
def gathered_pyramid(spark, sf_dir):
    """A pyramid of two levels, the higher one gathered two by two."""
    folder, out = _folder(spark, "pyramid"), _folder(spark, "gathered")
    tiles = _painted(spark, sf_dir)
    path = lambda z, shift: parse.xyz_path(F.lit(z), shift(99000 + F.col("r")), shift(70000 + F.col("c")))
    low = tiles.select(path(17, lambda v: F.floor(v / 2)).alias("name"), "content").dropDuplicates(["name"])
    pipelines.write_files(tiles.select(path(18, lambda v: v).alias("name"), "content").unionByName(low), folder)
    pipelines.import_pyramid(spark, folder, out, None, 2)
    return _gathered(spark, out)


@query("prepared_archives", "SELECT printf('t_%06d', s_suppkey) AS name, (s_suppkey % 70 + 1)::DOUBLE AS north, 4::INTEGER AS height, 4::INTEGER AS width FROM supplier")
def prepared_archives(spark, sf_dir):
    """Zipped images with sidecars, unpacked at half their size."""
    folder, out = _folder(spark, "scenes"), _folder(spark, "prepared")
    tiles = _painted(spark, sf_dir)
    pipelines.write_files(raster.zip_tiles(tiles.select("name", F.col("path").alias("entry"), "content")).select(F.concat("name", F.lit(".zip")).alias("name"), "content"), folder)
    pipelines.write_files(tiles.select(F.concat("name", F.lit(".json")).alias("name"), manifest.sidecar(_side_bounds(), F.col("path")).cast("binary").alias("content")), folder)
    pipelines.prepare_archives(spark, folder, out, 0.5)
    entries = manifest.images(manifest.read_manifest(spark, f"{out}/{manifest.NAME}"))
    images = raster.read_images(scan.files(spark, out, recursive=False).where(F.endswith("path", F.lit(".png"))).select("path", "content"))
    sized = images.select(F.regexp_replace(parse.basename(F.col("path")), r"\.png$", "").alias("name"), "height", "width")
    return entries.join(sized, "name").select("name", F.col("bounds")["northWest"]["lat"].alias("north"), "height", "width")


DOWNLOAD = f"""aim AS (SELECT {_bbox("20 * 1609.344::DOUBLE / 111320")} FROM (SELECT 5.0::DOUBLE AS lat, 10.0::DOUBLE AS lon)),
flat AS (SELECT {mx_sql("min_lon")} AS x0, {my_sql("min_lat")} AS y0, {mx_sql("max_lon")} AS x1, {my_sql("max_lat")} AS y1, 2 * pi() * {R}::DOUBLE / (256 * pow(2, 10)) AS pixel FROM aim),
size AS (SELECT greatest(1, round_even((x1 - x0) / pixel, 0)::BIGINT) AS w, greatest(1, round_even((y1 - y0) / pixel, 0)::BIGINT) AS h FROM flat),
grid AS (SELECT unnest(range(CAST(ceil(h / 256.0) AS BIGINT))) AS "row", w FROM size), plan AS (SELECT "row", unnest(range(CAST(ceil(w / 256.0) AS BIGINT))) AS col FROM grid)"""


@query("downloaded_chunks", f"""WITH {DOWNLOAD} SELECT "row" || '_' || col AS key, 'downloaded' AS status, 'chunk_' || col || '_' || "row" || '.tif' AS file, TRUE AS placed FROM plan""")
def downloaded_chunks(spark, sf_dir):
    """Chunks of the service that covers an area, from a stand-in for it; files are placed on the map, and a second run finds them."""
    out = _folder(spark, "download")
    registry = d.services(spark, sf_dir).select("key", F.col("key").alias("label"), F.lit("https://host/x/exportImage").alias("base_url"), num(1.0).alias("native_pixel_size_m"), F.lit(3857).alias("srs"), "coverage", "kinds")
    for _ in range(2):
        ledger = pipelines.download_imagery(spark, 5.0, 10.0, 20.0, registry, out, 10, 0, skip_mosaic=True, transport="gridloom.sources.remote:blank_get")
    heads = tiff.headers(scan.chunk_files(spark, f"{out}/chunks_10"))
    placed = heads.select(parse.basename(F.col("path")).alias("file"), (F.col("epsg") == 3857).alias("placed"))
    return ledger.join(placed, "file").select("key", "status", "file", "placed")


@query(
    "pyramid_cells",
    f"""WITH {CHUNKS_SQL}, b AS (SELECT x AS x0, x + w * pixel AS x1, y - h * pixel AS y0, y AS y1, {2 * O}::DOUBLE / 4096 AS span FROM chunks JOIN areas USING (area)),
e AS (SELECT floor((x0 + {O}::DOUBLE) / span + 1e-9)::BIGINT AS a, ceil((x1 + {O}::DOUBLE) / span - 1e-9)::BIGINT AS z, floor(({O}::DOUBLE - y1) / span + 1e-9)::BIGINT AS n, ceil(({O}::DOUBLE - y0) / span - 1e-9)::BIGINT AS s FROM b),
c AS (SELECT unnest(range(a, greatest(z, a + 1))) AS x, n, s FROM e)
SELECT DISTINCT 12::INTEGER AS z, x, y FROM (SELECT x, unnest(range(n, greatest(s, n + 1))) AS y FROM c)""",
)
def pyramid_cells(spark, sf_dir):
    """Tiles cut from chunks with the default kernel, as far as they are opaque anywhere."""

    def filled(frames):
        for frame in frames:
            images = {}
            rows = []
            for w, h in zip(frame["w"].tolist(), frame["h"].tolist(), strict=True):
                if (w, h) not in images:
                    images[w, h] = raster.encode_png(np.full((h, w, 3), 200, np.uint8))
                rows.append(images[w, h])
            yield frame.assign(content=rows)

    plan = _chunks(spark, sf_dir).select("row", "col", "w", "h", "xmin", "ymin", "xmax", "ymax")
    made = pyramid.pyramid_tiles(plan.mapInPandas(filled, "row long, col long, w int, h int, xmin double, ymin double, xmax double, ymax double, content binary"), 12)
    return made.select("z", "x", "y")


@query("mosaic_documents", "SELECT 'mosaic.vrt' AS name, CAST(ceil(count(*) * 100 / 256.0) * ceil(count(*) * 77 / 256.0) AS BIGINT) AS n FROM nation")
def mosaic_documents(spark, sf_dir):
    """The virtual mosaic of a grid of chunks: how many sources its band has."""
    n = F.count("*").cast("double")
    area = d.table(spark, sf_dir, "nation").agg(num(0).alias("xmin"), num(0).alias("ymin"), (n * num(100)).alias("xmax"), (n * num(77)).alias("ymax"), num(1).alias("pixel"))
    docs = chunks.vrt_documents(chunks.chunk_grid(area), 1)
    return docs.select("name", (F.size(F.split("value", "<SimpleSource>")) - 1).cast("long").alias("n"))


@query("mosaic_tile_values", "SELECT n_nationkey::BIGINT AS k, (n_nationkey % 5)::BIGINT AS col, (n_nationkey // 5)::BIGINT AS \"row\", (n_nationkey * 9)::INTEGER AS value FROM nation")
def mosaic_tile_values(spark, sf_dir):
    """Chunk files joined into one tiled GeoTIFF: the value in the middle of each chunk."""
    folder, out = _folder(spark, "chunks"), _folder(spark, "joined")

    def made(frames):
        for frame in frames:
            rows = [(f"chunk_{k % 5}_{k // 5}.tif", tiff.encode(np.full((1, 16, 16), k * 9, np.uint8), 16.0 * (k % 5), -16.0 * (k // 5), 1.0, 1.0, 3857)) for k in frame["k"].tolist()]
            yield pd.DataFrame(rows, columns=["name", "content"])

    keys = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pipelines.write_files(keys.mapInPandas(made, "name string, content binary"), folder)
    pipelines.write_files(spark.createDataFrame([("readme", bytearray(b"x"))], "name string, content binary"), out)
    area = keys.agg(F.count("*").alias("n")).select(num(0).alias("xmin"), (F.ceil(F.col("n") / 5) * -16).cast("double").alias("ymin"), num(80).alias("xmax"), num(0).alias("ymax"), num(1).alias("pixel"))
    pipelines.mosaic_file(spark, chunks.chunk_grid(area, 16), folder, f"{out}/mosaic.tif", 16)

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                v = tiff.pixels(content)[0]
                yield pd.DataFrame([(r_ * 5 + c, c, r_, int(v[r_ * 16 + 8, c * 16 + 8])) for r_ in range(v.shape[0] // 16) for c in range(5)], columns=["k", "col", "row", "value"])

    return scan.elevation_files(spark, out).select("content").mapInPandas(read, "k long, col long, row long, value int")
