"""Scans of file trees: paths without contents, and contents where they are asked for.

``binaryFile`` prunes ``content`` when it isn't selected, so a listing reads no data.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.parse import basename, chunk_of_file, has_extension, tile_of_cache_path, tile_of_xyz_path

_FILES = "path string, modificationTime timestamp, length long, content binary"


def all_layers(cache_dir: str) -> str:
    return f"{cache_dir.rstrip('/')}/_alllayers"


def files(spark: SparkSession, folder: str, recursive: bool = True, missing_ok: bool = True) -> DataFrame:
    """``path, modificationTime, length, content`` of the files below a folder; none if it is missing."""
    try:
        # as one root: a pattern would make each file a root, listed by a task of its own
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        if recursive:
            return found
        above = _qualified(spark, folder).split("/")
        parts = F.split("path", "/")
        return found.where((F.size(parts) == len(above) + 1) & (F.element_at(parts, -2) == above[-1]))
    except AnalysisException as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], _FILES)
        raise


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as paths of its files name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def is_png(cache_format: str) -> bool:
    return cache_format.strip().lower() == "png"


def cache_tiles(spark: SparkSession, cache_dir: str, cache_format: str = "PNG", contents: bool = False) -> DataFrame:
    """Tiles of an exploded cache: ``path, length, level, row, col`` (and ``content``).

    Only PNG caches can be read; files with other names or in other places are left out.
    """
    if not is_png(cache_format):
        raise ValueError(f"unsupported cache tile format: {cache_format}")
    found = files(spark, all_layers(cache_dir)).where(has_extension(F.col("path"), "png"))
    return _parsed(found, tile_of_cache_path(F.col("path")), contents)


def xyz_tiles(spark: SparkSession, folder: str, contents: bool = False) -> DataFrame:
    """Tiles of a ``<z>/<x>/<y>.png`` tree."""
    found = files(spark, folder).where(has_extension(F.col("path"), "png"))
    return _parsed(found, tile_of_xyz_path(F.col("path")), contents)


def _parsed(found: DataFrame, tile: dict, contents: bool) -> DataFrame:
    columns = ["path", "length", *(["content"] if contents else [])]
    return found.select(*columns, *(c.alias(k) for k, c in tile.items())).where("level IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")


def row_folders(tiles: DataFrame) -> DataFrame:
    """Distinct ``level_folder, row_folder`` names, in the order of their text."""
    parts = F.split("path", "/")
    named = tiles.select(F.element_at(parts, -3).alias("level_folder"), F.element_at(parts, -2).alias("row_folder"))
    return named.distinct().orderBy("level_folder", "row_folder")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Zip files of one folder, whatever the case of their suffix."""
    return files(spark, folder, recursive=False).where(has_extension(F.col("path"), "zip"))


def elevation_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """GeoTIFFs: ``.tif`` exactly, in lower case."""
    return files(spark, folder, recursive, missing_ok=False).where(F.endswith("path", F.lit(".tif")))


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder; a missing folder is a ValueError."""
    try:
        return files(spark, folder, recursive=False, missing_ok=False).select("path", "length")
    except AnalysisException as e:
        raise ValueError(f"not a folder: {folder}") from e


def find_file(listing: DataFrame, name: str) -> str | None:
    """The first path, in order, with that base name."""
    found = listing.where(basename(F.col("path")) == name).orderBy("path").limit(1).collect()
    return found[0]["path"] if found else None


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, content, row, col`` of downloaded chunks."""
    found = files(spark, folder, recursive=False).where(has_extension(F.col("path"), "tif"))
    return found.withColumns(chunk_of_file(F.col("path")))


def damaged_images(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected images (``path``) that are missing or empty: ``path, problem``."""
    met = expected.select("path").join(listing.select("path", "length"), "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty")
    return met.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """``project, file`` of text lists, one a project: the base name of every line."""
    lines = spark.read.text(folder, wholetext=False).select(F.col("_metadata.file_name").alias("list"), F.trim("value").alias("value")).where("value <> ''")
    return lines.select(F.regexp_replace("list", r"\.[^.]*$", "").alias("project"), basename(F.col("value")).alias("file"))


def scrape_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``fields``: the two-column rows of the metadata table, as an array of ``name, value``.

    Only the ``pageContentLayoutContainer`` part is read.  A page with several table bodies there,
    or a row of more than two cells, has null fields.
    """
    part = F.regexp_extract(F.col(html), r'(?s)id="pageContentLayoutContainer"(.*)', 1)
    bodies = F.regexp_count(part, F.lit("<tbody"))
    rows = F.regexp_extract_all(part, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)))
    text = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    pairs = F.transform(F.filter(cells, lambda c: F.size(c) == 2), lambda c: F.struct(text(c[0]).alias("name"), text(c[1]).alias("value")))
    good = (bodies <= 1) & ~F.exists(cells, lambda c: F.size(c) > 2)
    return pages.withColumn("fields", F.when(good, pairs))


def scraped_value(fields: str, key: str):
    """Value of the first field whose name contains ``key``."""
    return F.get(F.filter(F.col(fields), lambda f: f["name"].contains(key)), F.lit(0))["value"]
