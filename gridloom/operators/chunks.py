"""Download plans: the grid of chunks, the ledger of what is done, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import num
from gridloom.functions.parse import CHUNK_FILE, chunk_key, chunk_of_file
from gridloom.functions.predicates import tiff_intact
from gridloom.operators.grid import batches
from gridloom.staging import stage

LEDGER = "key string, status string, file string"
BATCH = 10_000  # sources of one mosaic part
FLAT = 50_000  # sources up to which a mosaic has one part

#: Responses worth another attempt.
RETRIED = (429, 500, 502, 503, 504)


def total_pixels(extent: Column, pixel: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(extent / pixel).cast("long"))


def chunk_grid(areas: DataFrame, chunk: int = 256) -> DataFrame:
    """Chunks of areas (``xmin, ymin, xmax, ymax, pixel`` and other columns): ``row, col, w, h`` and their box.

    Row 0 is in the north; the last row and column may be smaller.  A row of ``areas`` becomes
    its chunks by two explodes, so the grid is made where it is used.
    """
    sized = areas.withColumns({"__w": total_pixels(F.col("xmax") - F.col("xmin"), F.col("pixel")), "__h": total_pixels(F.col("ymax") - F.col("ymin"), F.col("pixel"))})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / chunk).cast("long") - 1)
    cells = sized.withColumn("row", F.explode(upto("__h"))).withColumn("col", F.explode(upto("__w")))
    cells = cells.withColumns({"w": F.least(F.lit(chunk), F.col("__w") - F.col("col") * chunk).cast("int"), "h": F.least(F.lit(chunk), F.col("__h") - F.col("row") * chunk).cast("int")})
    left = F.col("xmin") + (F.col("col") * chunk).cast("double") * F.col("pixel")
    top = F.col("ymax") - (F.col("row") * chunk).cast("double") * F.col("pixel")
    boxed = cells.withColumns({"__l": left, "__t": top})
    keep = [c for c in areas.columns if c not in ("xmin", "ymin", "xmax", "ymax", "pixel")]
    return boxed.select(
        *keep, "row", "col", "w", "h",
        F.col("__l").alias("xmin"), (F.col("__t") - F.col("h").cast("double") * F.col("pixel")).alias("ymin"),
        (F.col("__l") + F.col("w").cast("double") * F.col("pixel")).alias("xmax"), F.col("__t").alias("ymax"),
    )


def remaining(chunks: DataFrame, ledger: DataFrame, files: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that the ledger doesn't have as downloaded, or whose file is missing or damaged.

    ``files`` has ``file`` and ``intact``.  ``keys`` are further columns that name the download
    (area, level), so that equal rows and columns of another one don't count.
    """
    done = ledger.where("status = 'downloaded'")
    if files is not None:
        done = done.join(files.where("intact").select("file"), "file", "left_semi")
    keyed = chunks.withColumn("key", chunk_key(F.col("row"), F.col("col")))
    return keyed.join(done.select(*keys, "key"), [*keys, "key"], "left_anti").drop("key")


def updated(ledger: DataFrame, news: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with newer entries in place of older ones; of several news the downloaded one counts."""
    both = ledger.withColumn("__n", F.lit(0)).unionByName(news.withColumn("__n", F.when(F.col("status") == "downloaded", 2).otherwise(1)))
    best = F.max_by(F.struct("status", "file"), F.struct("__n", "file"))
    return both.groupBy(*keys, "key").agg(best.alias("e")).select(*keys, "key", "e.status", "e.file")


def recovered(files: DataFrame, path: str = "path") -> DataFrame:
    """Ledger entries from the names of chunk files; other names are ignored."""
    at = chunk_of_file(F.col(path))
    kept = files.where(F.col(path).rlike(CHUNK_FILE))
    return kept.select(chunk_key(at["row"], at["col"]).alias("key"), F.lit("downloaded").alias("status"), F.col(path).alias("file"))


def verified(files: DataFrame) -> DataFrame:
    """``file, intact`` of binary files: a TIFF header and more than a kilobyte."""
    return files.select(F.col("path").alias("file"), tiff_intact(F.col("content"), F.col("length")).alias("intact"))


def fetch_status(code: Column, content_type: Column, attempt: Column, most: int) -> Column:
    """What a response means: ``downloaded``, ``retry`` or ``failed``."""
    image = F.coalesce(F.startswith(F.lower(content_type), F.lit("image")), F.lit(False))
    again = code.isNull() | code.isin(*RETRIED)
    return F.when((code == 200) & image, "downloaded").when(again & (attempt < most), "retry").otherwise("failed")


def retry_seconds(attempt: Column) -> Column:
    return F.least(F.pow(num(2), attempt.cast("double")), num(30))


def mosaic_parts(chunks: DataFrame) -> DataFrame:
    """``part`` of each chunk file: one part up to ``FLAT`` files, else runs of ``BATCH`` by row and column."""
    if chunks.limit(FLAT + 1).count() <= FLAT:
        return chunks.withColumn("part", F.lit(0).cast("long"))
    return batches(chunks, BATCH, "row", "col").withColumnRenamed("batch", "part")


TOP_VRT = "mosaic.vrt"
_VRT_KINDS = {"uint8": "Byte", "uint16": "UInt16", "int16": "Int16", "uint32": "UInt32", "int32": "Int32", "float32": "Float32", "float64": "Float64"}


def _vrt(sources: DataFrame, key: str, bands: int, kind: str) -> DataFrame:
    """A document for each ``key``: ``value`` and the box of its sources (``file, x, y, w, h, left, top, px, py``)."""
    ends = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")]
    frame = [F.min("left").alias("left"), F.max("top").alias("top"), F.first("px").alias("px"), F.first("py").alias("py")]
    listed = F.array_sort(F.collect_list(F.struct("y", "x", "w", "h", "file"))).alias("listed")
    g = sources.groupBy(key).agg(*ends, *frame, listed)
    text = lambda c: c.cast("string")

    def source(s: Column, band: int) -> Column:
        size = F.concat(F.lit(' xSize="'), text(s["w"]), F.lit('" ySize="'), text(s["h"]), F.lit('"/>'))
        place = F.concat(F.lit('<DstRect xOff="'), text(s["x"] - F.col("x0")), F.lit('" yOff="'), text(s["y"] - F.col("y0")), F.lit('"'), size)
        return F.concat(F.lit('<SimpleSource><SourceFilename relativeToVRT="1">'), s["file"], F.lit(f'</SourceFilename><SourceBand>{band}</SourceBand><SrcRect xOff="0" yOff="0"'), size, place, F.lit("</SimpleSource>"))

    of_band = lambda b: lambda s: source(s, b)
    whole = [F.concat(F.lit(f'<VRTRasterBand dataType="{_VRT_KINDS[kind]}" band="{b}">'), F.concat_ws("", F.transform("listed", of_band(b))), F.lit("</VRTRasterBand>")) for b in range(1, bands + 1)]
    affine = F.concat_ws(", ", text(F.col("left")), text(F.col("px")), F.lit("0"), text(F.col("top")), F.lit("0"), text(-F.col("py")))
    head = F.concat(F.lit('<VRTDataset rasterXSize="'), text(F.col("x1") - F.col("x0")), F.lit('" rasterYSize="'), text(F.col("y1") - F.col("y0")), F.lit('"><SRS>EPSG:3857</SRS><GeoTransform>'), affine, F.lit("</GeoTransform>"))
    return g.withColumn("value", F.concat(head, *whole, F.lit("</VRTDataset>"))).drop("listed")


def vrt_documents(chunks: DataFrame, bands: int, kind: str = "uint8", chunk: int = 256) -> DataFrame:
    """``name, value``: virtual mosaics of chunk files (rows of ``chunk_grid``).

    Up to ``FLAT`` chunks are in one document; more are in documents of ``BATCH``, over which the top one
    stands.  So no document has more sources than ``FLAT``, or one a ``BATCH`` of chunks.
    """
    file = F.concat(F.lit("chunk_"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"), F.lit(".tif"))
    px, py = (F.col("xmax") - F.col("xmin")) / F.col("w"), (F.col("ymax") - F.col("ymin")) / F.col("h")
    placed = mosaic_parts(chunks).select(
        "part", file.alias("file"), (F.col("col") * chunk).alias("x"), (F.col("row") * chunk).alias("y"), F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"),
        F.col("xmin").alias("left"), F.col("ymax").alias("top"), px.alias("px"), py.alias("py"),
    )
    parts = stage(_vrt(placed, "part", bands, kind), "mosaic-parts")
    if parts.limit(2).count() < 2:
        return parts.select(F.lit(TOP_VRT).alias("name"), "value")
    named = parts.withColumn("file", F.concat(F.lit("mosaic_"), F.col("part").cast("string"), F.lit(".vrt")))
    over = named.select(F.lit(0).alias("top_part"), "file", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "left", "top", "px", "py")
    return named.select(F.col("file").alias("name"), "value").unionByName(_vrt(over, "top_part", bands, kind).select(F.lit(TOP_VRT).alias("name"), "value"))
