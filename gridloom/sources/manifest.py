"""JSON documents: output manifests, areas of interest, sidecars, registries, ledgers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.parse import bounds_type
from gridloom.operators.services import SCHEMA as SERVICE
from gridloom.operators.services import last_of_key

_POINT = "struct<lat:string,lon:string>"
_BOUNDS = f"struct<center:{_POINT},northEast:{_POINT},southEast:{_POINT},southWest:{_POINT},northWest:{_POINT}>"
_NUMERIC = _BOUNDS.replace("string", "double")
MANIFEST = f"images array<struct<name:string,bounds:{_BOUNDS}>>, elevation_files array<string>"
SHAPE = "boundsType string, center struct<lat:string,lon:string,x:double,y:double>, view_distance double, range double"
SIDECAR = f"bounds {_BOUNDS}, imageFileName string"
NAME = "height_info.json"
DEFAULT_MILES = 10.0


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; a missing file is an error."""
    return spark.read.option("multiLine", True).schema(MANIFEST).json(path)


def images(manifest: DataFrame) -> DataFrame:
    """``pos, name, bounds`` (numbers), one row a name: of duplicates the last."""
    rows = manifest.select(F.posexplode("images").alias("pos", "i")).select("pos", "i.name", F.col("i.bounds").cast(_NUMERIC).alias("bounds"))
    return rows.groupBy("name").agg(F.max("pos").alias("pos"), F.max_by("bounds", "pos").alias("bounds")).select("pos", "name", "bounds")


def elevation_files(manifest: DataFrame) -> list[str] | None:
    row = manifest.first()
    return row["elevation_files"] if row else None


def to_manifest(entries: DataFrame, elevation: list[str] | None = None, order: str = "pos") -> DataFrame:
    """One row ``value``, the document's JSON; ``elevation_files`` only if there are any.

    A manifest is a single document, of a row an output image.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "name", "bounds"))), lambda x: F.struct(x["name"].alias("name"), x["bounds"].alias("bounds")))
    parts = [listed.alias("images")]
    if elevation:
        parts.append(F.array(*(F.lit(e) for e in elevation)).alias("elevation_files"))
    return entries.agg(F.to_json(F.struct(*parts)).alias("value"))


def merge_splits(originals: DataFrame, parts: DataFrame) -> DataFrame:
    """Entries (``pos, name, bounds``) with split ones replaced in place by their parts (``name, half, bounds``)."""
    met = originals.join(parts.select("name", "half", F.col("bounds").alias("part")), "name", "left")
    named = F.when(F.col("half").isNull(), F.col("name")).otherwise(F.concat_ws("_", "name", "half"))
    out = met.select(F.struct(F.col("pos"), F.coalesce("half", F.lit("")).alias("half")).alias("o"), named.alias("name"), F.coalesce("part", "bounds").alias("bounds"))
    return out.withColumn("pos", F.struct("o.pos", "o.half")).drop("o")


def read_shape(spark: SparkSession, path: str) -> DataFrame:
    """Areas of interest: ``bounds_type, lat, lon, miles``; x and y before lat and lon, and the older ``range`` if there is no ``view_distance``."""
    rows = spark.read.option("multiLine", True).schema(SHAPE).json(path)
    return rows.select(*(c.alias(k) for k, c in shape_columns().items()))


def shape_columns() -> dict[str, Column]:
    """Of rows of ``SHAPE``."""
    center = F.col("center")
    return {
        "bounds_type": bounds_type(F.coalesce("boundsType", F.lit("POINT"))),
        "lat": F.coalesce(center["y"], center["lat"].cast("double")),
        "lon": F.coalesce(center["x"], center["lon"].cast("double")),
        "miles": F.coalesce("view_distance", "range", F.lit(DEFAULT_MILES)),
    }


def shape_document(lat: str | float, lon: str | float, miles: float = DEFAULT_MILES, kind: str = "POINT") -> str:
    """The JSON of an area of interest: coordinates as given and as numbers."""
    if kind.upper() != "POINT":
        raise ValueError(f"unknown bounds type: {kind}")
    if not -90 <= float(lat) <= 90 or not -180 <= float(lon) <= 180:
        raise ValueError("latitude or longitude out of range")
    return json.dumps({"boundsType": "POINT", "center": {"lat": lat, "lon": lon, "x": float(lon), "y": float(lat)}, "view_distance": float(miles)}, indent=2)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """``stem, bounds, imageFileName``: of each name's sidecars the ``.json`` one before the ``.txt`` one."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "*.{json,txt}").schema(SIDECAR).json(folder)
    file = F.col("_metadata.file_name")
    named = rows.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("stem"), F.endswith(file, F.lit(".json")).alias("json"), F.col("bounds").cast(_NUMERIC).alias("bounds"), "imageFileName")
    return named.groupBy("stem").agg(F.max_by(F.struct("bounds", "imageFileName"), "json").alias("s")).select("stem", "s.*")


def sidecar(bounds: Column, file_name: Column) -> Column:
    return F.to_json(F.struct(bounds.alias("bounds"), file_name.alias("imageFileName")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Services of a registry file, of equal keys the last; none if the file is missing or not JSON."""
    try:
        rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"services array<struct<{_struct(SERVICE)}>>").json(path)
    except Exception as e:  # a missing registry is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SERVICE)
    listed = rows.select(F.posexplode("services").alias("pos", "s")).select("pos", "s.*").where("key IS NOT NULL")
    kinds = F.coalesce("kinds", F.array(F.lit("imagery")))
    return last_of_key(listed.withColumn("kinds", kinds), "pos").select("key", "label", "base_url", "native_pixel_size_m", "srs", "coverage", "kinds")


def registry_document(services: DataFrame) -> DataFrame:
    """One row ``value``: the registry's JSON, in order of keys."""
    listed = F.array_sort(F.collect_list(F.struct(*(c.split()[0] for c in SERVICE.split(", ")))))
    return services.agg(F.to_json(F.struct(listed.alias("services"))).alias("value"))


def scan_list(text: str) -> list[dict]:
    """Endpoints of a scan list: an array of URLs or objects, or an object with ``endpoints`` or ``folders``."""
    doc = json.loads(text)
    if isinstance(doc, dict):
        doc = doc.get("endpoints", doc.get("folders"))
    if not isinstance(doc, list):
        raise ValueError("a scan list is an array of endpoints")
    out = []
    for i, item in enumerate(doc):
        entry = {"url": item} if isinstance(item, str) else item
        if not isinstance(entry, dict) or not entry.get("url"):
            raise ValueError(f"endpoint {i} has no url")
        out.append({"pos": i, "url": entry["url"], "pixel_size": entry.get("pixel_size"), "kinds": entry.get("kinds")})
    return out


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``key, status, file`` of a ledger document; none if it is missing or broken."""
    try:
        rows = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, status string, file string")
    parsed = F.from_json("value", "map<string,struct<status:string,file:string>>", {"mode": "PERMISSIVE"})
    return rows.select(F.explode(parsed).alias("key", "e")).select("key", "e.status", "e.file")


def ledger_document(ledger: DataFrame) -> DataFrame:
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("status", "file").alias("e")))))
    return ledger.agg(F.to_json(entries).alias("value"))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in ddl.split(", ")))


def write_document(value: DataFrame, path: str) -> None:
    """A single text file at ``path``: written aside by Spark, then renamed, so that no reader sees half of it."""
    spark = value.sparkSession
    aside = f"{path}.parts"
    value.coalesce(1).write.mode("overwrite").text(aside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, parts = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    fs = target.getFileSystem(conf)
    written = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(aside, "part-*"))]
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(written[0], target)
    fs.delete(parts, True)
