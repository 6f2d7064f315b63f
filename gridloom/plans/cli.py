"""The command line: ``python -m gridloom.plans.cli <command> ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from gridloom.operators import pyramid, services
from gridloom.plans import pipelines
from gridloom.sources import manifest, remote

REGISTRY = os.path.join(os.path.expanduser("~"), ".gridloom", "services.json")


def session(name: str = "gridloom") -> SparkSession:
    """Settings that suit the engine; what spark-submit gives comes first."""
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom", description="Gather, stitch, split and download map tiles and elevation.")
    sub = top.add_subparsers(dest="command")

    p = sub.add_parser("create-bounds", help="write an area of interest")
    p.add_argument("--lat", required=True)
    p.add_argument("--lon", required=True)
    p.add_argument("--type", default="POINT")
    p.add_argument("--view_distance", type=float, default=manifest.DEFAULT_MILES)
    p.add_argument("--output", default="Shape.json")

    p = sub.add_parser("gather-ortho", help="gather a tile cache or pyramid, or find scenes")
    p.add_argument("--source", choices=("arcgis", "download", "usgs"), default="arcgis")
    p.add_argument("--input_dir", help="cache, pyramid or scenes; not needed with --catalogue")
    p.add_argument("--output_dir", required=True)
    p.add_argument("--shape_file")
    _compose(p)
    p.add_argument("--lod", type=int)
    p.add_argument("--lod_min", type=int)
    p.add_argument("--lod_max", type=int)
    p.add_argument("--elevation_data_dir")
    p.add_argument("--catalogue", help="URL of a scene catalogue to search and download from (source usgs)")
    p.add_argument("--env_file", default=".env", help="credentials of the catalogue")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--post", default="gridloom.sources.remote:http_post")
    p.add_argument("--file_transport", default="gridloom.sources.remote:http_file")
    p.add_argument("--elevation_padding_deg", type=float, default=0.0)

    for name, helped in (("download-arcgis", "fetch imagery"), ("download-elevation", "fetch elevation")):
        p = sub.add_parser(name, help=helped)
        p.add_argument("--lat", type=float, required=True)
        p.add_argument("--lon", type=float, required=True)
        p.add_argument("--view_distance", type=float, default=manifest.DEFAULT_MILES)
        p.add_argument("--output_dir", required=True)
        p.add_argument("--registry", default=REGISTRY)
        p.add_argument("--service_index", type=int)
        p.add_argument("--retries", type=int, default=5)
        p.add_argument("--timeout", type=float, default=60)
        p.add_argument("--transport", default="gridloom.sources.remote:http_get")
        p.add_argument("--chunk_px", type=int, default=256)
        if name == "download-arcgis":
            p.add_argument("--lod", type=int)
            p.add_argument("--resampling", choices=pyramid.RESAMPLING, default="lanczos")
            p.add_argument("--tms", action="store_true")
            p.add_argument("--skip_mosaic", action="store_true")
        else:
            p.add_argument("--resolution", type=float)
            p.add_argument("--padding_deg", type=float, default=0.0)

    p = sub.add_parser("refresh-services", help="build the registry of services")
    p.add_argument("--scan_list", required=True)
    p.add_argument("--registry", default=REGISTRY)
    p.add_argument("--transport", default="gridloom.sources.remote:http_get")

    p = sub.add_parser("prep-ortho", help="unpack archives of scenes")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--scale_factor", type=float, default=1.0)

    p = sub.add_parser("stitch-ortho", help="composite the images of a manifest")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    _compose(p)
    p.add_argument("--no_verify", action="store_true")

    p = sub.add_parser("prep-geo", help="merge elevation files")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--shape_file", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--padding_deg", type=float, default=0.0)

    p = sub.add_parser("process-terrain", help="download imagery, then gather every tier")
    p.add_argument("--lat", type=float, required=True)
    p.add_argument("--lon", type=float, required=True)
    p.add_argument("--view_distance", type=float, default=manifest.DEFAULT_MILES)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--registry", default=REGISTRY)
    p.add_argument("--service_index", type=int)
    p.add_argument("--ultra", action="store_true", help="tier 19 as well")
    p.add_argument("--with_elevation", action="store_true")
    p.add_argument("--keep_tiles", action="store_true")
    _compose(p, dimension=2)
    p.add_argument("--retries", type=int, default=5)
    p.add_argument("--timeout", type=float, default=60)
    p.add_argument("--transport", default="gridloom.sources.remote:http_get")

    p = sub.add_parser("split-image", help="cut the images of a manifest in two")
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--axis", choices=("auto", "horizontal", "vertical"), default="auto")
    return top


def _compose(p: argparse.ArgumentParser, dimension: int = 1) -> None:
    p.add_argument("--dimension", type=int, default=dimension)
    p.add_argument("--scale_factor", type=float, default=1.0)
    p.add_argument("--resume", action="store_true")


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command is None:
        parser().print_help()
        return 0
    if a.command == "create-bounds":
        with open(a.output, "w") as f:
            f.write(manifest.shape_document(a.lat, a.lon, a.view_distance, a.type))
        return 0
    spark = session()
    try:
        return _run(spark, a)
    except services.AmbiguousServiceError as e:
        print(e, file=sys.stderr)
        return 2


def _run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "gather-ortho":
        if a.source == "usgs" and a.catalogue:
            if not a.shape_file:
                raise ValueError("searching a catalogue needs a shape")
            where = manifest.read_shape(spark, a.shape_file).first()
            client = remote.CatalogueClient(a.catalogue, remote.named(a.post))
            client.login = remote.credentials(a.env_file)
            with client:
                got = pipelines.download_scenes(spark, client, where["lat"], where["lon"], where["miles"], a.output_dir, a.start, a.end, transport=a.file_transport)
            failed = got.where("file IS NULL").count()
            if failed:
                print(f"{failed} scenes could not be downloaded", file=sys.stderr)
                return 1
        elif a.source == "usgs":
            scenes = spark.read.schema("id long, metadata array<struct<fieldName:string,value:string>>").json(a.input_dir)
            pipelines.scene_representatives(pipelines.scene_boxes(scenes)).write.mode("overwrite").parquet(a.output_dir)
        elif a.source == "download":
            low, high = a.lod_min if a.lod_min is not None else 0, a.lod_max if a.lod_max is not None else 23
            pipelines.import_pyramid(spark, a.input_dir, a.output_dir, a.shape_file, a.dimension, a.scale_factor, a.lod, low, high, a.resume, a.elevation_data_dir, a.elevation_padding_deg)
        else:
            pipelines.import_cache(spark, a.input_dir, a.output_dir, a.shape_file, a.dimension, a.scale_factor, a.lod, a.resume, a.elevation_data_dir, a.elevation_padding_deg)
    elif a.command in ("download-arcgis", "download-elevation"):
        return download(spark, a)
    elif a.command == "refresh-services":
        refresh(spark, a.scan_list, a.registry, a.transport)
    elif a.command == "prep-ortho":
        pipelines.prepare_archives(spark, a.input_dir, a.output_dir, a.scale_factor)
    elif a.command == "stitch-ortho":
        pipelines.stitch(spark, a.input_dir, a.output_dir, a.dimension, a.scale_factor, not a.no_verify, a.resume)
    elif a.command == "prep-geo":
        os.makedirs(a.output_dir, exist_ok=True)
        pipelines.merge_elevation(spark, a.input_dir, a.shape_file, a.output_dir, a.padding_deg)
    elif a.command == "process-terrain":
        registry = manifest.read_registry(spark, a.registry)
        fetching = {"retries": a.retries, "timeout": a.timeout, "transport": a.transport}
        pipelines.process_terrain(spark, a.lat, a.lon, a.view_distance, registry, a.output_dir, a.dimension, a.scale_factor, a.ultra, a.with_elevation, a.keep_tiles, a.resume, a.service_index, **fetching)
    elif a.command == "split-image":
        pipelines.split(spark, a.input_dir, a.output_dir, a.axis)
    return 0


def download(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fetch what is lacking; 1 if nothing could be fetched."""
    registry = manifest.read_registry(spark, a.registry)
    fetching = {"retries": a.retries, "timeout": a.timeout, "transport": a.transport}
    try:
        if a.command == "download-elevation":
            pipelines.download_elevation(spark, a.lat, a.lon, a.view_distance, registry, a.output_dir, a.resolution, a.padding_deg, a.service_index, a.chunk_px, **fetching)
        else:
            pipelines.download_imagery(spark, a.lat, a.lon, a.view_distance, registry, a.output_dir, a.lod, a.service_index, a.resampling, a.tms, a.skip_mosaic, a.chunk_px, **fetching)
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def refresh(spark: SparkSession, scan_list: str, registry: str, transport: str) -> None:
    """Ask every endpoint of the list for its metadata and write the registry."""
    get = remote.named(transport)
    with open(scan_list) as f:
        items = manifest.scan_list(f.read())
    rows = []
    for item in items:
        base = item["url"].rstrip("/").removesuffix("/exportImage")
        r = get(base, {"f": "json"}, 30)
        rows.append((item["pos"], item["url"], item["pixel_size"], item["kinds"], r.body.decode() if r.code == 200 else "{}"))
    raw = spark.createDataFrame(rows, "pos long, url string, pixel_size double, kinds array<string>, doc string")
    from pyspark.sql import functions as F

    parsed = raw.withColumn("metadata", F.from_json("doc", f"struct<{_colons(services.METADATA)}>")).drop("doc")
    os.makedirs(os.path.dirname(os.path.abspath(registry)), exist_ok=True)
    manifest.write_document(manifest.registry_document(services.harvest(parsed)), registry)


def _colons(ddl: str) -> str:
    """``a x, b y`` as the fields of a struct."""
    out, depth, names = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(names.strip())
            names = ""
        else:
            names += ch
    return ",".join(":".join(p.split(" ", 1)) for p in [*out, names.strip()])


if __name__ == "__main__":
    print(json.dumps({"exit": (code := main())}))
    sys.exit(code)
