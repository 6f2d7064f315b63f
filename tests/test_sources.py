import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import chunks, raster, services
from gridloom.plans import pipelines
from gridloom.sources import manifest, remote, scan, scheme
from gridloom.streaming import ingest

CONF = "<CacheInfo><TileCacheInfo>{sr}<TileOrigin><X>-1</X><Y>1</Y></TileOrigin><TileCols>256</TileCols><TileRows>256</TileRows>{dpi}</TileCacheInfo></CacheInfo>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_conf(spark, tmp_path):
    path = tmp_path / "conf.xml"
    path.write_text(CONF.format(sr="<SpatialReference><WKID>4326</WKID></SpatialReference>", dpi="<DPI>96</DPI>"))
    found = scheme.read_conf(spark, str(path))
    assert (found.wkid, found.latest_wkid, found.origin_x, found.format) == (4326, 4326, -1.0, "") and found.levels.count() == 0
    with pytest.raises(KeyError):
        found.resolution(3)
    for sr, dpi, missing in (("", "<DPI>96</DPI>", "SpatialReference"), ("<SpatialReference><WKID>1</WKID></SpatialReference>", "", "DPI")):
        path.write_text(CONF.format(sr=sr, dpi=dpi))
        with pytest.raises(ValueError, match=missing):
            scheme.read_conf(spark, str(path))


def test_web_mercator_scheme(spark):
    s = scheme.web_mercator(spark)
    assert s.levels.count() == 24 and s.resolution(0) == geo.WORLD_RESOLUTION and s.resolution(23) == geo.WORLD_RESOLUTION / 2**23
    for wrong in ({"min_level": -1}, {"min_level": 5, "max_level": 4}, {"tile_size": 0}, {"dpi": 0}):
        with pytest.raises(ValueError):
            scheme.web_mercator(spark, **wrong)


def test_tile_scans(spark, tmp_path):
    png = raster.encode_png(np.zeros((2, 2, 3), np.uint8))
    for name in ("_alllayers/L01/R0000000a/C0000000b.png", "_alllayers/L01/R00000001/C00000001.PNG", "_alllayers/L01/R00000001/readme.txt", "_alllayers/odd/C1.png", "3/2/1.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(png)
    tiles = scan.cache_tiles(spark, str(tmp_path), " png ")
    assert rows(tiles.select("level", "row", "col")) == [(1, 1, 1), (1, 10, 11)]
    assert [tuple(r) for r in scan.row_folders(tiles).collect()] == [("L01", "R00000001"), ("L01", "R0000000a")]
    with pytest.raises(ValueError):
        scan.cache_tiles(spark, str(tmp_path), "JPEG")
    assert scan.cache_tiles(spark, str(tmp_path / "none")).count() == 0
    assert rows(scan.xyz_tiles(spark, str(tmp_path)).select("level", "row", "col")) == [(3, 1, 2)]
    assert "content" not in scan.cache_tiles(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    listing = scan.files(spark, scan.all_layers(str(tmp_path)))
    assert scan.find_file(listing, "readme.txt").endswith("readme.txt") and scan.find_file(listing, "x") is None
    flat = tmp_path / "flat"
    (flat / "below").mkdir(parents=True)
    (flat / "a.txt").write_text("a")
    (flat / "below" / "b.txt").write_text("b")
    assert [r["path"].rsplit("/", 1)[-1] for r in scan.folder_files(spark, str(flat)).collect()] == ["a.txt"]
    with pytest.raises(ValueError):
        scan.folder_files(spark, str(tmp_path / "none"))


def test_damaged_images(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    there = spark.createDataFrame([("a", 5), ("b", 0)], "path string, length long")
    assert rows(scan.damaged_images(expected, there)) == [("b", "empty"), ("c", "missing")]
    broken = spark.createDataFrame([("x.png", bytearray(b"\x89PNG\r\n\x1a\nno"))], "path string, content binary")
    with pytest.raises(Exception, match="cannot open image x.png"):
        raster.read_images(broken).collect()


def test_known_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("vol001/s1\nvol001/s2\n\n")
    (tmp_path / "two.txt").write_text("vol9/s3\n")
    assert rows(scan.known_files(spark, str(tmp_path))) == [("one", "s1"), ("one", "s2"), ("two", "s3")]


def bounds(n=1.0):
    return {k: {"lat": n, "lon": str(n)} for k in ("center", "northEast", "southEast", "southWest", "northWest")}


def test_archives(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    image = np.arange(8 * 6 * 3, dtype=np.uint8).reshape(8, 6, 3)
    for name, entries in (("a.zip", {"notes.txt": b"x", "b.png": raster.encode_png(image)}), ("c.ZIP", {"d.PNG": raster.encode_png(image)})):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for entry, data in entries.items():
                z.writestr(entry, data)
        (source / name).write_bytes(held.getvalue())
    (source / "a.json").write_text(json.dumps({"bounds": bounds(1.0), "imageFileName": "b.png"}))
    (source / "a.txt").write_text(json.dumps({"bounds": bounds(9.0), "imageFileName": "old"}))
    (source / "c.txt").write_text(json.dumps({"bounds": bounds(2.0), "imageFileName": "d"}))
    assert rows(manifest.read_sidecars(spark, str(source)).select("stem", "bounds.center.lat")) == [("a", 1.0), ("c", 2.0)]
    assert pipelines.prepare_archives(spark, str(source), str(out)) == 2
    assert np.array_equal(raster.decode_png((out / "a.png").read_bytes()), image)
    assert [i["name"] for i in json.loads((out / manifest.NAME).read_text())["images"]] == ["a", "c"]
    with pytest.raises(ValueError, match="no image"):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("x.txt", "x")
        raster.first_image(held.getvalue())


def test_exported_tiles(spark, tmp_path):
    png = raster.encode_png(np.zeros((2, 2, 3), np.uint8))
    tiles = spark.createDataFrame([("x/C00000001.png", bytearray(png), 1, 0, 1)], "path string, content binary, level int, row long, col long")
    assert pipelines.export_tiles(tiles, scheme.web_mercator(spark), str(tmp_path)) == 1
    stem = "L01_R00000000_C00000001"
    assert raster.first_image((tmp_path / f"{stem}.zip").read_bytes())[0] == "C00000001.png"
    side = json.loads((tmp_path / f"{stem}.json").read_text())
    assert side["imageFileName"] == "C00000001.png" and round(side["bounds"]["northEast"]["lon"]) == 180


def test_registry(spark, tmp_path):
    path = tmp_path / "services.json"
    assert manifest.read_registry(spark, str(path)).count() == 0
    path.write_text("{broken")
    assert manifest.read_registry(spark, str(path)).count() == 0
    entry = {"key": "k", "label": "a", "base_url": "u", "native_pixel_size_m": 1.0, "srs": 3857, "coverage": [0, 0, 1, 1]}
    path.write_text(json.dumps({"services": [entry, entry | {"label": "b"}]}))
    assert rows(manifest.read_registry(spark, str(path)).select("label", F.array_join("kinds", ","))) == [("b", "imagery")]


def test_harvest_fallbacks(spark):
    extent = {"xmin": 0.0, "ymin": 0.0, "xmax": 1e6, "ymax": 1e6, "spatialReference": {"wkid": 102100}}
    metas = [
        {"fullExtent": extent, "tileInfo": {"lods": [{"resolution": 4.0}, {"resolution": 2.0}]}},
        {"fullExtent": extent, "minPixelSize": 0.0, "pixelSizeX": 0.5},
        {"fullExtent": extent},
        {"pixelSizeX": 1.0},
        {"fullExtent": extent, "pixelSizeX": 9.0},
    ]
    urls = ["h://s/a/ImageServer", "h://s/b/ImageServer", "h://s/c/ImageServer", "h://s/d/ImageServer", "h://s/a/ImageServer/exportImage"]
    fields = ",".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in services.METADATA.split(", "))
    df = spark.createDataFrame([(i, u, None, None, json.dumps(m)) for i, (u, m) in enumerate(zip(urls, metas, strict=True))], "pos long, url string, pixel_size double, kinds array<string>, doc string")
    built = services.harvest(df.withColumn("metadata", F.from_json("doc", f"struct<{fields}>")))
    assert rows(built.select("key", "native_pixel_size_m")) == [("s__a__ImageServer", 2.0), ("s__b__ImageServer", 0.5)]


def test_retry_rules(spark):
    df = spark.createDataFrame([(200, "image/tiff", 0), (200, "text/html", 0), (503, "", 0), (503, "", 5), (404, "", 0), (None, None, 0)], "code int, kind string, attempt int")
    got = [r[0] for r in df.select(chunks.fetch_status(F.col("code"), F.col("kind"), F.col("attempt"), 5)).collect()]
    assert got == ["downloaded", "failed", "retry", "failed", "failed", "retry"]


def test_mosaic_parts(spark, monkeypatch):
    df = spark.range(25).select((F.col("id") % 5).alias("row"), F.floor(F.col("id") / 5).alias("col"))
    assert chunks.mosaic_parts(df).select("part").distinct().count() == 1
    monkeypatch.setattr(chunks, "FLAT", 20)
    monkeypatch.setattr(chunks, "BATCH", 10)
    assert [r["count"] for r in chunks.mosaic_parts(df).groupBy("part").count().orderBy("part").collect()] == [10, 10, 5]


def test_stream_of_chunk_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "chunk_1_2.tif").write_bytes(b"II*\0" + b"\0" * 2000)
    (folder / "chunk_3_4.tif").write_bytes(b"II*\0")
    (folder / "other.tif").write_bytes(b"II*\0" + b"\0" * 2000)
    run = lambda: ingest.ingest_chunks(spark, str(folder), str(tmp_path / "ledger"), str(tmp_path / "check")).awaitTermination()
    run()
    run()
    assert rows(spark.read.parquet(str(tmp_path / "ledger")).select("key", "status")) == [("2_1", "downloaded"), ("4_3", "failed")]
    (folder / "chunk_4_3.tif").write_bytes(b"MM\0*" + b"\0" * 2000)
    run()
    assert rows(ingest.current_ledger(spark, str(tmp_path / "ledger")).select("key", "status")) == [("2_1", "downloaded"), ("3_4", "downloaded"), ("4_3", "failed")]


def test_scene_table(spark):
    fields = [(f"{c} Corner {a} dec", str(v)) for (c, a), v in zip([(c, a) for c in ("NW", "NE", "SE", "SW") for a in ("Lat", "Long")], (1, 0, 1, 1, 0, 1, 0, 0), strict=True)]
    scenes = spark.createDataFrame([(1, fields), (2, [("NW Corner Lat dec", None), *fields]), (3, fields[:-1])], "id long, metadata array<struct<fieldName:string,value:string>>")
    assert rows(pipelines.scene_boxes(scenes)) == [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)]
    assert rows(pipelines.scene_representatives(pipelines.scene_boxes(scenes))) == [(1, 1)]


def test_downloads_left(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "downloadId long")
    assert rows(remote.ready_downloads(ids(1, 2, 3), ids(2, 3, 3), ids(3))) == [(2,)]


def test_process_terrain(spark, tmp_path):
    coverage = [-80.0, -180.0, 80.0, 180.0]
    registry = spark.createDataFrame([("k", "l", "u", 0.3, 3857, coverage, ["imagery", "elevation"])], services.SCHEMA)
    stub = {"transport": "tests.stub_service:get", "timeout": 1}
    out = pipelines.process_terrain(spark, 39.2, -82.2, 0.05, registry, str(tmp_path), dimension=2, **stub)
    assert sorted(out) == [17, 18] and not (tmp_path / "tiles").exists()
    for level in out:
        doc = json.loads((tmp_path / f"tier_{level}" / manifest.NAME).read_text())
        assert doc["images"] and all((tmp_path / f"tier_{level}" / f"{i['name']}.png").exists() for i in doc["images"])
    again = pipelines.process_terrain(spark, 39.2, -82.2, 0.05, registry, str(tmp_path), dimension=2, resume=True, keep_tiles=True, **stub)
    assert again[18].count() == out[18].count() and (tmp_path / "tiles").exists()
    with pytest.raises(Exception, match="finer than the native level"):
        pipelines.download_imagery(spark, 39.2, -82.2, 0.05, registry.withColumn("native_pixel_size_m", F.lit(100.0)), str(tmp_path / "x"), 18, **stub)


def test_a_listing_leaves_out_folders_below(spark, tmp_path):
    below = tmp_path / "flat" / "flat" / "flat"
    below.mkdir(parents=True)
    for at in (below, below.parent, below.parent.parent):
        (at / f"f{len(at.parts) - len(tmp_path.parts)}.txt").write_text("x")
    assert [r["path"].rsplit("/", 1)[-1] for r in scan.folder_files(spark, f"{tmp_path}/flat/").collect()] == ["f1.txt"]
