import json
import os
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import staging
from gridloom.functions import geo
from gridloom.operators import chunks, coverage, grid, mosaic, ordering, polygon, pyramid, raster, services, spatial_join, windows
from gridloom.operators.components import components
from gridloom.plans import pipelines
from gridloom.sources import manifest, remote, scan, scheme, tiff


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_binned_join_is_the_plain_join(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(0, 10, (2, 200)), *rng.uniform(0, 3, (2, 200)), strict=True))]
    data += [(200, 0.0, 0.0, 1e6, 1e6), (201, -5e4, 1.0, 9.0, 2.0), (202, 3.0, 3.0, 3.0, 3.0), (203, 5.0, 5.0, 4.0, 6.0)]
    boxes = spark.createDataFrame(data, "id long, x0 double, y0 double, x1 double, y1 double")
    data = data[:-1]  # upside down: pairs with none
    plain = sorted((a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    for size in (None, 0.4, 50.0):
        assert rows(spatial_join.touching_pairs(boxes, size)) == plain
    assert "NestedLoop" not in spatial_join.touching_pairs(boxes, 1.0)._jdf.queryExecution().toString()


def test_overlap_refused(spark):
    boxes = spark.createDataFrame([(0, "a", 0.0, 0.0, 1.0, 1.0), (1, "b", 0.5, 0.0, 1.5, 1.0)], "id long, name string, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(RuntimeError, match='"a" & "b"'):
        spatial_join.refuse_overlaps(boxes)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 140)} == {100}
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []


def test_equal_boxes_hang_on_their_first(spark):
    """Groups are those of all pairs, though of equal boxes only one meets others; ids may repeat."""
    rng = np.random.default_rng(8)
    spots = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(*rng.uniform(0, 12, (2, 40)), *rng.uniform(0, 2, (2, 40)), strict=True)]
    data = [(i, *spots[i * i % 40]) for i in range(150)]
    data += [(200, 1.0, 1.0, 1.0, 4.0), (201, 1.0, 1.0, 1.0, 4.0), (202, 50.0, 50.0, 49.0, 51.0), (203, 50.0, 50.0, 49.0, 51.0), (204, None, 0.0, 1.0, 1.0), (205, None, 0.0, 1.0, 1.0), (206, 80.0, 80.0, 81.0, 81.0), (206, 90.0, 90.0, 91.0, 91.0), (207, 90.0, 90.0, 91.0, 91.0), (206, 80.0, 80.0, 81.0, 81.0)]
    boxes = spark.createDataFrame(data, "id long, x0 double, y0 double, x1 double, y1 double")
    for threshold in (0.3, 0.9, 1.0, 1.5):
        assert rows(spatial_join.overlap_groups(boxes, threshold)) == rows(spatial_join.groups(boxes, spatial_join.overlap_pairs(boxes, threshold)))
    assert rows(spatial_join.touching_groups(boxes)) == rows(spatial_join.groups(boxes, spatial_join.touching_pairs(boxes)))
    same = spark.range(3000).selectExpr("id", "0d AS x0", "0d AS y0", "1d AS x1", "1d AS y1")
    links = spatial_join._connecting(same, spatial_join.overlap_pairs, F.lit(True))
    assert links.count() == 2999


def test_scratch_tables_go(spark, tmp_path):
    def files(df):
        return [f for f in df.inputFiles() if os.path.exists(f.removeprefix("file://").removeprefix("file:"))]

    with staging.scratch() as keep:
        with staging.scratch() as pass_on:
            first = staging.stage(spark.range(3), "first")
            second = pass_on(staging.stage(first.selectExpr("id + 1 AS id"), "second"))
        assert not files(first) and files(second)
        third = keep(staging.stage(second, "third"))
    assert not files(second) and rows(third) == [(1,), (2,), (3,)]
    with pytest.raises(KeyError), staging.scratch():
        lost = staging.stage(spark.range(3), "lost")
        raise KeyError
    assert not files(lost)
    staging.discard(third)


def test_representatives(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 2.0, 2.0), (3, 0.0, 0.0, 2.0, 2.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    grouped = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, group long")
    assert rows(spatial_join.representatives(boxes, grouped)) == [(1, 1)]
    assert rows(spatial_join.representatives(boxes, grouped, "max_area")) == [(1, 2)]
    with pytest.raises(ValueError):
        spatial_join.representatives(boxes, grouped, "other")


def test_tolerance_counts_duplicates(spark):
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "v double")
    assert grid.tolerance(values(1.0, 2.0, 4.0)).first()[0] == 0.5
    assert grid.tolerance(values(1.0, 1.0, 4.0)).first()[0] == 1e-9
    assert grid.tolerance(values(1.0)).first()[0] == 1.0
    assert grid.tolerance(values()).first()[0] == 1.0
    assert rows(grid.clusters(values(1.0, 1.0 + 1e-10, 1.0, 4.0)).select("idx", "n")) == [(0, 3), (1, 1)]


def test_place_and_collide(spark):
    tiles = spark.createDataFrame([(0, "nw", 1.0, 0.0), (1, "ne", 1.0, 1.0), (2, "sw", 0.0, 0.0), (3, "sw2", 0.0, 0.0)], "pos long, name string, center_lat double, center_lon double")
    assert rows(grid.cells(grid.place(tiles)).select("r", "c", "name")) == [(0, 0, "nw"), (0, 1, "ne"), (1, 0, "sw2")]


def test_nearest_goes_to_the_lower_index_on_ties(spark):
    centers = spark.createDataFrame([(0, 0.0), (1, 2.0)], "idx long, center double")
    values = spark.createDataFrame([(0.9,), (1.0,), (1.1,), (9.0,)], "v double")
    assert rows(grid.nearest(values, centers, "v", "at")) == [(0.9, 0), (1.0, 0), (1.1, 1), (9.0, 1)] or rows(grid.nearest(values, centers, "v", "at"))[0] == (0.9, 0)
    assert dict(rows(grid.nearest(values, centers, "v", "at")))[1.0] == 0


def test_windows(spark):
    placed = spark.createDataFrame([(0, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 3, "d")], "r long, c long, name string")
    got = rows(windows.windows(placed, 2, "name").select("origin_r", "origin_c", "n", "root", "rows", "cols"))
    assert got == [(0, 0, 2, "a", 2, 2), (2, 0, 1, "c", 1, 1), (2, 2, 1, "d", 2, 2)]


def test_levels(spark):
    tiles = spark.createDataFrame([(17, 1, 1), (18, 2, 2)], "level int, row long, col long")
    assert rows(windows.select_level(tiles)) == [(18, 2, 2)]
    with pytest.raises(ValueError, match="level 99 has no tiles"):
        windows.select_level(tiles, 99)
    levels = scheme.web_mercator_levels(spark, 0, 17)
    with pytest.raises(Exception, match="No level-of-detail declared for level 18"):
        windows.with_footprints(tiles, levels).select("west_x").collect()
    assert windows.with_footprints(tiles, levels, strict=False).count() == 1


def test_strips():
    assert windows.strips(10, 4, 100, 1) == [(0, 3), (3, 6), (6, 8), (8, 10)]
    assert windows.strips(10, 4, 10, 1) == [(0, 10)]
    assert windows.strips(10, 4, 100, 1 << 30) == [(0, 10)]


def test_coverage(spark):
    target = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 2.0, 2.0), (3, 0.0, 0.0, 2.0, 2.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    boxes = [(1, 0.0, 0.0, 1.0, 2.0), (1, 1.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 1.0, 2.0), (2, 1.0, 0.0, 2.0, 1.5)]
    got = coverage.areas_covered(spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double"), target, "k")
    assert rows(got) == [(1, True), (2, False), (3, False)]


def test_service_choice(spark):
    offered = spark.createDataFrame([("b", ["imagery"], [0.0, 0.0, 10.0, 10.0]), ("a", ["imagery"], [0.0, 0.0, 20.0, 20.0]), ("e", ["elevation"], [0.0, 0.0, 10.0, 10.0])], "key string, kinds array<string>, coverage array<double>")
    aoi = lambda *v: spark.createDataFrame([(1, *map(float, v))], "id long, min_lat double, min_lon double, max_lat double, max_lon double")
    assert services.select_service(aoi(1, 1, 2, 2), offered, "elevation") == "e"
    assert services.select_service(aoi(1, 1, 2, 2), offered, index=1) == "b"
    with pytest.raises(services.AmbiguousServiceError) as e:
        services.select_service(aoi(1, 1, 2, 2), offered)
    assert e.value.candidates == ["a", "b"]
    for box, index, text in (((30, 30, 31, 31), None, "holds the area"), ((15, 15, 25, 25), None, "ends within the area"), ((1, 1, 2, 2), 5, "no candidate 5")):
        with pytest.raises(ValueError, match=text):
            services.select_service(aoi(*box), offered, index=index)


def test_ledger(spark):
    grid_ = chunks.chunk_grid(spark.createDataFrame([(0.0, 0.0, 600.0, 300.0, 1.0)], "xmin double, ymin double, xmax double, ymax double, pixel double"))
    assert rows(grid_.select("row", "col", "w", "h")) == [(0, 0, 256, 256), (0, 1, 256, 256), (0, 2, 88, 256), (1, 0, 256, 44), (1, 1, 256, 44), (1, 2, 88, 44)]
    ledger = spark.createDataFrame([("0_0", "downloaded", "a"), ("0_1", "failed", None), ("0_2", "downloaded", "gone")], "key string, status string, file string")
    files = spark.createDataFrame([("a", True), ("b", False)], "file string, intact boolean")
    assert rows(chunks.remaining(grid_, ledger, files).select("row", "col")) == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    news = spark.createDataFrame([("0_1", "failed", None), ("0_1", "downloaded", "n")], "key string, status string, file string")
    assert ("0_1", "downloaded", "n") in rows(chunks.updated(ledger, news))


def test_fetch_retries_only_busy_servers():
    waits, codes = [], iter([503, 429, 200])
    ok = lambda *_: remote.Response(next(codes), "image/tiff", b"x")
    assert remote.fetch(ok, "u", {}, 5, 1, waits.append) == (b"x", 3, None) and waits == [1.0, 2.0]
    assert remote.fetch(lambda *_: remote.Response(404, "", b""), "u", {}, 5, 1, waits.append)[:2] == (None, 1)
    assert remote.fetch(lambda *_: remote.Response(200, "text/html", b"x"), "u", {}, 5, 1, waits.append)[0] is None


def stub_get(url, params, timeout):
    return remote.Response(200, "image/tiff", params["bbox"].encode())


def test_chunk_source(spark):
    remote.register(spark)
    got = spark.read.format("image_chunks").options(url="u", chunks=json.dumps([[0, 1, 2, 2, 0.0, 0.0, 1.0, 1.0]]), transport="gridloom.sources.remote:http_get").load()
    assert got.columns[:4] == ["row", "col", "w", "h"]


def test_catalogue_client():
    calls = []

    def post(url, body, token, timeout):
        calls.append(url.rsplit("/", 1)[-1])
        return remote.Response(200, "json", json.dumps({"data": {"results": [{"entityId": "e"}]} if "scene" in url else []}).encode())

    client = remote.CatalogueClient("http://h/api/", post)
    assert client.scenes("d", (0, 0, 1, 1), "2004-01-01", "2004-05-05") == [{"entityId": "e"}] and calls == ["scene-search"]
    with pytest.raises(ValueError):
        client.options("d", ["x"] * remote.MAX_REQUESTS)
    with pytest.raises(remote.CatalogueError):
        remote.CatalogueClient("u", lambda *_: remote.Response(404, "", b"")).datasets((0, 0, 1, 1))


def test_first_valid(spark):
    data = [(0, 0, 1, None), (0, 0, 2, 5.0), (0, 0, 3, 6.0), (0, 1, 1, float("nan")), (1, 1, 2, 7.0)]
    df = spark.createDataFrame(data, "y int, x int, src_seq int, v double")
    assert rows(mosaic.first_valid(df, "y", "x").na.fill(-1.0)) == [(0, 0, 5.0), (0, 1, -1.0), (1, 1, 7.0)]


def test_png():
    rng = np.random.default_rng(1)
    for channels in (1, 2, 3, 4):
        for kind in (np.uint8, np.uint16):
            image = rng.integers(0, np.iinfo(kind).max, (5, 7, channels), kind)
            assert np.array_equal(raster.decode_png(raster.encode_png(image)), image)
    with pytest.raises(ValueError):
        raster.decode_png(b"no image")


def test_lanczos():
    flat = np.full((64, 48, 4), 200, np.uint8)
    for scale in (0.5, 0.2):
        small = raster.scaled(flat, scale)
        assert small.shape[:2] == (int(64 * scale), int(48 * scale)) and (small == 200).all()
    with pytest.raises(ValueError):
        raster.scaled(flat, 2.0)


def test_composite_in_strips_is_the_whole(spark):
    from gridloom.plans.queries import painted

    whole = raster.decode_png(raster.composite(painted(spark), 4).first()["content"])
    parts = [raster.decode_png(r["content"]) for r in raster.composite(painted(spark), 4, strip_rows=2).orderBy("strip").collect()]
    assert np.array_equal(np.concatenate(parts), whole) and tuple(whole[20, 40]) == (50, 100, 100)


def test_alpha_is_the_mask():
    canvas = np.zeros((2, 2, 3), np.uint8)
    tile = np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]], np.uint8)
    raster.paste(canvas, tile, 0, 1)
    assert canvas[1].tolist() == [[0, 0, 0], [10, 20, 30]]


def test_tiff_round_trip(spark, tmp_path):
    values = np.arange(60, dtype=np.float32).reshape(1, 6, 10)
    values[0, 0, 0] = np.nan
    data = tiff.encode(values, -80.0, 40.0, 0.01, 0.02, 4326, float("nan"))
    h = tiff.header(data)
    assert (h["width"], h["height"], h["epsg"], h["dtype"]) == (10, 6, 4326, "float32") and np.isnan(h["nodata"])
    assert np.array_equal(tiff.pixels(data), values, equal_nan=True)
    (tmp_path / "a.tif").write_bytes(data)
    head = tiff.headers(scan.elevation_files(spark, str(tmp_path))).first()
    assert round(head["min_lat"], 6) == 39.88 and round(head["max_lon"], 6) == -79.9
    with pytest.raises(ValueError):
        tiff.header(b"II*\0" + b"\0" * 4)


def test_manifest_last_of_a_name_wins(spark, tmp_path):
    b = lambda lat: {k: {"lat": lat, "lon": "2"} for k in ("center", "northEast", "southEast", "southWest", "northWest")}
    (tmp_path / "height_info.json").write_text(json.dumps({"images": [{"name": "a", "bounds": b("1")}, {"name": "b", "bounds": b(2)}, {"name": "a", "bounds": b(3)}]}))
    doc = manifest.read_manifest(spark, str(tmp_path / "height_info.json"))
    assert rows(manifest.images(doc).select("name", F.col("bounds.center.lat"))) == [("a", 3.0), ("b", 2.0)]
    assert manifest.elevation_files(doc) is None


def test_shapes(spark, tmp_path):
    for name, doc, want in (
        ("new", {"center": {"lat": "1", "lon": "2", "x": 4.0, "y": 3.0}, "view_distance": 5}, (3.0, 4.0, 5.0)),
        ("old", {"boundsType": "POINT", "center": {"lat": "1.5", "lon": 2}, "range": 7}, (1.5, 2.0, 7.0)),
        ("bare", {"center": {"lat": 1, "lon": 2}}, (1.0, 2.0, 10.0)),
    ):
        (tmp_path / name).write_text(json.dumps(doc))
        assert tuple(manifest.read_shape(spark, str(tmp_path / name)).select("lat", "lon", "miles").first()) == want
    text = manifest.shape_document("39.2", "-82.2", 5)
    (tmp_path / "made").write_text(text)
    assert tuple(manifest.read_shape(spark, str(tmp_path / "made")).select("lat", "lon", "miles").first()) == (39.2, -82.2, 5.0)
    with pytest.raises(ValueError):
        manifest.shape_document(99, 0)


def test_scan_list():
    assert [e["url"] for e in manifest.scan_list('["a", {"url": "b", "pixel_size": 0.3}]')] == ["a", "b"]
    for wrong in ('"a"', '[{"x": 1}]'):
        with pytest.raises(ValueError):
            manifest.scan_list(wrong)


def test_ledger_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1_2": {"status": "downloaded", "file": "f"}}')
    (tmp_path / "bad.json").write_text("{broken")
    assert rows(manifest.read_ledger(spark, str(tmp_path / "m.json"))) == [("1_2", "downloaded", "f")]
    assert manifest.read_ledger(spark, str(tmp_path / "bad.json")).count() == 0
    assert manifest.read_ledger(spark, str(tmp_path / "none.json")).count() == 0


def test_scrape(spark):
    page = '<div id="pageContentLayoutContainer"><tbody><tr><td>Entity ID</td><td>7</td></tr></tbody></div>'
    wide = page.replace("<td>7</td>", "<td>7</td><td>8</td>")
    df = spark.createDataFrame([(1, page), (2, wide), (3, "")], "id int, html string")
    got = scan.scrape_metadata(df).select("id", scan.scraped_value("fields", "Entity").alias("v"))
    assert rows(got) == [(1, "7"), (2, None), (3, None)]


def test_gather_end_to_end(spark, tmp_path):
    from gridloom.plans import pipelines

    folder = tmp_path / "cache" / "_alllayers" / "L05" / "R0000000a"
    folder.mkdir(parents=True)
    for i, color in enumerate((10, 20, 30)):
        (folder / f"C0000000{i + 1}.png").write_bytes(raster.encode_png(np.full((4, 4, 3), color, np.uint8)))
    (folder / "notes.txt").write_text("x")
    conf = '<CacheInfo><TileCacheInfo><SpatialReference><WKID>102100</WKID><LatestWKID>3857</LatestWKID></SpatialReference><TileOrigin><X>-20037508.342787001</X><Y>20037508.342787001</Y></TileOrigin><TileCols>256</TileCols><TileRows>256</TileRows><DPI>96</DPI><LODInfos><LODInfo><LevelID>5</LevelID><Scale>1</Scale><Resolution>4891.96981025128</Resolution></LODInfo></LODInfos></TileCacheInfo><TileImageInfo><CacheTileFormat>PNG</CacheTileFormat></TileImageInfo></CacheInfo>'
    (tmp_path / "cache" / "conf.xml").write_text(conf)
    out = tmp_path / "out"
    plan = pipelines.import_cache(spark, str(tmp_path / "cache"), str(out), dimension=2)
    assert rows(plan.select("name", "n")) == [("gathered_r0_c0", 2), ("gathered_r0_c2", 1)]
    assert raster.decode_png((out / "gathered_r0_c0.png").read_bytes())[0, [0, 4], 0].tolist() == [10, 20]
    doc = json.loads((out / "height_info.json").read_text())
    assert [i["name"] for i in doc["images"]] == ["gathered_r0_c0", "gathered_r0_c2"] and "elevation_files" not in doc
    with pytest.raises(ValueError, match="level 99 has no tiles"):
        pipelines.import_cache(spark, str(tmp_path / "cache"), str(tmp_path / "x"), level=99)
    # the output is a manifest folder: stitch and split it
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        stitched = pipelines.stitch(spark, str(out), str(tmp_path / "stitched"), dimension=2)
    assert stitched.count() == 1
    pipelines.split(spark, str(out), str(tmp_path / "split"))
    halves = json.loads((tmp_path / "split" / "height_info.json").read_text())["images"]
    assert [h["name"] for h in halves] == ["gathered_r0_c0_a", "gathered_r0_c0_b", "gathered_r0_c2_a", "gathered_r0_c2_b"]
    assert raster.decode_png((tmp_path / "split" / "gathered_r0_c0_b.png").read_bytes()).shape == (4, 4, 3)


def test_elevation_merge(spark, tmp_path):
    from gridloom.plans import pipelines

    (tmp_path / "tifs").mkdir()
    (tmp_path / "out").mkdir()
    for name, lon, value in (("a", -82.5, 100.0), ("b", -82.0, 200.0)):
        data = np.full((1, 200, 100), value, np.float32)
        (tmp_path / "tifs" / f"{name}.tif").write_bytes(tiff.encode(data, lon, 39.7, 0.005, 0.005, 4326, float("nan")))
    (tmp_path / "shape.json").write_text(manifest.shape_document("39.2", "-82.0", 5))
    name = pipelines.merge_elevation(spark, str(tmp_path / "tifs"), str(tmp_path / "shape.json"), str(tmp_path / "out"))
    merged = tiff.pixels((tmp_path / "out" / name).read_bytes())[0]
    w = merged.shape[1]
    assert np.nanmedian(merged[:, : w // 2 - 2]) == 100 and np.nanmedian(merged[:, w // 2 + 2 :]) == 200


def test_full_pass_downloads_missing_levels():
    from gridloom.plans.pipelines import full_pass, tiers

    loads, have = [], set()

    def download(level):
        loads.append(level)
        have.add(level)

    def gather(level):
        if level not in have:
            raise windows.EmptyLevelError(level, [])
        return level

    assert full_pass(tiers(18), gather, download) == {17: 17, 18: 18} and loads == [18, 17]
    with pytest.raises(ValueError):
        full_pass([17], gather, download, dimension=1)


def test_quads(spark):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    diamond = [(1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 1.0)]
    far = [(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (10.0, 9.0)]
    rows_ = [(i, [{"lat": a, "lon": b} for a, b in q]) for i, q in enumerate((square, diamond, far))]
    df = spark.createDataFrame(rows_, "id long, ring array<struct<lat:double,lon:double>>")
    assert [(r["i"], r["j"], round(r["ratio"], 9)) for r in polygon.quad_pairs(df).collect()] == [(0, 1, 1.0)]
    assert polygon.shared_area(np.array(square), np.array(diamond)) == 2.0
    closed = df.where("id = 1").select(polygon.ring_area(F.concat("ring", F.slice("ring", 1, 1))))
    assert closed.first()[0] == 2.0


def test_small_quads_far_from_the_origin(spark):
    """Areas keep their digits there, and pairs that share enough pass the check of envelopes."""
    x, y, w = 179.0, 89.0, 2.0**-20
    ring = lambda dx: [(y, x + dx), (y, x + dx + w), (y + w, x + dx + w), (y + w, x + dx)]
    rows = [(k, [{"lat": float(a), "lon": float(b)} for a, b in ring(dx)]) for k, dx in enumerate((0.0, w / 2, w * 0.75))]
    df = spark.createDataFrame(rows, "id long, ring array<struct<lat: double, lon: double>>")
    assert {r[0] for r in df.select(polygon.ring_area(F.concat("ring", F.slice("ring", 1, 1)))).collect()} == {w * w}
    found = polygon.quad_pairs(df, 0.5).orderBy("i", "j").collect()
    assert [tuple(r) for r in found] == [(0, 1, 0.5), (1, 2, 0.75)]


def test_many_quads_at_once(spark):
    """Pairs are clipped by the batch, not one by one, and boxes give the ratio of plain box arithmetic to the last bit."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 300, (60_000, 2, 2)) / 100
    high = low + rng.integers(50, 150, low.shape) / 100
    (x0, y0), (x1, y1) = low.transpose(2, 1, 0), high.transpose(2, 1, 0)
    a, b = (np.stack([[x0[k], y1[k]], [x1[k], y1[k]], [x1[k], y0[k]], [x0[k], y0[k]]]).transpose(2, 0, 1) for k in (0, 1))
    started = time.process_time()
    found = polygon.shared_areas(a, b)
    assert time.process_time() - started < 6  # one by one: about 20
    wide, tall = np.minimum(*x1) - np.maximum(*x0), np.minimum(*y1) - np.maximum(*y0)
    assert (found == np.maximum(wide, 0) * np.maximum(tall, 0)).all()
    # a slanted ring against the rest, turned either way; three points; what is missing pairs with none
    slanted, triangle = [(0.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0)]
    rings = [slanted, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], slanted[::-1], triangle, [(0.0, None), *triangle]]
    df = spark.createDataFrame([(i, [{"lat": y, "lon": x} for x, y in q]) for i, q in enumerate(rings)], "id long, ring array<struct<lat:double,lon:double>>")
    pairs = {(r["i"], r["j"]): round(r["ratio"], 9) for r in polygon.quad_pairs(df).collect()}
    assert pairs == {(0, 1): 1.0, (0, 2): 1.0, (0, 3): 0.5, (1, 2): 1.0, (1, 3): 1.0, (2, 3): 0.5}


def test_tiles_beyond_the_pole_are_placed(spark):
    """They were lost, and moved the southernmost row before them into its neighbour."""
    df = spark.createDataFrame([(i, f"t{i}", -88.5 - i // 2 / 2 - (i // 8) * 200, float(i % 2)) for i in range(12)], "pos long, name string, n double, w double")
    entries = df.select("pos", "name", geo.box_bounds(F.col("n"), F.col("n") - 0.5, F.col("w"), F.col("w") + 1).alias("bounds"))
    assert rows(pipelines.placed_images(entries).select("r", "c", "name")) == sorted((i // 2, i % 2, f"t{i}") for i in range(12))


def test_entries_without_a_center_are_placed(spark):
    df = spark.createDataFrame([(i, f"t{i}", 50.0 - i // 2, float(i % 2)) for i in range(6)], "pos long, name string, n double, w double")
    bounds = geo.box_bounds(F.col("n"), F.col("n") - 1, F.col("w"), F.col("w") + 1)
    gone = lambda when: F.when(~when, bounds["center"])
    entries = df.select("pos", "name", bounds.withField("center", gone(F.col("pos") >= 4)).alias("bounds"))
    assert rows(pipelines.placed_images(entries).select("r", "c", "name")) == [(i // 2, i % 2, f"t{i}") for i in range(6)]
    bare = entries.withColumn("bounds", F.when(F.col("pos") != 5, F.col("bounds")))
    with pytest.raises(Exception, match="no place for the image t5"):
        pipelines.placed_images(bare).collect()


def test_pyramid(spark):
    span = pyramid.tile_span(1)
    image = lambda c: raster.encode_png(np.full((8, 8, 3), c, np.uint8))
    chunks_ = [(0, 0, -span, 0.0, 0.0, span, image(10)), (0, 1, 0.0, 0.0, span / 2, span, image(20))]
    df = spark.createDataFrame(chunks_, "row int, col int, xmin double, ymin double, xmax double, ymax double, content binary")
    for how in ("near", "bilinear"):
        got = {(r["x"], r["y"]): raster.decode_png(r["content"]) for r in pyramid.pyramid_tiles(df, 1, how, 16).collect()}
        assert set(got) == {(0, 0), (1, 0)} and got[0, 0][3, 3].tolist() == [10, 10, 10, 255] and got[1, 0][0, [0, 15]].tolist() == [[20, 20, 20, 255], [0, 0, 0, 0]]
    assert spark.range(1).select(pyramid.flipped(3, F.lit(1))).first()[0] == 6


def test_scene_requests():
    answers = {"download-options": [{"entityId": "a", "id": "p", "available": True}, {"entityId": "b", "id": "q", "available": False}], "download-request": {"newRecords": {"7": "x"}, "duplicateProducts": {}}}
    rounds = iter([{"available": []}, {"available": [{"downloadId": 7}, {"downloadId": 8}]}])

    def post(url, body, token, timeout):
        what = url.rsplit("/", 1)[-1]
        return remote.Response(200, "json", json.dumps({"data": answers.get(what) or next(rounds)}).encode())

    waits = []
    got = list(remote.request_scenes(remote.CatalogueClient("u", post), "d", ["a", "b"], "l", waits.append))
    assert got == [{"downloadId": 7}] and waits == [30.0]


def test_ordered_statistics_agree_with_a_window(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"), (F.col("id") % 3).alias("w"))
    whole = Window.orderBy("v")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("v", F.lag("v").over(whole), F.row_number().over(whole) - 1, F.sum("w").over(upto), F.max("w").over(upto))
    for ranges in (5, None):
        got = ordering.ordered(df, "v", ranges=ranges)
        assert got.ranked.select(ordering.RANGE).distinct().count() == (ranges or 1)
        found = got.previous("v", "p").numbered("n").running_sum("w", "s").running_max("w", "m").rows()
        assert rows(found.select("v", F.coalesce("p", F.lit(-1)), "n", "s", "m")) == rows(want.na.fill(-1))


def test_download_resume_and_pyramid(spark, tmp_path):
    from gridloom.plans import cli, pipelines

    (tmp_path / "scan.json").write_text('["https://h/rest/services/a/ImageServer"]')
    cli.refresh(spark, str(tmp_path / "scan.json"), str(tmp_path / "registry.json"), "tests.stub_service:get")
    registry = manifest.read_registry(spark, str(tmp_path / "registry.json"))
    assert registry.first()["key"] == "h__rest__services__a__ImageServer" and registry.first()["native_pixel_size_m"] == 0.3
    out, stub = str(tmp_path / "out"), {"transport": "tests.stub_service:get", "timeout": 1}
    ledger = pipelines.download_imagery(spark, 39.2, -82.2, 0.2, registry, out, 16, skip_mosaic=True, **stub)
    n = ledger.count()
    assert n > 0 and ledger.where("status = 'downloaded'").count() == n
    folder = tmp_path / "out" / "chunks_16"
    first = sorted(folder.glob("chunk_*.tif"))[0]
    first.write_bytes(b"damaged")
    stamps = {p.name: p.stat().st_mtime_ns for p in folder.glob("chunk_*.tif")}
    pipelines.download_imagery(spark, 39.2, -82.2, 0.2, registry, out, 16, **stub)
    assert not folder.exists() and len(stamps) == n
    tiles = scan.xyz_tiles(spark, out)
    assert tiles.count() > 0 and {r["level"] for r in tiles.collect()} == {16}
    heights = pipelines.download_elevation(spark, 39.2, -82.2, 0.1, registry.withColumn("kinds", F.array(F.lit("elevation"))), str(tmp_path / "h"), resolution=5.0, **stub)
    assert heights.where("status = 'downloaded'").count() == heights.count() > 0


def test_command_line(tmp_path, capsys):
    from gridloom.plans import cli

    assert cli.main(["create-bounds", "--lat", "1", "--lon", "2", "--output", str(tmp_path / "s.json")]) == 0
    assert json.loads((tmp_path / "s.json").read_text())["center"]["x"] == 2.0
    assert cli.main([]) == 0 and "gather-ortho" in capsys.readouterr().out
    assert len(cli.parser()._subparsers._group_actions[0].choices) == 10


def test_tiled_file(tmp_path):
    values = np.arange(2 * 300 * 520, dtype=np.int16).reshape(2, 300, 520)
    path = str(tmp_path / "t.tif")
    with tiff.TiledFile(path, 520, 300, 2, "int16", 10.0, 50.0, 0.1, 0.2, 32617, -7) as out:
        for band, y, x in ((1, 1, 2), (0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 1, 1), (0, 1, 2), (1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0)):
            out.add(band, y, x, tiff.deflated(values[band, y * 256 : y * 256 + 256, x * 256 : x * 256 + 256], "int16", -7))
    data = open(path, "rb").read()
    want = values.copy()
    want[1, 256:, 256:512] = -7  # the tile that never came
    head = tiff.header(data)
    assert np.array_equal(tiff.pixels(data), want) and (head["epsg"], head["left"], head["py"], head["bands"]) == (32617, 10.0, 0.2, 2)
    with pytest.raises(KeyError), tiff.TiledFile(path, 5, 5, 1, "uint8", 0, 0, 1, 1, 4326, 0):
        raise KeyError
    assert sorted(f.name for f in tmp_path.iterdir()) == ["t.tif"]


def test_elevation_in_utm(spark):
    """A plane in UTM coordinates is the same plane after it was resampled to degrees."""
    from gridloom.functions import crs

    left, top, n = 400_000.0, 4_500_000.0, 400
    xs, ys = left + (np.arange(n) + 0.5) * 30, top - (np.arange(n) + 0.5) * 30
    plane = (xs[None, :] - left) * 0.01 + (top - ys[:, None]) * 0.02
    lat, lon = crs.degrees(32617, np.linspace(left + 2000, left + 9000, 50), np.linspace(top - 9000, top - 2000, 50))
    got = mosaic.resample(plane, left, top, 30, 30, 32617, lat, lon)
    x, y = crs.projected(32617, lat, lon)
    assert np.allclose(got, (x - left) * 0.01 + (top - y) * 0.02, atol=1e-6)
    box = tiff.world_bounds({"left": left, "top": top, "width": n, "height": n, "px": 30, "py": 30, "epsg": 32617})
    assert box[0] < lat.min() < lat.max() < box[2] and box[1] < lon.min() < lon.max() < box[3]


def test_kernels():
    image = np.add.outer(np.arange(40) * 3, np.arange(50) * 2).astype(np.uint8)[:, :, None]
    u, v = np.linspace(10, 30, 21) + 0.5, np.linspace(5, 25, 21) + 0.5
    for how in ("cubic", "lanczos"):
        assert np.array_equal(pyramid._filtered(image, u, v, how)[:, :, 0], image[5:26, 10:31, 0])  # at the pixels themselves
    half = pyramid._filtered(image, np.arange(1, 50, 2.0), np.arange(1, 40, 2.0), "average")
    assert half.shape == (20, 25, 1) and abs(int(half[3, 4, 0]) - (6 * 3 + 8 * 2 + 2)) <= 1
    flat = np.full((8, 8, 3), 77, np.uint8)
    assert all((pyramid._filtered(flat, np.linspace(0, 8, 13), np.linspace(0, 8, 5), how) == 77).all() for how in pyramid.KERNELS)


def test_mosaic_documents(spark, monkeypatch):
    import xml.etree.ElementTree as ET

    area = spark.createDataFrame([(0.0, 0.0, 600.0, 520.0, 1.0)], "xmin double, ymin double, xmax double, ymax double, pixel double")
    plan = chunks.chunk_grid(area)
    one = chunks.vrt_documents(plan, 3).collect()
    assert [r["name"] for r in one] == ["mosaic.vrt"]
    doc = ET.fromstring(one[0]["value"])
    assert (doc.get("rasterXSize"), doc.get("rasterYSize")) == ("600", "520") and len(doc.findall("VRTRasterBand")) == 3
    places = {s.find("SourceFilename").text: (int(s.find("DstRect").get("xOff")), int(s.find("DstRect").get("yOff")), int(s.find("SrcRect").get("xSize"))) for s in doc.find("VRTRasterBand")}
    assert len(places) == 9 and places["chunk_2_1.tif"] == (512, 256, 88)
    assert [float(x) for x in doc.find("GeoTransform").text.split(",")] == [0, 1, 0, 520, 0, -1]
    monkeypatch.setattr(chunks, "FLAT", 4)
    monkeypatch.setattr(chunks, "BATCH", 3)
    several = {r["name"]: ET.fromstring(r["value"]) for r in chunks.vrt_documents(plan, 1, "float32").collect()}
    assert sorted(several) == ["mosaic.vrt", "mosaic_0.vrt", "mosaic_1.vrt", "mosaic_2.vrt"]
    assert [int(s.find("DstRect").get("yOff")) for s in several["mosaic.vrt"].find("VRTRasterBand")] == [0, 256, 512] and several["mosaic_2.vrt"].get("rasterYSize") == "8"


def test_rolling_keeps_order_and_bound():
    import threading

    running, most, lock = 0, 0, threading.Lock()
    taken = []

    def work(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        with lock:
            running -= 1
        return i

    def items():
        for i in range(100):
            taken.append(i)
            yield i

    out = remote.rolling(work, items(), 3)
    assert next(out) == 0 and len(taken) == 6
    assert list(out) == list(range(1, 100)) and most <= 3


def test_credentials(tmp_path, monkeypatch):
    for k in ("CATALOGUE_USER", "CATALOGUE_TOKEN"):
        monkeypatch.delenv(k, raising=False)
    env = tmp_path / ".env"
    env.write_text("# comment\nexport CATALOGUE_USER=me\nCATALOGUE_TOKEN='a=b'\nOTHER\n")
    assert remote.credentials(str(env)) == ("me", "a=b")
    monkeypatch.setenv("CATALOGUE_USER", "you")
    assert remote.credentials(str(env)) == ("you", "a=b")
    with pytest.raises(ValueError, match="CATALOGUE_TOKEN"):
        remote.credentials(str(tmp_path / "none"))


def test_scenes_end_to_end(spark, tmp_path):
    """Search, thin out, ask, wait, download: the second of two equal scenes is left out, a broken file is reported."""
    asked = []

    def scene(i, west):
        corners = [(n, lat, lon) for n, lat, lon in (("NW", 1, west), ("NE", 1, west + 1), ("SE", 0, west + 1), ("SW", 0, west))]
        return {"entityId": f"E{i}", "metadata": [{"fieldName": f"{n} Corner {a} dec", "value": str(v)} for n, lat, lon in corners for a, v in (("Lat", lat), ("Long", lon))]}

    def post(url, body, token, timeout):
        what = url.rpartition("/")[2]
        asked.append(what)
        data = {
            "login-token": "t", "logout": None,
            "dataset-search": [{"datasetAlias": "roads", "keywords": "Roads"}, {"datasetAlias": "photos", "keywords": "Aerial, photo"}],
            "scene-search": {"results": [scene(0, 0.0), scene(1, 0.0), scene(2, 5.0), scene(3, 9.0)]},
            "download-options": [{"entityId": e, "id": "p", "available": True} for e in body.get("entityIds", [])],
            "download-request": {"newRecords": {str(i): "x" for i in range(len(body.get("downloads", [])))}},
            "download-retrieve": {"available": [{"downloadId": i, "entityId": e, "url": f"http://host/{e}.zip?x=1"} for i, e in enumerate(("E0", "E2", "E3"))]},
        }[what]
        return remote.Response(200, "application/json", json.dumps({"data": data}).encode())

    client = remote.CatalogueClient("http://host/api", post)
    client.login = ("me", "token")
    with client:
        got = pipelines.download_scenes(spark, client, 0.5, 0.5, 50.0, str(tmp_path / "out"), transport="tests.stub_service:get_file", sleep=lambda s: None)
    rows_ = {r["entityId"]: r["file"] for r in got.collect()}
    assert rows_ == {"E0": "E0.zip", "E2": "named.zip", "E3": None} and asked[0] == "login-token" and asked[-1] == "logout"
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["E0.json", "E0.zip", "named.json", "named.zip"]
    assert json.loads((tmp_path / "out/named.json").read_text())["bounds"]["northWest"] == {"lat": 1.0, "lon": 5.0}
