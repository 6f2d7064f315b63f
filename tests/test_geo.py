import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import crs, geo, parse, predicates
from gridloom.functions.geo import num


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_round_trip(spark):
    x, y = geo.mercator_x(num(-82.22)), geo.mercator_y(num(39.21))
    lon, lat = one(spark, geo.longitude(x), geo.latitude(y))
    assert math.isclose(lon, -82.22) and math.isclose(lat, 39.21)


def test_boxes_differ_by_rule(spark):
    a = one(spark, geo.box_around(num(55.9515), num(-159.2641), num(10))["min_lat"])[0]
    b = one(spark, geo.box_by_meters(num(55.9515), num(-159.2641), num(10))["min_lat"])[0]
    assert round(a, 6) == 55.806572 and round(b, 6) == 55.806931


def test_tile_bounds_are_north_up(spark):
    f = geo.tile_footprint(F.lit(2614176), F.lit(483179), num(0.018661383852976041))
    r = one(spark, geo.latitude(f["north_y"]), geo.longitude(f["west_x"]), geo.latitude(f["south_y"]))
    assert round(r[0], 9) == 55.951506605 and round(r[1], 9) == -159.264206893 and r[2] < r[0]


def test_native_lod_goes_half_to_even(spark):
    zoom = lambda px: one(spark, geo.native_lod(num(px)))[0]
    assert zoom(0.29858) == 19 and zoom(0.3) == 19
    assert zoom(2 * math.pi * geo.EARTH_RADIUS / 256 / 2**2.5) == 2


def test_middle_latitude(spark):
    assert round(one(spark, geo.middle_latitude(num(60), num(40)))[0], 6) == 51.065229
    assert abs(one(spark, geo.middle_latitude(num(1), num(-1)))[0]) < 1e-12


def test_middle_latitude_off_the_map(spark):
    """At the poles and beyond, where the projection has no value or another latitude's."""
    assert list(one(spark, *(geo.middle_latitude(num(n), num(n - 0.5)) for n in (-89.5, -90.0, -240.0, -300.0, 90.25)))) == [-89.75, -90.25, -240.25, -300.25, 90.0]


def test_checked_coordinates(spark):
    assert one(spark, geo.checked_latitude(F.lit("39.2")))[0] == 39.2
    for wrong in ("91", "x"):
        with pytest.raises(Exception, match="not a latitude"):
            one(spark, geo.checked_latitude(F.lit(wrong)))


def test_three_overlaps(spark):
    box = lambda *v: {k: num(x) for k, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)}
    a, touching, apart = box(0, 0, 1, 1), box(1, 0, 2, 1), box(3, 3, 4, 4)
    assert one(spark, predicates.overlaps_closed(a, touching), predicates.overlaps_open(a, touching), predicates.overlaps_closed(a, apart)) == (True, False, False)
    assert one(spark, predicates.overlap_ratio(a, box(0.5, 0, 2, 1)))[0] == 0.5
    assert one(spark, predicates.overlap_ratio(a, box(0, 0, 0, 1)))[0] is None


def test_cache_paths(spark):
    paths = ["x/L23/R0027e3a0/C00075f6b.png", "L1/R0A/C0b.PNG", "L1/Rzz/C0.png", "1/R0/C0.png", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [tuple(r) for r in df.select(*(c.alias(k) for k, c in parse.tile_of_cache_path(F.col("path")).items())).collect()]
    assert got == [(23, 2614176, 483179), (1, 10, 11), (None,) * 3, (None,) * 3, (None,) * 3]
    with pytest.raises(Exception, match="not a tile path"):
        df.select(parse.tile_of_cache_path(F.col("path"), strict=True)["row"]).collect()


def test_long_rows_keep_their_digits(spark):
    assert one(spark, parse.hex8(F.lit(2**36)))[0] == "1000000000"


def test_chunk_names(spark):
    df = spark.createDataFrame([("a/chunk_12_7.tif",), ("a/other.tif",)], "p string")
    assert [tuple(r) for r in df.select(*parse.chunk_of_file(F.col("p")).values()).collect()] == [(7, 12), (0, 0)]


def test_endpoints(spark):
    url = F.lit("https://h/rest/services/Naip_Plus/ImageServer/exportImage/")
    assert one(spark, parse.endpoint(url), parse.service_key(url), parse.service_label(url)) == ("https://h/rest/services/Naip_Plus/ImageServer", "h__rest__services__Naip_Plus__ImageServer", "Imageserver")


def test_arguments():
    for wrong in ({"dimension": 0}, {"scale": 0.0}, {"scale": 1.5}, {"workers": 0}, {"axis": "up"}):
        with pytest.raises(ValueError):
            predicates.check_arguments(**wrong)


@pytest.mark.parametrize("epsg", [32631, 32733, 26917, 25832, 5070, 3310, 3338, 2154, 3347, 3034, 3857])
def test_projections_go_both_ways(epsg):
    rng = np.random.default_rng(epsg)
    center = {32631: (40, 3), 32733: (-30, 15), 26917: (35, -81), 25832: (50, 9), 5070: (38, -96), 3310: (37, -120), 3338: (62, -150), 2154: (46, 3), 3347: (55, -95), 3034: (50, 10), 3857: (20, 30)}[epsg]
    lat, lon = center[0] + rng.uniform(-4, 4, 200), center[1] + rng.uniform(-3, 3, 200)
    x, y = crs.projected(epsg, lat, lon)
    back = crs.degrees(epsg, x, y)
    assert np.allclose(back[0], lat, atol=1e-9) and np.allclose(back[1], lon, atol=1e-9)


def test_projections_at_known_places():
    x, y = crs.projected(32631, np.array([0.0, 45.0]), np.array([3.0, 3.0]))
    assert np.allclose(x, 500_000) and np.allclose(y, [0, 4_982_950.400], atol=1e-2)  # the meridian's arc times 0.9996
    assert np.allclose(crs.projected(32733, np.array([0.0]), np.array([15.0])), [[500_000], [10_000_000]])
    assert np.allclose(crs.projected(5070, np.array([23.0]), np.array([-96.0])), 0, atol=1e-6)
    assert np.allclose(crs.projected(2154, np.array([46.5]), np.array([3.0])), [[700_000], [6_600_000]], atol=1e-6)
    with pytest.raises(ValueError, match="EPSG:2000 is not supported"):
        crs.projection(2000)


def test_cones_keep_areas_or_angles():
    """Over a small cell: Albers keeps its area on the ellipsoid, Lambert the ratio of its sides."""
    d, (a, f) = 1e-5, crs.GRS80
    e2 = f * (2 - f)
    for lat in (30.0, 47.0):
        phi = np.radians(lat)
        meridian, parallel = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5, a * np.cos(phi) / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        for epsg, lon in ((5070, -90.0), (2154, 1.0)):
            x, y = crs.projected(epsg, np.array([lat - d, lat + d, lat, lat]), np.array([lon, lon, lon - d, lon + d]))
            north, east = np.array([x[1] - x[0], y[1] - y[0]]) / np.radians(2 * d), np.array([x[3] - x[2], y[3] - y[2]]) / np.radians(2 * d)
            if epsg == 5070:
                assert abs(east[0] * north[1] - east[1] * north[0]) == pytest.approx(meridian * parallel, rel=1e-6)
            else:
                assert np.hypot(*north) / meridian == pytest.approx(np.hypot(*east) / parallel, rel=1e-6) and abs(north @ east) < 1e-4 * meridian * parallel
