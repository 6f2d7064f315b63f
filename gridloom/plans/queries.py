"""Queries of the engine by name, each with the SQL that an oracle runs over the same tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, parse
from gridloom.functions.geo import num
from gridloom.functions.predicates import lod_allowed, overlaps_open
from gridloom.operators import chunks, coverage, grid, mosaic, raster, services, spatial_join, windows
from gridloom.plans import derived as d
from gridloom.plans.pipelines import scene_representatives
from gridloom.sources import manifest, scan
from gridloom.staging import claim
from gridloom.streaming.ingest import current_ledger, ingest_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

R, O, WORLD = geo.EARTH_RADIUS, geo.ORIGIN, geo.WORLD_RESOLUTION
SPAN = f"({WORLD} / 262144 * 256)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def r(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def lon_sql(x: str) -> str:
    return f"degrees(({x}) / {R}::DOUBLE)"


def lat_sql(y: str) -> str:
    return f"degrees(2 * atan(exp(({y}) / {R}::DOUBLE)) - pi() / 2)"


def mx_sql(lon: str) -> str:
    return f"({R}::DOUBLE * radians({lon}))"


def my_sql(lat: str) -> str:
    return f"({R}::DOUBLE * ln(tan(pi() / 4 + radians({lat}) / 2)))"


# -- the tile gather and its parts -------------------------------------------------------------------

FOOT_SQL = f"""foot AS (SELECT *, -{O}::DOUBLE + col * {SPAN} AS west_x, -{O}::DOUBLE + (col + 1) * {SPAN} AS east_x,
  {O}::DOUBLE - ("row" + 1) * {SPAN} AS south_y, {O}::DOUBLE - "row" * {SPAN} AS north_y FROM tiles),
kept AS (SELECT * FROM foot WHERE west_x <= {d.AREA["max_x"]} AND east_x >= {d.AREA["min_x"]} AND south_y <= {d.AREA["max_y"]} AND north_y >= {d.AREA["min_y"]}),
placed AS (SELECT *, "row" - min("row") OVER () AS r, col - min(col) OVER () AS c FROM kept),
keyed AS (SELECT *, (floor(r / 4.0) * 4)::BIGINT AS origin_r, (floor(c / 4.0) * 4)::BIGINT AS origin_c FROM placed)"""
GATHER_SQL = f"WITH {d.TILES_SQL}, {FOOT_SQL}"


def kept_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    footed = windows.with_footprints(d.tiles(spark, sf_dir), d.levels(spark))
    return footed.where(windows.inside_area(**d.AREA))


def placed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.normalized(kept_tiles(spark, sf_dir))


def gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with ``name`` and projected edges."""
    plan = windows.windows(placed_tiles(spark, sf_dir), 4).withColumn("name", windows.output_name())
    return plan.withColumns(windows.window_footprint(WORLD / 2**d.LEVEL))


@query(
    "tile_gather",
    f"""{GATHER_SQL}
SELECT 'gathered_r' || origin_r || '_c' || origin_c AS name, count(*) AS n,
  round({lon_sql(f"-{O}::DOUBLE + min(col) * {SPAN}")}, 6) AS west, round({lon_sql(f"-{O}::DOUBLE + (max(col) + 1) * {SPAN}")}, 6) AS east,
  round({lat_sql(f'{O}::DOUBLE - min("row") * {SPAN}')}, 6) AS north, round({lat_sql(f'{O}::DOUBLE - (max("row") + 1) * {SPAN}')}, 6) AS south
FROM keyed GROUP BY origin_r, origin_c""",
)
def tile_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = gathered(spark, sf_dir)
    return plan.select("name", "n", r(geo.longitude(F.col("west_x"))).alias("west"), r(geo.longitude(F.col("east_x"))).alias("east"), r(geo.latitude(F.col("north_y"))).alias("north"), r(geo.latitude(F.col("south_y"))).alias("south"))


@query("aoi_tile_filter", f'{GATHER_SQL} SELECT "row", col, round(west_x, 3) AS west_x, round(north_y, 3) AS north_y FROM kept')
def aoi_tile_filter(spark, sf_dir):
    return kept_tiles(spark, sf_dir).select("row", "col", r(F.col("west_x"), 3).alias("west_x"), r(F.col("north_y"), 3).alias("north_y"))


@query(
    "window_partition",
    f"""{GATHER_SQL} SELECT origin_r, origin_c, count(*) AS n, min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max,
  min(r) AS min_r, min(c) AS min_c FROM keyed GROUP BY origin_r, origin_c""",
)
def window_partition(spark, sf_dir):
    return windows.windows(placed_tiles(spark, sf_dir), 4).select("origin_r", "origin_c", "n", "row_min", "row_max", "col_min", "col_max", "min_r", "min_c")


@query("window_root", f"{GATHER_SQL} SELECT origin_r, origin_c, arg_min('t' || r || '_' || c, r * 100000 + c) AS root FROM keyed GROUP BY origin_r, origin_c")
def window_root(spark, sf_dir):
    named = placed_tiles(spark, sf_dir).withColumn("name", F.concat(F.lit("t"), "r", F.lit("_"), "c"))
    return windows.windows(named, 4, "name").select("origin_r", "origin_c", "root")


@query("window_dims", f"{GATHER_SQL} SELECT origin_r, origin_c, max(r) - origin_r + 1 AS rows, max(c) - origin_c + 1 AS cols FROM keyed GROUP BY origin_r, origin_c")
def window_dims(spark, sf_dir):
    return windows.windows(placed_tiles(spark, sf_dir), 4).select("origin_r", "origin_c", "rows", "cols")


@query(
    "window_bounds",
    f"""{GATHER_SQL}, w AS (SELECT origin_r, origin_c, -{O}::DOUBLE + min(col) * {SPAN} AS w, -{O}::DOUBLE + (max(col) + 1) * {SPAN} AS e,
  {O}::DOUBLE - min("row") * {SPAN} AS n, {O}::DOUBLE - (max("row") + 1) * {SPAN} AS s FROM keyed GROUP BY origin_r, origin_c)
SELECT origin_r, origin_c, round({lat_sql("(n + s) / 2")}, 9) AS center_lat, round({lon_sql("(w + e) / 2")}, 9) AS center_lon, round({lat_sql("n")}, 9) AS ne_lat, round({lon_sql("e")}, 9) AS ne_lon,
  round({lat_sql("s")}, 9) AS sw_lat, round({lon_sql("w")}, 9) AS sw_lon FROM w""",
)
def window_bounds(spark, sf_dir):
    b = F.col("b")
    plan = windows.windows(placed_tiles(spark, sf_dir), 4).withColumn("b", windows.window_bounds(WORLD / 2**d.LEVEL))
    parts = {"center": b["center"], "ne": b["northEast"], "sw": b["southWest"]}
    return plan.select("origin_r", "origin_c", *(r(p[k], 9).alias(f"{n}_{k}") for n, p in parts.items() for k in ("lat", "lon")))


@query("lod_select_max", "WITH t AS (SELECT l_linenumber AS level, count(*) AS n FROM lineitem GROUP BY 1) SELECT max(level) AS level, CAST(arg_max(n, level) AS BIGINT) AS n, string_agg(level::VARCHAR, ',' ORDER BY level) AS available FROM t")
def lod_select_max(spark, sf_dir):
    tiles = d.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level"))
    known = tiles.agg(F.array_join(F.sort_array(F.collect_set("level")), ",").alias("available"))
    return windows.select_level(tiles).groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(known))


# -- names and paths -------------------------------------------------------------------------------------

KEYS_SQL = "keys AS (SELECT DISTINCT l_linenumber AS level, 99000 + l_orderkey % 200 AS \"row\", 70000 + l_partkey % 150 AS col FROM lineitem)"


def keys(spark, sf_dir):
    return d.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("level"), (99000 + F.col("l_orderkey") % 200).alias("row"), (70000 + F.col("l_partkey") % 150).alias("col")).distinct()


@query("tile_path_build", f"WITH {KEYS_SQL} SELECT level, \"row\", col, printf('R%08x/C%08x.png', \"row\", col) AS cache_path, level || '/' || col || '/' || \"row\" || '.png' AS xyz_path, printf('L%02d_R%08x_C%08x', level, \"row\", col) AS name FROM keys")
def tile_path_build(spark, sf_dir):
    level, row, col = F.col("level"), F.col("row"), F.col("col")
    return keys(spark, sf_dir).select("level", "row", "col", parse.cache_path(row, col).alias("cache_path"), parse.xyz_path(level, row, col).alias("xyz_path"), parse.tile_name(level, row, col).alias("name"))


@query("tile_path_parse", f"WITH {KEYS_SQL}, p AS (SELECT printf('L%d/R%08x/C%08x.png', level, \"row\", col) AS path FROM keys) SELECT path, regexp_extract(path, 'L([0-9]+)/', 1)::INTEGER AS level, ('0x' || regexp_extract(path, 'R([0-9a-f]+)/', 1))::BIGINT AS \"row\", ('0x' || regexp_extract(path, 'C([0-9a-f]+)[.]', 1))::BIGINT AS col FROM p")
def tile_path_parse(spark, sf_dir):
    paths = keys(spark, sf_dir).select(F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("/"), parse.cache_path(F.col("row"), F.col("col"))).alias("path"))
    return paths.select("path", *(c.alias(k) for k, c in parse.tile_of_cache_path(F.col("path")).items()))


@query("xyz_path_parse", f"WITH {KEYS_SQL} SELECT level || '/' || col || '/' || \"row\" || '.png' AS path, level, \"row\", col FROM keys")
def xyz_path_parse(spark, sf_dir):
    paths = keys(spark, sf_dir).select(parse.xyz_path(F.col("level"), F.col("row"), F.col("col")).alias("path"))
    return paths.select("path", *(c.alias(k) for k, c in parse.tile_of_xyz_path(F.col("path")).items()))


@query(
    "endpoint_normalize",
    r"""WITH e AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/exportImage' ELSE '/' END AS raw FROM pages),
n AS (SELECT page_id, regexp_replace(regexp_replace(raw, '/+$', ''), '/exportImage$', '') AS endpoint FROM e)
SELECT page_id, endpoint, replace(regexp_replace(endpoint, '^[A-Za-z]+://', ''), '/', '__') AS key FROM n""",
)
def endpoint_normalize(spark, sf_dir):
    raw = d.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 2 == 0, "/exportImage").otherwise("/")).alias("raw"))
    return raw.select("page_id", parse.endpoint(F.col("raw")).alias("endpoint"), parse.service_key(F.col("raw")).alias("key"))


# -- projections and areas -------------------------------------------------------------------------------


@query("web_mercator_forward", f"WITH {d.POINTS_SQL} SELECT id, round({mx_sql('lon')}, 4) AS x, round({my_sql('lat')}, 4) AS y FROM points")
def web_mercator_forward(spark, sf_dir):
    return d.points(spark, sf_dir).select("id", r(geo.mercator_x(F.col("lon")), 4).alias("x"), r(geo.mercator_y(F.col("lat")), 4).alias("y"))


@query("web_mercator_inverse", f"WITH {d.POINTS_SQL} SELECT id, round({lon_sql('lon * 100000')}, 9) AS lon, round({lat_sql('lat * 100000')}, 9) AS lat FROM points")
def web_mercator_inverse(spark, sf_dir):
    scaled = lambda k: F.col(k) * num(100000)
    return d.points(spark, sf_dir).select("id", r(geo.longitude(scaled("lon")), 9).alias("lon"), r(geo.latitude(scaled("lat")), 9).alias("lat"))


def _bbox(per_degree: str) -> str:
    return f"lat - {per_degree} AS min_lat, lon - {per_degree} / cos(radians(lat)) AS min_lon, lat + {per_degree} AS max_lat, lon + {per_degree} / cos(radians(lat)) AS max_lon"


@query("aoi_bbox_miles", f"WITH {d.AOIS_SQL}, b AS (SELECT id, {_bbox('miles / 69')} FROM aois) SELECT id, round(min_lat, 9) AS min_lat, round(min_lon, 9) AS min_lon, round(max_lat, 9) AS max_lat, round(max_lon, 9) AS max_lon FROM b")
def aoi_bbox_miles(spark, sf_dir):
    return d.aois(spark, sf_dir).select("id", *(r(c, 9).alias(k) for k, c in geo.box_around(F.col("lat"), F.col("lon"), F.col("miles")).items()))


@query(
    "aoi_bbox_metric",
    f"""WITH {d.AOIS_SQL}, b AS (SELECT id, {_bbox('miles * 1609.344::DOUBLE / 111320')} FROM aois)
SELECT id, round(min_lat, 9) AS min_lat, round(max_lon, 9) AS max_lon, round({mx_sql('min_lon')}, 4) AS xmin, round({my_sql('min_lat')}, 4) AS ymin, round({mx_sql('max_lon')}, 4) AS xmax, round({my_sql('max_lat')}, 4) AS ymax FROM b""",
)
def aoi_bbox_metric(spark, sf_dir):
    box = geo.box_by_meters(F.col("lat"), F.col("lon"), F.col("miles"))
    return d.aois(spark, sf_dir).select("id", r(box["min_lat"], 9).alias("min_lat"), r(box["max_lon"], 9).alias("max_lon"), *(r(c, 4).alias(k) for k, c in geo.projected(box).items()))


@query("tile_scheme_levels", f"SELECT z::INTEGER AS level_id, round({WORLD}::DOUBLE / pow(2, z) * 96 / 0.0254::DOUBLE, 6) AS scale, round({WORLD}::DOUBLE / pow(2, z), 9) AS resolution FROM range(0, 24) t(z)")
def tile_scheme_levels(spark, sf_dir):
    return d.levels(spark).select("level_id", r(F.col("scale")).alias("scale"), r(F.col("resolution"), 9).alias("resolution"))


@query(
    "lod_native_guard",
    f"""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE / 10 AS native, 14 + p_size % 8 AS zoom FROM part),
l AS (SELECT *, round_even(log2(2 * pi() * {R}::DOUBLE / 256 / native), 0)::INTEGER AS native_lod FROM p) SELECT id, zoom, native_lod, zoom <= native_lod AS allowed FROM l""",
)
def lod_native_guard(spark, sf_dir):
    parts = d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("double") / num(10)).alias("native"), (14 + F.col("p_size") % 8).alias("zoom"))
    return parts.select("id", "zoom", geo.native_lod(F.col("native")).alias("native_lod"), lod_allowed(F.col("zoom"), F.col("native")).alias("allowed"))


# -- boxes: range joins, components, coverage ------------------------------------------------------------

AREA_SQL = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
RATIO_SQL = f"({AREA_SQL} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))"


def _pairs_sql(threshold: float) -> str:
    return f"pairs AS (SELECT a.id AS i, b.id AS j, {RATIO_SQL} AS ratio FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0 WHERE {RATIO_SQL} >= {threshold}::DOUBLE)"


GROUPS_SQL = """edges AS (SELECT i AS u, j AS v FROM pairs UNION ALL SELECT j, i FROM pairs),
reach AS (SELECT id AS id, id AS root FROM boxes UNION SELECT edges.v, reach.root FROM reach JOIN edges ON edges.u = reach.id WHERE edges.v > reach.root),
grouped AS (SELECT id, min(root) AS "group" FROM reach GROUP BY id)"""


@query("overlap_pairs", f"WITH {d.BOXES_SQL}, {_pairs_sql(0.3)} SELECT i, j, round(ratio, 9) AS ratio FROM pairs")
def overlap_pairs(spark, sf_dir):
    return spatial_join.overlap_pairs(d.boxes(spark, sf_dir), 0.3).select("i", "j", r(F.col("ratio"), 9).alias("ratio"))


@query(
    "elevation_intersect_open",
    f"""WITH {d.BOXES_SQL}, {d.AOIS_SQL}, aim AS (SELECT id, {_bbox('miles / 69')} FROM aois)
SELECT aim.id AS aoi, boxes.id AS box FROM aim JOIN boxes ON x0 < max_lon AND x1 > min_lon AND y0 < max_lat AND y1 > min_lat""",
)
def elevation_intersect_open(spark, sf_dir):
    box = geo.box_around(F.col("lat"), F.col("lon"), F.col("miles"))
    aims = d.aois(spark, sf_dir).select("id", box["min_lon"].alias("x0"), box["min_lat"].alias("y0"), box["max_lon"].alias("x1"), box["max_lat"].alias("y1"))
    return spatial_join.overlap_join(aims, d.boxes(spark, sf_dir), overlaps_open).select(F.col("l_id").alias("aoi"), F.col("r_id").alias("box"))


@query("region_touch_pairs", f"WITH {d.BOXES_SQL} SELECT count(*) AS n, CAST(sum(b.id - a.id) AS BIGINT) AS checksum FROM boxes a JOIN boxes b ON a.id < b.id AND a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0")
def region_touch_pairs(spark, sf_dir):
    return spatial_join.touching_pairs(d.boxes(spark, sf_dir)).agg(F.count("*").alias("n"), F.sum(F.col("j") - F.col("i")).alias("checksum"))


def grouped_boxes(spark, sf_dir, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    boxes = d.boxes(spark, sf_dir)
    return boxes, spatial_join.overlap_groups(boxes, threshold)


@query("overlap_components", f'WITH RECURSIVE {d.BOXES_SQL}, {_pairs_sql(0.3)}, {GROUPS_SQL} SELECT id, "group" FROM grouped')
def overlap_components(spark, sf_dir):
    return grouped_boxes(spark, sf_dir)[1]


@query("overlap_representatives_min_index", f'WITH RECURSIVE {d.BOXES_SQL}, {_pairs_sql(0.3)}, {GROUPS_SQL} SELECT "group", min(id) AS id FROM grouped GROUP BY 1')
def representatives_min_index(spark, sf_dir):
    return spatial_join.representatives(*grouped_boxes(spark, sf_dir), "min_index")


@query("overlap_representatives_max_area", f'WITH RECURSIVE {d.BOXES_SQL}, {_pairs_sql(0.3)}, {GROUPS_SQL} SELECT "group", id FROM grouped JOIN boxes USING (id) QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY (x1 - x0) * (y1 - y0) DESC, id) = 1')
def representatives_max_area(spark, sf_dir):
    return spatial_join.representatives(*grouped_boxes(spark, sf_dir), "max_area")


@query("scene_dedupe", f'WITH RECURSIVE {d.BOXES_SQL}, {_pairs_sql(0.9)}, {GROUPS_SQL} SELECT "group", min(id) AS id FROM grouped GROUP BY 1')
def scene_dedupe(spark, sf_dir):
    return scene_representatives(d.boxes(spark, sf_dir))


INTERVALS_SQL = "mine AS (SELECT boxes.*, c_nationkey AS nation FROM boxes JOIN customer ON c_custkey = id)"


def _cover_sql(intervals: str, targets: str, keys: str) -> str:
    """Interval coverage by a running maximum; ``targets`` has keys, lo, hi."""
    return f"""clipped AS (SELECT {keys}, t.lo AS t_lo, t.hi AS t_hi, greatest(i.lo, t.lo) AS lo, least(i.hi, t.hi) AS hi FROM {intervals} i JOIN {targets} t USING ({keys}) WHERE greatest(i.lo, t.lo) < least(i.hi, t.hi)),
run AS (SELECT *, greatest(coalesce(max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t_lo), t_lo) AS reach FROM clipped),
flat AS (SELECT {keys}, coalesce(bool_and(run.lo <= run.reach) AND max(run.hi) >= max(run.t_hi), FALSE) AS covered FROM {targets} t LEFT JOIN run USING ({keys}) GROUP BY {keys})"""


@query("interval_cover", f"WITH {d.BOXES_SQL}, {INTERVALS_SQL}, ivals AS (SELECT nation, x0 AS lo, x1 AS hi FROM mine), aims AS (SELECT n_nationkey AS nation, (2 + n_nationkey)::DOUBLE AS lo, (2 + 2 * n_nationkey + n_nationkey % 3)::DOUBLE AS hi FROM nation), {_cover_sql('ivals', 'aims', 'nation')} SELECT nation, covered FROM flat")
def interval_cover(spark, sf_dir):
    customer = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    mine = d.boxes(spark, sf_dir).join(customer, "id").select("nation", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    k = F.col("n_nationkey")
    aims = d.table(spark, sf_dir, "nation").select(k.alias("nation"), (2 + k).cast("double").alias("lo"), (2 + 2 * k + k % 3).cast("double").alias("hi"))
    return coverage.intervals_cover(mine, aims, "nation")


@query(
    "area_fully_covered",
    f"""WITH {d.BOXES_SQL}, {INTERVALS_SQL}, targets AS (SELECT n_nationkey AS nation, 10 + n_nationkey % 5::DOUBLE AS x0, 12 + n_nationkey % 7::DOUBLE AS y0, 10 + n_nationkey % 5 + (n_nationkey % 4) * 0.2::DOUBLE AS x1, 12 + n_nationkey % 7 + (n_nationkey % 3 + 1) * 0.1::DOUBLE AS y1 FROM nation),
cuts AS (SELECT nation, y0 AS y FROM targets UNION SELECT nation, y1 FROM targets UNION SELECT m.nation, u.y FROM mine m JOIN targets t ON m.nation = t.nation, LATERAL (SELECT m.y0 AS y UNION ALL SELECT m.y1) u WHERE u.y > t.y0 AND u.y < t.y1),
strips AS (SELECT nation, (y + up) / 2 AS mid FROM (SELECT nation, y, lead(y) OVER (PARTITION BY nation ORDER BY y) AS up FROM cuts) WHERE up IS NOT NULL),
ivals AS (SELECT s.nation, s.mid, m.x0 AS lo, m.x1 AS hi FROM strips s JOIN mine m ON m.nation = s.nation AND m.y0 <= s.mid AND m.y1 >= s.mid),
aims AS (SELECT s.nation, s.mid, t.x0 AS lo, t.x1 AS hi FROM strips s JOIN targets t USING (nation)),
{_cover_sql('ivals', 'aims', 'nation, mid')}
SELECT nation, bool_and(covered) AS covered FROM flat GROUP BY nation""",
)
def area_fully_covered(spark, sf_dir):
    customer = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    mine = d.boxes(spark, sf_dir).join(customer, "id")
    k = F.col("n_nationkey")
    x0, y0 = num(10) + (k % 5).cast("double"), num(12) + (k % 7).cast("double")
    aims = d.table(spark, sf_dir, "nation").select(k.alias("nation"), x0.alias("x0"), y0.alias("y0"), (x0 + (k % 4).cast("double") * num(0.2)).alias("x1"), (y0 + (k % 3 + 1).cast("double") * num(0.1)).alias("y1"))
    return coverage.areas_covered(mine, aims, "nation")


# -- grids ----------------------------------------------------------------------------------------------

CENTERS_SQL = "centers AS (SELECT c_custkey AS pos, 't' || c_custkey AS name, 40 - (c_custkey % 30) * 0.5::DOUBLE AS center_lat, -80 + ((c_custkey * 7) % 37) * 0.25::DOUBLE AS center_lon FROM customer)"


def centers(spark, sf_dir):
    k = F.col("c_custkey")
    return d.table(spark, sf_dir, "customer").select(k.alias("pos"), F.concat(F.lit("t"), k.cast("string")).alias("name"), (num(40) - (k % 30).cast("double") * num(0.5)).alias("center_lat"), (num(-80) + ((k * 7) % 37).cast("double") * num(0.25)).alias("center_lon"))


@query("grid_cluster", f"WITH {CENTERS_SQL} SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS idx, round(v, 9) AS center, n FROM (SELECT center_lat AS v, count(*) AS n FROM centers GROUP BY 1)")
def grid_cluster(spark, sf_dir):
    return grid.clusters(centers(spark, sf_dir), "center_lat").select("idx", r(F.col("center"), 9).alias("center"), "n")


PLACE_SQL = f"""{CENTERS_SQL}, ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY center_lat DESC) - 1 AS BIGINT) AS r, CAST(dense_rank() OVER (ORDER BY center_lon) - 1 AS BIGINT) AS c FROM centers),
cells AS (SELECT r, c, arg_max(name, pos) AS name, max(pos) AS pos FROM ranked GROUP BY r, c)"""


@query("grid_place", f"WITH {PLACE_SQL} SELECT r, c, name, pos FROM cells")
def grid_place(spark, sf_dir):
    return grid.cells(grid.place(centers(spark, sf_dir))).select("r", "c", "name", "pos")


@query(
    "neighbor_touch_check",
    f"""WITH {PLACE_SQL}, b AS (SELECT r, c, name, 40 - (pos % 30) * 0.5::DOUBLE + 0.25 AS north, 40 - (pos % 30) * 0.5::DOUBLE - 0.25 - CASE WHEN pos % 11 = 0 THEN 0.01 ELSE 0 END AS south,
  -80 + ((pos * 7) % 37) * 0.25::DOUBLE - 0.125 AS west, -80 + ((pos * 7) % 37) * 0.25::DOUBLE + 0.125 + CASE WHEN pos % 13 = 0 THEN 0.01 ELSE 0 END AS east FROM cells),
e AS (SELECT 'EAST' AS side, a.name, o.name AS other, abs(a.east - o.west) AS gap, abs(a.east - o.west) > 0.001::DOUBLE * abs(a.east - a.west) AS gap_wide,
  abs(a.north - o.north) > 0.001::DOUBLE * abs(a.north - a.south) OR abs(a.south - o.south) > 0.001::DOUBLE * abs(a.north - a.south) AS misaligned FROM b a JOIN b o ON o.r = a.r AND o.c = a.c + 1),
s AS (SELECT 'SOUTH' AS side, a.name, o.name AS other, abs(a.south - o.north) AS gap, abs(a.south - o.north) > 0.001::DOUBLE * abs(a.north - a.south) AS gap_wide,
  abs(a.west - o.west) > 0.001::DOUBLE * abs(a.east - a.west) OR abs(a.east - o.east) > 0.001::DOUBLE * abs(a.east - a.west) AS misaligned FROM b a JOIN b o ON o.r = a.r + 1 AND o.c = a.c)
SELECT side, name, other, round(gap, 6) AS gap, gap_wide, misaligned FROM (SELECT * FROM e UNION ALL SELECT * FROM s) WHERE gap_wide OR misaligned""",
)
def neighbor_touch_check(spark, sf_dir):
    placed = grid.cells(grid.place(centers(spark, sf_dir)))
    p = F.col("pos")
    lat, lon = num(40) - (p % 30).cast("double") * num(0.5), num(-80) + ((p * 7) % 37).cast("double") * num(0.25)
    n, s = lat + num(0.25), lat - num(0.25) - F.when(p % 11 == 0, num(0.01)).otherwise(num(0))
    w, e = lon - num(0.125), lon + num(0.125) + F.when(p % 13 == 0, num(0.01)).otherwise(num(0))
    bounds = F.struct(geo.point(n, e).alias("northEast"), geo.point(s, e).alias("southEast"), geo.point(s, w).alias("southWest"), geo.point(n, w).alias("northWest"))
    return grid.neighbours(placed.withColumn("bounds", bounds)).select("side", "name", "other", r(F.col("gap")).alias("gap"), "gap_wide", "misaligned")


@query(
    "merged_bounds",
    f"""WITH {d.BOXES_SQL}, q AS (SELECT id % 50 AS grp, y1 + id % 3 * 0.01 AS ne_lat, x1 AS ne_lon, y0 AS se_lat, x1 + id % 5 * 0.01 AS se_lon, y0 - id % 4 * 0.01 AS sw_lat, x0 AS sw_lon, y1 AS nw_lat, x0 - id % 2 * 0.01 AS nw_lon FROM boxes),
m AS (SELECT grp, max(greatest(ne_lat, se_lat, sw_lat, nw_lat)) AS n, min(least(ne_lat, se_lat, sw_lat, nw_lat)) AS s, min(least(ne_lon, se_lon, sw_lon, nw_lon)) AS w, max(greatest(ne_lon, se_lon, sw_lon, nw_lon)) AS e FROM q GROUP BY grp)
SELECT grp, round(n, 6) AS north, round(s, 6) AS south, round(w, 6) AS west, round(e, 6) AS east, round((n + s) / 2, 6) AS center_lat, round((w + e) / 2, 6) AS center_lon FROM m""",
)
def merged_bounds(spark, sf_dir):
    k = F.col("id")
    skew = lambda m: (k % m).cast("double") * num(0.01)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    bounds = F.struct(geo.point(y1 + skew(3), x1).alias("northEast"), geo.point(y0, x1 + skew(5)).alias("southEast"), geo.point(y0 - skew(4), x0).alias("southWest"), geo.point(y1, x0 - skew(2)).alias("northWest"))
    b = F.col("bounds")
    merged = windows.merged_bounds(d.boxes(spark, sf_dir).select((k % 50).alias("grp"), bounds.alias("bounds")), "grp")
    return merged.select("grp", r(b["northWest"]["lat"]).alias("north"), r(b["southWest"]["lat"]).alias("south"), r(b["northWest"]["lon"]).alias("west"), r(b["northEast"]["lon"]).alias("east"), r(b["center"]["lat"]).alias("center_lat"), r(b["center"]["lon"]).alias("center_lon"))


# -- services -------------------------------------------------------------------------------------------

CHOOSE_SQL = f"""{d.AOIS_SQL}, {d.SERVICES_SQL}, aim AS (SELECT id, {_bbox('miles * 1609.344::DOUBLE / 111320')} FROM aois),
hits AS (SELECT id, key, x0 <= min_lon AND x1 >= max_lon AND y0 <= min_lat AND y1 >= max_lat AS inside FROM aim JOIN services
  ON (min_lon + max_lon) / 2 BETWEEN x0 AND x1 AND (min_lat + max_lat) / 2 BETWEEN y0 AND y1),
found AS (SELECT id, count(key) AS n_hits, count(*) FILTER (WHERE inside) AS n, list_sort(list(key) FILTER (WHERE inside)) AS keys FROM aim LEFT JOIN hits USING (id) GROUP BY id)"""


def _aims(spark, sf_dir):
    return d.aois(spark, sf_dir).select("id", *(c.alias(k) for k, c in geo.box_by_meters(F.col("lat"), F.col("lon"), F.col("miles")).items()))


@query("service_ambiguous", f"WITH {CHOOSE_SQL} SELECT id, n AS n_candidates, CASE WHEN n = 1 THEN keys[1] END AS key, CASE WHEN n_hits = 0 THEN 'no_service' WHEN n = 0 THEN 'straddles' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM found")
def service_ambiguous(spark, sf_dir):
    return services.choose(_aims(spark, sf_dir), d.services(spark, sf_dir))


@query("service_select", f"WITH {CHOOSE_SQL} SELECT id, n AS n_candidates, keys[2] AS key, CASE WHEN n_hits = 0 THEN 'no_service' WHEN n = 0 THEN 'straddles' WHEN n < 2 THEN 'index_out_of_range' ELSE 'ok' END AS status FROM found")
def service_select(spark, sf_dir):
    return services.choose(_aims(spark, sf_dir), d.services(spark, sf_dir), index=1)


META_SQL = """items AS (SELECT event_id AS pos, 'https://host/arcgis/rest/services/svc_' || event_id % 40 || '/ImageServer' || CASE WHEN event_id % 3 = 0 THEN '/exportImage' ELSE '' END AS url,
  CASE WHEN event_id % 7 = 0 THEN value END AS pixel_size, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0.0 ELSE value + 1 END AS min_pixel, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + 2 END AS pixel_x,
  value + 3 AS mean_pixel, CASE WHEN event_id % 6 = 0 THEN [value + 4, value + 5] END AS lods FROM events)"""


def _items(spark, sf_dir):
    """Endpoints with metadata, from events."""
    k, v = F.col("event_id"), F.col("value")
    extent = F.struct((v * num(1000)).alias("xmin"), (v * num(500)).alias("ymin"), (v * num(1000) + num(50000)).alias("xmax"), (v * num(500) + num(40000)).alias("ymax"), F.struct(F.lit(102100).alias("wkid"), F.lit(3857).alias("latestWkid")).alias("spatialReference"))
    lods = F.when(k % 6 == 0, F.struct(F.array(F.struct((v + num(4)).alias("resolution")), F.struct((v + num(5)).alias("resolution"))).alias("lods")))
    min_pixel = F.when(k % 5 == 0, F.lit(None).cast("double")).when(k % 5 == 1, num(0)).otherwise(v + num(1))
    meta = F.struct(extent.alias("fullExtent"), lods.alias("tileInfo"), min_pixel.alias("minPixelSize"), F.when(k % 4 != 0, v + num(2)).alias("pixelSizeX"), (v + num(3)).alias("meanPixelSize"))
    url = F.concat(F.lit("https://host/arcgis/rest/services/svc_"), (k % 40).cast("string"), F.lit("/ImageServer"), F.when(k % 3 == 0, "/exportImage").otherwise(""))
    return d.table(spark, sf_dir, "events").select(k.alias("pos"), url.alias("url"), F.when(k % 7 == 0, v).alias("pixel_size"), F.when(k % 2 == 0, F.array(F.lit("elevation"), F.lit("other"))).alias("kinds"), meta.alias("metadata"))


@query("service_native_pixel", f"WITH {META_SQL} SELECT pos, round(coalesce(list_min(lods), nullif(min_pixel, 0), nullif(pixel_x, 0), nullif(mean_pixel, 0)), 6) AS native FROM items")
def service_native_pixel(spark, sf_dir):
    m = F.col("metadata")
    return _items(spark, sf_dir).select("pos", r(parse.native_pixel(m["tileInfo"]["lods"], m["minPixelSize"], m["pixelSizeX"], m["meanPixelSize"])).alias("native"))


@query(
    "service_harvest",
    f"""WITH {META_SQL}, e AS (SELECT *, regexp_replace(url, '/exportImage$', '') AS base FROM items), firsts AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY base ORDER BY pos) = 1)
SELECT f.pos, replace(replace(base, 'https://', ''), '/', '__') AS key, base || '/exportImage' AS base_url, 3857 AS srs,
  round(coalesce(pixel_size, list_min(lods), nullif(min_pixel, 0), nullif(pixel_x, 0), nullif(mean_pixel, 0)), 6) AS native, CASE WHEN f.pos % 2 = 0 THEN 'elevation' ELSE 'imagery' END AS kinds,
  round({lat_sql("value * 500")}, 6) AS min_lat, round({lon_sql("value * 1000 + 50000")}, 6) AS max_lon FROM firsts f JOIN events ON event_id = f.pos""",
)
def service_harvest(spark, sf_dir):
    built = services.harvest(_items(spark, sf_dir))
    return built.select("pos", "key", "base_url", "srs", r(F.col("native_pixel_size_m")).alias("native"), F.array_join("kinds", ",").alias("kinds"), r(F.get("coverage", F.lit(0))).alias("min_lat"), r(F.get("coverage", F.lit(3))).alias("max_lon"))


# -- chunks ----------------------------------------------------------------------------------------------

CHUNKS_SQL = f"""areas AS (SELECT n_nationkey AS area, -n_nationkey * 1000.0::DOUBLE AS xmin, n_nationkey * 500.0::DOUBLE AS ymin, -n_nationkey * 1000.0::DOUBLE + 30000 + n_nationkey * 777 AS xmax, n_nationkey * 500.0::DOUBLE + 20000 + n_nationkey * 333 AS ymax, 2 * pi() * {R}::DOUBLE / (256 * pow(2, 12)) AS pixel FROM nation),
sized AS (SELECT *, greatest(1, round_even((xmax - xmin) / pixel, 0)::BIGINT) AS pw, greatest(1, round_even((ymax - ymin) / pixel, 0)::BIGINT) AS ph FROM areas),
chunks AS (SELECT area, r.r AS "row", c.c AS col, least(256, pw - c.c * 256)::INTEGER AS w, least(256, ph - r.r * 256)::INTEGER AS h, xmin + c.c * 256 * pixel AS x, ymax - r.r * 256 * pixel AS y FROM sized, LATERAL (SELECT unnest(range(CAST(ceil(ph / 256.0) AS BIGINT))) AS r) r, LATERAL (SELECT unnest(range(CAST(ceil(pw / 256.0) AS BIGINT))) AS c) c)"""


def _chunks(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    areas = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), (-k * num(1000)).alias("xmin"), (k * num(500)).alias("ymin"), (-k * num(1000) + num(30000) + k * num(777)).alias("xmax"), (k * num(500) + num(20000) + k * num(333)).alias("ymax"), geo.pixel_size(F.lit(12)).alias("pixel"))
    return chunks.chunk_grid(areas)


@query("chunk_grid", f'WITH {CHUNKS_SQL} SELECT area, "row", col, w, h, round(x, 4) AS xmin, round(y, 4) AS ymax FROM chunks')
def chunk_grid(spark, sf_dir):
    return _chunks(spark, sf_dir).select("area", "row", "col", "w", "h", r(F.col("xmin"), 4).alias("xmin"), r(F.col("ymax"), 4).alias("ymax"))


@query(
    "chunk_ledger_resume",
    f"""WITH {CHUNKS_SQL}, done AS (SELECT DISTINCT (event_id % 25)::INTEGER AS area, (event_id // 25 % 12) AS "row", (event_id // 300 % 10) AS col FROM events WHERE event_type IN ('view', 'click'))
SELECT area, "row", col FROM chunks ANTI JOIN done USING (area, "row", col)""",
)
def chunk_ledger_resume(spark, sf_dir):
    k = F.col("event_id")
    status = F.when(F.col("event_type").isin("view", "click"), "downloaded").otherwise("failed")
    ledger = d.table(spark, sf_dir, "events").select((k % 25).cast("int").alias("area"), parse.chunk_key(F.floor(k / 25) % 12, F.floor(k / 300) % 10).alias("key"), status.alias("status"), F.lit(None).cast("string").alias("file"))
    return chunks.remaining(_chunks(spark, sf_dir), ledger, keys=("area",)).select("area", "row", "col")


@query("chunk_ledger_upsert", "SELECT (event_id % 97)::VARCHAR || '_0' AS key, CASE WHEN bool_or(event_type = 'click') THEN 'downloaded' ELSE 'failed' END AS status FROM events GROUP BY 1")
def chunk_ledger_upsert(spark, sf_dir):
    news = d.table(spark, sf_dir, "events").select(F.concat((F.col("event_id") % 97).cast("string"), F.lit("_0")).alias("key"), F.when(F.col("event_type") == "click", "downloaded").otherwise("failed").alias("status"), F.lit("f").alias("file"))
    empty = news.limit(0)
    return chunks.updated(empty, news).select("key", "status")


@query("chunk_batches", 'SELECT "row", col, CAST((row_number() OVER (ORDER BY "row", col) - 1) // 100 AS BIGINT) AS batch FROM (SELECT DISTINCT 99000 + l_orderkey % 200 AS "row", 70000 + l_partkey % 150 AS col FROM lineitem)')
def chunk_batches(spark, sf_dir):
    rows = d.table(spark, sf_dir, "lineitem").select((99000 + F.col("l_orderkey") % 200).alias("row"), (70000 + F.col("l_partkey") % 150).alias("col")).distinct()
    return grid.batches(rows, 100, "row", "col")


@query("strip_plan", 'WITH k AS (SELECT n_nationkey AS id, 1 + n_nationkey * 3 AS n_rows FROM nation), s AS (SELECT id, n_rows, least(n_rows, 8) AS k, unnest(range(least(n_rows, 8))) AS i FROM k) SELECT id, i AS strip, i * (n_rows // k) + least(i, n_rows % k) AS first, (i + 1) * (n_rows // k) + least(i + 1, n_rows % k) AS past FROM s')
def strip_plan(spark, sf_dir):
    """Row bands of canvases with 1 + 3k rows for 8 workers: bands get the remainder first."""
    n = F.col("n_rows")
    rows = d.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (1 + F.col("n_nationkey") * 3).alias("n_rows"))
    banded = rows.withColumn("k", F.least(n, F.lit(8))).withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)))
    at = lambda i: (i * F.floor(n / F.col("k")) + F.least(i, (n % F.col("k")).cast("long"))).cast("long")
    return banded.select("id", "strip", at(F.col("strip")).alias("first"), at(F.col("strip") + 1).alias("past"))


# -- rasters as rows --------------------------------------------------------------------------------------


@query("elevation_mosaic_first_valid", f"WITH {d.PIXELS_SQL} SELECT y, x, arg_min(v, src_seq) FILTER (WHERE v IS NOT NULL) AS v FROM pixels GROUP BY y, x")
def elevation_mosaic_first_valid(spark, sf_dir):
    return mosaic.first_valid(d.pixels(spark, sf_dir), "y", "x")


@query("target_resolution", "SELECT min(p_size / 1000.0::DOUBLE) AS px, min((p_size + 7) / 2000.0::DOUBLE) AS py FROM part")
def target_resolution(spark, sf_dir):
    s = F.col("p_size").cast("double")
    return mosaic.target_resolution(d.table(spark, sf_dir, "part").select((s / num(1000)).alias("px"), ((s + num(7)) / num(2000)).alias("py")))


def _split_sql(axis: str) -> str:
    mid_lat = lat_sql(f"({my_sql('n')} + {my_sql('s')}) / 2")
    mid_lon = lon_sql(f"({mx_sql('w')} + {mx_sql('e')}) / 2")
    return f"""WITH {d.BOXES_SQL}, b AS (SELECT id, y1 AS n, y0 AS s, x0 AS w, x1 AS e, {axis} AS axis FROM boxes), m AS (SELECT *, {mid_lat} AS lat, {mid_lon} AS lon FROM b),
h AS (SELECT id, axis, 'a' AS half, n, CASE WHEN axis = 'horizontal' THEN lat ELSE s END AS s, w, CASE WHEN axis = 'horizontal' THEN e ELSE lon END AS e FROM m
UNION ALL SELECT id, axis, 'b', CASE WHEN axis = 'horizontal' THEN lat ELSE n END, s, CASE WHEN axis = 'horizontal' THEN w ELSE lon END, e FROM m)
SELECT id, axis, half, round(n, 9) AS north, round(s, 9) AS south, round(w, 9) AS west, round(e, 9) AS east FROM h"""


def _split(spark, sf_dir, axis: Column) -> DataFrame:
    boxes = d.boxes(spark, sf_dir).withColumn("bounds", geo.box_bounds(F.col("y1"), F.col("y0"), F.col("x0"), F.col("x1"))).withColumn("axis", axis)
    cut = boxes.select("id", "axis", F.explode(geo.halves(F.col("bounds"), F.col("axis"))).alias("h"))
    b = F.col("h.bounds")
    return cut.select("id", "axis", "h.half", r(b["northWest"]["lat"], 9).alias("north"), r(b["southWest"]["lat"], 9).alias("south"), r(b["northWest"]["lon"], 9).alias("west"), r(b["northEast"]["lon"], 9).alias("east"))


for _axis in ("vertical", "horizontal"):
    query(f"split_bounds_{_axis}", _split_sql(f"'{_axis}'"))(lambda spark, sf_dir, axis=_axis: _split(spark, sf_dir, F.lit(axis)))


@query("split_bounds_auto", _split_sql("CASE WHEN y1 - y0 > x1 - x0 THEN 'horizontal' ELSE 'vertical' END"))
def split_bounds_auto(spark, sf_dir):
    return _split(spark, sf_dir, geo.split_axis(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


@query("split_pixels", "SELECT p_partkey AS id, CAST((p_size * 7 + 1) // 2 AS INTEGER) AS a, CAST(p_size * 7 + 1 - (p_size * 7 + 1) // 2 AS INTEGER) AS b FROM part")
def split_pixels(spark, sf_dir):
    halves = geo.half_pixels(F.col("p_size") * 7 + 1)
    return d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), halves["a"].alias("a"), halves["b"].cast("int").alias("b"))


# -- manifests and catalogues --------------------------------------------------------------------------------


def _manifest_entries(spark, sf_dir) -> DataFrame:
    bounds = windows.window_bounds(WORLD / 2**d.LEVEL)
    plan = windows.windows(placed_tiles(spark, sf_dir), 4)
    return plan.select((F.col("origin_r") * 100000 + F.col("origin_c")).alias("pos"), windows.output_name().alias("name"), bounds.alias("bounds"))


_MANIFEST_SQL = f"""{GATHER_SQL}, w AS (SELECT 'gathered_r' || origin_r || '_c' || origin_c AS name, origin_r * 100000 + origin_c AS o, -{O}::DOUBLE + min(col) * {SPAN} AS w, {O}::DOUBLE - min("row") * {SPAN} AS n,
  -{O}::DOUBLE + (max(col) + 1) * {SPAN} AS e FROM keyed GROUP BY origin_r, origin_c)"""


def _written_manifest(spark, sf_dir) -> DataFrame:
    doc = manifest.to_manifest(_manifest_entries(spark, sf_dir))
    return doc.select(F.from_json("value", manifest.MANIFEST).alias("m")).select("m.*")


@query("manifest_inline", f"{_MANIFEST_SQL} SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS pos, name, round({lat_sql('n')}, 9) AS north, round({lon_sql('w')}, 9) AS west FROM w")
def manifest_inline(spark, sf_dir):
    b = F.col("bounds")
    return manifest.images(_written_manifest(spark, sf_dir)).select("pos", "name", r(b["northWest"]["lat"], 9).alias("north"), r(b["northWest"]["lon"], 9).alias("west"))


@query(
    "manifest_split_merge",
    f"""{_MANIFEST_SQL}, p AS (SELECT row_number() OVER (ORDER BY o) - 1 AS pos, * FROM w), parts AS (
SELECT pos, name, w, e FROM p WHERE pos % 3 <> 0
UNION ALL SELECT pos, name || '_a', w, (w + e) / 2 FROM p WHERE pos % 3 = 0 UNION ALL SELECT pos, name || '_b', (w + e) / 2, e FROM p WHERE pos % 3 = 0)
SELECT CAST(pos AS INTEGER) AS pos, name, round({lon_sql('w')}, 9) AS west, round({lon_sql('e')}, 9) AS east FROM parts""",
)
def manifest_split_merge(spark, sf_dir):
    entries = manifest.images(_written_manifest(spark, sf_dir))
    cut = entries.where("pos % 3 = 0").select("name", F.explode(geo.halves(F.col("bounds"), F.lit("vertical"))).alias("h")).select("name", "h.half", "h.bounds")
    b = F.col("bounds")
    return manifest.merge_splits(entries, cut).select("pos.pos", "name", r(b["northWest"]["lon"], 9).alias("west"), r(b["northEast"]["lon"], 9).alias("east"))


_CORNERS = ("NW", "NE", "SE", "SW")


@query(
    "metadata_corners",
    "SELECT o_orderkey AS id, "
    + ", ".join(f"CASE WHEN (o_orderkey + {i}) % 9 <> 0 THEN (o_orderkey % 80 + {i})::DOUBLE / 2 END AS {c.lower()}_lat, (o_orderkey % 170 - {i})::DOUBLE AS {c.lower()}_lon" for i, c in enumerate(_CORNERS))
    + ", " + " AND ".join(f"(o_orderkey + {i}) % 9 <> 0" for i in range(4)) + " AS valid FROM orders",
)
def metadata_corners(spark, sf_dir):
    k = F.col("o_orderkey")
    field = lambda name, value: F.struct(F.lit(name).alias("fieldName"), value.cast("string").alias("value"))
    fields = [field("Entity ID", k)]
    for i, c in enumerate(_CORNERS):
        fields.append(field(f"{c} Corner Lat dec", F.when((k + i) % 9 != 0, (k % 80 + i).cast("double") / num(2))))
        fields.append(field(f"{c} Corner Long dec", (k % 170 - i).cast("double")))
    scenes = d.table(spark, sf_dir, "orders").select(k.alias("id"), F.array(*fields).alias("metadata"))
    found = {n: c for n, c in parse.corner_fields(F.col("metadata")).items() if not n.startswith("center")}
    flat = scenes.select("id", *(c.alias(n) for n, c in found.items()))
    whole = F.lit(True)
    for n in found:
        whole = whole & F.col(n).isNotNull()
    return flat.withColumn("valid", whole)


@query(
    "page_metadata_scrape",
    r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'en' AS lang, (page_id * 3)::VARCHAR AS entity FROM pages""",
)
def page_metadata_scrape(spark, sf_dir):
    table = F.concat(F.lit('<div id="pageContentLayoutContainer"><table><tbody><tr><td>Entity <b>ID</b></td><td>'), (F.col("page_id") * 3).cast("string"), F.lit("</td></tr><tr><td>Language</td><td> en </td></tr></tbody></table></div>"))
    pages = d.table(spark, sf_dir, "pages").select("page_id", "html", F.concat("html", table).alias("with_table"))
    scraped = scan.scrape_metadata(pages, "with_table")
    return scraped.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), scan.scraped_value("fields", "Language").alias("lang"), scan.scraped_value("fields", "Entity").alias("entity"))


@query("known_file_lookup", "WITH k AS (SELECT 'project_' || p_size AS project, 's' || p_partkey AS file FROM part) SELECT l_orderkey AS id, l_linenumber AS line, project FROM lineitem JOIN k ON file = 's' || l_partkey")
def known_file_lookup(spark, sf_dir):
    lines = d.table(spark, sf_dir, "part").select(F.concat(F.lit("project_"), F.col("p_size").cast("string")).alias("project"), F.concat(F.lit("vol"), F.col("p_size").cast("string"), F.lit("/s"), F.col("p_partkey").cast("string")).alias("value"))
    known = lines.select("project", parse.basename(F.col("value")).alias("file"))
    wanted = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("file"))
    return wanted.join(known, "file").select("id", "line", "project")


@query("aoi_documents", f"WITH {d.AOIS_SQL} SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN id % 3 = 2 THEN 10.0::DOUBLE ELSE miles END AS miles FROM aois")
def aoi_documents(spark, sf_dir):
    """Shape documents written and read back: with view_distance, with the older range, with neither."""
    k = F.col("id")
    center = F.struct(F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"))
    doc = F.to_json(F.struct(F.lit("POINT").alias("boundsType"), center.alias("center"), F.when(k % 3 == 0, F.col("miles")).alias("view_distance"), F.when(k % 3 == 1, F.col("miles")).alias("range")))
    parsed = d.aois(spark, sf_dir).select("id", F.from_json(doc, manifest.SHAPE).alias("s")).select("id", "s.*")
    columns = manifest.shape_columns()
    return parsed.select("id", r(columns["lat"]).alias("lat"), r(columns["lon"]).alias("lon"), columns["miles"].alias("miles"))


# -- images and streams: checked by tests -----------------------------------------------------------------------


def painted(spark: SparkSession, n: int = 4, pixels: int = 16) -> DataFrame:
    """An n x n grid of single-colored PNG tiles: ``r, c, path, content``."""

    def paint(frames):
        for frame in frames:
            out = []
            for k in frame["id"]:
                row, col = int(k) // n, int(k) % n
                tile = np.full((pixels, pixels, 3), (row * 50, col * 50, 100), np.uint8)
                out.append((row, col, f"tile_{row}_{col}.png", raster.encode_png(tile)))
            yield pd.DataFrame(out, columns=["r", "c", "path", "content"])

    return spark.range(n * n).mapInPandas(paint, "r long, c long, path string, content binary")


@query("image_composite")
def image_composite(spark, sf_dir):
    made = raster.composite(painted(spark), 2)
    images = raster.read_images(made.withColumn("path", windows.output_name()))
    return images.select("path", "height", "width", "channels", F.sha2("data", 256).alias("sha256"))


@query("image_resize")
def image_resize(spark, sf_dir):
    made = raster.composite(painted(spark), 4, 0.5)
    images = raster.read_images(made.withColumn("path", windows.output_name()))
    return images.select("path", "height", "width", "channels")


@query("image_split")
def image_split(spark, sf_dir):
    return raster.split_images(painted(spark).withColumnRenamed("path", "name")).select("name", "half", "width", "height")


@query("png_roundtrip")
def png_roundtrip(spark, sf_dir):
    return raster.read_images(painted(spark)).select("path", "r", "c", "height", "width", F.hex(F.substring("data", 1, 3)).alias("first_pixel"))


@query("chunk_stream_available_now")
def chunk_stream_available_now(spark, sf_dir):
    """Status rows as a stream, drained twice: the second run adds nothing."""
    events = d.table(spark, sf_dir, "events").select(F.concat((F.col("event_id") % 97).cast("string"), F.lit("_0")).alias("key"), F.when(F.col("event_type") == "click", "downloaded").otherwise("failed").alias("status"), F.lit("f").alias("file"))
    base = claim(spark, "stream")
    events.repartition(4).write.parquet(f"{base}/in")
    for _ in range(2):
        ingest_rows(spark, "key string, status string, file string", f"{base}/in", f"{base}/ledger", f"{base}/checkpoint", 2).awaitTermination()
    return current_ledger(spark, f"{base}/ledger").select("key", "status")


from gridloom.plans import roundtrips  # noqa: E402, F401  registers its queries here
