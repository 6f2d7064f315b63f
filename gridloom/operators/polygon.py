"""Overlap of convex quadrilaterals that needn't be axis-aligned, such as scene footprints.

Candidates come from the binned join of their envelopes, without those whose envelopes already
share too little; the shared area is the shoelace area of one ring clipped by the other's edges,
for all pairs of an Arrow batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.predicates import Box
from gridloom.operators.spatial_join import AXES, overlap_join
from gridloom.staging import stage

#: Relative error of areas that a candidate is allowed.
SLACK = 1e-6


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of ``lat, lon`` points, about its first one: small rings far from the origin keep their digits."""
    n = F.size(ring) - 1
    lon, lat = (lambda i, k=k: F.get(ring, i)[k] - F.get(ring, F.lit(0))[k] for k in ("lon", "lat"))
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: lon(i) * lat(i + 1) - lon(i + 1) * lat(i))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def _areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shoelace areas of (m, n) vertices of n polygons, as ``ring_area``."""
    x, y = x - x[0], y - y[0]
    return np.abs((x * np.roll(y, -1, axis=0)).sum(axis=0) - (y * np.roll(x, -1, axis=0)).sum(axis=0)) / 2


def _cut(x: np.ndarray, y: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of n polygons, (m, n) vertices, cut by the half-plane left of its own edge.

    Polygons with fewer vertices than others repeat their first one, which changes no area; empty ones are NaN.
    """
    edge = end - start
    side = edge[0] * (y - start[1]) - edge[1] * (x - start[0])
    after = np.roll(side, -1, axis=0)
    inside, crossed = side >= 0, side * after < 0
    place = inside.cumsum(axis=0) + crossed.cumsum(axis=0)  # of what follows a vertex and its crossing
    i, j = np.nonzero(inside)
    ci, cj = np.nonzero(crossed)
    at, c_at = (place - crossed - 1)[i, j], (place - 1)[ci, cj]
    share, c_after = side[ci, cj], (ci + 1) % len(x)
    span = share - side[c_after, cj]
    out = []
    for k, v in enumerate((x, y)):
        p = v[ci, cj]
        met = p + (v[c_after, cj] - p) * share / span
        met = np.where(edge[k, cj] == 0, start[k, cj], met)  # exactly on an edge that runs along the other axis
        made = np.full((int(place.max(initial=1)), v.shape[1]), np.nan)
        made[at, j] = v[i, j]
        made[c_at, cj] = met
        out.append(np.where(np.arange(len(made))[:, None] < place[-1], made, made[0]))
    return out[0], out[1]


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n pairs of convex polygons, (n, m, 2) vertices in order: each of ``a`` cut by each edge's half-plane of its ``b``."""
    (x, y), b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    clockwise = (b[0] * np.roll(b[1], -1, axis=0)).sum(axis=0) < (b[1] * np.roll(b[0], -1, axis=0)).sum(axis=0)
    b = np.where(clockwise, b[:, ::-1], b)
    for i in range(b.shape[1]):
        x, y = _cut(x, y, b[:, i], b[:, (i + 1) % b.shape[1]])
    areas = _areas(x, y)
    return np.where(np.isnan(areas), 0.0, areas)


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Of one pair."""
    return float(shared_areas(a[None], b[None])[0])


def _vertices(quads: pa.ListArray) -> np.ndarray:
    """(n, 4, 2); missing coordinates are NaN."""
    return quads.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 4, 2)


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    p, q = _vertices(a), _vertices(b)
    smaller = np.minimum(_areas(*p.T), _areas(*q.T))
    solid = smaller > 0
    return pa.array(np.where(solid, shared_areas(p, q) / np.where(solid, smaller, 1), np.nan), from_pandas=True)


def quad_pairs(quads: DataFrame, threshold: float = 0.3, size: float | None = None) -> DataFrame:
    """``i, j, ratio`` of footprints (``id, ring`` of four ``lat, lon`` points, closed or not) that share ``threshold`` or more of the smaller one."""
    # plain expressions of four points: lambdas would build the ring anew for each value; three points repeat the first one
    points = [F.when(F.size("ring") > i, F.get("ring", F.lit(i))).otherwise(F.get("ring", F.lit(0))) for i in range(4)]
    lon, lat = [p["lon"] for p in points], [p["lat"] for p in points]
    dx, dy = [v - lon[0] for v in lon], [v - lat[0] for v in lat]
    shoelace = dx[1] * dy[2] - dx[2] * dy[1] + dx[2] * dy[3] - dx[3] * dy[2]  # terms with the first point are zero
    envelope = {"x0": F.least(*lon), "y0": F.least(*lat), "x1": F.greatest(*lon), "y1": F.greatest(*lat)}
    flat = F.array(*(v for p in zip(lon, lat, strict=True) for v in p))
    boxes = stage(quads.select("id", flat.alias("quad"), (F.abs(shoelace) / 2).alias("size"), *(envelope[k].alias(k) for k in AXES)), "quads")
    least = F.least("l_size", "r_size") * F.lit(float(threshold) * (1 - SLACK))

    def candidate(a: Box, b: Box) -> Column:
        shared = (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * (F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        return (F.col("l_id") < F.col("r_id")) & (shared >= least)

    # small tables of many pairs: a broadcast would leave them all to the tasks that read one file
    near = overlap_join(boxes.hint("merge"), boxes, candidate, size)
    return near.select(F.col("l_id").alias("i"), F.col("r_id").alias("j"), F.arrow_udf(_ratios, "double")("l_quad", "r_quad").alias("ratio")).where(F.col("ratio") >= threshold)
