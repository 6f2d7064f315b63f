"""Free-form tiles on a grid: one-dimensional clusters of centers, placement, neighbours.

The gaps are a global order statistic.  They are taken over the distinct coordinates, which a
map-side aggregation has reduced, and by ranges (see ``ordering``), so no task sorts them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import edges, num
from gridloom.operators import ordering

TOUCH = 1e-3  # of a tile's width or height


def _counted(values: DataFrame, value: str) -> ordering.Ordered:
    """Ordered distinct values with ``n`` and their ``gap`` to the one before."""
    counted = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    return ordering.ordered(counted, "v").previous("v", "before").with_column("gap", F.col("v") - F.col("before"))


def _tolerance(counted: DataFrame) -> DataFrame:
    least = counted.agg(F.min("gap").alias("gap"), F.max("n").alias("repeats"), F.sum("n").alias("n"))
    half = F.when(F.col("repeats") > 1, num(0)).otherwise(F.col("gap") * num(0.5))
    return least.select(F.when(F.coalesce("n", F.lit(0)) < 2, num(1)).otherwise(F.greatest(half, num(1e-9))).alias("tol"))


def tolerance(values: DataFrame, value: str = "v") -> DataFrame:
    """One row ``tol``: half the least gap between neighbours in order, at least 1e-9; 1.0 for fewer than two values.

    A value that repeats has gap zero.  So a repeat anywhere gives 1e-9, and else the gaps of
    distinct values decide.
    """
    return _tolerance(_counted(values, value).rows())


def clusters(values: DataFrame, value: str = "v") -> DataFrame:
    """``idx, center, n``: runs of values whose gaps are at most the tolerance, in ascending order, with their means."""
    counted = _counted(values, value)
    tol = _tolerance(counted.rows()).first()["tol"]
    indexed = counted.with_column("opens", F.when(F.col("gap") > num(tol), 1).otherwise(0)).running_sum("opens", "idx").rows()
    return indexed.groupBy("idx").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("center"), F.sum("n").alias("n"))


def nearest(values: DataFrame, centers: DataFrame, value: str, out: str) -> DataFrame:
    """Each distinct value's nearest center (``idx, center``), ties to the lower index: ``value, out``.

    Centers in order split the axis at their midpoints, so the nearest one is found by a merge
    of values and midpoints in order, not by comparing all pairs.
    """
    starts = ordering.ordered(centers.select("center", F.col("idx").cast("long").alias("idx")), "center").previous("center", "below").rows()
    # a value up to and including the midpoint below belongs to the center before it
    marks = starts.select(F.coalesce((F.col("center") + F.col("below")) / num(2), num(float("-inf"))).alias("at"), F.lit(1).alias("kind"), "idx")
    points = values.select(F.col(value).alias("at")).distinct().select("at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("idx"))
    # indices rise with the centers, so the last one met is the largest
    found = ordering.ordered(marks.unionByName(points), "at", "kind").running_max("idx", "found").rows()
    return found.where("kind = 0").select(F.col("at").alias(value), F.col("found").alias(out))


def place(tiles: DataFrame, lat: str = "center_lat", lon: str = "center_lon") -> DataFrame:
    """Tiles with ``r`` (from the north) and ``c`` (from the west), the ranks of their clusters."""
    lat_clusters, lon_clusters = clusters(tiles, lat), clusters(tiles, lon)
    rows = nearest(tiles, lat_clusters, lat, "__y")
    cols = nearest(tiles, lon_clusters, lon, "c")
    top = lat_clusters.agg(F.max("idx").alias("__top"))
    placed = tiles.join(rows, lat).join(cols, lon).join(F.broadcast(top))
    return placed.withColumn("r", F.col("__top") - F.col("__y")).drop("__y", "__top")


def cells(placed: DataFrame, position: str = "pos") -> DataFrame:
    """One tile a cell: of several the last by ``position``."""
    rest = [c for c in placed.columns if c not in ("r", "c")]
    return placed.groupBy("r", "c").agg(F.max_by(F.struct(*rest), F.col(position)).alias("t")).select("r", "c", "t.*")


def neighbours(grid: DataFrame, bounds: str = "bounds") -> DataFrame:
    """Warnings for neighbours that don't touch or align: ``side, name, other, gap, gap_wide, misaligned``.

    Each tile meets its east and south neighbour by two equi-joins on shifted cells; the
    tolerance is a thousandth of the first tile's width or height.
    """
    e = edges(F.col(bounds))
    flat = grid.select("r", "c", "name", *(v.alias(k) for k, v in e.items()))
    out = None
    for side, dr, dc in (("EAST", 0, 1), ("SOUTH", 1, 0)):
        other = flat.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("name").alias("other"), *(F.col(k).alias(f"o_{k}") for k in e))
        pair = flat.join(other, ["r", "c"])
        wide, tall = num(TOUCH) * F.abs(F.col("east") - F.col("west")), num(TOUCH) * F.abs(F.col("north") - F.col("south"))
        if side == "EAST":
            gap, tol = F.abs(F.col("east") - F.col("o_west")), wide
            off = (F.abs(F.col("north") - F.col("o_north")) > tall) | (F.abs(F.col("south") - F.col("o_south")) > tall)
        else:
            gap, tol = F.abs(F.col("south") - F.col("o_north")), tall
            off = (F.abs(F.col("west") - F.col("o_west")) > wide) | (F.abs(F.col("east") - F.col("o_east")) > wide)
        part = pair.select(F.lit(side).alias("side"), "name", "other", gap.alias("gap"), (gap > tol).alias("gap_wide"), off.alias("misaligned"))
        out = part if out is None else out.unionByName(part)
    return out.where("gap_wide OR misaligned")


def batches(rows: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """``batch``: number of the row in the given order, over ``size``."""
    numbered = ordering.ordered(rows, *order).numbered("__n").rows()
    return numbered.withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")
