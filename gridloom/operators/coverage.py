"""Whether boxes cover an area without gaps: intervals, then strips of a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals_cover(intervals: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """``keys, covered``: for each target (``keys, lo, hi``), do its ``lo, hi`` intervals cover it?

    Intervals are clipped to the target and empty ones dropped; sorted, none may start beyond
    what the earlier ones reach, and the last reach is the target's end.
    """
    aims = targets.select(*keys, F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    clipped = intervals.join(aims, list(keys)).select(*keys, "t_lo", "t_hi", F.greatest("lo", "t_lo").alias("lo"), F.least("hi", "t_hi").alias("hi")).where("lo < hi")
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = clipped.withColumn("reach", F.coalesce(F.greatest(F.max("hi").over(before), F.col("t_lo")), F.col("t_lo")))
    ok = reach.groupBy(*keys).agg((F.every(F.col("lo") <= F.col("reach")) & (F.max("hi") >= F.max("t_hi"))).alias("covered"))
    return aims.select(*keys).join(ok, list(keys), "left").select(*keys, F.coalesce("covered", F.lit(False)).alias("covered"))


def areas_covered(boxes: DataFrame, targets: DataFrame, *keys: str) -> DataFrame:
    """``keys, covered``: for each target box (``keys, x0, y0, x1, y1``), do its boxes cover it?

    The target is cut at every y edge within it; at the middle of each strip, the boxes that
    reach it must cover the strip's x interval.
    """
    aims = targets.select(*keys, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    mine = boxes.join(aims, list(keys))
    cuts = mine.select(*keys, "t_y0", "t_y1", F.explode(F.array("y0", "y1")).alias("y")).where("y > t_y0 AND y < t_y1").select(*keys, "y")
    ends = aims.select(*keys, F.explode(F.array("t_y0", "t_y1")).alias("y"))
    breaks = cuts.unionByName(ends).distinct()
    strips = breaks.withColumn("up", F.lead("y").over(Window.partitionBy(*keys).orderBy("y"))).where("up IS NOT NULL").select(*keys, ((F.col("y") + F.col("up")) / 2).alias("mid"))
    reaching = strips.join(mine.select(*keys, "x0", "y0", "x1", "y1"), list(keys)).where("y0 <= mid AND y1 >= mid")
    flat = intervals_cover(reaching.select(*keys, "mid", F.col("x0").alias("lo"), F.col("x1").alias("hi")), strips.join(aims, list(keys)).select(*keys, "mid", F.col("t_x0").alias("lo"), F.col("t_x1").alias("hi")), *keys, "mid")
    summed = flat.groupBy(*keys).agg(F.every("covered").alias("covered"))
    return aims.select(*keys).join(summed, list(keys), "left").select(*keys, F.coalesce("covered", F.lit(True)).alias("covered"))
