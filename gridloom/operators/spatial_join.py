"""Range joins of boxes as equi-joins on grid cells.

A bare overlap predicate plans as a nested-loop join over all pairs.  Here each box goes to
the cells it lies in, boxes meet in equal cells, and a pair counts only in the cell that holds
the lower-left corner of its common part, so no pair is made twice and no distinct is needed.

Cells of the lowest level are twice as large as the median box.  A larger box lives on a level
whose cells are at least its size, so any box lies in four cells at most; smaller boxes visit it
there, on each level that has boxes.  AQE splits cells that hold very many.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import area
from gridloom.functions.predicates import Box, overlap_ratio, overlaps_closed
from gridloom.operators.components import components

AXES = ("x0", "y0", "x1", "y1")


def cell_size(*boxes: DataFrame) -> float:
    """Twice the median extent of the boxes: one small aggregation."""
    sizes = [b.agg(F.percentile_approx(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), 0.5, 200)).first()[0] for b in boxes]
    return 2 * max([s for s in sizes if s] or [0.5])


def _cell(value: Column, size: Column) -> Column:
    return F.floor(value / size).cast("long")


def _size(size: float, level: Column) -> Column:
    return F.lit(float(size)) * F.pow(F.lit(2.0), level)


def _own_level(size: float) -> Column:
    """The level of a box by its larger extent: cells there are no smaller."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(float(size))) / F.lit(float(size)))), F.lit(0)).cast("int")


def _celled(boxes: DataFrame, size: float, prefix: str, levels: Column) -> DataFrame:
    """A row for each cell of the box on each of the levels."""
    named = boxes.select("own_level", *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c != "own_level"))
    on_level = named.withColumn("level", F.explode(levels)).drop("own_level")
    edge = lambda k: _cell(F.col(f"{prefix}{k}"), _size(size, F.col("level")))
    return on_level.withColumn("cell_x", F.explode(F.sequence(edge("x0"), edge("x1")))).withColumn("cell_y", F.explode(F.sequence(edge("y0"), edge("y1"))))


def overlap_join(left: DataFrame, right: DataFrame, predicate: Callable[[Box, Box], Column], size: float | None = None) -> DataFrame:
    """Pairs of rows with ``x0, y0, x1, y1`` that touch and fulfil ``predicate``; columns get ``l_`` and ``r_``.

    Rows with a null coordinate, or with a lower edge above the upper one, pair with none.
    """
    proper = lambda df: df.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    left, right = proper(left), proper(right)
    size = size or cell_size(left, right)
    left, right = (df.withColumn("own_level", _own_level(size)) for df in (left, right))
    present = sorted({r[0] for df in (left, right) for r in df.select("own_level").distinct().collect()})
    a, b = ({k: F.col(f"{p}{k}") for k in AXES} for p in ("l_", "r_"))
    home = F.array("own_level")
    above = lambda strict: F.filter(F.array(*map(F.lit, present)), lambda m: m > F.col("own_level") if strict else m >= F.col("own_level"))

    def met(l_levels: Column, r_levels: Column) -> DataFrame:
        pairs = _celled(left, size, "l_", l_levels).join(_celled(right, size, "r_", r_levels), ["level", "cell_x", "cell_y"])
        cell = lambda k: _cell(F.greatest(a[k], b[k]), _size(size, F.col("level")))
        own = (F.col("cell_x") == cell("x0")) & (F.col("cell_y") == cell("y0"))
        return pairs.where(overlaps_closed(a, b) & own & predicate(a, b)).drop("level", "cell_x", "cell_y")

    if len(present) < 2:
        return met(home, home)
    # the box of the higher level is at home; boxes of equal levels meet in the first part
    return met(home, above(False)).unionByName(met(above(True), home))


def overlap_pairs(boxes: DataFrame, threshold: float = 0.3, size: float | None = None) -> DataFrame:
    """``i, j, ratio`` of the pairs i < j (of ``id``) whose shared area is ``threshold`` or more of the smaller box's.

    Boxes without area take no part.
    """
    boxes = boxes.select("id", *AXES)
    ratio = lambda a, b: overlap_ratio(a, b) >= F.lit(float(threshold))
    pairs = overlap_join(boxes, boxes, lambda a, b: (F.col("l_id") < F.col("r_id")) & ratio(a, b), size)
    a, b = ({k: F.col(f"{p}{k}") for k in AXES} for p in ("l_", "r_"))
    return pairs.select(F.col("l_id").alias("i"), F.col("r_id").alias("j"), overlap_ratio(a, b).alias("ratio"))


def touching_pairs(boxes: DataFrame, size: float | None = None) -> DataFrame:
    """``i, j`` of the pairs i < j that overlap or touch."""
    boxes = boxes.select("id", *AXES)
    pairs = overlap_join(boxes, boxes, lambda a, b: F.col("l_id") < F.col("r_id"), size)
    return pairs.select(F.col("l_id").alias("i"), F.col("r_id").alias("j"))


def refuse_overlaps(boxes: DataFrame, names: str = "name", threshold: float = 0.05, shown: int = 20) -> None:
    """RuntimeError that names pairs of boxes which overlap by ``threshold`` or more."""
    pairs = overlap_pairs(boxes, threshold)
    by = boxes.select(F.col("id"), F.col(names).alias("n"))
    found = pairs.join(by.withColumnsRenamed({"id": "i", "n": "a"}), "i").join(by.withColumnsRenamed({"id": "j", "n": "b"}), "j").orderBy(F.desc("ratio"), "i", "j").limit(shown).collect()
    if found:
        raise RuntimeError("overlapping tiles: " + "; ".join(f'"{r["a"]}" & "{r["b"]}" (ratio {r["ratio"]:.2f})' for r in found))


def _connecting(boxes: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], takes_part: Column) -> DataFrame:
    """``i, j`` that connect what ``pairs_of(boxes)`` connects: of equal boxes the smallest id meets others, and the rest hang on it.

    So n copies of a box make n - 1 pairs.  Boxes that fulfil ``takes_part`` must pair with their equals.
    """
    equal = boxes.where(takes_part).select("id", *AXES)
    firsts = equal.groupBy(*AXES).agg(F.min("id").alias("id"), F.max("id").alias("__last"))
    crowded = firsts.where(F.col("__last") > F.col("id")).select(*AXES, F.col("id").alias("i"))
    hanging = equal.join(crowded, [*AXES]).where(F.col("id") > F.col("i")).select("i", F.col("id").alias("j"))
    return pairs_of(firsts.select("id", *AXES)).select("i", "j").unionByName(hanging)


def overlap_groups(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``id, group`` of boxes that share ``threshold`` or more of the smaller one's area, over any number of steps."""
    solid = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & F.lit(threshold <= 1)
    return groups(boxes, _connecting(boxes, lambda b: overlap_pairs(b, threshold), solid))


def touching_groups(boxes: DataFrame) -> DataFrame:
    """``id, group`` of boxes that overlap or touch, over any number of steps."""
    proper = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    return groups(boxes, _connecting(boxes, touching_pairs, proper))


def groups(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, group``: the smallest id reachable over ``pairs``; boxes without a pair are groups of their own."""
    linked = components(pairs.select(F.col("i").cast("long").alias("u"), F.col("j").cast("long").alias("v")))
    return boxes.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", F.col("id").cast("long")).alias("group"))


def representatives(boxes: DataFrame, grouped: DataFrame, criteria: str = "min_index") -> DataFrame:
    """``group, id``: of each group the smallest id, or the first of the largest boxes."""
    if criteria == "min_index":
        return grouped.groupBy("group").agg(F.min("id").alias("id"))
    if criteria == "max_area":
        sized = grouped.join(boxes, "id").withColumn("size", area(*(F.col(k) for k in AXES)))
        return sized.groupBy("group").agg(F.max_by("id", F.struct(F.col("size"), -F.col("id"))).alias("id"))
    raise ValueError(f"unknown criteria: {criteria}")
