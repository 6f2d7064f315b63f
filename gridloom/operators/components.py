"""Connected components of an edge table by alternating large and small stars.

Every round is two joins-and-aggregations over the edges, staged in the shared folder, so a
lost executor costs a re-read.  Minima are combined before the shuffle; the joins put one row
per node against the edges, which AQE splits where a node has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.staging import discard, stage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on ``u, v`` (u > v): every neighbour is linked to the smallest one."""
    if small:
        pairs = edges
    else:
        pairs = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if small:
        linked = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``u``, ``v`` long); no row for others."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(ordered, "edges")
    before = None
    for _ in range(rounds):
        last, edges = edges, stage(_star(_star(edges, small=False), small=True), "stars")
        discard(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
