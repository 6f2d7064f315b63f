"""What the two text classifiers share: folds, a bounded sample of labelled rows, sums of count blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.staging import stage


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def lowest_hashes(rows: DataFrame, most: int, total: int, *columns: Column | str) -> DataFrame:
    """The ``most`` rows (about) of lowest hash among ``total``.

    A bound on the hash leaves about twice as many before they are sorted, so what meets in one
    task does not grow with the input.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    if total > 2 * most:
        rows = rows.where(place < int(2 * most / total * (1 << 40)))
    return rows.orderBy(place, *(c for c in columns if isinstance(c, str))).limit(most)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, name: str) -> tuple[DataFrame, int, int]:
    """(``doc_id, text, y``, ids of class 0, ids of class 1): staged training documents and the labels' totals.

    At most ``per_class`` ids of each class are taken, by the lowest hash, among the documents'
    own ids of the folds that may be learned from; an id with both labels counts as 1.  The sampled
    ids, ``2 * per_class`` at most, are broadcast, so texts are filtered in the scan's stage.  An id with
    several rows is in the sample once, with its text of the lowest hash, so that the sample is
    bounded in rows too; of such ids alone, hashes are compared before any text is shuffled.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("here", F.lit(True))
    known = stage(known.join(own, "doc_id", "left"), f"{name}-labels")
    totals = known.agg(*(F.count_if(F.col("y") == y) for y in (0, 1)), *(F.count_if((F.col("y") == y) & F.col("here")) for y in (0, 1))).first()
    known = known.where("here").select("doc_id", "y")
    parts = [lowest_hashes(known.where(F.col("y") == y), per_class, totals[2 + y], F.lit(name), "doc_id") for y in (0, 1)]
    ids = stage(parts[0].unionByName(parts[1]).coalesce(1), f"{name}-ids")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64(F.col("text").isNull(), "text"))
    found = rows.join(F.broadcast(ids), "doc_id")
    often = stage(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("__h").alias("first")).where("n > 1"), f"{name}-repeats")
    if often.isEmpty():
        sample = found
    else:
        # as many ids as the sample has at most, so a broadcast as well
        told = found.join(F.broadcast(often), "doc_id", "left")
        several = told.where("n IS NOT NULL AND __h = first").groupBy("doc_id", "y").agg(F.first("text").alias("text"))
        sample = told.where("n IS NULL").select("doc_id", "text", "y").unionByName(several.select("doc_id", "text", "y"))
    return stage(sample.select("doc_id", "text", "y"), f"{name}-sample"), totals[0], totals[1]


_BLOCK = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def emit_blocks(table: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """A task's table of counts as rows of ``width`` int64 numbers; empty ones are left out."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % 64
    rows = table.astype(np.int64).reshape(-1, width)
    full = np.flatnonzero(rows.any(axis=1))
    for i in range(0, len(full), 64):
        part = full[i : i + 64]
        columns = [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), salt, np.int32)), pa.array([rows[j].tobytes() for j in part], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            row = np.frombuffer(counts, np.int64)
            if block in sums:
                sums[block] += row
            else:
                sums[block] = row.copy()
    if sums:
        columns = [pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_BLOCK)


def sum_blocks(blocks: DataFrame, size: int, width: int) -> np.ndarray:
    """The sum of all tasks' tables: ``size`` whole numbers, whatever the input's size.

    Tasks' rows are summed as they stream by, first within 64 groups of tasks and then over
    the groups; a task holds the blocks dealt to it and no more.
    """
    kind = "block int, salt int, counts binary"
    once = blocks.repartition("block", "salt").mapInArrow(_summed, kind)
    twice = once.repartition("block").mapInArrow(_summed, kind)
    out = np.zeros(size, np.int64).reshape(-1, width)
    for r in twice.toLocalIterator():
        out[r["block"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()
