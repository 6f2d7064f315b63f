"""Exact top-k inner-product search with vector-approximation files.

1. Vectors become integers, floor(256 * x), staged with a number for each row: the exact file.
2. One aggregation gives each dimension's extremes, between which lie 256 equal cells.  The
   approximation file has one byte a component, its cell, in blocks of ``CANDIDATE_ROWS``.
3. Each query block meets each block of cells in one row of an equi-join: the stated query set
   against all rows, in blocks.  One product of query and cells gives the middle of every score's
   range; the range's half width depends on the query alone.  A meeting passes on the candidates
   whose upper bound reaches its kth best lower bound.
4. Over all meetings, those stay whose upper bound reaches the query's kth best lower bound.
   Only their exact vectors are read, by a join on the row's number, and scored in the order of
   their bounds until the kth best score is above the next bound: the result is exact.

Of rows with equal vectors in one block of cells, only those that any query's k best can hold go
on: k rows of each of the k + 1 smallest ids, since ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id; shorter vectors count as padded with zeros; rows with the query's own id
are not its candidates, other repeated rows are candidates of their own; of repeated query rows
each has its own k results; ties go to the smaller id; an empty table, or one without queries,
gives an empty result; other columns are ignored.  Scores beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.staging import stage

SCALE = 256
CELLS = 256  # per dimension: one byte
CANDIDATE_ROWS = 4096
QUERY_ROWS = 1024
TILE = 256  # queries bounded at once in a meeting
TOP = 5
_LEAST, _MOST = -(2.0**63), 2.0**63


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: floor(256 * x) of every usable vector, as doubles (whole numbers)."""
    kept = vectors.where(F.col("vec_id").isNotNull() & usable(F.col(vector)))
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    # the SQL floor gives a long; what is beyond one is whole already
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def _padded(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of numbers as a matrix, shorter ones filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high, n = np.empty(0), np.empty(0), np.empty(0, np.int64)
    for batch in batches:
        lists = batch.column("v")
        lengths = np.diff(lists.offsets.to_numpy())
        dims = max(int(lengths.max(initial=0)), len(low))
        more = dims - len(low)
        low, high, n = np.pad(low, (0, more), constant_values=np.inf), np.pad(high, (0, more), constant_values=-np.inf), np.pad(n, (0, more))
        for x in lists:
            v = x.values.to_numpy()
            np.minimum(low[: len(v)], v, out=low[: len(v)])
            np.maximum(high[: len(v)], v, out=high[: len(v)])
        n += (np.arange(dims) < lengths[:, None]).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high), pa.array(n)], ["dim", "low", "high", "n"])


class Cells:
    """The edges of the cells: ``low`` and ``step`` of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low, self.step, self.cells = low, np.maximum((high - low) / cells, 1e-9), cells
        self.reach = np.maximum(np.abs(low), np.abs(high))

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((vectors - self.low) / self.step), 0, self.cells - 1).astype(np.uint8)

    def middles(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The middle of the range of every query's score with every candidate."""
        return (queries * self.step) @ codes.T.astype(float) + (queries @ (self.low + self.step / 2))[:, None]

    def half_widths(self, queries: np.ndarray) -> np.ndarray:
        """Half of that range, a number for each query; the rest takes in rounding."""
        size = np.abs(queries)
        return size @ (self.step / 2) + 1e-9 * (size @ (self.reach + self.step)) + 1e-6


def _cells_of(whole: DataFrame) -> Cells | None:
    """From one aggregation to a row a dimension; None without vectors."""
    found = whole.select("v").mapInArrow(_extremes, "dim long, low double, high double, n long")
    rows = found.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim").collect()
    total = whole.count()
    if not total:
        return None
    # where some vectors are shorter, their padding counts
    low, high = (np.array([f(r[k], 0.0) if r["n"] < total else r[k] for r in rows], float) for f, k in ((min, "low"), (max, "high")))
    return Cells(low, high)


def needed(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows that some query's k best may hold: of equal vectors, k rows of each of the k + 1 smallest ids."""
    _, same = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, same.ravel()))
    group, sorted_ids = same.ravel()[order], ids[order]
    at = np.arange(len(order))
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    new_id = new_group | np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1]))
    within = at - np.maximum.accumulate(np.where(new_id, at, 0))
    distinct = np.cumsum(new_id)
    rank = distinct - np.maximum.accumulate(np.where(new_group, distinct, 0))
    return np.sort(order[(within < k) & (rank <= k)])


_CODES = "block long, rids binary, ids binary, codes binary"
_QUERIES = "q_block long, q_rids binary, q_ids binary, q_vectors binary"


def _numbered_rows(batches: Iterator[pa.RecordBatch], rows: int, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block's number, rids, ids, vectors) of every ``rows`` rows."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        part = (batch.column("rid").to_numpy(), batch.column("vec_id").to_numpy(), _padded(batch.column("v"), dims))
        at = 0
        while at < len(part[0]):
            take = min(rows - size, len(part[0]) - at)
            held.append(tuple(x[at : at + take] for x in part))
            size, at = size + take, at + take
            if size == rows:
                yield number, *map(np.concatenate, zip(*held, strict=True))
                number, held, size = number + 1, [], 0
    if size:
        yield number, *map(np.concatenate, zip(*held, strict=True))


def _approximate(cells: Cells, rows: int, k: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rids, ids, vectors in _numbered_rows(batches, rows, len(cells.low)):
            kept = needed(vectors, ids, k)
            values = [rids[kept].astype(np.int64).tobytes(), ids[kept].astype(np.int64).tobytes(), cells.codes(vectors[kept]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in values)], ["block", "rids", "ids", "codes"])

    return made


def _ask(dims: int, rows: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rids, ids, vectors in _numbered_rows(batches, rows, dims):
            values = [rids.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), vectors.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in values)], ["q_block", "q_rids", "q_ids", "q_vectors"])

    return made


def near(cells: Cells, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, lower, upper) of the candidates whose upper bound reaches the query's kth best lower bound."""
    middle, half = cells.middles(queries, codes), cells.half_widths(queries)[:, None]
    middle[query_ids[:, None] == ids] = -np.inf
    kth = np.partition(middle, len(ids) - k, axis=1)[:, [len(ids) - k]] if len(ids) > k else np.full((len(queries), 1), -np.inf)
    upper = np.clip(middle + half, _LEAST, _MOST)
    q, c = np.nonzero((upper >= np.clip(kth - half, _LEAST, _MOST)) & (middle > -np.inf))
    return q, c, np.clip(middle[q, c] - half[q, 0], _LEAST, _MOST), upper[q, c]


_NEAR = "q long, rid long, lower double, upper double"


def _meet(cells: Cells, k: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rids, ids, codes = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["codes"], np.uint8).reshape(-1, len(cells.low))
                q_rids, q_ids = np.frombuffer(r["q_rids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                queries = np.frombuffer(r["q_vectors"], float).reshape(-1, len(cells.low))
                for i in range(0, len(q_ids), TILE):
                    q, c, lower, upper = near(cells, q_ids[i : i + TILE], queries[i : i + TILE], ids, codes, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_rids[i + q]), pa.array(rids[c]), pa.array(lower), pa.array(upper)], ["q", "rid", "lower", "upper"])

    return met


def _exact(query: np.ndarray, vectors: np.ndarray) -> list[int]:
    reach = np.abs(vectors) @ np.abs(query)
    if reach.size and reach.max() < 2.0**52:  # every partial sum is a whole number a double holds
        return (vectors @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    scores = [sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in vectors]
    return [min(max(x, -(2**63)), 2**63 - 1) for x in scores]


def _decide(k: int, dims: int, step: int = 16):
    """Rows come by query, in the order of their upper bounds: exact scores until the kth is certain, then the k best."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query_id, best, certain = None, None, [], False

        def result() -> pa.RecordBatch:
            rows = [(query_id, i + 1, vec_id, -score) for i, (score, vec_id) in enumerate(best)]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            numbers, ids, upper = (batch.column(c).to_numpy() for c in ("q", "vec_id", "upper"))
            starts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != now:
                    if best:
                        yield result()
                    now, query_id, best, certain = numbers[a], batch.column("query_id")[a].as_py(), [], False
                query = _padded(batch.column("q_v").slice(a, 1), dims)[0]
                for i in range(a, b, step):
                    certain = certain or (len(best) == k and upper[i] < -best[-1][0])
                    if certain:
                        break
                    part = slice(i, min(i + step, b))
                    scores = _exact(query, _padded(batch.column("v").slice(i, part.stop - i), dims))
                    best = sorted([*best, *((-s, x) for s, x in zip(scores, ids[part].tolist(), strict=True))])[:k]
        if best:
            yield result()

    return decided


_FOUND = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, vector: str = "embedding", candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best of all other rows."""
    whole = stage(integer_vectors(vectors, vector).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    cells = _cells_of(whole)
    asked = whole.where(is_query)
    n = asked.count() if cells else 0
    if not n:
        return vectors.sparkSession.createDataFrame([], _FOUND)
    dims = len(cells.low)
    blocks = stage(whole.select("rid", "vec_id", "v").mapInArrow(_approximate(cells, candidate_rows, k), _CODES), "vector-cells")
    dealt_out = asked.select("rid", "vec_id", "v").repartition(-(-n // query_rows), "rid")
    queries = stage(dealt_out.mapInArrow(_ask(dims, query_rows), _QUERIES), "vector-queries")
    # every block's number goes to every slot, and the query blocks of that slot meet it there
    slots = max(1, queries.count())
    queries = queries.withColumn("slot", F.pmod(F.xxhash64("q_block"), F.lit(slots)))
    numbers = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    pairs = numbers.join(queries.select("slot", "q_block"), "slot").drop("slot")
    dealt = pairs.join(queries.drop("slot"), "q_block").join(blocks, "block").repartition("block", "q_block")
    met = dealt.select("rids", "ids", "codes", "q_rids", "q_ids", "q_vectors").mapInArrow(_meet(cells, k), _NEAR)
    # a query's ranges are equally wide, so the order of upper bounds is that of lower ones
    kth = F.nth_value("lower", k).over(Window.partitionBy("q").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = stage(met.withColumn("kth", kth).where("kth IS NULL OR upper >= kth").select("q", "rid", "upper"), "vector-near")
    exact = left.join(whole.select("rid", "vec_id", "v"), "rid")
    exact = exact.join(asked.select(F.col("rid").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("q_v")), "q")
    ordered = exact.repartition("q").sortWithinPartitions("q", F.desc("upper"))
    return ordered.select("q", "query_id", "vec_id", "upper", "v", "q_v").mapInArrow(_decide(k, dims), _FOUND)


def op6_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 50 == 0)


ORACLE_OP6 = """
WITH whole AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
