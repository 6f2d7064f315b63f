"""SimHash near-dedup of documents: five-word shingles, a similarity of 0.8 or more.

1. A text's sketch is made in Arrow batches: the sorted 32-bit hashes of its distinct shingles,
   their 64-bit digest, their SimHash fingerprint, and 20 keys of four minimum hashes each.
   Texts with equal shingles fold into one row (combined before the shuffle).
2. Candidates share a key.  A pair of similarity 0.8 shares none with a chance of 3 in 100,000.
   Keys with the same members count once.
3. A key with more than ``BUCKET_ROWS`` sets is cut into chunks by hash, and every pair of
   chunks is a task of its own.  Shingles travel for candidates alone.
4. In a bucket, fingerprints are compared as bit planes with carry-save counters, as in
   ``simhash``, and words of 64 members are abandoned once all are beyond ``RADIUS``.  At a
   similarity of 0.8 about 10 of 64 bits differ; more than 26 do with a chance of about 1 in
   a million.
5. What is left is counted from the shingles, and a spanning forest of the pairs that reach the
   bound is emitted; components of these edges are the groups.

Defined results: texts of one to four words are one shingle; null and blank texts have none and
are alike; a null id takes part by its text; repeated rows are one group; an empty table gives an
empty result; extra columns pass through, also ones named like those made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import in_text_batches
from gridloom.llm.simhash import SEED, _spread, bit_counts, hashed, labelled, link_pairs, one_of_each
from gridloom.staging import stage

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, MINIMA = 20, 4
#: Bits in which fingerprints of that similarity may differ.
RADIUS = 26
#: Sets under one key that a task compares together.
BUCKET_ROWS = 256
#: Rows of several buckets whose fingerprints are compared at once.
GATHERED = 4096

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 2**64, BANDS * MINIMA, np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**64, BANDS * MINIMA, np.uint64)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE]))
    slices = map(slice, starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), np.uint64, len(words) - SHINGLE + 1))


def band_keys(hashes: np.ndarray, slab: int = 1 << 11) -> list[int]:
    """The keys of a set of hashes; an empty one has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for i in range(0, len(hashes), slab):
        least = np.minimum(least, (hashes[i : i + slab, None] * _FACTORS + _TERMS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(m.tobytes(), i) for i, m in enumerate(least.reshape(BANDS, MINIMA))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.uint64)[0])


_SKETCH = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("rid", pa.int64()), ("fp", pa.int64()), ("print", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        sets = list(map(shingle_hashes, texts))
        digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        prints = np.array(list(map(fingerprint, sets)), np.uint64).view(np.int64)
        rows = np.arange(row, row + len(texts))
        row += len(texts)
        short = [np.unique(s.astype(np.uint32)).tobytes() for s in sets]
        columns = [batch.column("doc_id"), batch.column("h"), pa.array(rows), pa.array(digests), pa.array(prints), pa.array(list(map(band_keys, sets)), pa.list_(pa.int64())), pa.array(short, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH)


def sketches(keyed: DataFrame) -> DataFrame:
    """``doc_id, h, rid`` (a number for each row), ``fp`` (digest of all shingles), ``print`` (their SimHash), ``bands, shingles`` of ``hashed`` documents."""
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__h").alias("h"), F.col("text").cast("string").alias("text"))
    return in_text_batches(rows).mapInArrow(_sketches, "doc_id long, h long, rid long, fp long, print long, bands array<long>, shingles binary")


def alike(sets: list[np.ndarray], near: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges over the pairs of ``sets`` (sorted, not empty) whose similarity reaches the bound; ``near``: pairs to look at."""
    sizes = np.array(list(map(len, sets)))
    left, edges = np.ones(len(sets), bool), []
    while left.any():
        reached = [int(np.argmax(left))]
        left[reached] = False
        while reached:
            x = reached.pop()
            fit = np.flatnonzero(left & near[x] & (LEAST[1] * np.minimum(sizes, sizes[x]) >= LEAST[0] * np.maximum(sizes, sizes[x])))
            if not len(fit):
                continue
            others = np.concatenate([sets[i] for i in fit])
            place = np.minimum(np.searchsorted(sets[x], others), sizes[x] - 1)
            common = np.add.reduceat((sets[x][place] == others).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[fit])[:-1])))
            found = fit[LEAST[1] * common >= LEAST[0] * (sizes[x] + sizes[fit] - common)]
            edges += [(int(y), x) for y in found]
            reached += found.tolist()
            left[found] = False
    return edges


def bucket_edges(prints: np.ndarray, bucket: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """``alike`` in every bucket; rows are sorted by bucket."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    ends = np.concatenate((starts[1:], [len(bucket)]))
    pairs = list(link_pairs(prints, bucket, RADIUS))
    if not pairs:
        return []
    i, j = map(np.concatenate, zip(*pairs, strict=True))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first, last = np.searchsorted(i, starts), np.searchsorted(i, ends)
    out = []
    for a, b, f, g in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        if f == g:
            continue
        near = np.zeros((b - a, b - a), bool)
        near[i[f:g] - a, j[f:g] - a] = near[j[f:g] - a, i[f:g] - a] = True
        out += [(x + a, y + a) for x, y in alike(sets[a:b], near)]
    return out


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u, v`` of each bucket; rows come sorted by bucket."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    last, number = None, 0
    buckets, ids, prints, sets = [], [], [], []

    def edges() -> pa.RecordBatch:
        found = bucket_edges(np.array(prints, np.int64).view(np.uint64), np.array(buckets), sets)
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], schema=schema)

    for batch in batches:
        for key, part, fp, print_, held in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "fp", "print", "shingles")), strict=True):
            if (key, part) != last:
                if len(ids) >= GATHERED:
                    yield edges()
                    buckets, ids, prints, sets = [], [], [], []
                last, number = (key, part), number + 1
            buckets.append(number)
            ids.append(fp)
            prints.append(print_)
            sets.append(np.frombuffer(held, np.uint32))
    if ids:
        yield edges()


def links(prints: DataFrame, chosen: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges ``u, v`` over the ``fp`` of ``prints`` (staged ``sketches``); ``chosen`` has the ``fp, rid`` of one row for each."""
    banded = prints.select("rid", "fp", "bands").join(chosen.select("rid"), "rid", "left_semi").select("fp", F.explode("bands").alias("key"))
    banded = stage(banded, "near-bands")
    shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).where("n > 1")
    members = stage(banded.join(shared.groupBy("n", "who").agg(F.min("key").alias("key")).select("key"), "key").select("key", "fp"), "near-members")
    wanted = chosen.join(members.select("fp").distinct(), "fp", "left_semi").select("rid")
    sets = prints.select("rid", "fp", "print", "shingles").join(wanted, "rid", "left_semi").select("fp", "print", "shingles")
    met = _spread(members, bucket_rows).join(sets, "fp").select("key", "part", "fp", "print", "shingles")
    return in_text_batches(met.repartition("key", "part").sortWithinPartitions("key", "part")).mapInArrow(_alike, "u long, v long")


def near_dedup(documents: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents without near-duplicates: of each group the row of the smallest ``doc_id`` stays.

    If that id has several rows in the group, the one of the smallest hash of all columns stays;
    rows of one id with other texts count in their own texts' groups.  A group without any id
    keeps one row as well.  Rows are chosen by narrow columns alone; the whole rows are shuffled
    once, for a hash join that keeps the chosen ones, and need no sort.
    """
    keyed = hashed(documents)
    prints = stage(sketches(keyed), "near-sketches")
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid")), "near-reps")
    return one_of_each(keyed, prints, labelled(reps.select("fp", "rep"), links(prints, reps.select("fp", "rid"), bucket_rows)))
