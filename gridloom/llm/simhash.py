"""SimHash near-duplicates: fingerprints, bit-sliced comparison, components.

1. Fingerprints are made in Arrow batches and staged with their document's id; equal
   fingerprints fold into one row, with the smallest id (combined before the shuffle).
2. Candidates: the 64 bits are cut into six blocks; two fingerprints that differ in at most
   three bits agree on at least three blocks, so each fingerprint goes under its 20 triples of
   blocks (about 32 bits each).  That is exact: no link is missed, whatever the data.
3. A key with more than ``BUCKET_ROWS`` fingerprints is cut into chunks by hash, and every pair
   of chunks is a task of its own, so no task holds more than about two chunks.  (Rows sent
   for such a key grow with the square of its distinct fingerprints over the chunk's size.)
4. In a bucket, members are stored as bit planes, 64 to a machine word.  A query's distance to
   the 64 members of a word grows by carry-save bitwise counters over the planes, and a word
   is abandoned once all of its members exceed the radius.
5. A bucket emits a spanning forest of its links (fewer edges than members), never all pairs;
   components of these edges are the near-duplicate groups.

Defined results: a null or blank text has fingerprint zero and is linked like any other; texts
of one or two words hash as a whole; a null id takes part by its text, and a group without any
other id has a null component; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.

``near_dedup`` in the module of that name applies the comparison to documents of similar five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import in_text_batches
from gridloom.operators.components import components
from gridloom.staging import stage

SEED = 42
SHINGLE = 3
RADIUS = 3
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
KEPT = 3
#: Fingerprints under one key that a task compares together.
BUCKET_ROWS = 2048
#: (query, word) pairs compared at once in a task: bounds its memory.
SLAB = 1 << 19


def fingerprint(text: bytes | None) -> int:
    """Of one text's UTF-8: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -SHINGLE]))
    slices = map(slice, starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist())
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), np.uint64, n)
    return int(np.packbits(2 * bit_counts(hashes) > n, bitorder="little").view(np.uint64)[0])


def bit_counts(hashes: np.ndarray, slab: int = 1 << 14) -> np.ndarray:
    """How many hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), slab):
        part = hashes[i : i + slab]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(prints.view(np.int64))], ["doc_id", "h", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long)."""
    return _prints_of(documents.withColumn("__h", F.lit(0).cast("long"))).drop("h")


def _prints_of(keyed: DataFrame) -> DataFrame:
    """``doc_id, h, fp``, with ``h`` the rows' ``__h``."""
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__h").alias("h"), F.col("text").cast("string").alias("text"))
    return in_text_batches(rows).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _masks() -> list[int]:
    whole = lambda b: ((1 << b[1]) - 1) << b[0]
    masks = [sum(map(whole, kept)) for kept in combinations(BLOCKS, KEPT)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame) -> DataFrame:
    """Each fingerprint under its 20 keys: the table's number and the hash of the kept bits."""
    tables = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(_masks())))
    return prints.select("fp", F.explode(tables).alias("key"))


def _spread(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    """Add ``part``: 0, or for hot keys the number of the pair of chunks; hot rows go to each pair of their chunk."""
    hot = stage(keyed.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", F.ceil(F.col("count") / bucket_rows).cast("long").alias("chunks")), "simhash-hot")
    joined = keyed.join(hot, "key", "left")
    chunks, chunk = F.col("chunks"), F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda j: F.when(j != chunk, F.least(j, chunk) * chunks + F.greatest(j, chunk)))
    parts = F.when(chunks.isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.filter(pairs, lambda p: p.isNotNull()))
    return joined.select("key", "fp", F.explode(parts).alias("part"))


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; a label is the smallest index of its class."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


_WORD = np.uint64(64)


def link_classes(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, slab: int = SLAB) -> np.ndarray:
    """For rows sorted by ``bucket``: the smallest row index linked to each within its bucket, by bit-sliced comparison."""
    labels = np.arange(len(prints))
    for i, j in link_pairs(prints, bucket, radius, slab):
        _union(labels, i, j)
    return labels


def link_pairs(prints: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, slab: int = SLAB) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by ``bucket``: the pairs ``i < j`` within a bucket that differ in ``radius`` bits at most, some at a time."""
    n = len(prints)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    words_of = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words_of)))[:-1]
    n_words = int(words_of.sum())
    of_row = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[of_row]
    word, lane = first_word[of_row] + place // 64, (place % 64).astype(np.uint64)
    member = np.full((n_words, 64), -1, np.int64)
    member[word, lane.astype(np.int64)] = np.arange(n)
    lanes = np.packbits((member >= 0), axis=1, bitorder="little").view(np.uint64).ravel()
    cells = np.zeros((n_words, 64), np.uint64)
    cells[word, lane.astype(np.int64)] = prints
    bits = np.unpackbits(cells.view(np.uint8).reshape(n_words, 64, 8), axis=2, bitorder="little").reshape(n_words, 64, 64)
    packed = np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little"))
    planes = np.ascontiguousarray(packed.view(np.uint64).reshape(n_words, 64).T)
    del bits, cells, packed
    # a query meets its own word and the later ones of its bucket
    meets = first_word[of_row] + words_of[of_row] - word
    ends = np.cumsum(meets)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slab, side="right")))
        q = np.repeat(np.arange(at, upto), meets[at:upto])
        w = word[q] + np.arange(len(q)) - np.repeat(ends[at:upto] - meets[at:upto] - (ends[at - 1] if at else 0), meets[at:upto])
        alive = lanes[w].copy()
        own = w == word[q]
        above = ~np.uint64(0) << lane[q[own]] << np.uint64(1)  # later members only; a shift by 64 would be undefined
        alive[own] &= above
        q, w, hits = _compare(prints, planes, q, w, alive, radius)
        for i in range(0, len(q), 1 << 13):
            lit = np.unpackbits(hits[i : i + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(lit)
            yield q[i + row], member[w[i + row], bit]
        at = upto


def _compare(prints: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, alive: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, lanes within the radius) of the pairs of query and word that aren't abandoned."""
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(q), np.uint64)
    fps = prints[q]
    for bit in range(64):
        carry = planes[bit][w] ^ (np.uint64(0) - (fps >> np.uint64(bit) & np.uint64(1)))
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        over |= carry
        if bit % 4 == 3:
            live = (alive & ~(over | _exceeds(counters, radius))) != 0
            if not live.all():
                q, w, alive, over, fps = q[live], w[live], alive[live], over[live], fps[live]
                counters = [c[live] for c in counters]
                if not len(q):
                    break
    return q, w, alive & ~(over | _exceeds(counters, radius))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius (overflow is kept apart)."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            over = over | (equal & counters[i])
            equal = equal & ~counters[i]
    return over


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges ``u, v`` of the links in each bucket; rows come sorted by bucket, the last of a batch waits for the next."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = []

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
        bucket = np.cumsum(change)
        full = np.bincount(bucket)[bucket] > 1
        rows, bucket = rows[full], bucket[full]
        labels = link_classes(np.ascontiguousarray(rows[:, 2]).view(np.uint64), bucket)
        linked = labels != np.arange(len(labels))
        prints = rows[:, 2]
        return pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[labels[linked]])], schema=schema)

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp")], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        last = rows[-1, :2]
        if (rows[0, :2] == last).all():
            continue
        rows = np.concatenate(held)
        cut = len(rows) - int(np.argmin((rows[::-1, :2] == last).all(axis=1)))
        held = [rows[cut:]]
        yield edges(rows[:cut])
    if held and len(rows := np.concatenate(held)):
        yield edges(rows)


def link_forest(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning edges (``u, v``) over the links of distinct ``fp``; every link's ends are connected by them."""
    spread = _spread(_keyed(prints), bucket_rows)
    sorted_ = spread.repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_.select("key", "part", "fp").mapInArrow(_forest, "u long, v long")


def labelled(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, component, component_id`` of every ``fp`` in ``reps`` (``fp, rep``): its component's own key and smallest id."""
    linked = components(edges)
    known = reps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    known = stage(known, "simhash-labels")
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    return known.join(smallest, "component").select("fp", "component", "component_id")


def _groups(prints: DataFrame, bucket_rows: int) -> DataFrame:
    """``fp, component, component_id`` of every fingerprint in ``prints`` (``doc_id, fp``)."""
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    return labelled(reps, link_forest(reps.select("fp"), bucket_rows))


def near_duplicates(documents: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``documents``."""
    prints = stage(fingerprints(documents), "simhash-prints")
    return prints.join(_groups(prints, bucket_rows), "fp").select("doc_id", "fp", "component_id")


def hashed(documents: DataFrame) -> DataFrame:
    """Add ``__h``, the hash of all columns; the text comes first, since nulls don't count in a hash."""
    return documents.withColumn("__h", F.xxhash64(F.col("text").isNull(), "text", *_plain(documents)))


def _plain(documents: DataFrame) -> list[str]:
    return [f.name for f in documents.schema if "map<" not in f.dataType.simpleString()]  # maps can't be hashed


def one_of_each(keyed: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Of ``hashed`` documents the chosen row of each group: ``prints`` has ``doc_id, h, fp``, ``groups`` is ``labelled``.

    Groups are told apart by their component; ids may be shared by groups.
    """
    documents = keyed.drop("__h")
    named = prints.select("doc_id", "h", "fp").join(groups, "fp")
    firsts = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("component_id").alias("__id"), F.min("h").alias("__kept"))
    firsts = stage(firsts.select("__id", "__kept").distinct(), "simhash-kept")
    same = keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["__h"] == F.col("__kept"))
    kept = keyed.join(firsts.hint("shuffle_hash"), same, "left_semi").select(*documents.columns)
    # only rows that are equal in all columns are left to fold
    repeats = prints.groupBy("doc_id", "h").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(_plain(documents)) if repeats else kept


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(documents)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
