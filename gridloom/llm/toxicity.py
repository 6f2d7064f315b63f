"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it, whole text, lower-cased and
with runs of white space as one blank.  From labelled documents, each n-gram's document counts
in the two classes give its log-count ratio; the n-grams with the most telling ratios are kept,
and a logistic regression is fitted on presence times ratio.  Scoring is one pass over the texts.

Training documents are a bounded sample (``PER_CLASS`` ids a class, one row an id); counts are summed
in tables of fixed size.  The driver holds that table and the sample's chosen features: at most
2 * ``PER_CLASS`` * ``FEATURES`` numbers, usually a few hundred a document.

Defined results: a null or empty text has the score of a text without features; very long texts
are read whole, in slices that overlap; repeated rows get equal scores; a null id is not held
out; with no label, or labels of one class only, every score is the smoothed share of toxic labels;
an empty table gives an empty result; extra columns pass through ``score_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.batches import in_text_batches
from gridloom.llm.labelled import emit_blocks, held_out, labelled_sample, sum_blocks

SIZES = (4, 5, 6)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
PER_CLASS = 10_000
FEATURES = 5_000
LEAST_DOCS = 4
EVIDENCE = 10.83  # of the log-likelihood ratio: one in a thousand by chance
THRESHOLD = 0.7
SLICE = 1 << 20  # code points hashed at once

_WIDTH = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"\s+")


def slots_of(text: str | None) -> np.ndarray:
    """The distinct slots of the text's n-grams, unordered."""
    text = f" {_SPACE.sub(' ', text.lower()).strip()} " if text else ""
    if len(text) <= 2:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = [_distinct(_hashed(code[i : i + SLICE + SIZES[-1]])) for i in range(0, len(code), SLICE)]
    return seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))


def _hashed(code: np.ndarray) -> np.ndarray:
    out = []
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        if n > len(code):
            break
        rolled = rolled[: len(code) - n + 1] * _ODD + code[n - 1 :]
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * (_ODD + np.uint64(2 * n))
            out.append((mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


_last = np.zeros(SLOTS, np.int32)


def _distinct(slots: np.ndarray) -> np.ndarray:
    """Without sorting: of equal slots, the one written last stays."""
    at = np.arange(len(slots), dtype=np.int32)
    _last[slots] = at
    return slots[_last[slots] == at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((SLOTS, 2), np.int64)
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            table[slots_of(text), y] += 1
    yield from emit_blocks(table, _WIDTH)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by slot: logistic weight times log-count ratio
    intercept: float

    def score(self, text: str | None) -> float:
        slots = slots_of(text)
        z = self.intercept + float(self.weights[slots].sum(dtype=np.float64)) if len(slots) else self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(counts: np.ndarray, n0: int, n1: int, smooth: float = 0.5) -> np.ndarray:
    """ln of the smoothed share of toxic documents with the n-gram over that of the others."""
    return np.log((counts[:, 1] + smooth) / (n1 + 2 * smooth)) - np.log((counts[:, 0] + smooth) / (n0 + 2 * smooth))


def log_likelihood(counts: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """G squared of each n-gram's presence against the classes."""
    seen = counts.sum(axis=1).astype(float)
    out = np.zeros(len(counts))
    for y, n in ((0, n0), (1, n1)):
        for observed, expected in ((counts[:, y], seen * n / (n0 + n1)), (n - counts[:, y], (n0 + n1 - seen) * n / (n0 + n1))):
            out += 2 * observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9))
    return out


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, weight: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on presence times ``scale`` by Nesterov steps with a ridge."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    value = scale[column]
    row_norm = np.bincount(owner, value * value, len(rows))
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * (1 + float((weight * row_norm).sum() * 4)) + ridge)
    w, b = np.zeros(len(scale)), 0.0
    ahead, ahead_b = w, b
    for t in range(steps):
        z = ahead_b + np.bincount(owner, ahead[column] * value, len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gradient = np.bincount(column, error[owner] * value, len(scale)) + ridge * ahead
        new, new_b = ahead - rate * gradient, ahead_b - rate * error.sum()
        ahead, ahead_b = new + t / (t + 3) * (new - w), new_b + t / (t + 3) * (new_b - b)
        w, b = new, new_b
    return w, b


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES) -> ToxicityModel:
    spark = documents.sparkSession
    sample, all0, all1 = labelled_sample(documents, labels, label, per_class, "toxicity")
    in_text_batches(sample)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = (all1 + 1) / (all0 + all1 + 2) if all0 + all1 else 0.01
        return ToxicityModel(np.zeros(SLOTS), float(np.log(share / (1 - share))))
    kind = "block int, salt int, counts binary"
    counts = sum_blocks(sample.select("text", "y").mapInArrow(_count, kind), 2 * SLOTS, _WIDTH).reshape(-1, 2)
    ratio = log_count_ratios(counts, n0, n1)
    telling = log_likelihood(counts, n0, n1)
    telling[counts.sum(axis=1) < LEAST_DOCS] = 0
    chosen = np.argsort(-telling, kind="stable")[:features]
    chosen = chosen[telling[chosen] > EVIDENCE]
    place = np.full(SLOTS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(place)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.sort(p[p >= 0]).astype(np.int32).tobytes() for p in (shared.value[slots_of(t)] for t in batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.binary())], ["y", "f"])

    rows, y = [], []
    for r in sample.select("text", "y").mapInArrow(featured, "y int, f binary").toLocalIterator():
        rows.append(np.frombuffer(r["f"], np.int32))
        y.append(r["y"])
    y = np.array(y, float)
    # classes are sampled apart: weights restore their shares among all labelled documents
    weight = np.where(y == 1, all1 / n1, all0 / n0)
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64), y))
    w, b = _logistic([rows[i] for i in order], y[order], ratio[chosen], weight[order])
    weights = np.zeros(SLOTS)
    weights[chosen] = w * ratio[chosen]
    return ToxicityModel(weights, float(b))


def score_documents(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` (1 from ``threshold`` on), replacing columns so named."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.drop("score", "predicted")
    kept = [c for c in rows.columns if keep_text or c != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter(map(shared.value.score, batch.column("text").to_pylist()), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return in_text_batches(rows).mapInArrow(scored, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(documents, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
