"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

Words (runs of letters, digits or marks, and marks of their case) are hashed to ``WORDS`` slots.
Each slot has a sparse ternary index vector, derived from its number; its context vector is the
sum of the index vectors of the words around its occurrences, over the whole texts of all
documents.  These sums are whole numbers, so they don't depend on the order of tasks.

A document is four poolings of its words' context vectors: their mean weighted towards rare words,
their plain mean, their spread (standard deviation), and the mean product of each with the next but
one, which is large where words come back.  Poolings were chosen by cross-validation within the folds
that may be learned from.  The network learns from a bounded sample of labelled documents
(``PER_CLASS`` ids a class); a part of that sample is kept back to fit the temperature that
calibrates its probabilities.

Defined results: a null or empty text has the zero vector and the score the network gives it;
very long texts are read whole, in slices; repeated rows get equal scores; a null id is not held
out; with no label, or labels of one class only, every score is the smoothed share of class 1;
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

WORDS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
REACH = 2  # words to either side
PER_CLASS = 10_000
HIDDEN = 24
RARE = 1e-3
SLICE = 1 << 18  # characters of a text read at once
CACHED = 500_000  # words that a worker keeps
APART = 2  # places between the words whose vectors are multiplied
POOLED = 4 * DIMENSIONS

_WIDTH = (DIMENSIONS + 1) * 64
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
#: Marks of case: added to the words, as they say more about quality than most words.
_SHAPES = ("<upper>", "<title>", "<long>")


def _slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 5) % WORDS


class _Slots(dict):
    """Run of text without blanks → slots of its words and of their case, as 16-bit numbers in bytes."""

    def __missing__(self, run: str) -> bytes:
        out = []
        for word in _WORD.findall(run):
            out.append(_slot(word.lower()))
            if len(word) > 1 and word.isupper():
                out.append(_slot(_SHAPES[0]))
            elif word[0].isupper():
                out.append(_slot(_SHAPES[1]))
            if len(word) > 20:
                out.append(_slot(_SHAPES[2]))
        packed = np.array(out, np.int16).tobytes()
        if len(run) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[run] = packed
        return packed


_slots = _Slots()


def slots_of(text: str | None) -> Iterator[np.ndarray]:
    """Slots of a text's words in order, a slice of the text at a time."""
    if not text:
        return
    for i in range(0, len(text), SLICE):
        runs = text[i : i + SLICE].replace("\n", " \n ").split(" ")
        yield np.frombuffer(b"".join(map(_slots.__getitem__, runs)), np.int16).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each slot's nonzero components."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((WORDS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (WORDS, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    weights = signs.astype(float)  # sums of ones stay exact
    width = DIMENSIONS + 1
    table = np.zeros(WORDS * width, np.int64)
    held: list[np.ndarray] = []
    size = 0
    gap = np.full(REACH, -1)

    def add() -> None:
        words = np.concatenate(held)
        real = words >= 0
        np.add(table, np.bincount(words[real] * width + DIMENSIONS, minlength=len(table)), out=table)
        for d in range(1, REACH + 1):
            a, b = words[:-d], words[d:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for x, y in ((a, b), (b, a)):
                for j in range(NONZERO):
                    table[:] += np.bincount(x * width + places[y, j], weights=weights[y, j], minlength=len(table)).astype(np.int64)

    for batch in batches:
        for text in batch.column("text").to_pylist():
            for words in slots_of(text):
                held += (words, gap)
                size += len(words) + REACH
                if size > 1 << 20:
                    add()
                    held, size = [], 0
    if held:
        add()
    yield from emit_blocks(table, _WIDTH)


@dataclass
class WordVectors:
    vectors: np.ndarray  # (WORDS, DIMENSIONS): unit context vectors
    weights: np.ndarray  # (WORDS,)

    @staticmethod
    def of(table: np.ndarray) -> WordVectors:
        """From the summed contexts and counts."""
        table = table.reshape(WORDS, DIMENSIONS + 1)
        counts = table[:, DIMENSIONS].astype(float)
        context = table[:, :DIMENSIONS] / np.maximum(counts, 1)[:, None]
        context = context - (context * counts[:, None]).sum(axis=0) / max(counts.sum(), 1)
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        weights = RARE / (RARE + counts / max(counts.sum(), 1))
        return WordVectors(context.astype(np.float32), weights.astype(np.float32))

    def pooled(self, text: str | None) -> np.ndarray:
        rare, plain, square, product = np.zeros((4, DIMENSIONS))
        weight, n, pairs = 0.0, 0, 0
        for words in slots_of(text):
            v, w = self.vectors[words], self.weights[words]
            rare += np.einsum("i,ij->j", w, v)
            plain += v.sum(axis=0)
            square += np.einsum("ij,ij->j", v, v)
            product += np.einsum("ij,ij->j", v[APART:], v[:-APART])
            weight += float(w.sum(dtype=float))
            n += len(words)
            pairs += max(len(words) - APART, 0)
        mean = plain / max(n, 1)
        spread = np.sqrt(np.maximum(square / max(n, 1) - mean * mean, 0))
        return np.concatenate((rare / max(weight, 1e-9), mean, spread, product / max(pairs, 1)))


def word_vectors(documents: DataFrame) -> WordVectors:
    """From all documents; a task sends one table of fixed size, and tables are summed on the way."""
    blocks = in_text_batches(documents.select("text")).mapInArrow(_contexts, "block int, salt int, counts binary")
    return WordVectors.of(sum_blocks(blocks, WORDS * (DIMENSIONS + 1), _WIDTH))


@dataclass
class Network:
    """Two layers, tanh and logistic; ``temperature`` divides the logit."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.spread, -6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.logits(x) / self.temperature)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on weighted log loss; every fifth row is kept back for the temperature."""
    back = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    rng = np.random.default_rng(seed)
    fit_x, fit_y, fit_w = x[~back], y[~back], weight[~back] / weight[~back].mean()
    net = Network(fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    scaled = np.clip((fit_x - net.mean) / net.spread, -6, 6)
    parts = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit_y))
        for i in range(0, len(order), 256):
            at = order[i : i + 256]
            h = np.tanh(scaled[at] @ parts[0] + parts[1])
            e = fit_w[at] * (_logistic(h @ parts[2] + parts[3][0]) - fit_y[at]) / len(at)
            back_h = np.outer(e, parts[2]) * (1 - h * h)
            grads = [scaled[at].T @ back_h + decay * parts[0], back_h.sum(axis=0), h.T @ e + decay * parts[2], np.array([e.sum()])]
            step += 1
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    if back.any():
        net.temperature = best_temperature(net.logits(x[back]), y[back], weight[back])
    return net


def best_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Of a grid from 1/4 to 8, the one of least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
    losses = [float((weight * np.logaddexp(0, -(2 * y - 1) * logits / t)).sum()) for t in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass
class QualityModel:
    words: WordVectors | None = None
    network: Network | None = None
    constant: float = 0.5

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None or self.words is None:
            return np.full(len(texts), self.constant)
        x = np.stack([self.words.pooled(t) for t in texts]) if texts else np.zeros((0, POOLED))
        return self.network.probability(x)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    sample, all0, all1 = labelled_sample(documents, labels, label, per_class, "quality")
    in_text_batches(sample)
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return QualityModel(constant=(all1 + 1) / (all0 + all1 + 2))
    words = word_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [shared.value.pooled(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(vectors, pa.binary())], ["doc_id", "y", "x"])

    rows = sorted((xxhash.xxh64_intdigest(str(r["doc_id"])), r["x"], r["y"]) for r in sample.mapInArrow(pooled, "doc_id long, y int, x binary").toLocalIterator())
    x = np.stack([np.frombuffer(r[1], np.float32) for r in rows]).astype(float)
    y = np.array([r[2] for r in rows], float)
    weight = np.where(y == 1, all1 / sizes[1], all0 / sizes[0])
    return QualityModel(words, train(x, y, weight))


def score_documents(documents: DataFrame, model: QualityModel, threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``documents`` with ``score`` and ``predicted`` (1 from ``threshold`` on), replacing columns so named."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.drop("score", "predicted")
    kept = [c for c in rows.columns if keep_text or c != "text"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return in_text_batches(rows).mapInArrow(scored, T.StructType([*(rows.schema[c] for c in kept), *added]))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(documents, model, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
