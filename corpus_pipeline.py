"""From raw documents to token ids: toxicity, quality rules, near-duplicates by SimHash, mixing, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each one's
result as Parquet and reads it as the next one's documents.

Defined results, for every stage: an empty table gives an empty result; a null in any column is
allowed; very long texts are read whole; other columns pass through, whatever their names (the
last stage replaces ones named like its results).  What nulls, empty texts, ties and repeated rows
mean is said at each stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, near_dedup, quality_rules, toxicity
from gridloom.staging import scratch, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage_: Stage) -> Stage:
    """The stage, returning exactly the columns of its documents: ones that an operator names alike are set apart meanwhile."""

    @functools.wraps(stage_)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apart = {c: f"__own_{c}" for c in docs.columns if c not in ("doc_id", "text", "lang", "source")}
        out = stage_(spark, docs.withColumnsRenamed(apart), sf_dir)
        return out.select(*(F.col(apart.get(c, c)).alias(c) for c in docs.columns))

    return run_stage


@keeping_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on these documents' labels, calls toxic.

    A null or empty text has the score of a text without features; a null id has no label, but a
    score; repeated rows are scored alike and go or stay together; a score of 0.7 sharp is toxic.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).where("predicted = 0")


@keeping_columns
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or lie beyond their group's fences.

    A null or empty text fails the base rules; a null language or source is the empty one; repeated
    rows are judged alike and each counts in the sketches; a ratio on the fence stays.
    """
    return quality_rules.judge(quality_rules.measure(docs)).where("kept")


@keeping_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more.

    The row of the smallest id stays, of its repeated rows one; null and blank texts are one group; a
    null id comes after all others.
    """
    return near_dedup.near_dedup(docs)


@keeping_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, shuffled.

    A null source is the empty one; a null text or id draws like the empty string; repeated rows
    draw the same count and each has its copies.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but for the text, with ``ids``, ``n_tokens`` and the digests of ids and decoded text.

    A null text is empty and has no tokens; repeated rows have equal results.
    """
    return bpe.encode_documents(docs, keep_text=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Fitted models and 64-bit hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch() as keep:
        for name, step in STAGES:
            with scratch() as pass_on:  # a stage's own tables go as soon as its result is written
                docs = pass_on(stage(step(spark, docs, sf_dir), name.split()[0].lower()))
        keep(docs)
    return docs
