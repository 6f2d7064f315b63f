"""Mixing sources to target weights by Poisson replication, in DataFrame expressions.

Each source's repetition rate is its target share of the output over its share of the input,
from counts over all documents.  A document's count is the Poisson quantile, with that mean,
of a uniform number hashed from its id, text and the seed; it is exploded by its count, and
the copies are dealt out by a hash that is also their order: a global shuffle that is the
same on every run over the same files.

Defined results: a null source is the empty source; a null id hashes as the empty string;
repeated rows (same id and text) get the same count; sources absent from ``weights`` get
``other``; a weight of zero drops its source; an empty table gives an empty result; extra
columns pass through, and input columns named ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.staging import stage

#: Production weights: the first source is held at twice an ordinary one's share.
WEIGHTS: Mapping[str, float] = {"src0": 2.0}
OTHER = 1.0
SEED = 17


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 52 bits of the parts' MD5."""
    digest = F.md5(F.concat_ws(":", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def repetition_rates(documents: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, size: float = 1.0) -> DataFrame:
    """``source``, ``rate``, ``cdf``: the mean count of a source's documents and its Poisson distribution.

    ``size`` is the output's expected rows over the input's.  ``cdf`` holds the probability of
    at most 0, 1, ... copies, as far as a double tells it from 1; it is summed in log space, so
    large means don't underflow.
    """
    counts = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    named = F.lit(float(other))
    for source, weight in weights.items():
        named = F.when(F.col("source") == source, F.lit(float(weight))).otherwise(named)
    counts = stage(counts.withColumn("weight", named).coalesce(1), "mix-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    rate = F.col("weight") / F.lit(total["weight"]) * F.lit(float(total["n"])) * F.lit(float(size)) / F.col("n") if total["weight"] > 0 else F.lit(0.0)
    rates = counts.select("source", rate.alias("rate"))
    upto = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(F.col("rate") / k)
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(acc["cdf"], total).alias("cdf"))

    start = F.struct((-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("total"), F.array(F.exp(-F.col("rate"))).alias("cdf"))
    cdf = F.when(F.col("rate") > 0, F.aggregate(F.sequence(F.lit(1), upto), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))
    return rates.withColumn("cdf", cdf)


def mix(documents: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, size: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed documents in shuffled order, with ``copy`` (from 0) and ``shuffle_key``.

    ``rates`` is staged, one row a source: broadcast only if Spark finds its size below the
    threshold.  The one shuffle of texts is the global shuffle itself; rows go by a hash of
    document and copy and by the row's number, so no source and no document is hot, and neither
    are the rows of a document that repeats.
    """
    documents = documents.drop("copy", "shuffle_key")
    rates = stage(repetition_rates(documents, weights, other, size).coalesce(1), "mix-rates")
    rates = rates.select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"))
    known = documents.join(rates, F.coalesce(documents["source"], F.lit("")) == F.col("__source"))
    identity = (F.col("doc_id").cast("string"), F.md5(F.coalesce(documents["text"], F.lit("")).cast("binary")), F.lit(str(seed)))
    drawn = known.withColumns({"__u": uniform(*identity), "__row": F.monotonically_increasing_id()})
    drawn = drawn.withColumn("__n", F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))).where("__n > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__n") - 1).cast("long"))))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "doc_id", "__u", "copy"))
    shuffled = keyed.repartition("shuffle_key", "__row").sortWithinPartitions("shuffle_key")
    return shuffled.select(*documents.columns, "copy", "shuffle_key")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(documents).select("doc_id", "source", "lang", "n_chars", "text", "copy")


ORACLE_OP2 = """
WITH counts AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
weighted AS (SELECT s, n, CASE WHEN s = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM counts),
rates AS (SELECT s, w / sum(w) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM weighted),
terms AS (
  SELECT s, k, exp(-rate + k * ln(rate) - coalesce((SELECT sum(ln(i)) FROM range(1, 400) t(i) WHERE i <= k), 0)) AS p
  FROM rates, range(0, 400) u(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 24)
),
cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS upto FROM terms),
drawn AS (
  SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':17'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
)
SELECT doc_id, source, lang, n_chars, text, k AS copy
FROM drawn JOIN cdf ON s = coalesce(source, '') AND upto <= u
"""
