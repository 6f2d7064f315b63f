"""Arrow batches of texts, bounded by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST = 4 << 20


def in_text_batches(rows: DataFrame) -> DataFrame:
    """``rows``, whose Arrow batches have 4 MB at most (or a single longer row).

    Long texts make batches of a fixed number of rows very uneven, and the JVM and Python both
    hold a batch.  The setting is the session's, and is only ever lowered.
    """
    spark = rows.sparkSession
    now = spark.conf.get(_SETTING)
    if not now.isdigit() and now.rstrip("b").isdigit():
        now = now.rstrip("b")
    if not now.isdigit() or int(now) > MOST:
        spark.conf.set(_SETTING, f"{MOST}b")
    return rows
