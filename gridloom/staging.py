"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage: a lost executor re-reads it instead of repeating the work
behind it.  The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: dict[str, SparkSession] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridloom-"))
    return _own[0]


def claim(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-stage/{uuid.uuid4().hex}-{name}"
    _written[path] = spark
    if (scratch := _scratch.get()) is not None:
        scratch.append(path)
    return path


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at its end, but for those given to the function that it yields.

    For work whose result is staged itself: what led to it has no reader left.  Without it tables stay
    until the process ends, since results are lazy.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(staged: DataFrame) -> DataFrame:
        kept.add(staged._staged_path)
        return staged

    outer = _scratch.set(made)
    try:
        yield keep
    finally:
        _scratch.reset(outer)
        if (around := _scratch.get()) is not None:
            around.extend(p for p in made if p in kept)
        for path in made:
            if path not in kept and path in _written:
                _delete(path, _written.pop(path))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it read back."""
    spark = df.sparkSession
    path = claim(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def _delete(path: str, spark: SparkSession) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = staged._staged_path
    _delete(path, _written.pop(path))


def release() -> None:
    """Delete what this process staged; results that still read a staged table end with it."""
    while _written:
        try:
            _delete(*_written.popitem())
        except Exception:  # the session is gone: its folder is cleaned with the cluster
            return


atexit.register(release)
