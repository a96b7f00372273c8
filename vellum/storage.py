"""Tables kept in the shared folder between the steps of an iterative operator."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine (a local master), where the session names no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"

#: Spark's setting that deletes the shuffle files of a query at its end, instead of at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage ends there and lost executors lose nothing.

    The tables of a session are removed when the driver process ends, or earlier by ``discard`` and ``stage``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffles of a table again once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or context is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before its scratch tables
        return


def discard(stored: DataFrame) -> None:
    """Delete a table that ``store`` has returned, once nothing will read it again."""
    folders = {file.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for file in stored.inputFiles()}
    for entry in [e for e in _scratch if e[1].split(":", 1)[-1].lstrip("/") in folders]:
        _scratch.remove(entry)
        _delete(*entry)


@contextmanager
def stage() -> Iterator[None]:
    """Delete the tables stored inside it at its end, all but the last one, which is its result."""
    before = set(_scratch)
    yield
    inside = [e for e in _scratch if e not in before]
    for entry in inside[:-1]:
        _scratch.remove(entry)
        _delete(*entry)


def clear_scratch() -> None:
    """Delete every table that ``store`` has written in this process."""
    while _scratch:
        _delete(*_scratch.pop())


atexit.register(clear_scratch)
