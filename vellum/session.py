"""Session factory and table access shared by queries, bench and tests."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Settings every entry point relies on; a cluster may override all others.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "vellum", **conf: str) -> SparkSession:
    """A session with the defaults above; extra settings win. Keys use '__' for '.'."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``, read through Spark's own readers."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, four tasks for each: a small file has few splits, whatever the work on a row costs."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def ship(module: str) -> None:
    """Send the functions of a module by value, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
