"""Sinks that change only what differs: upserts by key, writes by content, tables of history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """``target`` with ``changes`` (one per key) applied: equal keys are replaced, new ones added, deleted ones left out."""
    columns = target.columns
    gone = F.coalesce(F.col(f"c.{deleted}"), F.lit(False)) if deleted else F.lit(False)
    joined = target.alias("t").join(changes.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "full")
    changed = F.col(f"c.{key}").isNotNull()
    return joined.filter(~gone).select(*[F.when(changed, F.col(f"c.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def changed_only(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that ``old`` lacks or has with other content."""
    content = lambda df: F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in sorted(df.columns)])), 256)
    known = old.select(F.col(key).alias("_key"), content(old).alias("_content"))
    return new.withColumn("_content", content(new)).alias("n").join(known.alias("o"), (F.col(f"n.{key}") == F.col("o._key")) & (F.col("n._content") == F.col("o._content")), "left_anti").drop("_content")


def with_history(current: DataFrame, history: DataFrame, changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Current rows after the changes, and the history with the rows that were overwritten."""
    replaced = current.join(changes.select(key), key, "left_semi")
    newer = upsert(current, changes, key)
    return newer, history.unionByName(replaced).dropDuplicates([key, version])


def write_csv(lines: DataFrame, path: str, header: str) -> None:
    """Write formatted lines (column ``line``) as CSV text that begins with a byte order mark and the header.

    The files of the folder, in order of their names, are one CSV file cut in parts; the
    first part is the header.
    """
    first = lines.sparkSession.createDataFrame([("\ufeff" + header,)], "line string").coalesce(1)
    first.union(lines.select("line")).write.option("lineSep", "\r\n").mode("overwrite").text(path)
