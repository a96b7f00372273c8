"""Faceted counts of a collection: multi-valued groups, fixed domains, pivots, shares, lists with their tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_VALUE = "(none)"


def values_of(column: Column, missing: str = NO_VALUE) -> Column:
    """The values a record adds to; those without any add to ``missing``. Empty strings are no values."""
    values = F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(missing)))


def count_by(df: DataFrame, values: Column, name: str = "value") -> DataFrame:
    """``name, n``: records per value of an array column; a record counts under each of its values."""
    return df.select(F.explode(values).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def ranked_counts(counts: DataFrame, name: str = "value", last: str = NO_VALUE) -> DataFrame:
    """Counts with ``place``: most first, then by name, the ``last`` value at the end whatever its count.

    Takes aggregated counts: the window runs over one row per value.
    """
    order = Window.orderBy((F.col(name) == last).cast("int"), F.col("n").desc(), F.col(name))
    return counts.withColumn("place", F.row_number().over(order))


def fixed_domain(counts: DataFrame, domain: list[str], name: str = "value") -> DataFrame:
    """Counts of every value of ``domain``, zero where there is none; values outside it follow as they are."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(v, k) for k, v in enumerate(domain)], f"{name} string, place int")
    return known.join(counts, name, "full").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("place", F.lit(len(domain))).alias("place"))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("long")


def status_pivot(df: DataFrame, groups: Column, status: Column, statuses: list[str], done: list[str]) -> DataFrame:
    """One row per group: total, done, share done and a count per status; a record counts in each of its groups."""
    rows = df.select(F.explode(groups).alias("name"), F.coalesce(status, F.lit(NO_VALUE)).alias("status"))
    per = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    counted = rows.groupBy("name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*done)).alias("done"), *per)
    return counted.withColumn("done_percent", percent(F.col("done"), F.col("total")))


def top_with_tail(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows in order, with ``more``: how many rows the list leaves out."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.orderBy(*order).limit(k).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def facet_bundle(df: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """``facet, value, n`` of several facets in one scan and one shuffle; each facet is an array of values."""
    pairs = [_named(name, values) for name, values in facets.items()]
    return df.select(F.inline(F.flatten(F.array(*pairs)))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def _named(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
