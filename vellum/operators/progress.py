"""Facts of periods from what was logged: how things stood when a period began and ended, and what changed in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.storage import store


def as_of(rows: DataFrame, facts: DataFrame, key: str, time: str, values: list[str], before: bool = False) -> DataFrame:
    """``rows`` with ``values`` and ``fact_time`` of the last of ``facts`` of their key at their time, or strictly ``before`` it; nulls where there is none.

    Both are put in one order of key and time and the last fact is carried on, so a key of
    any size is sorted, not joined with itself. Of facts at one time the largest by ``values``
    counts. Rows without a key or a time get nulls.
    """
    fields = [f.name for f in rows.schema]
    fact = F.struct(F.col(time).alias("fact_time"), *values)
    # At one time facts come before rows, or after them where only earlier ones count.
    left = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(0 if before else 1).alias("_side"), F.struct(*fields).alias("_row"), F.lit(None).cast(_kind(facts, fact)).alias("_fact"))
    right = facts.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1 if before else 0).alias("_side"), F.lit(None).cast(_kind(rows, F.struct(*fields))).alias("_row"), fact.alias("_fact"))
    order = Window.partitionBy("_k").orderBy("_t", "_side", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last("_fact", ignorenulls=True).over(order)
    carried = left.unionByName(right).withColumn("_known", F.when(F.col("_k").isNotNull() & F.col("_t").isNotNull(), known)).filter("_row IS NOT NULL")
    return carried.select("_row.*", "_known.fact_time", *[F.col(f"_known.{v}").alias(v) for v in values])


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def days_of(periods: DataFrame) -> DataFrame:
    """``day, period`` of the days of periods (period, start, end), both ends counted; periods may overlap."""
    return periods.filter("start <= end").select("period", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("day"))


def status_changes(log: DataFrame, periods: DataFrame) -> DataFrame:
    """``period, key, before, after, entries``: keys that end a period in another status than they began it in, from the log (key, at, old, new)."""
    dated = log.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("day", F.to_date("at")).join(days_of(periods), "day")
    order = F.struct("at", F.coalesce("new", F.lit("")))
    both = dated.groupBy("period", "key").agg(F.min_by("old", order).alias("before"), F.max_by("new", order).alias("after"), F.count(F.lit(1)).alias("entries"))
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def snapshot_changes(snapshots: DataFrame, periods: DataFrame, values: list[str]) -> DataFrame:
    """``review, period`` with each of ``values`` at the period's end and, as ``<value>_change``, its difference from the last snapshot before the period.

    A review has a row for every period that ends after its first snapshot; differences
    from no snapshot are null.
    """
    first = snapshots.filter("review IS NOT NULL AND at IS NOT NULL").groupBy("review").agg(F.min("at").alias("first"))
    every = F.expr("array_agg(struct(period, start, end))")
    asked = first.join(F.broadcast(periods.agg(every.alias("p"))), F.lit(True)).select("review", "first", F.explode("p").alias("p")).select("review", "first", "p.*")  # one row that holds the stated periods
    ends = asked.withColumn("at", F.date_add(F.col("end").cast("date"), 1).cast("timestamp")).filter(F.col("first") < F.col("at")).drop("first")
    now = as_of(ends, snapshots, "review", "at", values, before=True).drop("fact_time", "at")
    now = now.withColumnsRenamed({v: f"{v}_now" for v in values}).withColumn("at", F.col("start").cast("date").cast("timestamp"))
    then = as_of(now, snapshots, "review", "at", values, before=True)
    return then.select("review", "period", *[F.col(f"{v}_now").alias(v) for v in values], *[(F.col(f"{v}_now") - F.col(v)).alias(f"{v}_change") for v in values])


def totals_by_period(versions: DataFrame, periods: DataFrame) -> DataFrame:
    """``period, total, change, updated`` over all drafts (versions: draft, at, words): words when the period ended, their change in it, drafts with a version in it.

    A version is turned into its difference from the one before it; the differences are
    summed by day, and only days, not drafts, are put in one order.
    """
    known = versions.filter("draft IS NOT NULL AND at IS NOT NULL").withColumn("words", F.coalesce("words", F.lit(0)))
    order = Window.partitionBy("draft").orderBy("at", "words")
    steps = store(known.select("draft", F.to_date("at").alias("day"), (F.col("words") - F.coalesce(F.lag("words").over(order), F.lit(0))).alias("step")), "steps")
    days = steps.groupBy("day").agg(F.sum("step").alias("step"))
    calendar = days.withColumn("total", F.sum("step").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # one row per day
    one = calendar.select(F.lit(1).alias("k"), F.col("day").alias("at"), "total")
    at_end = as_of(periods.select(F.lit(1).alias("k"), "period", F.col("start"), F.col("end").cast("date").alias("at")), one, "k", "at", ["total"]).drop("fact_time", "at").withColumnRenamed("total", "total_now")
    both = as_of(at_end.withColumn("at", F.col("start").cast("date")), one, "k", "at", ["total"], before=True)
    updated = steps.join(days_of(periods), "day").groupBy("period").agg(F.count_distinct("draft").alias("updated"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.join(updated, "period", "left").select("period", zero("total_now").alias("total"), (zero(F.col("total_now")) - zero(F.col("total"))).alias("change"), zero("updated").alias("updated"))


def dated_counts(items: DataFrame, periods: DataFrame, fields: list[str]) -> DataFrame:
    """``period`` with, of each date field, how many items have it in the period; periods without any have zeros."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.to_date(F.col(f)).alias("day")) for f in fields]))
    rows = items.select(each.alias("d")).select("d.*").filter("day IS NOT NULL").groupBy("day", "field").agg(F.count(F.lit(1)).alias("n"))
    summed = days_of(periods).join(rows, "day").groupBy("period").agg(*[F.sum(F.when(F.col("field") == f, F.col("n")).otherwise(0)).alias(f) for f in fields])
    return periods.select("period").join(summed, "period", "left").select("period", *[F.coalesce(f, F.lit(0)).alias(f) for f in fields])
