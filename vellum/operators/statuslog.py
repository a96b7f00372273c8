"""Append-only status log, merge of sides, differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_KEY, MAX_ENTRIES, MAX_DAYS = 20, 3_000, 730


def appended(changes: DataFrame) -> DataFrame:
    """Changes (key, seq, date, old, new) that enter the log: not empty, not unchanged, and not to where the last one went."""
    order = Window.partitionBy("key").orderBy("seq")
    real = changes.filter((F.coalesce("new", F.lit("")) != "") & ~F.col("new").eqNullSafe(F.col("old")))
    return real.withColumn("last", F.lag("new").over(order)).filter(~F.col("new").eqNullSafe(F.col("last"))).drop("last")


def capped(log: DataFrame, today: Column, per_key: int = PER_KEY, entries: int = MAX_ENTRIES, days: int = MAX_DAYS) -> DataFrame:
    """The newest entries of each key, none older than ``days``, and of those the newest ``entries`` by date.

    A ranked limit over all keys is the feature; it is taken by partial limits, never by one sort of the log.
    """
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    first = Window.partitionBy("key").orderBy("seq")
    kept = log.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= per_key).withColumn("_i", F.row_number().over(first))
    fresh = kept.filter(F.col("date") >= F.date_sub(today, days))
    return fresh.orderBy(F.col("date").desc(), F.col("_i").desc(), "key").limit(entries).drop("_n", "_i")


def reading_changes(log: DataFrame, start: Column, end: Column, done: list[str]) -> DataFrame:
    """``key, date, old, new``: per key the last change in the period if it went to a done status, from where its first change began."""
    within = log.filter(F.col("date").between(start, end))
    ends = within.groupBy("key").agg(F.max_by(F.struct("date", "new"), "seq").alias("last"), F.min_by("old", "seq").alias("old"))
    return ends.select("key", "last.date", "old", "last.new").filter(F.col("new").isin(*done))


def previous_date(dates: DataFrame, date: Column) -> DataFrame:
    """The latest date before the given one, in one row."""
    return dates.filter(F.col("date") < date).agg(F.max("date").alias("previous"))


def keep_last(history: DataFrame, n: int, order: str = "date", *keys: str) -> DataFrame:
    """The newest ``n`` entries per key."""
    return history.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_n") <= n).drop("_n")


def merge_status(base: Column, sides: dict[str, Column], default: str, deleted: str = "deleted") -> Column:
    """Struct of value, source, conflict and the sides to write, from sides in order of priority.

    A null side takes no part. A side has changed if it has a status other than the base;
    the first changed side wins, and two different changes are a conflict. Without a
    change the base stays, or the default where there is none. ``deleted`` counts as none.
    """
    clean = lambda c: F.when(F.trim(c) == deleted, "").otherwise(F.coalesce(F.trim(c), F.lit("")))
    old = clean(base)
    each = F.array(*[F.struct(F.lit(name).alias("side"), clean(c).alias("status"), F.trim(c).alias("raw")) for name, c in sides.items()])
    present = F.filter(each, lambda s: s["raw"].isNotNull())
    changed = F.filter(present, lambda s: (s["status"] != "") & (s["status"] != old))
    first = F.try_element_at(changed, F.lit(1))
    value = F.coalesce(first["status"], F.when(old != "", old).otherwise(default))
    return F.struct(
        value.alias("value"),
        F.coalesce(first["side"], F.when(old != "", "base").otherwise("default")).alias("source"),
        (F.size(F.array_distinct(F.transform(changed, lambda s: s["status"]))) > 1).alias("conflict"),
        F.array_join(F.transform(F.filter(present, lambda s: s["raw"] != value), lambda s: s["side"]), ",").alias("writes"),
    )


def reconcile(items: DataFrame, notes: DataFrame, pages: DataFrame, bases: DataFrame, default: str) -> DataFrame:
    """Statuses of live items merged over their sides: key, value, source, conflict, writes.

    ``items`` (key, status, deleted) take part where they have a note (key, status, path)
    or a page of a remote table (key, status, pos); of several the first by path or pos
    counts, of ties the least status. A note goes before the library, the library before the table. ``bases`` (key,
    base) has what all sides agreed on last.
    """
    first = lambda order, name: F.min(F.struct(F.col(order), F.coalesce("status", F.lit("")).alias("status")))["status"].alias(name)
    note = notes.groupBy("key").agg(first("path", "_note"))
    page = pages.groupBy("key").agg(first("pos", "_page"))
    live = items.filter(~F.coalesce(F.col("deleted"), F.lit(False))).select("key", F.coalesce("status", F.lit("")).alias("_item"))
    joined = live.join(note, "key", "left").join(page, "key", "left").filter("_note IS NOT NULL OR _page IS NOT NULL").join(bases.select("key", F.col("base").alias("_base")), "key", "left")
    merged = merge_status(F.col("_base"), {"notes": F.col("_note"), "library": F.col("_item"), "table": F.col("_page")}, default)
    return joined.select("key", merged.alias("_m")).select("key", "_m.*")


def new_bases(bases: DataFrame, merged: DataFrame, failed: DataFrame) -> DataFrame:
    """Bases after a pass (key, base): the merged value where no side of the key failed to be written (key, side), else as before."""
    bad = failed.select("key").distinct()
    good = merged.join(bad, "key", "left_anti").select("key", F.col("value").alias("_new"))
    return bases.select("key", "base").join(good, "key", "full").select("key", F.coalesce("_new", "base").alias("base"))


def snapshot_diff(now: DataFrame, before: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``now`` with ``d_<measure>``: the change since the snapshot; null where either side has no value."""
    old = before.select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    joined = now.join(old, keys, "left")
    return joined.select(*keys, *measures, *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in measures])
