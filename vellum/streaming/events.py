"""Incremental operators as Structured Streaming queries; each has a batch twin with the same result.

``run_available`` drains a file source once, into a table in the shared folder, so that a
stream can be compared with its twin. State is kept per key and bounded per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.session import ship
from vellum.storage import shared_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, its time with a zone (watermarks need one)."""
    folder = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, then give the result as a table.

    Complete and update results go through foreachBatch; of an updated key the last batch counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    else:
        writer.foreachBatch(lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of events per user: a burst ends after a quiet gap (debounce)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def monthly_ledger(events: DataFrame) -> DataFrame:
    """Calls and units per month and type; months are no fixed windows, so they are grouped by their first day."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("event_id") % 100).alias("units"))


def _log(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Log entries of a key: not empty, not unchanged, not to where the last one went."""
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    changed = rows[rows["new"].fillna("").ne("") & rows["new"].ne(rows["old"])]
    # What repeats the entry before it is dropped, so the row before always holds the last status.
    kept = changed[changed["new"].ne(changed["new"].shift(fill_value=last))]
    state.update((kept["new"].iloc[-1] if len(kept) else last,))
    yield kept.assign(key=key[0])[["key", "seq", "old", "new"]]


def status_log(changes: DataFrame) -> DataFrame:
    """Streaming append with de-duplication per key; the state of a key is its last status."""
    return changes.groupBy("key").applyInPandasWithState(_log, "key long, seq long, old string, new string", "last string", "append", GroupStateTimeout.NoTimeout)


def unseen_ids(found: DataFrame) -> DataFrame:
    """``watch, id`` the first time that a watch finds an id; every id is remembered, in the state store."""
    return found.select("watch", "id").dropDuplicates(["watch", "id"])


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Of each key the row of the last batch."""
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def suppress_own(events: DataFrame, own: DataFrame, seconds: int = 16) -> DataFrame:
    """Events that do not follow a write of one's own to the same key within some seconds."""
    near = (F.col("e.key") == F.col("o.key")) & F.col("e.ts").between(F.col("o.ts"), F.col("o.ts") + F.make_dt_interval(secs=F.lit(seconds)))
    return events.alias("e").join(own.alias("o"), near, "left_anti")


def plan_watch(seen: DataFrame, queued: DataFrame, found: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What a saved search takes now, and what waits: queued ids first, then new ones, none seen before, ``most`` per watch."""
    ranked = lambda rows, rank, pos: rows.select("watch", "id", pos, F.lit(rank).alias("rank"))
    known = ranked(seen.filter("watch IS NOT NULL AND id IS NOT NULL"), -1, F.lit(None).alias("pos"))
    every = ranked(queued, 0, F.col("pos")).unionByName(ranked(found, 1, F.col("pos"))).unionByName(known)
    # Dealt before it is summed: a table of all ids that a task has read would grow with the task; one sort then tells seen ids and first places.
    fresh = every.repartition("watch", "id").groupBy("watch", "id").agg(F.min(F.struct("rank", "pos")).alias("o")).filter("o.rank >= 0")
    placed = fresh.withColumn("n", F.row_number().over(Window.partitionBy("watch").orderBy("o", "id")))
    return placed.filter(F.col("n") <= most).select("watch", "id", "n"), placed.filter(F.col("n") > most).select("watch", "id", "n")


ship(__name__)
