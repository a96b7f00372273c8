"""A table kept in buckets by key, changed in place batch by batch: the sink of streams and of incremental views.

A batch rewrites only the buckets that its keys fall into, into a folder of its own, and
then enters them in the log in one file. What the log names is the table, so a batch that
dies half way leaves it as it was, and a batch that comes again is known by its number and
changes nothing. Rewritten folders are left until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.storage import discard, store

LOG_SCHEMA = "batch long, bucket int, folder string"


class BucketTable:
    """Rows by unique ``key`` under ``path``, in a number of buckets fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame:
        """One row per batch and bucket that it has written; a batch without changes has a bucket of -1."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG_SCHEMA)

    def applied(self, batch: int) -> bool:
        return bool(self.log().filter(F.col("batch") == batch).take(1))

    def folders(self, wanted: list[int] | None = None) -> dict[int, str]:
        """Where each bucket is: the folder of the last batch that wrote it; at most one row per bucket reaches the driver."""
        last = self.log().filter("bucket >= 0").groupBy("bucket").agg(F.max_by("folder", "batch").alias("folder")).collect()
        return {r.bucket: r.folder for r in last if r.folder and (wanted is None or r.bucket in wanted)}

    def read(self, wanted: list[int] | None = None) -> DataFrame:
        """The table, or only some of its buckets."""
        paths = [f"{self.path}/{folder}/bucket={bucket}" for bucket, folder in sorted(self.folders(wanted).items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets of the keys of ``changes``; null keys have none."""
        return sorted(r[0] for r in changes.filter(F.col(self.key).isNotNull()).select(self.bucket(self.key)).distinct().collect())

    def _merged(self, buckets: list[int], one: DataFrame, deleted: str | None) -> DataFrame:
        """Buckets with ``one`` row of each changed key, and their number: old and new rows are dealt once, by bucket, and the new row of a key counts."""
        names, gone = self.schema.names, F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        old = self.read(buckets).select(*names, F.lit(False).alias("_gone"), F.lit(0).alias("_new"))
        both = old.unionByName(one.select(*names, gone.alias("_gone"), F.lit(1).alias("_new"))).withColumn("bucket", self.bucket(self.key)).repartition("bucket")
        rest = [c for c in [*names, "_gone"] if c != self.key]
        last = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*rest), "_new").alias("_row"))
        return last.filter("NOT _row._gone").select(*[F.col(c) if c == self.key else F.col(f"_row.{c}").alias(c) for c in names], "bucket")

    def apply(self, changes: DataFrame, batch: int, order: Column | None = None, deleted: str | None = None, unique: bool = False) -> list[int]:
        """Apply ``changes`` as batch number ``batch``; returns the buckets rewritten, none if it was applied before.

        Of rows of one key the last by ``order`` counts (by all columns if it ties or is not
        given); rows whose ``deleted`` is true take their key out. Null keys are left out.
        ``unique`` changes are a stored table with one row per key, which is used as it is.
        """
        if self.applied(batch):
            return []
        columns = [*self.schema.names, *([deleted] if deleted else [])]
        rest = [c for c in columns if c != self.key]
        latest = F.struct(*([order] if order is not None else []), *[F.to_json(F.struct(*rest)) if rest else F.lit("")])
        known = changes.filter(F.col(self.key).isNotNull())
        if unique:
            one = known.select(*columns)
        else:
            known = known.select(self.key, F.struct(*rest).alias("_row"), latest.alias("_order"))
            one = store(known.groupBy(self.key).agg(F.max_by("_row", "_order").alias("_row")).select(self.key, "_row.*").select(*columns), "changes")
        buckets = self.touched(one)
        folder = f"data/batch={batch}-{uuid.uuid4().hex}"
        if buckets:
            self._merged(buckets, one, deleted).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self._enter(batch, buckets, folder)
        if not unique:
            discard(one)
        return buckets

    def _enter(self, batch: int, buckets: list[int], folder: str) -> None:
        """Write the log's entry of a batch: one file, so it is there or it is not."""
        written = set(buckets) - self._emptied(folder, buckets)
        rows = [(batch, b, folder if b in written else "") for b in buckets] or [(batch, -1, "")]
        self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _emptied(self, folder: str, buckets: list[int]) -> set[int]:
        """Buckets of which nothing is left; a batch that writes none of its buckets leaves an empty folder."""
        if not buckets:
            return set()
        held = self.spark.read.schema("bucket int").parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()
        return set(buckets) - {r[0] for r in held}

    def vacuum(self) -> int:
        """Delete the folders that the log no longer needs; returns how many. No batch may run meanwhile."""
        spark, needed = self.spark, set(self.folders().values())
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in system.listStatus(where) if f"data/{s.getPath().getName()}" not in needed] if system.exists(where) else []
        for path in gone:
            system.delete(path, True)
        return len(gone)


def drain_into(stream: DataFrame, table: BucketTable, checkpoint: str, order: Column | None = None, deleted: str | None = None) -> None:
    """Apply all that a stream has, batch by batch; a restart goes on after the last batch that the checkpoint or the log knows."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: table.apply(batch, number, order, deleted)).start().awaitTermination()


class CountView:
    """How many notes name each key, kept up to date by the changed notes alone.

    Two tables: the keys of every note, and of every key how many notes name it and how
    often. A batch reads the buckets of its own notes, takes the difference between their old
    and new keys, and adds it to the buckets of the keys in which anything differs. A key that
    no note names any more stays, as an orphan with counts of 0.
    """

    def __init__(self, spark: SparkSession, path: str, note_type: str = "bigint", buckets: int = 64):
        self.notes = BucketTable(spark, f"{path}/notes", f"note {note_type}, keys array<string>", "note", buckets)
        self.counts = BucketTable(spark, f"{path}/counts", "key string, n_notes bigint, n_mentions bigint", "key", buckets)

    @staticmethod
    def _mentions(notes: DataFrame, sign: int) -> DataFrame:
        keys = notes.select("note", F.explode("keys").alias("key")).filter("key IS NOT NULL").groupBy("note", "key").agg(F.count(F.lit(1)).alias("times"))
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_notes"), F.sum("times").alias("n_mentions")).select("key", (F.col("n_notes") * sign).alias("n_notes"), (F.col("n_mentions") * sign).alias("n_mentions"))

    def apply(self, changes: DataFrame, batch: int) -> tuple[list[int], list[int]]:
        """Apply changed notes (note, keys, deleted; one row per note, null keys are none); returns the buckets of both tables rewritten.

        The counts go first, from the notes as they were: a batch that dies between the two
        comes again, finds its counts applied, and only enters its notes.
        """
        changed = store(changes.select("note", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"), F.coalesce("deleted", F.lit(False)).alias("deleted")).filter("note IS NOT NULL"), "notes")
        counts: list[int] = []
        if not self.counts.applied(batch):
            old = self.notes.read(self.notes.touched(changed)).join(changed.select("note"), "note", "left_semi")
            both = self._mentions(old, -1).unionByName(self._mentions(changed.filter("NOT deleted"), 1))
            delta = store(both.groupBy("key").agg(F.sum("n_notes").alias("n_notes"), F.sum("n_mentions").alias("n_mentions")).filter("n_notes <> 0 OR n_mentions <> 0"), "delta")
            before = self.counts.read(self.counts.touched(delta)).join(delta.select("key"), "key", "left_semi")
            after = before.unionByName(delta).groupBy("key").agg(F.sum("n_notes").alias("n_notes"), F.sum("n_mentions").alias("n_mentions"))
            after = store(after, "after")
            counts = self.counts.apply(after, batch, unique=True)
            discard(delta)
            discard(after)
        notes = self.notes.apply(changed, batch, deleted="deleted", unique=True)
        discard(changed)
        return notes, counts

    def read(self) -> DataFrame:
        """``key, n_notes, n_mentions, orphan``."""
        return self.counts.read().withColumn("orphan", F.col("n_notes") == 0)


def rebuilt(batches: list[DataFrame]) -> DataFrame:
    """What the view holds after all ``batches`` in order, from the notes anew: the twin that reads everything."""
    every = batches[0].withColumn("_batch", F.lit(0))
    for number, batch in enumerate(batches[1:], 1):
        every = every.unionByName(batch.withColumn("_batch", F.lit(number)))
    last = every.filter("note IS NOT NULL").withColumn("_last", F.row_number().over(Window.partitionBy("note").orderBy(F.col("_batch").desc())) == 1)
    mentioned = last.select("note", "_last", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.explode("keys").alias("key")).filter("key IS NOT NULL")
    per_note = mentioned.filter("NOT deleted").groupBy("key", "note").agg(F.count_if("_last").alias("times"))
    counts = per_note.groupBy("key").agg(F.count_if(F.col("times") > 0).alias("n_notes"), F.sum("times").alias("n_mentions"))
    return counts.withColumn("orphan", F.col("n_notes") == 0)
