"""Mixing sources to target weights by capped water-filling.

Sources share all words by weight; a source is clamped at MAX_EPOCHS times its own
words, and what it cannot take is dealt again to the others by weight until no source
is above its clamp. A source then takes whole repetitions of all its documents and a
seeded sample of them for the fraction that is left.

The sample is drawn without ordering a source in one place. Documents that hold over a
hundredth of their source's words (fewer than a hundred) come first, in seeded order,
up to the word count nearest their share. The rest is dealt into BUCKETS by the same
hash; sums by bucket give each bucket's place, and only inside a bucket are documents
put in order. The cut is made at the document nearest the words still due, so the words
taken miss the target by half of such a small document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import store

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Seeded parts into which every source is dealt; a hot source is spread over as many tasks.
BUCKETS = 4_096
#: Documents above this share of their source's words are drawn first.
LARGE = 0.01
SEED = "mix-1"


def words_of(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, size: Column) -> Column:
    """The seeded place of a document, 60 bits of an MD5, the same on every run."""
    key = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def ranked_sources(sums: DataFrame) -> DataFrame:
    """Sources with their place (0, 1, ...) by code point, null last, numbered range by range."""
    ordered = store(sums.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ordered.join(parts, "part").withColumn("place", F.col("before") + F.row_number().over(inside) - 1).drop("part", "before")


def water_fill(sources: DataFrame, weight: Column, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``, the words each is to give.

    Each round clamps the sources whose share is above their clamp; one row of sums
    reaches the driver per round. Sizes of zero give targets of zero.
    """
    pool = store(sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(max_epochs)), "pool")
    total = pool.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, capped, free = None, 0.0, None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        now_capped, now_free, n = pool.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)), F.count_if(clamped)
        ).first()
        if now_free == 0 or (free is not None and n == free):
            break
        level, capped, free = (total - now_capped) / now_free, now_capped, n
    share = F.lit(0.0) if level is None else F.col("weight") * level
    return pool.withColumn("target", F.least(share, F.col("cap"))).drop("cap", "weight")


def _nearest(ordered: DataFrame, due: Column, before: Column) -> Column:
    """Whether the first documents in order, cut at the nearest word count to ``due``, include this one."""
    return (due > 0) & ((2 * before + F.col("size")) <= 2 * due)


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, repeats, and the columns ``keep``.

    Weights go round the sources by code point, the null source last. ``taken`` is
    ``size`` times ``repeats``, which never exceeds ``max_epochs``; reruns agree.
    Documents without words are taken not at all beyond the whole repetitions. Rows
    with one doc_id and size share their seeded place and are ordered arbitrarily among
    themselves, which changes no sum. Only doc_id, text, source and ``keep`` (names not
    made here) are read, so extra columns cannot clash. Empty tables give an empty result.
    """
    size = words_of(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), *keep).withColumn("place", draw(F.col("doc_id"), F.col("size")))
    rows = store(rows.withColumn("bucket", F.pmod("place", F.lit(BUCKETS))), "sizes")
    sums = store(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = ranked_sources(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    filled = store(water_fill(sources, weight, max_epochs), "targets")
    epochs = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(max_epochs)))
    plan = filled.withColumn("whole", F.floor(epochs + 1e-9)).withColumn("due", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).select("source", "source_size", "target", "whole", "due")
    # The plan of a source travels by (source, bucket), so that the rows of a hot source meet it in many places.
    by_bucket = store(sums.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole", "due"), "plan")
    known = rows.join(by_bucket, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    known = store(known.withColumn("large", F.col("size") > LARGE * F.col("source_size")), "known")

    first = Window.partitionBy("source").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    large = known.filter("large").withColumn("all_large", F.sum("size").over(Window.partitionBy("source")))
    large = large.withColumn("more", _nearest(large, F.col("due") * F.col("all_large") / F.col("source_size"), F.coalesce(F.sum("size").over(first), F.lit(0))))
    large = store(large, "large")
    given = large.groupBy("source").agg(F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("given"))

    small = known.filter(~F.col("large"))
    bucket_sums = small.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket_sums.withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    starts = starts.join(given.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")), "left").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", F.coalesce("given", F.lit(0)).alias("given"))
    placed = small.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    more = _nearest(placed, F.col("due") - F.col("given"), F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    wanted = ("doc_id", "size", "source_size", "target", "whole", "more", *keep)
    done = placed.withColumn("more", more).select(*wanted).unionByName(large.select(*wanted))
    repeats = F.least(F.col("whole") + F.when(F.col("more") & (F.col("size") > 0), 1).otherwise(0), F.lit(max_epochs)).cast("int")
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"), *keep)
