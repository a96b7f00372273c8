"""State that changes from run to run: pending failures, digests, undo, tombstones, ticked lists, numbering, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import ship
from vellum.storage import store


def last_matching(messages: DataFrame, matches: Column, order: str, most: int) -> DataFrame:
    """The last ``most`` messages that match, in order."""
    return messages.filter(F.coalesce(matches, F.lit(False))).orderBy(F.col(order).desc()).limit(most).orderBy(order)


def all_match(rows: DataFrame, value: Column, wanted: str, *groups: str) -> DataFrame:
    """Per group: whether there are values and every one of them is ``wanted``; nulls and blanks are no values."""
    given = F.when(F.trim(value) != "", F.trim(value))
    return rows.groupBy(*groups).agg(F.coalesce(F.every(given == wanted), F.lit(False)).alias("all_match"))


def meaning_groups(marks: DataFrame, meanings: list[tuple[str, str]], color: str, *groups: str, other: str = "other") -> DataFrame:
    """Marks counted by the meaning of their colour: ``place`` (order as configured, others last), ``meaning``, ``marks``; only groups with marks."""
    spark = marks.sparkSession
    known = spark.createDataFrame([(c.lower(), k, m) for k, (c, m) in enumerate(meanings)], "_color string, place int, meaning string")
    joined = marks.join(F.broadcast(known), F.lower(color) == F.col("_color"), "left")
    return joined.groupBy(*groups, F.coalesce("place", F.lit(len(meanings))).alias("place"), F.coalesce("meaning", F.lit(other)).alias("meaning")).agg(F.count(F.lit(1)).alias("marks"))


def preset_differences(switches: DataFrame, value: str, presets: list[str]) -> DataFrame:
    """Per preset (a column of ``switches`` each): how many switches differ, and whether it is the nearest; ties to the first."""
    counts = switches.agg(*[F.count_if(~F.col(value).eqNullSafe(F.col(p))).alias(p) for p in presets])
    rows = counts.select(F.posexplode(F.array(*[F.struct(F.lit(p).alias("preset"), F.col(p).alias("differs")) for p in presets])).alias("place", "_p"), F.array_position(F.array(*presets), F.least(*presets) if len(presets) > 1 else F.col(presets[0])).alias("_best"))
    return rows.select("_p.preset", "_p.differs", (F.col("place") + 1 == F.col("_best")).alias("nearest"))


def merge_failures(pending: DataFrame, failed: DataFrame) -> DataFrame:
    """Pending work (ref, targets, action) with what failed now: one row per ref; targets united, actions that clash are "missing"."""
    every = pending.select("ref", "targets", "action").unionByName(failed.select("ref", "targets", "action"))
    united = F.array_sort(F.array_distinct(F.flatten(F.collect_set("targets"))))
    return every.groupBy("ref").agg(united.alias("targets"), F.when(F.min("action") == F.max("action"), F.min("action")).otherwise(F.lit("missing")).alias("action"))


def merge_digest(listed: DataFrame, found: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Lines of a digest with new ones behind them: a key that is listed anywhere is not listed again; of new ones the first in order is taken."""
    first = Window.partitionBy(key).orderBy(order, group)
    fresh = found.join(listed.select(key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return listed.select(group, key, order, F.lit(False).alias("new")).unionByName(fresh.select(group, key, order, F.lit(True).alias("new")))


def stale_files(files: DataFrame, kept: DataFrame, pattern: str = r"^([0-9A-Z]{8})-([0-9A-Z]{8})\.png$") -> DataFrame:
    """Files named by the pattern (owner, part) whose owner has rows in ``kept`` (owner, part) but not this part. Files of other names are no one's."""
    named = files.select("file", F.regexp_extract("file", pattern, 1).alias("owner"), F.regexp_extract("file", pattern, 2).alias("part")).filter("owner <> ''")
    return named.join(kept.select("owner").distinct(), "owner", "left_semi").join(kept.select("owner", "part").distinct(), ["owner", "part"], "left_anti").select("file", "owner", "part")


def undo(memberships: DataFrame, added: DataFrame, created: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run did is taken back: memberships (container, item) without the added ones, and the created containers with ``deleted``.

    A created container goes unless it, or something below it, still has items or was
    not created by the run: whatever must stay keeps everything above it.
    ``containers`` is the tree (key, parent), which is climbed level by level until no container is new.
    """
    left = memberships.join(added.select("container", "item").distinct(), ["container", "item"], "left_anti")
    made = created.select("key").distinct()
    filled = left.select(F.col("container").alias("key")).distinct()
    stays = containers.select("key").join(made, "key", "left_anti").unionByName(filled).distinct()
    parents = containers.filter("parent IS NOT NULL").select("key", "parent")
    level = store(stays, "stays")
    above = level
    while level.limit(1).count():
        level = store(parents.join(level, "key").select(F.col("parent").alias("key")).distinct().join(above, "key", "left_anti"), "stays")
        above = above.unionByName(level)
    above = above.withColumn("stays", F.lit(True))
    return left, made.join(above, "key", "left").select("key", F.col("stays").isNull().alias("deleted"))


def tombstones(notes: DataFrame, deleted: DataFrame, now: Column, status: str = "deleted") -> DataFrame:
    """Notes (key, status, before, deleted_at) marked where their source is gone, and restored where a mark has its source back.

    A mark keeps the status before and the time of the first mark; marking twice changes nothing.
    """
    joined = notes.join(deleted.select("key", F.lit(True).alias("_gone")).distinct(), "key", "left")
    gone, marked = F.coalesce("_gone", F.lit(False)), F.col("deleted_at").isNotNull()
    before = F.when(F.col("status") != status, F.col("status"))
    return joined.select(
        "key",
        F.when(gone, F.lit(status)).when(marked & (F.col("status") == status), F.col("before")).otherwise(F.col("status")).alias("status"),
        F.when(gone, F.when(marked, F.col("before")).otherwise(before)).alias("before"),
        F.when(gone, F.coalesce("deleted_at", now)).alias("deleted_at"),
    )


def ticked(lines: DataFrame, doc: str, order: str, line: str = "line") -> DataFrame:
    """Ticked lines of lists that link a DOI or PubMed id, the first per document and id: doc, ``key``, ``title`` (the words in bold)."""
    text = F.col(line)
    doi = F.lower(F.regexp_replace(F.regexp_extract(text, r"(?i)https?://(?:dx\.)?doi\.org/(10\.\d{4,9}/[^\s)>\]]+)", 1), r"[.,;:]+$", ""))
    pmid = F.regexp_extract(text, r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,9})", 1)
    key = F.when(doi != "", F.concat(F.lit("doi:"), doi)).when(pmid != "", F.concat(F.lit("pmid:"), pmid))
    rows = lines.filter(text.rlike(r"^[ \t]*[-*+][ \t]+\[[xX]\][ \t]+")).select(doc, order, key.alias("key"), F.regexp_replace(F.regexp_extract(text, r"\*\*(.+?)\*\*", 1), r"\\(.)", "$1").alias("title")).filter("key IS NOT NULL")
    first = Window.partitionBy(doc, "key").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def settled(requests: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """Each request of a batch (ref, done) with ``outcome``: gone, skipped (done before), ok, failed or missing (no result)."""
    best = results.groupBy("ref").agg(F.min(F.when(F.col("type") == "succeeded", "ok").otherwise("zfailed")).alias("_result"))
    alive = items.select("ref", F.lit(True).alias("_alive")).distinct()
    joined = requests.join(alive, "ref", "left").join(best, "ref", "left")
    outcome = F.when(F.col("_alive").isNull(), "gone").when(F.col("done"), "skipped").when(F.col("_result") == "ok", "ok").when(F.col("_result").isNotNull(), "failed").otherwise("missing")
    return joined.select("ref", outcome.alias("outcome"))


def by_language(sources: DataFrame, chinese: Column, order: str) -> DataFrame:
    """Search sources (lang zh, en or any) with ``place``: those of the query's language first, then as configured."""
    rank = F.when(chinese, F.when(F.col("lang") == "zh", 0).when(F.col("lang") == "en", 2).otherwise(1)).otherwise(F.when(F.col("lang").isin("en", "any"), 0).otherwise(1))
    return sources.withColumn("place", F.row_number().over(Window.orderBy(rank, order)))


class Numbering:
    """Numbers of list items that may start again at one: the count goes on, unless the list returns to it by itself."""

    def __init__(self) -> None:
        self.offset, self.last_raw, self.last = 0, None, 0

    def next(self, number: int, lettered: bool) -> int:
        restarted = self.last_raw is not None and (number < self.last_raw or (number == self.last_raw and not lettered))
        if restarted:
            self.offset = self.last
        elif self.offset and number in (self.last, self.last + 1):
            self.offset = 0
        self.last_raw, self.last = number, number + self.offset
        return self.last


class Budget:
    """Takes entries in turn while their number, each one's size and the sum of sizes stay within limits; what does not fit is passed over."""

    def __init__(self, count: int, each: int, total: int) -> None:
        self.count, self.each, self.total, self.taken, self.used = count, each, total, 0, 0

    def takes(self, size: int | None) -> bool:
        if size is None or self.taken >= self.count or size > self.each or self.used + size > self.total:
            return False
        self.taken, self.used = self.taken + 1, self.used + size
        return True


def stepwise(rows: DataFrame, group: str, order: str | tuple[str, ...], schema: str, start, step) -> DataFrame:
    """``rows`` with the column ``schema`` that ``step(state, row)`` gives to the rows of a group in order.

    A group's rows stream through one task in sorted order, with a state of fixed size; no group is held whole.
    """
    name = schema.split()[0]
    rows = rows.drop(name)
    whole = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for batch in batches:
            values = []
            for key, row in zip(batch[group], batch.itertuples(index=False), strict=True):
                if key != now:
                    now, state = key, start()
                values.append(step(state, row))
            yield batch.assign(**{name: values})

    return rows.repartition(group).sortWithinPartitions(group, *((order,) if isinstance(order, str) else order)).mapInPandas(run, whole)


def numbered(items: DataFrame, group: str, order: str) -> DataFrame:
    """List items (number, letter) with ``n``, their number in the whole list. Rows need a group, an order and a number."""
    return stepwise(items.filter(f"{group} IS NOT NULL AND number IS NOT NULL"), group, order, "n long", Numbering, lambda state, row: state.next(int(row.number), bool(row.letter)))


def within_budget(entries: DataFrame, group: str, order: str, count: int, each: int, total: int) -> DataFrame:
    """Entries (size) with ``taken``: chosen in order under limits on number, single size and total size. A null size is never taken."""
    known = entries.filter(f"{group} IS NOT NULL").withColumn("size", F.coalesce("size", F.lit(each + 1)).cast("long"))
    return stepwise(known, group, order, "taken boolean", lambda: Budget(count, each, total), lambda state, row: state.takes(int(row.size)))


ship(__name__)
