"""A list of work that outlives the run: items are claimed in steps, and what a step has done is entered once.

Two bucketed tables hold the list and the results. Every change of them is a numbered batch
of their logs, so a run that is killed at any point can be taken up again: a step whose
results are entered is not worked again, and one that is not is worked from its claim.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.buckets import BucketTable
from vellum.storage import discard, store

ITEM = "ref string, state string, targets array<string>, mode string, step bigint, attempts int"
WAITING, CLAIMED, FAILED = "waiting", "claimed", "failed"
#: What two different modes of one item become: nothing that is there is made again.
CAREFUL = "missing"


class WorkList:
    """Items by ref. ``work`` takes claimed items (ref, targets, mode, attempts) and gives ref, ok and the columns of ``result``."""

    def __init__(self, spark: SparkSession, path: str, result: str, buckets: int = 16):
        self.items = BucketTable(spark, f"{path}/items", ITEM, "ref", buckets)
        self.results = BucketTable(spark, f"{path}/results", f"ref string, step bigint, {result}", "ref", buckets)
        self.columns = [c for c in self.results.schema.names if c not in ("ref", "step")]

    def _next(self) -> int:
        last = self.items.log().agg(F.max("batch").alias("b")).first()["b"]
        return 0 if last is None else last + 1

    def add(self, wanted: DataFrame) -> None:
        """Enter items (ref, targets, mode). One that is on the list keeps its state; its targets are joined, and differing modes become CAREFUL."""
        new = wanted.filter("ref IS NOT NULL").groupBy("ref").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"), F.when(F.count_distinct("mode") > 1, CAREFUL).otherwise(F.min("mode")).alias("mode"))
        old = self.items.read(self.items.touched(new)).alias("o")
        both = new.alias("n").join(old, F.col("n.ref") == F.col("o.ref"), "left")
        known = F.col("o.ref").isNotNull()
        targets = F.array_sort(F.array_union(F.col("n.targets"), F.coalesce("o.targets", F.array().cast("array<string>"))))
        mode = F.when(known & ~F.col("o.mode").eqNullSafe(F.col("n.mode")), CAREFUL).otherwise(F.col("n.mode"))
        merged = both.select("n.ref", F.coalesce("o.state", F.lit(WAITING)).alias("state"), targets.alias("targets"), mode.alias("mode"), "o.step", F.coalesce("o.attempts", F.lit(0)).alias("attempts"))
        stored = store(merged, "added")
        self.items.apply(stored, self._next())
        discard(stored)

    def claim(self, count: int, most_attempts: int | None = None) -> int | None:
        """Claim the next ``count`` items, those tried least first; the number of the step, or None where nothing waits that may be tried again."""
        number = self._next()
        order = ["attempts", "ref"]
        free = store(self.items.read().filter(F.col("state").isin(WAITING, FAILED) & (F.lit(True) if most_attempts is None else F.col("attempts") < most_attempts)).orderBy(*order).limit(count), "claimed")
        if free.isEmpty():
            return None
        self.items.apply(free.withColumn("state", F.lit(CLAIMED)).withColumn("step", F.lit(number).cast("bigint")), number)
        discard(free)
        return number

    def open_steps(self) -> list[int]:
        """Steps that were claimed and not finished, as after a killed run."""
        return sorted(r[0] for r in self.items.read().filter(F.col("state") == CLAIMED).select("step").distinct().collect())

    def run(self, step: int, work: Callable[[DataFrame], DataFrame]) -> None:
        """Work a claimed step and enter what came of it; what an earlier run of the step has entered is not worked again.

        Items that went well leave the list; those that did not, or of which ``work`` says
        nothing, are failed and wait behind the others.
        """
        claimed = self.items.read().filter((F.col("state") == CLAIMED) & (F.col("step") == step))
        if not self.results.applied(step):
            outcome = store(work(claimed.select("ref", "targets", "mode", "attempts")), "outcome")
            good = outcome.filter(F.coalesce("ok", F.lit(False))).select("ref", *self.columns)
            self.results.apply(good.join(claimed.select("ref"), "ref", "left_semi").withColumn("step", F.lit(step).cast("bigint")), step)
            discard(outcome)
        # An item that an earlier step has done and that was added again is done only if this step has done it.
        done = self.results.read(self.results.touched(claimed)).filter(F.col("step") == step).select("ref", F.lit(True).alias("done"))
        entered = claimed.join(done, "ref", "left").withColumn("gone", F.coalesce("done", F.lit(False))).drop("done")
        finished = store(entered.withColumn("state", F.lit(FAILED)).withColumn("attempts", F.col("attempts") + 1).withColumn("step", F.lit(None).cast("bigint")), "finished")
        self.items.apply(finished, self._next(), deleted="gone")
        discard(finished)

    def resume(self, work: Callable[[DataFrame], DataFrame]) -> int:
        """Finish the steps that a killed run has left open; how many there were."""
        steps = self.open_steps()
        for step in steps:
            self.run(step, work)
        return len(steps)

    def drain(self, work: Callable[[DataFrame], DataFrame], count: int, most_attempts: int = 3) -> None:
        """Resume, then claim and work until nothing waits that has been tried less than ``most_attempts`` times."""
        self.resume(work)
        while (step := self.claim(count, most_attempts)) is not None:
            self.run(step, work)

    def counts(self) -> DataFrame:
        """``state, n`` of the items on the list."""
        return self.items.read().groupBy("state").agg(F.count(F.lit(1)).alias("n"))
