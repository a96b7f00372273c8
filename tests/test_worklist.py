import pytest
from pyspark.sql import functions as F

from vellum.operators.worklist import WorkList
from vellum.sources.buckets import BucketTable


def works(items):
    """Refs that end in 3 never go well, nothing is said of those that end in 4; one that is not asked for is made up."""
    told = items.filter("ref NOT LIKE '%4'").select("ref", (~F.col("ref").endswith("3")).alias("ok"), F.concat(F.lit("v-"), "ref", F.lit("-"), "mode").alias("value"))
    return told.unionByName(items.sparkSession.createDataFrame([("other", True, "x")], "ref string, ok boolean, value string"))


def wanted(spark, refs, mode="missing", targets=("a",)):
    return spark.createDataFrame([(r, list(targets), mode) for r in refs], "ref string, targets array<string>, mode string")


def listed(work):
    return {r.ref: (r.state, tuple(r.targets), r["mode"], r.attempts) for r in work.items.read().collect()}


def results(work):
    return {r.ref: r.value for r in work.results.read().collect()}


def test_steps_failures_and_merged_entries(spark, tmp_path):
    work = WorkList(spark, f"file://{tmp_path}/w", "value string", buckets=2)
    assert work.claim(5) is None and work.resume(works) == 0
    work.add(wanted(spark, ["r1", "r2", "r3", "r4", None]))
    work.add(wanted(spark, ["r2"], "regenerate", ("b",)))
    assert listed(work)["r2"] == ("waiting", ("a", "b"), "missing", 0)
    work.run(work.claim(3), works)
    assert results(work) == {"r1": "v-r1-missing", "r2": "v-r2-missing"}
    assert listed(work) == {"r3": ("failed", ("a",), "missing", 1), "r4": ("waiting", ("a",), "missing", 0)}
    work.drain(works, 10, most_attempts=2)
    assert {k: v[0::3] for k, v in listed(work).items()} == {"r3": ("failed", 2), "r4": ("failed", 2)}
    # What is done may be asked for again, and then counts only if it is done again.
    work.add(wanted(spark, ["r1"], "regenerate"))
    work.run(work.claim(1), lambda items: works(items).withColumn("ok", F.lit(False)))
    assert listed(work)["r1"][0] == "failed" and results(work)["r1"] == "v-r1-missing"
    work.run(work.claim(1), works)
    assert "r1" not in listed(work) and results(work)["r1"] == "v-r1-regenerate"
    assert {r.state: r.n for r in work.counts().collect()} == {"failed": 2}


@pytest.mark.parametrize("dies_at", ["work", "results", "items"])
def test_a_killed_run_goes_on_and_works_nothing_twice(spark, tmp_path, monkeypatch, dies_at):
    path = f"file://{tmp_path}/w"
    work = WorkList(spark, path, "value string", buckets=2)
    work.add(wanted(spark, ["r1", "r2", "r3"]))
    step = work.claim(3)
    calls = []

    def counted(items):
        calls.append(items.count())
        if dies_at == "work" and len(calls) == 1:
            raise RuntimeError("killed")
        return works(items)

    apply = BucketTable.apply

    def killed(self, changes, batch, *rest, **named):
        out = apply(self, changes, batch, *rest, **named) if not (dies_at == "items" and "/items" in self.path) else None
        if dies_at == "results" or out is None:
            raise RuntimeError("killed")
        return out

    with monkeypatch.context() as patch:
        if dies_at != "work":
            patch.setattr(BucketTable, "apply", killed)
        with pytest.raises(RuntimeError):
            work.run(step, counted)
    again = WorkList(spark, path, "value string", buckets=2)
    assert again.open_steps() == [step]
    assert again.resume(counted) == 1 and again.open_steps() == []
    assert len(calls) == (2 if dies_at == "work" else 1)
    assert results(again) == {"r1": "v-r1-missing", "r2": "v-r2-missing"} and listed(again).keys() == {"r3"}
