import pytest
from pyspark.sql import functions as F

from vellum.sources import buckets
from vellum.sources.buckets import BucketTable, CountView


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_upserts_rewrite_only_touched_buckets_and_come_once(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "id long, v string", "id", buckets=8)
    schema = "id long, v string, n int, gone boolean"
    first = spark.createDataFrame([(k, f"a{k}", 0, False) for k in range(40)] + [(None, "x", 0, False)], schema)
    assert table.apply(first, 0, F.col("n"), "gone") == list(range(8))
    second = spark.createDataFrame([(3, "old", 1, False), (3, "new", 2, False), (5, "z", 1, True), (99, "add", 1, None)], schema)
    before = table.folders()
    touched = table.apply(second, 1, F.col("n"), "gone")
    after = table.folders()
    assert touched == table.touched(second) and {b for b in after if after[b] != before.get(b)} == set(touched) and len(touched) < 8
    want = {(k, f"a{k}") for k in range(40) if k not in (3, 5)} | {(3, "new"), (99, "add")}
    assert rows(table.read()) == want
    assert table.apply(second.withColumn("v", F.lit("again")), 1, F.col("n"), "gone") == []
    assert table.apply(second.limit(0), 2, F.col("n"), "gone") == [] and table.applied(2)
    assert rows(table.read()) == want
    assert table.vacuum() == 0 or rows(table.read()) == want


def test_a_bucket_may_become_empty_and_fill_again(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", "id long, v string", "id", buckets=1)
    row = lambda gone, v="a": spark.createDataFrame([(1, v, gone)], "id long, v string, gone boolean")
    for number, (gone, v) in enumerate([(False, "a"), (True, "a"), (True, "a"), (False, "b")]):
        table.apply(row(gone, v), number, deleted="gone")
        assert rows(table.read()) == (set() if gone else {(1, v)})


def test_a_batch_that_dies_leaves_the_table_and_comes_again(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, f"file://{tmp_path}/t", "id long, v string", "id", buckets=4)
    table.apply(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), 0)
    change = spark.createDataFrame([(1, "c"), (3, "d")], "id long, v string")
    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.apply(change, 1)
    assert rows(table.read()) == {(1, "a"), (2, "b")}
    table.apply(change, 1)
    assert rows(table.read()) == {(1, "c"), (2, "b"), (3, "d")}
    assert table.vacuum() >= 1 and rows(table.read()) == {(1, "c"), (2, "b"), (3, "d")}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    schema = "id long, v string, n int"
    for k in range(4):
        spark.createDataFrame([(i, f"{k}", k) for i in range(k, k + 3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f={k}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    table = BucketTable(spark, f"file://{tmp_path}/t", "id long, v string, n int", "id", buckets=4)
    calls, enter = [], BucketTable._enter

    def killed(self, batch, *rest):
        calls.append(batch)
        enter(self, batch, *rest)
        if len(calls) == 2:
            raise RuntimeError("killed after its entry")

    with monkeypatch.context() as patch:
        patch.setattr(BucketTable, "_enter", killed)
        with pytest.raises(Exception, match="killed"):
            buckets.drain_into(stream(), table, f"{tmp_path}/check", F.col("n"))
    buckets.drain_into(stream(), table, f"{tmp_path}/check", F.col("n"))
    assert sorted(r.batch for r in table.log().select("batch").distinct().collect()) == [0, 1, 2, 3]
    assert rows(table.read().select("id", "v")) == {(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "3"), (5, "3")}


BATCHES = [
    [(1, ["a", "b", "a"], None), (2, ["b"], False), (3, [], False), (4, None, False), (None, ["z"], False)],
    [(1, ["a"], False), (5, ["c", None], False)],
    [(2, ["b"], True), (6, ["d"], True), (5, ["c", "c"], False)],
    [(1, [], False), (7, ["a", "e"], False)],
]


def test_view_equals_a_full_rebuild_and_reads_changed_buckets_only(spark, tmp_path, monkeypatch):
    view = CountView(spark, f"file://{tmp_path}/v", buckets=16)
    frames = [spark.createDataFrame(b, "note long, keys array<string>, deleted boolean") for b in BATCHES]
    read, asked = BucketTable.read, []
    monkeypatch.setattr(BucketTable, "read", lambda self, wanted=None: (asked.append((self.key, wanted)), read(self, wanted))[1])
    for number, frame in enumerate(frames):
        asked.clear()
        notes, counts = view.apply(frame, number)
        assert all(wanted is not None for _, wanted in asked)
        assert set(notes) == set(view.notes.touched(frame)) and len(notes) <= 5
        assert {b for key, wanted in asked if key == "key" for b in wanted} == set(counts)
        assert rows(view.read()) == rows(buckets.rebuilt(frames[: number + 1]).select("key", "n_notes", "n_mentions", "orphan"))
    assert rows(view.read()) == {("a", 1, 1, False), ("b", 0, 0, True), ("c", 1, 2, False), ("e", 1, 1, False)}
    assert view.apply(frames[3], 3) == ([], [])


def test_view_survives_a_death_between_its_tables(spark, tmp_path, monkeypatch):
    view = CountView(spark, f"file://{tmp_path}/v", buckets=4)
    frames = [spark.createDataFrame(b, "note long, keys array<string>, deleted boolean") for b in BATCHES]
    view.apply(frames[0], 0)
    with monkeypatch.context() as patch:
        apply = BucketTable.apply
        patch.setattr(BucketTable, "apply", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("killed")) if self.key == "note" else apply(self, *a, **k))
        with pytest.raises(RuntimeError):
            view.apply(frames[1], 1)
    view.apply(frames[1], 1)
    assert rows(view.read()) == rows(buckets.rebuilt(frames[:2]).select("key", "n_notes", "n_mentions", "orphan"))


def test_a_view_stores_and_deals_changed_rows_once(spark, tmp_path, monkeypatch):
    view = CountView(spark, f"file://{tmp_path}/v", buckets=4)
    frames = [spark.createDataFrame(b, "note long, keys array<string>, deleted boolean") for b in BATCHES]
    stored, plans, merged, store = [], [], BucketTable._merged, buckets.store
    monkeypatch.setattr(buckets, "store", lambda df, name: (stored.append(name), store(df, name))[1])

    def seen(self, *args):
        found = merged(self, *args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(BucketTable, "_merged", seen)
    for number, frame in enumerate(frames[:2]):
        view.apply(frame, number)
    assert stored == ["notes", "delta", "after"] * 2
    assert len(plans) == 4 and all(p.count("Exchange ") == 1 for p in plans)
