import json

from pyspark.sql import functions as F

from vellum.sources import cited

SCHEMA = "seed string, direction string, page int, cursor string, json string"


def page(seed, n, works, after, total=None, direction="forward"):
    meta = {"count": total, "next_cursor": after}
    return seed, direction, n, "*" if n == 0 else f"{seed}{n}", json.dumps({"meta": meta, "results": [{"id": f"https://x.org/{w}", "doi": f"https://doi.org/10.1/{w}", "cited_by_count": 3} for w in works]})


PAGES = [
    page("a", 0, ["W1", "W2", "W3"], "a1", 8), page("a", 1, ["W4", "W5", "W6"], "a2", 8), page("a", 2, ["W7", "W8"], None, 8),
    page("b", 0, ["W1"], None, 1), page("b", 0, ["W9"], "b1", 2, "backward"), page("b", 2, ["W10"], None, 2, "backward"),
    page("c", 0, [], None, 0), ("d", "forward", 0, "*", "{not json"), (None, "forward", 0, "*", "{}"), ("e", "forward", 1, "e1", "{}"),
]


def found(rows):
    return {(r.seed, r.direction, r.place, r.work) for r in cited.parsed_works(rows).collect()}


def want(cap):
    a = {("a", "forward", k, f"W{k + 1}") for k in range(min(8, cap))}
    return a | {("b", "forward", 0, "W1"), ("b", "backward", 0, "W9")}


def test_pages_along_their_cursors_up_to_a_cap(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert cited.read_works(spark, path).count() == 0
    cited.record_pages(spark.createDataFrame(PAGES + PAGES[:2], SCHEMA), path, 4)
    assert found(cited.read_works(spark, path)) == want(200)
    for cap in (3, 4, 7):
        assert found(cited.read_works(spark, path, cap)) == want(cap)
    reports = {(r.seed, r.direction): (r.works, r.total, r.capped) for r in cited.list_reports(cited.read_works(spark, path, 4), 4).collect()}
    assert reports == {("a", "forward"): (4, 8, True), ("b", "forward"): (1, 1, False), ("b", "backward"): (1, 2, True)}


def test_a_page_with_another_cursor_ends_its_list(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    broken = [page("a", 0, ["W1"], "a1"), ("a", "forward", 1, "other", page("a", 1, ["W2"], "a2")[4]), page("a", 2, ["W3"], None)]
    cited.record_pages(spark.createDataFrame(broken, SCHEMA), path, 2)
    assert found(cited.read_works(spark, path)) == {("a", "forward", 0, "W1")}


def test_a_resumed_stream_repeats_nothing(spark, tmp_path):
    path, out = f"file://{tmp_path}/r", f"{tmp_path}/out"

    def drain():
        stream = cited.read_works(spark, path, 7, streaming=True)
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return spark.read.parquet(out)

    frame = spark.createDataFrame(PAGES, SCHEMA)
    cited.record_pages(frame.filter("page = 0"), path, 4)
    first = drain()
    assert first.count() == 5
    # What is recorded later continues the lists; pages are recorded with all before them known.
    later = f"file://{tmp_path}/all"
    cited.record_pages(frame, later, 4)
    spark.read.parquet(later).filter("page > 0").write.partitionBy("bucket").mode("append").parquet(path)
    both = drain()
    assert both.count() == 9 and found(both) == want(7)
    assert drain().count() == 9


def test_addresses(spark):
    rows = spark.createDataFrame([("https://doi.org/10.1000/A(b)", None, "W5", "backward", ""), (None, "PMID: 77", "W6", "forward", "x=="), (None, None, None, "forward", None)], "doi string, pmid string, work string, direction string, cursor string")
    got = rows.select(cited.seed_address("https://x.org", F.col("doi"), F.col("pmid"), F.lit("me@y.org")).alias("s"), cited.list_address("https://x.org", F.col("work"), F.col("direction"), F.col("cursor"), 50).alias("l")).collect()
    assert got[0].s == f"https://x.org/works/doi:10.1000/a(b)?select={cited.SEED_FIELDS}&mailto=me@y.org"
    assert got[1].s.startswith("https://x.org/works/pmid:77?") and got[2].s is None and got[2].l is None
    assert got[0].l == f"https://x.org/works?filter=cited_by:W5&select={cited.WORK_FIELDS}&sort=cited_by_count:desc&per-page=50&cursor=*"
    assert "filter=cites:W6" in got[1].l and got[1].l.endswith("cursor=x%3D%3D")


def test_a_bucket_is_read_in_small_parts(tmp_path):
    """A task holds the works of some pages, not of a whole file of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 2_000
    (tmp_path / "bucket=0").mkdir()
    answer = '{"meta": {"count": 1}, "results": [{"id": "W1"}]}'
    pages = {"seed": [f"s{k}" for k in range(n)], "direction": ["forward"] * n, "page": pa.array([0] * n, pa.int32()), "first": pa.array([0] * n, pa.int32()), "json": [answer] * n}
    pq.write_table(pa.table(pages), tmp_path / "bucket=0" / "a.parquet")
    sizes = [b.num_rows for b in cited.read_bucket(cited.Bucket(str(tmp_path / "bucket=0"), 0, None), 10)]
    assert sum(sizes) == n and max(sizes) <= cited.BATCH_PAGES
