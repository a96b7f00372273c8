"""Cases with stated results for lists, trees, reports, recorded pages and exports."""

import json

from pyspark.sql import functions as F

from vellum.operators import assembly, lists, reports
from vellum.sources import records
from vellum.streaming import events


def test_round_robin_and_headings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, i int")
    assert [(r.g, r.i) for r in lists.round_robin(df, "g", [F.col("i")], 3).orderBy("round", "g").collect()] == [("a", 1), ("b", 4), ("a", 2)]
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(["- [ ] before", "## One", "- [x] a", "text", "# Two", "* [X] b", "- [ ] c"])], "doc string, pos int, line string")
    under = lists.under_headings(lines, "doc", "pos", F.col("line"))
    assert {r.heading: (r["items"], r.ticked) for r in lists.checklist_counts(under, F.col("line"), "heading").collect()} == {None: (1, 0), "One": (1, 1), "Two": (2, 1)}


def test_trees(spark):
    edges = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", None, "X")], "key string, parent string, name string")
    assert {tuple(r) for r in lists.descendants(edges, "a").collect()} == {("a", "A", 0), ("b", "A/B", 1), ("c", "A/B/C", 2)}
    items = spark.createDataFrame([(1, None, False), (2, 1, False), (3, None, True), (4, 3, False)], "id int, parent int, deleted boolean")
    assert [r.id for r in lists.top_level(items, spark.createDataFrame([(1,), (2,), (4,)], "id int")).collect()] == [1]


def test_alignment_by_position_or_item(spark):
    catalog = spark.createDataFrame([("4a", 0), ("4b", 1)], "item string, pos int")
    answers = spark.createDataFrame([("s", 0, "x", "yes"), ("s", 1, "y", "no"), ("t", 0, "4b", "yes")], "study string, pos int, item string, answer string")
    assert {tuple(r) for r in lists.aligned(answers, catalog, "study").collect()} == {("s", "4a", "yes"), ("s", "4b", "no"), ("t", "4b", "yes")}


def test_plans_are_idempotent(spark):
    wanted = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("A", 1)], "container string, item int")
    plan = {r.container: (r.adds, r.already, r.new) for r in lists.plan_memberships(wanted, wanted.filter("container = 'A' AND item = 1")).collect()}
    assert plan == {"A": (1, 1, False), "B": (1, 0, True)}
    assert all(r.adds == 0 for r in lists.plan_memberships(wanted, wanted).collect())


def test_columns_resolve_by_id_then_name(spark):
    have = [("1", "Titel", "text"), ("2", "Year", "number"), ("3", "Status", "text")]
    want = [{"key": "title", "id": "1", "names": ["Title"], "type": "text"}, {"key": "year", "names": ["Jahr", "Year"], "type": "number"}, {"key": "doi", "names": ["DOI"], "type": "url"}]
    assert lists.resolve_columns(have, want) == {"title": "Titel", "year": "Year"}


def test_reports(spark):
    rows = spark.createDataFrame([("RCT", 10), ("RCT", None), ("review", 99)], "design string, n long")
    assert {r.design: tuple(r)[1:] for r in reports.evidence_summary(rows, ["RCT"]).collect()} == {"RCT": (2, 10, 1), "review": (1, 0, 0)}
    assert reports.mermaid_pie("T", [("a", 2), ("b", 0)]) == 'pie title T\n  "a" : 2' and reports.mermaid_pie("T", []) == ""
    assert reports.mermaid_graph([("a", "b", 3)]) == 'graph LR\n  n0["a"]\n  n1["b"]\n  n0 ---|3| n1'


def test_recorded_pages(spark):
    page = {"esearchresult": {"count": "2", "idlist": ["11", "12"]}}
    found = records.found_ids(spark.createDataFrame([("w", json.dumps(page)), ("v", "broken"), ("u", None)], "watch string, json string"))
    assert {tuple(r) for r in found.collect()} == {("w", "11", 0, 2), ("w", "12", 1, 2)}
    entry = {"uid": "11", "title": "A title.", "pubdate": "2020 Jan", "source": "J", "authors": [{"name": "Lee A"}], "articleids": [{"idtype": "doi", "value": "10.1000/X"}]}
    got = records.summaries(spark.createDataFrame([(json.dumps({"result": {"uids": ["11", "12"], "11": entry, "12": {"uid": "12", "error": "no"}}}),)], "json string")).collect()
    assert [tuple(r) for r in got] == [("11", "A title", "2020", "J", "10.1000/x", ["Lee A"])]
    work = {"id": "https://openalex.example/W7", "doi": "https://doi.org/10.1000/Y", "display_name": "T", "publication_year": 2019, "type": "article", "cited_by_count": 3, "ids": {"pmid": "https://pubmed.example/55"}}
    got = records.works(spark.createDataFrame([("s", "forward", json.dumps({"meta": {"count": 1}, "results": [work]}))], "seed string, direction string, json string")).collect()
    assert [tuple(r) for r in got] == [("s", "forward", "W7", "10.1000/y", "T", 2019, "article", 3, "55")]
    address = spark.range(1).select(records.search_address("https://x.example/s", term=F.lit('a b & "c"'), size="20", none="")).first()[0]
    assert address == "https://x.example/s?term=a%20b%20%26%20%22c%22&size=20"


def test_exports(spark):
    schema = "id string, key string, type string, title string, year string, doi string, creators array<struct<lastName: string, firstName: string, name: string>>"
    rows = spark.createDataFrame([("1", "lee2020x", "article", "A & B", "2020", "", [("Lee", "A", ""), ("", "", "WHO")]), ("2", "k", "book", "", "in press", "10.1/x", [])], schema)
    entries = {r.id: json.loads(r.json) for r in records.csl_json(rows).collect()}
    assert entries["1"] == {"id": "1", "type": "article", "title": "A & B", "issued": {"date-parts": [[2020]]}, "author": [{"family": "Lee", "given": "A"}, {"literal": "WHO"}]}
    assert entries["2"] == {"id": "2", "type": "book", "DOI": "10.1/x"}
    assert {r.id: r.text for r in records.bibtex(rows).collect()}["1"] == "@article{lee2020x,\n  author = {Lee, A and WHO},\n  title = {A \\& B},\n  year = {2020}\n}"
    df = spark.createDataFrame([("falls; fall prevention", "nurse", None), ("", None, None)], "p string, i string, o string")
    assert [r[0] for r in df.select(records.pico_query([F.col("p"), F.col("i"), F.col("o")])).collect()] == ['(falls OR "fall prevention") AND nurse', ""]


def test_watch_plan_and_self_changes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "watch string, id int, pos int")
    take, wait = events.plan_watch(frame([("w", 1, 0)]), frame([("w", 2, 5)]), frame([("w", 1, 0), ("w", 3, 1), ("w", 2, 2), ("w", 4, 3)]), 2)
    assert [(r.id, r.n) for r in take.orderBy("n").collect()] == [(2, 1), (3, 2)] and [r.id for r in wait.collect()] == [4]
    at = lambda rows: spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    left = events.suppress_own(at([("a", "2024-01-01 00:00:10"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:10")]), at([("a", "2024-01-01 00:00:00")]))
    assert left.count() == 2


def test_numbers_within_groups_of_any_size(spark):
    rows = [("hot", k % 500, k) for k in range(2_000)] + [(None, k, k) for k in range(3)] + [(f"g{k}", 1, k) for k in range(50)]
    frame = spark.createDataFrame(rows, "g string, o int, id int").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        found = lists.numbered_within(frame, "g", F.col("o").desc(), F.col("id").asc()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for g, _, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        want.setdefault(g, []).append(i)
    assert len(found) == len(rows) and all(want[r.g][r.n - 1] == r.id for r in found)
    assert lists.numbered_within(frame.limit(0), "g", F.col("o").asc()).count() == 0


def test_deep_trees_and_loops_end(spark):
    rows = [(f"k{n}", f"k{n - 1}" if n else None, f"n{n}") for n in range(15)] + [("a", "b", "A"), ("b", "a", "B")]
    edges = spark.createDataFrame(rows, "key string, parent string, name string")
    found = {r.key: (r.path, r.level) for r in lists.descendants(edges, "k3").collect()}
    assert set(found) == {f"k{n}" for n in range(3, 15)} and found["k5"] == ("n3/n4/n5", 2)
    assert sorted(r.key for r in lists.descendants(edges, "a").collect()) == ["a", "b"]
    assert lists.descendants(edges, "none").count() == 0


def test_pieces_of_notes_and_their_edge_cases(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]
    assert one(lambda c: assembly.text_pieces(c, 3), "abcdefg") == ["abc", "def", "g"] and one(lambda c: assembly.text_pieces(c, 3), None) == []
    assert [one(assembly.confidence, v) for v in ("High", "80%", "0.5", "12", "x", None)] == ["high", "high", "medium", "low", "", ""]
    assert one(assembly.page_paragraphs, "a\nb\n\n| x |\n| y |\nc-\nd") == ["a b", "| x |", "| y |", "cd"] and one(assembly.page_paragraphs, None) == []
    assert [one(assembly.escaped, v) for v in ("# a", "---", "a == b", "a")] == ["\\# a", "\\---", "a =\\= b", "a"]
    batches = spark.createDataFrame([("g", 0, 1), ("g", 0, 2), ("g", 1, 3), (None, 0, 4)], "g string, batch int, id int")
    answers = spark.createDataFrame([("g", 0, '{"1": ["a", " a", "z"], "2": null}'), ("g", 1, "[]")], "g string, batch int, json string")
    topics = spark.createDataFrame([("a",)], "topic string")
    found = {r.id: (r.status, r.topics) for r in assembly.batch_topics(batches, answers, topics, "g").collect()}
    assert found == {"1": ("ok", ["a"]), "2": ("ok", []), "3": ("failed", []), "4": ("failed", [])}
    quotes = spark.createDataFrame([(1, "A b!"), (1, "none"), (1, "..."), (2, "x")], "id int, quote string")
    pages = spark.createDataFrame([(1, 3, "x a, B c"), (1, 2, "A-B"), (2, 1, None)], "id int, page int, text string")
    assert {(r.id, r.quote): r.page for r in assembly.quote_pages(quotes, pages).collect()} == {(1, "A b!"): 2, (1, "none"): None, (1, "..."): None, (2, "x"): None}


def test_schema_is_evolved_and_nothing_overwritten(spark):
    from vellum.operators import lists

    rows = spark.createDataFrame([("7", "x", "mine", None)], "Year string, Name string, title string, other int")
    want = [{"key": "title", "names": ["Name"], "type": "string"}, {"key": "year", "names": ["Jahr", "Year"], "type": "int"}, {"key": "tags", "names": ["Tags"], "type": "array<string>"}]
    out = lists.evolved(rows, want)
    assert out.columns == ["title", "year", "tags", "title_old", "other"]
    assert tuple(out.first()) == ("x", 7, None, "mine", None)
    assert lists.evolved(rows.limit(0), want).count() == 0


def test_watch_plan_is_told_by_one_sort_and_no_join(spark):
    frame = lambda rows: spark.createDataFrame(rows, "watch string, id int, pos int")
    seen = frame([("w", 1, 0), ("w", 1, 7), ("w", None, 0), (None, 5, 0)])
    take, wait = events.plan_watch(seen, frame([("w", 2, None), ("w", None, 3), (None, 5, 1)]), frame([("w", 1, 0), ("w", 2, 0), ("w", 4, 9)]), 2)
    assert "Join" not in take._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in take.collect()} == {("w", 2, 1), ("w", None, 2), (None, 5, 1)} and [tuple(r) for r in wait.collect()] == [("w", 4, 3)]
