"""Cases with stated results for the record, log and agreement operators."""

import pytest
from pyspark.sql import functions as F

from vellum.functions.rules import RuleError, compile_rule, parse, parse_rules
from vellum.operators import agreement, dedup, facets, funnel, graph, ledger, routing, statuslog
from vellum.operators.components import connected_components


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RECORDS = [
    (1, ["ta/include", "ft/include", "source/db1"], None),
    (2, ["ta/include", "ft/exclude", "reason/outcome", "reason/population"], "db2"),
    (3, ["ta/include", "ft/exclude"], ""),
    (4, ["duplicate", "ta/include"], None),
    (5, ["ta/include", "ta/exclude"], None),
    (6, ["ft/notRetrieved", "source/citations"], None),
    (7, None, None),
    (8, ["ta/exclude", "reason/language"], None),
    (9, ["ta/include"], None),
]


@pytest.fixture
def staged(spark):
    return funnel.staged(spark.createDataFrame(RECORDS, "id long, tags array<string>, catalog string"), ("citations",))


def test_funnel_counts_and_balance(staged):
    by = {r["other"]: r.asDict() for r in funnel.funnel_counts(staged).collect()}
    assert [by[False][c] for c in funnel.COUNTERS] == [8, 1, 7, 1, 2, 4, 0, 4, 2, 1, 1]
    assert [by[True][c] for c in funnel.COUNTERS] == [1, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0]
    assert by[False]["broken"] == by[True]["broken"] == ""


def test_funnel_reasons_sources_issues(staged):
    assert rows(funnel.reason_counts(staged, ("population",))) == [(False, funnel.NO_REASON, 1), (False, "population", 1)]
    assert (False, funnel.NO_SOURCE, 6) in rows(funnel.source_counts(staged)) and (True, "citations", 1) in rows(funnel.source_counts(staged))
    assert dict(rows(funnel.issue_counts(staged))) == {"taConflict": 1, "duplicateDecided": 1, "noReason": 1, "manyReasons": 1, "reasonWithoutExclude": 1, "taPending": 2, "ftPending": 1}


def test_broken_sums_are_named(spark):
    df = spark.createDataFrame([(5, 1, 3, 1, 1, 1, 0, 1, 0, 0, 1)], ", ".join(f"{c} long" for c in funnel.COUNTERS))
    assert df.select(funnel.check_counts()).first()[0] == "identified"


def test_planned_tag_change(spark):
    df = spark.createDataFrame([(["ta/include", "x"], "ta", "exclude"), (["ta/include"], "ta", "include"), (None, "ft", "include"), (["ft/include"], "ft", "")], "tags array<string>, s string, d string")
    got = [(r.c.remove, r.c.add) for r in df.select(funnel.plan_change(F.col("tags"), F.col("s"), F.col("d")).alias("c")).collect()]
    assert got == [(["ta/include"], ["ta/exclude"]), ([], []), ([], ["ft/include"]), (["ft/include"], [])]


def test_facets(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a", ""])], "id int, g array<string>")
    counts = facets.ranked_counts(facets.count_by(df, facets.values_of(F.col("g"))))
    assert sorted(map(tuple, counts.collect()), key=lambda r: r[2]) == [("a", 2, 1), ("b", 1, 2), (facets.NO_VALUE, 2, 3)]
    assert rows(facets.fixed_domain(facets.count_by(df, facets.values_of(F.col("g"))), ["z", "a"]))[-1] == ("z", 0, 0)
    top = facets.top_with_tail(df.select("id"), 3, F.col("id")).collect()
    assert [tuple(r) for r in top] == [(1, 1), (2, 1), (3, 1)]
    share = spark.createDataFrame([(1, 8), (1, 3), (0, 0)], "a int, b int").select(facets.percent(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in share] == [13, 33, 0]


def test_routing_first_match_and_fallbacks(spark):
    rules = [{"name": "off", "enabled": False}, {"name": "deep", "library": "7", "collection": "/A/B/", "db": "d"}, {"name": "any", "library": "*", "collection": "A", "folder": "f"}]
    df = spark.createDataFrame([("7", ["A/B/C"]), ("7", ["A"]), ("8", ["A/B"]), ("8", ["AB"]), (None, None)], "lib string, cols array<string>")
    got = df.select(routing.first_match(rules, F.col("lib"), F.col("cols"), {"db": "main"}, ("db", "folder")).alias("r")).select("r.*")
    assert [tuple(r) for r in got.collect()] == [("deep", "d", ""), ("any", "main", "f"), ("any", "main", "f"), ("", "main", ""), ("", "main", "")]


RULES = [
    ('title:"burn out" AND year>=2020', True), ("nurse OR doctor title:none", True), ("(nurse OR doctor) title:none", False), ("NOT tag:stage/*", False), ("tag:stage", False), ("TAG:STAGE/x", True),
    ("year:2022-2018", True), ("year:2010-2015", False), ("journal:lancet", True), ("author:陳 nurse", True), ("「burn out」", True), ("NOT year>1900", False), ("type:article language:en", True), ("not not nurse", True),
]


@pytest.mark.parametrize(("rule", "expected"), RULES)
def test_rules(spark, rule, expected):
    df = spark.createDataFrame(
        [("Burn Out of a Nurse", None, "2020", ["stage/x", "y"], ["The Lancet"], ["陳美玲"], "Article", "en-US")],
        "title string, abstract string, year string, tag array<string>, journal array<string>, author array<string>, type string, language string",
    )
    assert df.select(compile_rule(rule, {c: F.col(c) for c in df.columns})).first()[0] is expected


def test_rules_without_values_are_false_not_null(spark):
    df = spark.createDataFrame([(None, None)], "title string, year string")
    columns = {c: F.col(c) for c in df.columns}
    for rule, expected in [("year>2000", False), ("NOT year>2000", True), ("NOT title:x", True), ("tag:x", False)]:
        assert df.select(compile_rule(rule, columns)).first()[0] is expected


@pytest.mark.parametrize("bad", ["", "(a", "a)", "AND a", "a OR", 'title:"x', "title>3", "year:20", "year>=2010-2012", "title:", '""'])
def test_bad_rules(bad):
    with pytest.raises(RuleError):
        parse(bad)


def test_rule_lists():
    rules, errors = parse_rules("# c\nA = title:x\n\n// d\nB year:2020\n= x\nC = (")
    assert [n for n, _ in rules] == ["A"] and [n for n, _ in errors] == [5, 6, 7]


def test_duplicates_expect_two_groups(spark):
    data = [
        (1, "Effects of nurse staffing", "2020", "10.1000/AB"), (2, "Other title entirely here", "2019", "https://doi.org/10.1000/ab."), (3, "Éffects of <i>nurse</i> staffing!", "2020", None),
        (4, "Effects of nurse staffing", "2021", None), (5, "Same title two works", "2018", "10.1000/x1"), (6, "Same title two works", "2018", "10.1000/x2"), (7, "Same title two works", "2018", ""),
        (8, "short", "2018", None), (9, "short", "2018", None), (10, None, None, None),
    ]
    df = spark.createDataFrame([(*r, None, False, False, True, 0, "d") for r in data], "id long, title string, year string, doi string, date string, is_duplicate boolean, screened boolean, has_abstract boolean, attachments int, date_added string")
    groups = dedup.duplicate_groups(df)
    assert rows(groups) == [(1, 1), (2, 1), (3, 1)]
    kept = {r.id: r.keep for r in dedup.survivors(df, groups).collect()}
    assert kept == {1: True, 2: False, 3: False}
    assert dedup.duplicate_groups(df.limit(0)).count() == 0


def test_library_lookup_order_and_doi_guard(spark):
    lib = spark.createDataFrame([(1, 1, "10.1000/a", "11", "A long enough title", "2020"), (2, 2, "10.1000/a", None, "Another long title", "2019"), (3, 3, None, "12", "A third long title", "2018")], "id long, pos int, doi string, pmid string, title string, year string")
    cand = spark.createDataFrame(
        [(10, "doi:10.1000/A", "12", None, None), (11, None, "12", "A long enough title", "2020"), (12, None, None, "a LONG enough title", "2021"), (13, "10.1000/other", None, "A long enough title", "2020"), (14, None, None, "A third long title", "2020"), (15, None, None, None, None)],
        "id long, doi string, pmid string, title string, year string",
    )
    got = {r.id: (r.match_id, r.match_by) for r in dedup.library_lookup(cand, lib).collect()}
    assert got == {10: (1, "doi"), 11: (3, "pmid"), 12: (1, "title"), 13: (None, None), 14: (None, None), 15: (None, None)}


def test_concepts_aliases_and_pairs(spark):
    lines = spark.createDataFrame([(0, "# c"), (1, "Falls = 跌倒 = accidental falls"), (2, "Other = falls"), (3, "single")], "pos int, line string")
    aliases = graph.alias_rows(lines)
    mentions = [("p1", 1, "Falls", "concept"), ("p1", 2, "Burn-out", "outcome"), ("p2", 1, "burn out", "concept"), ("p2", 2, "burn out", "concept"), ("p2", 3, "跌倒", "measure"), ("p3", 1, "Ｂｕｒｎ out", "concept"), ("p3", 2, " ", "concept")]
    found = graph.resolved(spark.createDataFrame(mentions, "paper string, pos int, name string, type string"), aliases)
    nodes = {r.key: tuple(r)[1:] for r in graph.concept_nodes(found).collect()}
    assert nodes == {"falls": ("Falls", 2, 2, "concept,measure"), "burn out": ("burn out", 3, 3, "concept,outcome")}
    assert rows(graph.cooccurrence(found)) == [("burn out", "falls", 2)]
    assert len(rows(graph.top_edges(graph.cooccurrence(found), 1))) == 2


def test_kappa_textbook_values(spark):
    pairs = [("y", "y")] * 4 + [("n", "n")] * 3 + [("y", "n")] * 1 + [("n", "y")] * 2
    got = agreement.kappa(spark.createDataFrame([*pairs, (None, "y")], "a string, b string"), "a", "b").first()
    assert (got.n, got.po) == (10, 0.7) and got.pe == pytest.approx(0.5) and got.kappa == pytest.approx(0.4)
    assert agreement.kappa(spark.createDataFrame([("y", "y")] * 3, "a string, b string"), "a", "b").first().kappa is None
    assert agreement.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    labels = spark.createDataFrame([(0.4,), (-0.1,), (0.9,), (None,)], "k double").select(agreement.kappa_label(F.col("k"))).collect()
    assert [r[0] for r in labels] == ["fair", "poor", "almost perfect", None]


def test_ledger_prices_and_costs(spark):
    calls = [("2024-10-02 10:00:00", "m-1", 1000, 100, 500, 200, 300), ("2024-10-03 10:00:00", "m-1-20240501", 500, 1000, 0, 0, 0), ("2024-10-04 10:00:00", "m (batch)", 1_000_000, 0, 0, 0, 0), ("2024-11-01 00:00:00", "zz", 5, -3, None, 0, 0)]
    df = spark.createDataFrame(calls, "ts string, model string, input long, output long, cache_read long, cache_write long, cache_write_1h long").withColumn("ts", F.col("ts").cast("timestamp"))
    usage = ledger.rollup_usage(df).filter("is_total = 0").drop("is_total")
    prices = {"m": {"input": 2.0, "output": 4.0}, "m-1": {"input": 10.0, "output": 30.0}}
    got = {r.model: r for r in ledger.priced(usage, prices).collect()}
    assert got["m-1"].cost == pytest.approx((1000 * 10 + 100 * 30 + 500 * 1.0 + 0 * 12.5 + 200 * 20) / 1e6)
    assert got["m-1-20240501"].price_key == "m-1" and got["m (batch)"].cost == pytest.approx(1.0) and got["zz"].cost is None
    assert got["zz"].output == 0
    months = {r.month: r for r in ledger.summarize(ledger.priced(usage, prices)).collect()}
    assert months["2024-11"].unpriced_calls == 1 and months["2024-10"].batch_calls == 1 and months["2024-10"].batch_savings == pytest.approx(1.0)


def test_status_merge_cases(spark):
    cases = [("todo", None, "todo", None), ("todo", "read", "todo", None), ("todo", "read", "cited", "todo"), (None, "", None, None), ("todo", "deleted", "read", ""), ("read", " read ", "read", "read")]
    df = spark.createDataFrame(cases, "base string, a string, b string, c string")
    got = [tuple(r.m) for r in df.select(statuslog.merge_status(F.col("base"), {k: F.col(k) for k in "abc"}, "new").alias("m")).collect()]
    assert got == [("todo", "base", False, ""), ("read", "a", False, "b"), ("read", "a", True, "b,c"), ("new", "default", False, "a"), ("read", "b", False, "a,c"), ("read", "base", False, "")]


def test_status_log_append_cap_and_changes(spark):
    data = [("k", 1, "2026-09-25", "todo", "reading"), ("k", 2, "2026-09-26", "reading", "reading"), ("k", 3, "2026-09-27", "x", "reading"), ("k", 4, "2026-10-01", "reading", "read"), ("j", 1, "2020-01-01", "a", "b"), ("j", 2, "2026-10-02", "b", ""), ("j", 3, "2026-10-03", "b", "c")]
    df = spark.createDataFrame(data, "key string, seq long, date string, old string, new string").withColumn("date", F.col("date").cast("date"))
    log = statuslog.appended(df)
    assert rows(log.select("key", "seq")) == [("j", 1), ("j", 3), ("k", 1), ("k", 4)]
    day = lambda d: F.lit(d).cast("date")
    assert rows(statuslog.capped(log, day("2026-10-05"), per_key=1).select("key", "seq")) == [("j", 3), ("k", 4)]
    assert [tuple(r)[2:] for r in statuslog.reading_changes(log, day("2026-09-24"), day("2026-10-08"), ["read"]).collect()] == [("todo", "read")]


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_scratch_tables_are_deleted_when_done(spark):
    from vellum import storage

    first = storage.store(spark.range(3).toDF("id"), "kept")
    with storage.stage():
        storage.store(spark.range(5).toDF("id"), "inner")
        last = storage.store(first.filter("id > 0"), "last")
    assert first.count() == 3 and last.count() == 2 and not [p for _, p in storage._scratch if "/inner-" in p]
    storage.discard(last)
    assert first.count() == 3 and not [p for _, p in storage._scratch if "/last-" in p]


def test_library_lookup_broadcasts_nothing(spark):
    """Stored candidates are small files, but what is made of them must not be gathered in the driver."""
    from vellum.operators import dedup

    schema = "id long, pos long, doi string, pmid string, title string, year string"
    lib = spark.createDataFrame([(1, 1, "10.1000/a", "7", "A title of some length", "2001"), (2, 2, None, "8", "A title of some length", "2000")], schema)
    cand = spark.createDataFrame([(5, 1, "doi:10.1000/A", "8", None, None), (6, 2, None, "8", "A title of some length", "2001"), (7, 3, None, None, "A title of some length", "2001"), (8, 4, None, "", None, None)], schema)
    found = dedup.library_lookup(cand, lib)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.match_id, r.match_by) for r in found.collect()} == {5: (1, "doi"), 6: (2, "pmid"), 7: (2, "title"), 8: (None, None)}
