"""Cases with stated results for prose functions and for state that changes from run to run."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.functions import prose as P
from vellum.operators import updates as U

NOTE = "# A\nx\n## Key\n\n- a  b\n1. c\n* \n# B\ny"
CASES = [
    (P.plain_text, "%% x %%\n> [!note] a\n> b\nc **d** [[x/y]] [[a|b]]\n## H\n### I\n- [x] t\n- [ ] u\n- v\n> q\n\n\n\nz", "c d y b\n【H】\n■ I\n☑ t\n☐ u\n・v\nq\n\nz"),
    (P.plain_text, None, ""),
    (P.join_hyphens, "interven- tion self-\nreported pre- and post-test evidence-based so­ft Self- care", "intervention self-reported pre- and post-test evidence-based soft Self-care"),
    (P.heading_id, "2.1 Methods:", "methods"),
    (P.heading_id, "R E F E R E N C E S", "references"),
    (P.heading_id, "參 考 文 獻", "references"),
    (P.heading_id, "Methods were", None),
    (P.heading_id, "Methods" + "x" * 80, None),
    (P.heading_id, None, None),
    (lambda c: P.section(c, "Key"), NOTE, "- a  b\n1. c\n*"),
    (lambda c: P.section(c, "Absent"), NOTE, ""),
    (lambda c: P.key_points(c, "Key"), NOTE, ["a b", "c"]),
    (lambda c: P.key_points(c, "Key"), "## Key\nOne is. Two is. Three.", ["One is.", "Two is."]),
    (lambda c: P.key_points(c, "Key"), None, []),
    (P.longest_quote, 'a "bc" and “defg” 「x」', "defg"),
    (P.longest_quote, '"ab" “cd”', "cd"),
    (P.longest_quote, 'a "bc”', "bc"),
    (P.longest_quote, '"  "', "  "),  # blank spans do not compete, but the last resort takes any
    (P.longest_quote, None, None),
    (P.citations, "x [S1, p. 5; S2] y [s3，PP. 3–4] [Sx] [S1 or]", [("S1", "p. 5"), ("S2", ""), ("S3", "pp. 3–4")]),
    (P.citations, "", []),
    (P.checkable_numbers, "In 2020 年 there were 5 of 12 篇, 95% CI 1.5 to 2.50, 40% and 1,234 people, 7%", ["1.5", "2.5", "40", "1234", "7"]),
    (P.decode_entities, "a<br/>b <i>c</i> &lt;&amp;lt; &#39;", "a\nb c <&lt; '"),
    (lambda c: P.clip(c, 5), "abc defgh", "abc d…"),
    (lambda c: P.shorten(c, 9), "abc\ndefgh ijk", "abc…"),
    (lambda c: P.clamp_int(c, 1, 10, 5), "7.5", 8),
    (lambda c: P.clamp_int(c, 1, 10, 5), "", 5),
    (lambda c: P.clamp_int(c, 1, 10, 5), None, 5),
    (lambda c: P.clamp_int(c, 1, 10, 5), "1e300", 10),
    (lambda c: P.format_usd(c.cast("double")), "0.001", "< US$0.01"),
    (lambda c: P.format_usd(c.cast("double")), None, ""),
    (lambda c: P.signed(c.cast("int")), "3", "+3"),
    (lambda c: P.signed(c.cast("int")), "-3", "-3"),
    (lambda c: P.size_bucket(c.cast("int")), "1000", "100–1000"),
    (lambda c: P.size_bucket(c.cast("int")), None, "unknown"),
    (P.split_values, "a; b；a、none,  ", ["a", "b"]),
    (P.uuid_of, "https://x/My-DB-0123456789abcdef0123456789ABCDEF?v=1", "01234567-89ab-cdef-0123-456789abcdef"),
    (P.uuid_of, "https://x/f0123456789abcdef0123456789ABCDEF", None),
    (P.degree_of, "A master's thesis", "master"),
    (P.degree_of, None, None),
    (P.local_day, "2026-10-01", datetime.date(2026, 10, 1)),
    (P.local_day, "2026-13-01", None),
    (P.local_day, "2026-10-01 23:10:00", datetime.date(2026, 10, 1)),
    (P.usage_counts, '{"usage":{"prompt_tokens":10,"completion_tokens":2,"prompt_tokens_details":{"cached_tokens":4}}}', (6, 2, 4, 0, 0)),
    (P.usage_counts, '{"usage":{"input_tokens":10,"cache_creation_input_tokens":5,"cache_creation":{"ephemeral_1h_input_tokens":9}}}', (10, 0, 0, 5, 5)),
    (P.usage_counts, "broken", (0, 0, 0, 0, 0)),
]


def plain(value):
    if isinstance(value, list):
        return [plain(v) for v in value]
    return tuple(value) if isinstance(value, tuple) else value


def test_prose_functions(spark):
    row = spark.createDataFrame([tuple(v for _, v, _ in CASES)], ", ".join(f"c{k} string" for k in range(len(CASES))))
    got = row.select(*[f(F.col(f"c{k}")).alias(f"r{k}") for k, (f, _, _) in enumerate(CASES)]).first()
    wrong = [(k, plain(got[k]), want) for k, (_, _, want) in enumerate(CASES) if plain(got[k]) != want]
    assert not wrong


def test_chinese_records(spark):
    rows = [("中文", None, None, True), ("Deep", ["李"], "zh", False), ("", ["李 四"], "", True), ("", None, "zh-TW", True), ("日本のこと", None, "zh", False), (None, [], None, False)]
    df = spark.createDataFrame(rows, "t string, n array<string>, l string, want boolean")
    assert df.filter(P.is_chinese(F.col("t"), F.col("n"), F.col("l")) != F.col("want")).count() == 0


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([(1, ""), (2, ""), (1, ""), (2, "")], [1, 2, 3, 4]),
        ([(1, ""), (2, "a"), (2, "b"), (3, "")], [1, 2, 2, 3]),
        ([(1, ""), (2, ""), (3, ""), (1, ""), (4, "b"), (5, "")], [1, 2, 3, 4, 4, 5]),
        ([(1, ""), (1, "")], [1, 2]),
    ],
)
def test_numbering_goes_on(spark, items, want):
    df = spark.createDataFrame([("x", k, n, letter, 0) for k, (n, letter) in enumerate(items)] + [("y", 0, 9, None, 0), (None, 0, 1, "", 0), ("y", 1, None, "", 0)], "g string, k int, number int, letter string, n int")
    got = U.numbered(df, "g", "k").collect()
    assert [r.n for r in sorted((r for r in got if r.g == "x"), key=lambda r: r.k)] == want
    assert [r.n for r in got if r.g == "y"] == [9] and len(got) == len(items) + 1


def test_budget(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 11), ("a", 3, None), ("a", 4, 6), ("a", 5, 4), ("a", 6, 1), ("b", 1, 10)], "g string, k int, size long")
    got = {(r.g, r.k) for r in U.within_budget(df, "g", "k", 3, 10, 10).filter("taken").collect()}
    assert got == {("a", 1), ("a", 5), ("a", 6), ("b", 1)}
    assert U.within_budget(df.limit(0), "g", "k", 3, 10, 10).count() == 0


def test_undo_keeps_what_is_used(spark):
    tree = spark.createDataFrame([("top", None), ("f", "top"), ("v", "f"), ("w", "f"), ("g", "top"), ("x", "g")], "key string, parent string")
    members = spark.createDataFrame([("v", 1), ("w", 1), ("w", 2), ("x", 3)], "container string, item int")
    added = spark.createDataFrame([("v", 1), ("w", 1), ("x", 3), ("x", 9)], "container string, item int")
    made = spark.createDataFrame([("f",), ("v",), ("w",), ("g",), ("x",)], "key string")
    left, containers = U.undo(members, added, made, tree)
    assert {tuple(r) for r in left.collect()} == {("w", 2)}
    assert {tuple(r) for r in containers.collect()} == {("v", True), ("w", False), ("f", False), ("x", True), ("g", True)}


def test_tombstones_twice_and_back(spark):
    notes = spark.createDataFrame([("a", "read", None, None), ("b", None, None, None), ("c", "new", None, None)], "key string, status string, before string, deleted_at string")
    gone = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    once = U.tombstones(notes, gone, F.lit("d1"))
    assert {tuple(r) for r in once.collect()} == {("a", "deleted", "read", "d1"), ("b", "deleted", None, "d1"), ("c", "new", None, None)}
    assert {tuple(r) for r in U.tombstones(once, gone, F.lit("d2")).collect()} == {tuple(r) for r in once.collect()}
    assert {tuple(r) for r in U.tombstones(once, gone.limit(0), F.lit("d2")).collect()} == {tuple(r) for r in notes.collect()}


def test_small_updates(spark):
    messages = spark.createDataFrame([(k, "error" if k % 2 else None) for k in range(9)], "k int, kind string")
    assert [r.k for r in U.last_matching(messages, F.col("kind") == "error", "k", 2).collect()] == [5, 7]
    votes = spark.createDataFrame([("a", "q"), ("a", " "), ("a", None), ("b", "q"), ("b", "r"), ("c", None)], "g string, v string")
    assert {tuple(r) for r in U.all_match(votes, F.col("v"), "q", "g").collect()} == {("a", True), ("b", False), ("c", False)}
    marks = spark.createDataFrame([("#FF",), ("#00",), (None,)], "color string")
    assert {tuple(r) for r in U.meaning_groups(marks, [("#ff", "method"), ("#11", "x")], "color").collect()} == {(0, "method", 1), (2, "other", 2)}
    switches = spark.createDataFrame([(True, True, False), (None, False, None)], "v boolean, one boolean, two boolean")
    assert {tuple(r) for r in U.preset_differences(switches, "v", ["one", "two"]).collect()} == {("one", 1, True), ("two", 1, False)}
    pending = spark.createDataFrame([("r", ["n"], "all"), ("s", ["n"], "all")], "ref string, targets array<string>, action string")
    failed = spark.createDataFrame([("r", ["m", "n"], "missing")], pending.schema)
    assert {(r.ref, tuple(r.targets), r.action) for r in U.merge_failures(pending, failed).collect()} == {("r", ("m", "n"), "missing"), ("s", ("n",), "all")}
    files = spark.createDataFrame([("AAAAAAAA-BBBBBBBB.png",), ("AAAAAAAA-CCCCCCCC.png",), ("own.png",), ("DDDDDDDD-BBBBBBBB.png",), (None,)], "file string")
    kept = spark.createDataFrame([("AAAAAAAA", "BBBBBBBB")], "owner string, part string")
    assert [r.part for r in U.stale_files(files, kept).collect()] == ["CCCCCCCC"]
    requests = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False), ("e", False)], "ref string, done boolean")
    results = spark.createDataFrame([("a", "succeeded"), ("c", "errored"), ("c", "errored"), ("e", "succeeded")], "ref string, type string")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ref string")
    assert {tuple(r) for r in U.settled(requests, results, items).collect()} == {("a", "ok"), ("b", "skipped"), ("c", "failed"), ("d", "missing"), ("e", "gone")}


def test_trimmed_sections(spark):
    body = "word " * 100
    papers = {
        "late": (f"intro {body}\n## References\n1. A\nTable 1 x\n## Results\nr", f"intro {body}\nTable 1 x\n## Results\nr", ["references"]),
        "early": (f"i\n## References\n1. A\n## Results\n{body}", f"i\n## References\n1. A\n## Results\n{body}".strip(), []),
        "long": (f"a\n## Funding\n{'x' * 4001}", f"a\n## Funding\n{'x' * 4001}", []),
        "several": (f"{body}\n\n## Funding\nf\n\n## Competing interests\nnone\n\n## References:\nz", body.strip(), ["funding", "coi", "references"]),
        "none": ("", "", []),
        "plain": ("### Funding\nx", "### Funding\nx", []),
    }
    rows = spark.createDataFrame([(k, text) for k, (text, _, _) in papers.items()], "k string, text string")
    got = {r.k: r.t for r in rows.select("k", P.trim_sections(F.col("text")).alias("t")).collect()}
    for k, (text, md, cut) in papers.items():
        assert (got[k].md, got[k].before, got[k].after, [c.id for c in got[k].cut]) == (md, len(text), len(md), cut), k
    assert rows.select(P.trim_sections(F.lit(None).cast("string")).alias("t")).first().t.before == 0


def test_creator_repair(spark):
    from vellum.functions.creators import creator_repair

    cases = [
        (("Chen", "Mei-Ling", None), None),
        (("陳", "美玲", None), None),
        ((None, None, "衛生福利部 國民健康署"), None),
        ((None, None, "陳美玲、林小華"), ("sure", [(None, None, "陳美玲"), (None, None, "林小華")])),
        (("陳美玲 林小華", "", None), ("check", [(None, None, "陳美玲"), (None, None, "林小華")])),
        (("陳美玲 Chen", "Mei", None), ("check", [(None, None, "陳美玲")])),
        ((None, None, "陳 美玲"), ("sure", [(None, None, "陳美玲")])),
        (("美玲", "陳", None), ("sure", [("陳", "美玲", None)])),
        (("林美", "陳", None), ("check", [("陳", "林美", None)])),
        (("歐", "陽志明", None), ("check", [("歐陽", "志明", None)])),
        (("歐陽", "志明", None), None),
        (("陳美玲", "林小華", None), ("check", [(None, None, "陳美玲"), (None, None, "林小華")])),
        (("陳 ", "美 玲", None), ("sure", [("陳", "美玲", None)])),
        ((None, None, None), None),
        ((None, None, ""), None),
    ]
    df = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, l string, f string, w string")
    got = {r.k: r.r for r in df.select("k", creator_repair(F.col("l"), F.col("f"), F.col("w"), "陳林王李").alias("r")).collect()}
    found = [None if got[k] is None else (got[k].confidence, [tuple(p) for p in got[k].replacement]) for k in range(len(cases))]
    assert found == [want for _, want in cases]


def test_reconcile(spark):
    from vellum.operators import statuslog

    items = spark.createDataFrame([("a", "read", False), ("b", None, None), ("c", "read", True), ("d", "read", False), ("e", "todo", False)], "key string, status string, deleted boolean")
    notes = spark.createDataFrame([("a", "todo", "2"), ("a", "reading", "1"), ("c", "todo", "1"), ("e", None, "1")], "key string, status string, path string")
    pages = spark.createDataFrame([("b", "read", 0), ("a", "todo", 5)], "key string, status string, pos int")
    bases = spark.createDataFrame([("a", "todo"), ("z", "read")], "key string, base string")
    merged = statuslog.reconcile(items, notes, pages, bases, "todo")
    assert {tuple(r) for r in merged.collect()} == {("a", "reading", "notes", True, "library,table"), ("b", "read", "table", False, "library"), ("e", "todo", "library", False, "notes")}
    failed = spark.createDataFrame([("a", "table")], "key string, side string")
    assert {tuple(r) for r in statuslog.new_bases(bases, merged, failed).collect()} == {("a", "todo"), ("z", "read"), ("b", "read"), ("e", "todo")}
