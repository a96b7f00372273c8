import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import regions as R

OWNED = ["title", "year", "design"]


def note(front, body):
    return f"---\n{front}\n---\n{body}"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


def managed(**keys):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("text")) for k, v in keys.items()])


def test_unknown_keys_and_comments_stay(spark):
    front = "# mine\ntitle: old\nrating: 5\ntags:\n  - a\n  - b\ndesign: RCT\nyear: 1999\nnote: |\n  a: b\n  c"
    got = one(spark, R.renewed_frontmatter(F.col("t"), managed(title="title: new", year=""), OWNED, ["design"]), t=front)
    assert got == "title: new\n# mine\nrating: 5\ntags:\n  - a\n  - b\ndesign: RCT\nnote: |\n  a: b\n  c"
    assert "design" not in one(spark, R.renewed_frontmatter(F.col("t"), managed(design=None), OWNED, ["design"]), t=front)
    assert one(spark, R.renewed_frontmatter(F.col("t"), managed(title="title: x"), OWNED), t=None) == "title: x"


def test_regions_of_any_version_are_found_and_renewed(spark):
    body = "# H\nmine 1\n%% vellum:ai:start — old hint %%\nold\n%% vellum:ai:end %%\nmine 2\n%% vellum:main:start v1 %%\nm\n%% vellum:main:end %%\nmine 3"
    put = R.put_region(R.put_region(F.col("t"), "main", F.lit("M2\n"), 3), "ai", F.lit("A2"), 3)
    got = one(spark, put, t=body)
    assert got == "# H\nmine 1\n%% vellum:ai:start v3 %%\n\nA2\n\n%% vellum:ai:end %%\nmine 2\n%% vellum:main:start v3 %%\n\nM2\n\n%% vellum:main:end %%\nmine 3"
    assert one(spark, put, t=got) == got
    assert one(spark, R.region(F.col("t"), "ai")["inside"], t=got) == "A2"
    assert one(spark, R.put_region(F.col("t"), "ai", F.lit(None).cast("string"), 3), t=body) == body


def test_where_a_missing_region_goes(spark):
    put = lambda **k: R.put_region(F.col("t"), "ai", F.lit("A"), 2, **k)
    block = "%% vellum:ai:start v2 %%\n\nA\n\n%% vellum:ai:end %%"
    main = "%% vellum:main:start v1 %%\nm\n%% vellum:main:end %%"
    assert one(spark, put(after="main", before="## Mine"), t=f"x\n{main}\ny\n## Mine\nz") == f"x\n{main}\n\n{block}\ny\n## Mine\nz"
    assert one(spark, put(after="main", before="## Mine"), t="x\n## Mine\nz") == f"x\n{block}\n\n## Mine\nz"
    assert one(spark, put(), t="# T\nx") == f"# T\n\n{block}\n\nx"
    assert one(spark, put(), t="x\n\n") == f"x\n\n{block}\n"
    assert one(spark, put(), t=None) == f"{block}\n"
    closed_first = "%% vellum:ai:end %%\nx\n%% vellum:ai:start v1 %%"
    assert one(spark, put(), t=closed_first) == f"{closed_first}\n\n{block}\n"


def test_three_ways(spark):
    make = R.merged_note(F.col("base"), F.col("mine"), managed(title="title: T2"), OWNED, [("main", F.lit("new main")), ("ai", F.col("ai"))], 2, "## Mine")
    first = one(spark, make, base=None, mine=None, ai="first ai")
    assert first == note("title: T2", "\n%% vellum:main:start v2 %%\n\nnew main\n\n%% vellum:main:end %%\n\n%% vellum:ai:start v2 %%\n\nfirst ai\n\n%% vellum:ai:end %%\n\n## Mine\n")
    assert one(spark, make, base=first, mine=first, ai="first ai") == first
    mine = first.replace("first ai", "first ai\nmy remark").replace("title: T2", "title: T2\nrating: 4") + "my note"
    got = one(spark, make, base=first, mine=mine, ai="second ai")
    assert "rating: 4" in got and "first ai" not in got and got.endswith("## Mine\n\nmy remark\n\nmy note") and "second ai" in got
    states = [one(spark, R.region_state(F.col("base"), F.col("mine"), "ai"), base=b, mine=m) for b, m in ((None, first), (first, mine), (first, first), (first, "x"))]
    assert states == ["new", "edited", "same", "removed"]


LINES = st.lists(st.sampled_from(["", "text", "# H", "## Mine", "- a: b", "%% c %%"]), max_size=8)


@settings(max_examples=25, deadline=None)
@given(LINES, LINES)
def test_what_stands_outside_is_kept(spark, above, below):
    region = "%% vellum:ai:start x %%\nold\n%% vellum:ai:end %%"
    text = "\n".join([*above, region, *below])
    got = one(spark, R.put_region(F.col("t"), "ai", F.lit("new"), 1), t=text)
    assert re.split(r"%% vellum:ai:(?:start v1 %%\n\nnew\n\n%% vellum:ai:)?end %%", got) == text.split(region)


def test_a_note_is_cut_once_at_each_mark(spark):
    frame = spark.createDataFrame([("b", "m", "x")], "base string, mine string, ai string")
    make = R.merged_note(F.col("base"), F.col("mine"), managed(title="title: T"), OWNED, [("main", F.lit("new")), ("ai", F.col("ai"))], 2, "## Mine")
    plan = frame.select(make.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(word) for word in ("RLIKE", "regexp_extract(", "split(")) < 50


def test_marks_beside_odd_signs(spark):
    block = "%% vellum:ai:start v1 %%\n\nA\n\n%% vellum:ai:end %%"
    put = R.put_region(F.col("t"), "ai", F.lit("A"), 1)
    for before, region, after in [
        ("\U0001f600 é\r\n", "%% vellum:ai:start x %%\r\n\U0001f600\r\n%% vellum:ai:end %%", "\r\nz"),
        ("", "%% vellum:ai:start a %%\r%% vellum:ai:end %%", "\rz"),
        ("a %% vellum:ai:start %%\n", "%% vellum:ai:start %%\n%% vellum:ai:start %%\nb\n%% vellum:ai:end %%", "\n%% vellum:ai:end %%"),
    ]:
        assert one(spark, put, t=before + region + after) == before + block + after
