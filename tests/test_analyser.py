from pyspark.sql import functions as F

from vellum.functions import analyser as A

SURNAMES = "陳林王李張黃"
PERSON = lambda last=None, first=None, name=None, kind="author": (last, first, name, kind)


def analysed(spark, records):
    """Findings, and fields and creators after the sure ones, of records (fields, creators), all in one job."""
    schema = "id int, " + ", ".join(f"`{f}` string" for f in A.FIELDS) + f", creators {A.CREATORS}"
    frame = spark.createDataFrame([(k, *[fields.get(f) for f in A.FIELDS], list(creators)) for k, (fields, creators) in enumerate(records)], schema)
    found = A.analyse(frame, SURNAMES).withColumn("all", F.col("findings"))
    rows = sorted(A.applied(found.withColumn("findings", A.sure_ones(F.col("all")))).collect(), key=lambda r: r.id)
    return [(r["all"], r.asDict(), [tuple(p) for p in r.creators]) for r in rows]


GOOD = {"itemType": "journalArticle", "title": "護理人員的經驗", "date": "2023-04", "volume": "70", "issue": "2", "pages": "45-56", "DOI": "10.6224/JN.202304_70(2).07", "language": "zh-TW", "publicationTitle": "護理雜誌"}


def kinds(found):
    return {f.kind: (f.problem, f.sure, f.suggested) for f in found}


def test_every_kind(spark):
    seen = {}
    cases = [
        ({"publisher": "臺灣大學碩士論文"}, "itemType", ("looks like a thesis", False, "thesis")),
        ({"title": " 護理,研究。"}, "title", ("form", True, "護理，研究")),
        ({"title": "護理人員的經驗 The experience of many nurses"}, "title-english", ("translation behind", False, "護理人員的經驗")),
        ({"title": "護理人員的經驗 以醫院為例"}, "title-space", ("space inside", False, "護理人員的經驗：以醫院為例")),
        ({"publicationTitle": "《護理雜誌》"}, "publicationTitle", ("form", True, "護理雜誌")),
        ({"publicationTitle": "護理雜誌 Journal of Nursing"}, "publicationTitle-english", ("two names", False, "護理雜誌")),
        ({"date": " "}, "date-missing", ("missing", False, "")),
        ({"date": "春季"}, "date-missing", ("no year", False, "")),
        ({"date": "民國112年4月"}, "date", ("republic year", True, "2023-04")),
        ({"date": "112/04"}, "date", ("republic year", False, "2023-04")),
        ({"date": "２０２３"}, "date", ("full-width digits", True, "2023")),
        ({"volume": "70(2)", "issue": ""}, "volume", ("issue inside", True, "70(2)")),
        ({"volume": "70(2)", "issue": "3"}, "volume", ("issue inside", False, "70(2)")),
        ({"volume": "第70卷", "issue": "第2期"}, "volume", ("form", True, "70 / 2")),
        ({"pages": "第45至56頁"}, "pages", ("form", True, "45-56")),
        ({"volume": "", "pages": None}, "volume-missing", ("volume, pages", False, "")),
        ({"DOI": "https://doi.org/10.6224/JN.1"}, "DOI", ("form", True, "10.6224/JN.1")),
        ({"DOI": "", "extra": "a: b\nDOI: 10.6224/JN.2\nc"}, "DOI", ("in extra", True, "10.6224/JN.2")),
        ({"DOI": None, "url": "https://doi.org/10.6224/JN.3"}, "DOI", ("in the address", True, "10.6224/JN.3")),
        ({"DOI": "10.6224"}, "DOI-bad", ("invalid", False, "")),
        ({"itemType": "thesis", "publisher": "國立臺灣大學", "extra": "碩士論文"}, "thesisType", ("missing", False, "碩士論文")),
        ({"itemType": "thesis", "thesisType": "碩士論文"}, "publisher", ("missing", False, "")),
        ({"language": "zh_tw"}, "language", ("code of another form", True, "zh-TW")),
        ({"language": "简体中文"}, "language", ("language in words", True, "zh-CN")),
        ({"language": ""}, "language", ("no region", True, "zh-TW")),
        ({"language": "en"}, "language", ("another language than the title's", False, "zh-TW")),
    ]
    others = [(GOOD, [PERSON("陳", "美玲")]), (GOOD | {"title": "Nursing  care of all。", "volume": "第70卷", "language": "en"}, []), ({}, []), (GOOD, [PERSON(name="陳美玲、林大同"), PERSON("美玲", "陳")])]
    results = analysed(spark, [(GOOD | changes, []) for changes, _, _ in cases] + others)
    for (changes, kind, want), (found, _, _) in zip(cases, results, strict=False):
        assert kinds(found).get(kind) == want, (changes, kinds(found))
        seen[kind] = True
    fine, foreign, nothing, people = results[len(cases) :]
    assert fine[0] == foreign[0] == nothing[0] == [] and all(nothing[1][f] is None for f in A.FIELDS) and nothing[2] == []
    assert [(f.kind, f.place, [p.name or (p.lastName, p.firstName) for p in f.replacement]) for f in people[0]] == [("creator", 0, ["陳美玲", "林大同"]), ("creator", 1, [("陳", "美玲")])]
    assert {*seen, "creator"} == set(A.KINDS) and len(A.KINDS) == 17


def test_sure_findings_are_applied(spark):
    people = [PERSON(name="陳美玲、林大同"), PERSON("張", "三", None, "editor")]
    record = GOOD | {"title": "護理,研究。", "volume": "70(2)", "issue": None, "DOI": "", "extra": "a: b\nDOI: 10.6224/JN.2", "language": "zh_tw", "date": "112/04"}
    ((_, new, creators),) = analysed(spark, [(record, people)])
    assert (new["title"], new["volume"], new["issue"], new["DOI"], new["extra"], new["language"], new["date"]) == ("護理，研究", "70", "2", "10.6224/JN.2", "a: b", "zh-TW", "112/04")
    assert creators == [(None, None, "陳美玲", "author"), (None, None, "林大同", "author"), ("張", "三", None, "editor")]


def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, tmp_path):
    from vellum.session import spread

    spark.range(1_000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spread(spark.read.parquet(f"{tmp_path}/one"))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == 1_000
