import random
import re

from pyspark.sql import functions as F

from vellum.operators import reminders as R


def length(text):
    lines = [x for x in (text or "").split("\n") if not re.match(r"\s*\||#{1,6}\s", x)]
    text = re.sub(r"[*_`>#]", "", re.sub(r"(?i)\[S\d+[^\]\n]*\]", "", "\n".join(lines)))
    return len(re.findall("[\u4e00-\u9fff]", text)) + len(re.findall(r"[A-Za-z0-9]+(?:[.'’-][A-Za-z0-9]+)*", re.sub("[\u4e00-\u9fff]", " ", text)))


def expected(r):
    """The reminders of one report, told one after the other."""
    s, a, rows, entries = r["sections"] or {}, r["answer"] or {}, r["rows"] or [], r["entries"] or []
    cite = {e["id"]: e["citation"] for e in reversed(entries)}
    get = lambda k: (a.get(k) or "").strip()
    out = [("missingSection", "warn", [k]) for k in R.SECTIONS if not (s.get(k) or "").strip()]
    if (s.get("appraisal") or "").strip():
        heads = "\n".join(x for x in s["appraisal"].split("\n") if re.match(r"#{1,6}\s", x))
        cited = set(re.findall(r"S\d+", " ".join(re.findall(r"\[S\d+[^\]]*\]", heads))))
        missing = [e["citation"] for e in entries if e["id"] not in cited]
        out += [("missingAppraisal", "warn", missing)] if missing else []
    if len(rows) < 2:
        out.append(("fewStudies", "warn", [str(len(rows))]))
    if len(rows) > 5:
        out.append(("manyStudies", "info", [str(len(rows))]))
    if rows and not any(x["design"] in R.REVIEW_DESIGNS for x in rows):
        out.append(("noReview", "info", []))
    if r["withoutAI"]:
        out.append(("withoutAI", "warn", r["withoutAI"]))
    none = [cite.get(x["id"], x["id"]) for x in rows if not x["level"]]
    out += [("noLevel", "warn", none)] if none else []
    kind = get("questionType") or "therapy"
    if kind != "therapy" and any(x["level"] for x in rows):
        out.append(("cebmColumn", "warn", [kind]))
    tools = list(dict.fromkeys(f"{cite.get(x['id'], x['id'])}: {x['tool']}" for x in rows if x["tool"] and "casp" not in x["tool"].lower()))
    out += [("tool", "warn", tools)] if tools else []
    if not get("scenario"):
        out.append(("noScenario", "warn", []))
    elif not re.search("[「『“\"]", get("scenario")):
        out.append(("noQuote", "info", []))
    out += [("pico", "warn", [letter]) for k, letter in R.PICO if not get(k)]
    dbs = get("databases")
    if not dbs:
        out.append(("noDatabases", "warn", []))
    else:
        gone = [n for p, n in (("cochrane", "Cochrane Library"), ("pubmed|medline", "PubMed")) if not re.search(p, dbs.lower())]
        out += [("databases", "warn", gone)] if gone else []
        out += [] if "cinahl" in dbs.lower() else [("cinahl", "info", [])]
    out += [] if get("searchDate") else [("searchDate", "info", [])]
    if r["search"] and R.NOT_SEARCHED in (r["search"]["queryNote"] or "") and get("query") == (r["search"]["query"] or "").strip():
        out.append(("autoQuery", "warn", [get("query")]))
    if r["prisma"] is None:
        out.append(("noPrisma", "warn", []))
    else:
        pending = [f"{k}: {r['prisma'][k]}" for k in ("taPending", "ftPending") if r["prisma"][k]]
        out += [("prismaPending", "warn", pending)] if pending else []
    out += [("abstractLength", "warn", [f"{k}: {length(s.get(k))}"]) for k in ("abstractZh", "abstractEn") if length(s.get(k)) > 1200]
    body = length("\n".join(s.get(k) or "" for k in R.BODY))
    out += [("bodyLength", "warn", [str(body)])] if body > 6000 else []
    todo = sum((s.get(k) or "").count("〔待補") for k in R.SECTIONS)
    out += [("todos", "info", [str(todo)])] if todo else []
    chinese = [e["citation"] for e in entries if e["chinese"]]
    out += [("chineseRefs", "info", chinese)] if chinese else []
    return out + [("appraisers", "info", [])]


def report(seed):
    random.seed(seed)
    some = lambda *xs: random.choice(xs)
    entries = [{"id": f"S{k}", "citation": f"Author {k}", "chinese": some(True, False, None)} for k in range(1, random.randint(1, 8))]
    sections = {k: some("", None, "文字 of words [S1]", "# 標題\n| t |\n〔待補〕 x〔待補：y〕", "長" * random.choice([10, 1300, 7000]), "### [S1, p. 5; S2] a\nb [S3]\n## [S4]") for k in random.sample(R.SECTIONS, random.randint(0, 9))}
    rows = [{"id": e["id"], "design": some("RCT", "meta-analysis", None), "level": some("1", "", None), "tool": some("CASP RCT", "JBI", "", None)} for e in entries if random.random() < 0.8]
    keys = ("questionType", "scenario", "population", "intervention", "comparison", "outcome", "databases", "searchDate", "query")
    answer = {k: some(None, " ", "harm", "PubMed, Cochrane", "cinahl", "「痛」") for k in keys}
    prisma = some(None, {"taPending": 0, "ftPending": None}, {"taPending": 3, "ftPending": 1})
    search = some(None, {"query": answer["query"], "queryNote": "（尚未實際檢索）"}, {"query": "other", "queryNote": "尚未實際檢索"})
    return {"report": str(seed), "sections": some(sections, sections, None), "entries": some(entries, entries, None), "rows": some(rows, rows, None), "answer": some(answer, answer, None), "prisma": prisma, "search": search, "withoutAI": some(None, [], ["Author 1"])}


def test_all_checks_as_told_one_by_one(spark):
    reports = {str(k): report(k) for k in range(120)}
    frame = spark.createDataFrame(list(reports.values()), R.REPORT).repartition(3)
    found = {}
    for r in R.report_reminders(frame).collect():
        found.setdefault(r.report, {})[r.pos] = (r.code, r.level, r.evidence)
    for k, one in reports.items():
        assert [found[k][n] for n in range(len(found[k]))] == expected(one), k
    seen = {code for one in found.values() for code, _, _ in one.values()}
    assert seen == {c.code for c in R.checks()} and len(seen) == 24
    counts = {r.report: (r.warnings, r.infos) for r in R.issue_counts(R.report_reminders(frame)).collect()}
    assert counts == {k: (sum(x[1] == "warn" for x in expected(one)), sum(x[1] == "info" for x in expected(one))) for k, one in reports.items()}
    assert R.report_reminders(frame.limit(0)).count() == 0


def test_lengths_are_told_once_and_only_of_texts_that_can_pass_the_limit(spark):
    found = {c.code: str(c.evidence) for c in R.checks()}
    assert found["bodyLength"].count("[*_`>#]") == 1 and found["abstractLength"].count("[*_`>#]") == 2 and found["todos"].count(R.TO_DO) == 1
    texts = ["護理 word [S1] **two**\n## heading\n| a |", "plain words, don't", "", "é ü", "長" * 5]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.rough_length(F.col("t")).alias("n"), R._over(F.col("t"), 4).alias("over")).collect()
    assert [r.n for r in rows] == [4, 3, 0, 0, 5] and [r.over for r in rows] == [[], [], [], [], [5]]


def test_words_and_characters_are_counted_in_one_pass(spark):
    assert str(R.rough_length(F.col("t"))).count("IsHan") == 1
    random.seed(3)
    bits = ["a", "Z9", "word", ".", "'", "’", "-", " ", "\n", "漢", "護理", "é", "[S1", "]", "#", "# ", "*", "| ", "〔待補〕", "_"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(400)]
    # The lines that go are told in one way only where no mark or empty line stands before the line that follows.
    texts = [t for t in texts if not re.search(r"#\n|\n\s*\n", t)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.rough_length(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in found] == [(t, length(t)) for t in texts] and len(texts) > 200
