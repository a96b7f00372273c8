"""Reminders about evidence reports: one table of checks over all inputs of a report, evaluated in one pass over the reports.

A check has a code, a level, and the evidence that it finds: an array of strings, null where
it does not hold. The checks are columns of one projection, so a report of any number of
studies is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.identifiers import blank
from vellum.functions.prose import citations
from vellum.functions.text import HAN

#: Sections of a report, those of its body, designs that review others, limits of length, and marks of what is to be filled in.
SECTIONS = ("title", "abstractZh", "abstractEn", "intro", "question", "appraisal", "synthesis", "application", "conclusion")
BODY = ("intro", "question", "appraisal", "synthesis", "application", "conclusion")
REVIEW_DESIGNS = ("meta-analysis", "systematic review")
ABSTRACT_LIMIT, BODY_LIMIT = 1_200, 6_000
LEAST_STUDIES, MOST_STUDIES = 2, 5
TO_DO = "〔待補"
NOT_SEARCHED = "尚未實際檢索"
PICO = (("population", "P"), ("intervention", "I"), ("comparison", "C"), ("outcome", "O"))
THERAPY = "therapy"
#: A Latin word, or a Han character: these part words and are in none, so one pass counts both. The range in front tells ASCII at one step.
WORD_OR_HAN = rf"[A-Za-z0-9]++(?:[.'’-][A-Za-z0-9]++)*+|[\x{{80}}-\x{{10FFFF}}&&[{HAN}]]"

REPORT = (
    "report string, sections map<string, string>, entries array<struct<id: string, citation: string, chinese: boolean>>, rows array<struct<id: string, design: string, level: string, tool: string>>, "
    "answer struct<questionType: string, scenario: string, population: string, intervention: string, comparison: string, outcome: string, databases: string, searchDate: string, query: string>, "
    "prisma struct<taPending: int, ftPending: int>, search struct<query: string, queryNote: string>, withoutAI array<string>"
)


@dataclass(frozen=True)
class Check:
    """Code, level, and the evidence: an array, null where the check does not hold; ``each`` makes a finding of every element."""

    code: str
    level: str
    evidence: Column
    each: bool = False


def rough_length(text: Column) -> Column:
    """Han characters and Latin words of a text, without tables, headings, citations and marks."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^(?:\s*\||#{1,6}\s).*$", "")
    plain = F.regexp_replace(plain, r"(?i)\[S\d+(?:[^\]\n]*)\]|[*_`>#]", "")
    return F.regexp_count(plain, F.lit(WORD_OR_HAN))


def _over(text: Column, limit: int) -> Column:
    """The rough length of a text where it passes the limit, in an array; a text of no more signs cannot, and is not read."""
    return F.filter(F.array(F.when(F.length(text) > limit, rough_length(text))), lambda n: F.coalesce(n > limit, F.lit(False)))


def _found(values: Column) -> Column:
    """An array as evidence: null where it is empty."""
    return F.when(F.size(values) > 0, values)


def _when(test: Column, *said: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(*[s.cast("string") for s in said]).cast("array<string>"))


def checks() -> list[Check]:
    """All checks, in the order in which a report lists them."""
    section = lambda key: F.coalesce(F.try_element_at("sections", F.lit(key)), F.lit(""))
    answer = lambda key: blank(F.col(f"answer.{key}"))
    rows, entries = (F.coalesce(c, F.array().cast(kind)) for c, kind in ((F.col("rows"), "array<struct<id: string, design: string, level: string, tool: string>>"), (F.col("entries"), "array<struct<id: string, citation: string, chinese: boolean>>")))
    n = F.size(rows)
    name = lambda id: F.coalesce(F.get(F.filter(entries, lambda e: e["id"] == id), F.lit(0))["citation"], id)
    names = lambda found: F.transform(found, lambda r: name(r["id"]))
    headings = F.array_join(F.regexp_extract_all(section("appraisal"), F.lit(r"(?m)^#{1,6}\s.*$"), F.lit(0)), "\n")
    cited = F.transform(citations(headings), lambda c: c["id"])
    # As the variable of a function, what is cited is looked for once and not for every entry.
    uncited = F.flatten(F.transform(F.array(cited), lambda c: F.filter(entries, lambda e: ~F.array_contains(c, F.upper(e["id"])))))
    unappraised = F.transform(uncited, lambda e: e["citation"])
    other_tools = F.filter(rows, lambda r: (blank(r["tool"]) != "") & ~r["tool"].rlike("(?i)casp"))
    kind = F.coalesce(F.nullif(answer("questionType"), F.lit("")), F.lit(THERAPY))
    databases, scenario = answer("databases"), answer("scenario")
    missing_databases = F.filter(F.array(*[F.when(~databases.rlike(p), F.lit(x)) for p, x in (("(?i)cochrane", "Cochrane Library"), ("(?i)pubmed|medline", "PubMed"))]), lambda x: x.isNotNull())
    abstract = lambda key: F.transform(_over(section(key), ABSTRACT_LIMIT), lambda n: F.concat(F.lit(f"{key}: "), n.cast("string")))
    long_abstracts = F.concat(abstract("abstractZh"), abstract("abstractEn"))
    long_body = F.transform(_over(F.concat_ws("\n", *[section(k) for k in BODY]), BODY_LIMIT), lambda n: n.cast("string"))
    to_do = F.transform(F.filter(F.array(F.regexp_count(F.concat_ws("\n", *[section(k) for k in SECTIONS]), F.lit(TO_DO))), lambda n: n > 0), lambda n: n.cast("string"))
    empty = F.filter(F.array(*[F.when(blank(section(k)) == "", F.lit(k)) for k in SECTIONS]), lambda x: x.isNotNull())
    no_pico = F.filter(F.array(*[F.when(answer(k) == "", F.lit(letter)) for k, letter in PICO]), lambda x: x.isNotNull())
    pending = F.filter(F.array(*[F.when(F.coalesce(F.col(f"prisma.{c}"), F.lit(0)) > 0, F.concat(F.lit(f"{c}: "), F.col(f"prisma.{c}").cast("string"))) for c in ("taPending", "ftPending")]), lambda x: x.isNotNull())
    return [
        Check("missingSection", "warn", empty, each=True),
        Check("missingAppraisal", "warn", F.when(blank(section("appraisal")) != "", _found(unappraised))),
        Check("fewStudies", "warn", _when(n < LEAST_STUDIES, n)),
        Check("manyStudies", "info", _when(n > MOST_STUDIES, n)),
        Check("noReview", "info", _when((n > 0) & ~F.exists(rows, lambda r: F.coalesce(r["design"].isin(*REVIEW_DESIGNS), F.lit(False))))),
        Check("withoutAI", "warn", _found(F.coalesce("withoutAI", F.array().cast("array<string>")))),
        Check("noLevel", "warn", _found(names(F.filter(rows, lambda r: blank(r["level"]) == "")))),
        Check("cebmColumn", "warn", _when((kind != THERAPY) & F.exists(rows, lambda r: blank(r["level"]) != ""), kind)),
        Check("tool", "warn", _found(F.array_distinct(F.transform(other_tools, lambda r: F.concat(name(r["id"]), F.lit(": "), r["tool"]))))),
        Check("noScenario", "warn", _when(scenario == "")),
        Check("noQuote", "info", _when((scenario != "") & ~scenario.rlike("[「『“\"]"))),
        Check("pico", "warn", no_pico, each=True),
        Check("noDatabases", "warn", _when(databases == "")),
        Check("databases", "warn", F.when(databases != "", _found(missing_databases))),
        Check("cinahl", "info", _when((databases != "") & ~databases.rlike("(?i)cinahl"))),
        Check("searchDate", "info", _when(answer("searchDate") == "")),
        Check("autoQuery", "warn", _when(blank(F.col("search.queryNote")).contains(NOT_SEARCHED) & (answer("query") == blank(F.col("search.query"))), answer("query"))),
        Check("noPrisma", "warn", _when(F.col("prisma").isNull())),
        Check("prismaPending", "warn", _found(pending)),
        Check("abstractLength", "warn", long_abstracts, each=True),
        Check("bodyLength", "warn", long_body, each=True),
        Check("todos", "info", to_do, each=True),
        Check("chineseRefs", "info", _found(F.transform(F.filter(entries, lambda e: F.coalesce(e["chinese"], F.lit(False))), lambda e: e["citation"]))),
        Check("appraisers", "info", F.array().cast("array<string>")),
    ]


def report_reminders(reports: DataFrame, table: list[Check] | None = None) -> DataFrame:
    """``report, pos, code, level, evidence`` of all reports (of the schema REPORT), in the order of the checks.

    Null fields count as empty: a report of nothing has all the reminders of an empty one.
    Extra columns are not read; an empty table gives none.
    """
    finding = lambda check, evidence: F.struct(F.lit(check.code).alias("code"), F.lit(check.level).alias("level"), evidence.alias("evidence"))
    none = F.array().cast("array<struct<code: string, level: string, evidence: array<string>>>")

    def told(check: Check) -> Column:
        """The findings of a check; its evidence stands in the plan once."""
        if check.each:
            return F.coalesce(F.transform(check.evidence, lambda e: finding(check, F.array(e))), none)
        return F.transform(F.filter(F.array(check.evidence), lambda e: e.isNotNull()), lambda e: finding(check, e))

    parts = [told(check) for check in (checks() if table is None else table)]
    found = reports.select("report", F.posexplode(F.flatten(F.array(*parts))).alias("pos", "f"))
    return found.select("report", "pos", "f.code", "f.level", "f.evidence")


def issue_counts(reminders: DataFrame) -> DataFrame:
    """``report, warnings, infos`` of the reports that have any."""
    return reminders.groupBy("report").agg(F.count_if(F.col("level") == "warn").alias("warnings"), F.count_if(F.col("level") == "info").alias("infos"))
