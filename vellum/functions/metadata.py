"""Metadata fields: widths, pages, volumes, dates, names, citations, study data, answers, file names, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.identifiers import blank, let

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def half_width(column: Column) -> Column:
    """Full-width ASCII and the ideographic space as their half-width forms."""
    return F.translate(F.coalesce(column, F.lit("")), _FULL, _HALF)


def clean_han(column: Column) -> Column:
    """Spaces collapsed, and dropped between Han characters."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\s　]+", " ")), r"(?<=\p{IsHan}) (?=\p{IsHan})", "")


#: Grammar of a list of pages: a page, a range, and what may stand around the list.
PAGE = r"[A-Za-z]?\d+[A-Za-z]?"
PAGE_RANGE = rf"{PAGE}(?:\s*(?:[-‐‑‒–—―−~〜]+|至|到)\s*{PAGE})?"
PAGE_LIST = rf"{PAGE_RANGE}(?:\s*[,、]\s*{PAGE_RANGE})*"
PAGE_WORD = r"(?:頁碼|頁數|頁次|頁|(?i:pages?|pp?\.?))\s*:?\s*"


def normalize_pages(column: Column) -> Column:
    """Page ranges as 45-56, 60; null where the text is no plain list of pages."""
    listed = F.regexp_extract(F.trim(half_width(column)), rf"^(?:第\s*)?(?:{PAGE_WORD})?+({PAGE_LIST})(?:\s*頁)?$", 1)
    ranges = F.transform(F.regexp_extract_all(listed, F.lit(PAGE_RANGE), F.lit(0)), lambda r: F.array_join(F.regexp_extract_all(r, F.lit(PAGE), F.lit(0)), "-"))
    return F.nullif(F.array_join(ranges, ", "), F.lit(""))


#: Marks of volumes and issues, and of dates, each with the letter that stands for it in a text's shape; n is a number.
ISSUE_MARKS = {"n": r"\d+(?:\s*[-/]\s*\d+)?", "W": r"(?i:volume)\b\.?", "V": r"(?i:vol)\b\.?", "N": r"(?i:no|issue)(?![A-Za-z])\.?", "o": "第", "v": "卷", "i": "期", "(": r"\(", ")": r"\)", ",": ","}
DATE_MARKS = {"n": r"\d+", "R": "(?:中華)?民國", "y": "年", "m": "月", "d": "日", "-": "[./-]"}


def _shape(column: Column, marks: dict[str, str], body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of a text, of its marks as a string of their letters, and of its numbers; the marks are empty where anything else stands in the text."""
    pattern = "|".join(marks.values())

    def letter(mark: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, one in marks.items():
            out = out.when(mark.rlike(rf"\A(?:{one})\z"), name)
        return out

    def parts(text: Column) -> Column:
        # Most texts fail here, and their marks are not looked at.
        whole = F.regexp_replace(text, rf"{pattern}|\s", "") == ""
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        return let(F.when(whole, found).otherwise(F.array().cast("array<string>")), lambda marks: F.struct(text.alias("text"), F.array_join(F.transform(marks, letter), "").alias("shape"), _numbers(marks).alias("numbers")))

    return let(let(F.trim(half_width(column)), parts), lambda p: body(p["text"], p["shape"], p["numbers"]))


def _numbers(marks: Column) -> Column:
    return F.transform(F.filter(marks, lambda m: m.rlike(r"\A\d")), lambda m: F.regexp_replace(m, r"\s+", ""))


def clean_volume(column: Column) -> Column:
    """The number of a volume, as in 第70卷 or Vol. 70; null where the text is something else."""
    first = lambda numbers: F.get(numbers, F.lit(0))
    return _shape(column, ISSUE_MARKS, lambda _, shape, numbers: F.when(shape.rlike(r"\A(?:o?nv|[VW]?n)\z") & first(numbers).rlike(r"\A\d+\z"), first(numbers)))


def clean_issue(column: Column) -> Column:
    """The number of an issue or of several, as in 第2期, No. 2-3 or (2); null where the text is something else."""
    return _shape(column, ISSUE_MARKS, lambda _, shape, numbers: F.when(shape.rlike(r"\A(?:o?ni|N?n|\(n\))\z"), F.get(numbers, F.lit(0))))


def split_volume(column: Column) -> Column:
    """Struct of volume and issue written together, as in 70(2); null where they are not."""

    def split(_: Column, shape: Column, numbers: Column) -> Column:
        volume = F.get(numbers, F.lit(0))
        return F.when(shape.rlike(r"\A(?:n\(n\)|o?nv,?o?ni|Vn,?Nn)\z") & volume.rlike(r"\A\d+\z"), F.struct(volume.alias("volume"), F.get(numbers, F.lit(1)).alias("issue")))

    return _shape(column, ISSUE_MARKS, split)


def roc_date(column: Column) -> Column:
    """Struct of year, date and sure for a date in years of the Republic (1912 is year 1); null where it is none.

    A year is named by its sign, which makes it sure, or else written as a plain date.
    """

    def dated(text: Column, shape: Column, numbers: Column) -> Column:
        named, plain = shape.rlike(r"\AR?ny(?:nm(?:nd)?)?\z"), shape.rlike(r"\An(?:-n(?:-n)?)?\z") & ~text.rlike(r"\s")
        digits = [F.coalesce(F.length(F.get(numbers, F.lit(k))), F.lit(0)) for k in range(3)]
        part = [F.get(numbers, F.lit(k)).try_cast("int") for k in range(3)]
        # Without the Republic's name one digit is too few; without any mark two are.
        least = F.when(shape.startswith("R"), 1).when(shape == "n", 3).otherwise(2)
        good = digits[0].between(least, 3) & (digits[1] <= 2) & (digits[2] <= 2) & part[0].between(1, 200)
        good = good & F.coalesce(part[1].between(1, 12), F.lit(True)) & F.coalesce(part[2].between(1, 31), F.lit(True))
        date = F.concat_ws("-", (part[0] + 1911).cast("string"), *[F.lpad(p.cast("string"), 2, "0") for p in part[1:]])
        return F.when((named | plain) & good, F.struct((part[0] + 1911).alias("year"), date.alias("date"), named.alias("sure")))

    return _shape(column, DATE_MARKS, dated)


def author_names(creators: Column) -> Column:
    """Names of the authors, or of all creators if none is an author. Han names are written in one piece."""
    authors = F.filter(creators, lambda c: c["creatorType"] == "author")
    chosen = F.when(F.size(authors) > 0, authors).otherwise(creators)

    def name(c: Column) -> Column:
        last, first, whole = (F.coalesce(c[k], F.lit("")) for k in ("lastName", "firstName", "name"))
        han = F.concat(last, first).rlike(r"^\p{IsHan}+$")
        parts = F.array_join(F.filter(F.array(last, first), lambda x: x != ""), ", ")
        return F.when(whole != "", clean_han(whole)).when(han, F.concat(last, first)).otherwise(parts)

    return F.filter(F.transform(F.coalesce(chosen, F.array().cast(_CREATORS)), name), lambda n: n != "")


_CREATORS = "array<struct<lastName: string, firstName: string, name: string, creatorType: string>>"


def short_citation(names: Column, year: Column) -> Column:
    """(A, 2020), (A & B, 2020) or (A et al., 2020), by last names; n.d. for no year."""
    last = F.transform(names, lambda n: F.substring_index(n, ",", 1))
    who = F.when(F.size(last) == 0, "Anonymous").when(F.size(last) == 1, last[0]).when(F.size(last) == 2, F.concat(F.get(last, 0), F.lit(" & "), F.get(last, 1))).otherwise(F.concat(F.get(last, 0), F.lit(" et al.")))
    return F.concat(F.lit("("), who, F.lit(", "), F.coalesce(F.nullif(blank(year), F.lit("")), F.lit("n.d.")), F.lit(")"))


#: Words that stand for a value not reported.
NOT_REPORTED = ("", "null", "none", "n/a", "na", "nr", "-", "—", "not reported", "not applicable", "unknown", "unclear", "未報告", "文中未報告", "不適用", "無", "未知", "不清楚", "未提及")

#: Designs of studies, and the patterns that tell them by the first that fits, the more specific first.
STUDY_DESIGNS = ("RCT", "quasi-experimental", "cohort", "case-control", "cross-sectional", "qualitative", "mixed methods", "systematic review", "meta-analysis", "scoping review", "guideline", "other")
DESIGNS = (
    ("meta-analysis", r"meta[\s-]?analy|統合分析|後設分析"),
    ("scoping review", r"scoping|範域"),
    ("systematic review", r"systematic|umbrella|系統性(文獻)?回顧"),
    ("mixed methods", r"mixed|混合"),
    ("guideline", r"guideline|指引"),
    ("quasi-experimental", r"quasi|non[\s-]?randomi[sz]ed|pre[\s-]?(and[\s-]?)?post|before[\s-]and[\s-]after|類實驗|前後測"),
    ("RCT", r"\brcts?\b|randomi[sz]ed|隨機"),
    ("case-control", r"case[\s-]?control|病例對照"),
    ("cohort", r"cohort|longitudinal|世代|縱貫"),
    ("cross-sectional", r"cross[\s-]?sectional|survey|橫斷|橫斷面|調查"),
    ("qualitative", r"qualitative|phenomenolog|grounded theory|ethnograph|質性|現象學|紮根"),
)


def clean_value(column: Column, most: int = 500) -> Column:
    """Spaces collapsed; words for "not reported" count as empty."""
    text = F.trim(F.regexp_replace(F.coalesce(column.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.lower(text).isin(*NOT_REPORTED), "").otherwise(F.substring(text, 1, most))


def normalize_design(column: Column) -> Column:
    """The design named, spaces, hyphens and case aside; else the first whose pattern fits; empty for none reported."""
    text = F.lower(clean_value(column))
    key = lambda c: F.trim(F.regexp_replace(c, r"[\s_-]+", " "))
    names = F.create_map(*[x for d in STUDY_DESIGNS for x in (F.lit(d.lower().replace("-", " ")), F.lit(d))])
    found = F.when(text == "", "")
    for design, pattern in DESIGNS:
        found = found.when(text.rlike(pattern), design)
    return F.when(text != "", F.coalesce(F.try_element_at(names, key(text)), found.otherwise("other"))).otherwise("")


def sample_size(column: Column) -> Column:
    """The first whole number, thousands separators dropped."""
    joined = F.regexp_replace(clean_value(column), r"(?<=\d)[,，\s](?=\d{3}\b)", "")
    return F.nullif(F.regexp_extract(joined, r"\d+", 0), F.lit("")).try_cast("long")


def evidence_level(column: Column) -> Column:
    """1 to 5 from a digit, or from a Roman number that begins the text or follows "level"; years do not count; empty if there is none."""
    text = F.regexp_replace(clean_value(column), r"\b(?:19|20)\d\d\b", "")
    words = F.split(F.lower(text), "[^a-z]+")
    places = F.transform(words, lambda w, k: F.when(w.startswith("level"), F.substring(w, 6, 9)).when((k == 0) | (F.get(words, k - 1) == "level"), w))
    numbers = F.array(*[F.lit(x) for x in ("i", "ii", "iii", "iv", "v")])
    roman = F.get(F.filter(places, lambda w: F.array_contains(numbers, w)), F.lit(0))
    return F.coalesce(F.nullif(F.regexp_extract(text, "[1-5]", 0), F.lit("")), F.array_position(numbers, roman).cast("string"), F.lit(""))


def distinct_values(values: Column, most: int = 30) -> Column:
    """Cleaned values, the first spelling of each, in order."""
    clean = F.filter(F.transform(values, lambda v: clean_value(v, 100)), lambda v: v != "")
    keys = F.transform(clean, lambda v: F.lower(v))
    first = F.filter(F.transform(clean, lambda v, i: F.struct(v.alias("v"), (F.array_position(keys, F.lower(v)) == i + 1).alias("first"))), lambda x: x["first"])
    return F.slice(F.transform(first, lambda x: x["v"]), 1, most)


#: Words for the answers yes, no, unclear and not applicable.
ANSWER_WORDS = (
    ("yes", "y", "是", "符合", "有"),
    ("no", "n", "否", "不符合", "無"),
    ("unclear", "can't tell", "cant tell", "cannot tell", "unknown", "?", "不清楚", "不明確", "無法判斷", "不確定"),
    ("not applicable", "n/a", "na", "不適用"),
)


def normalize_answer(column: Column, answers: tuple[str, str, str, str] = ("yes", "no", "unclear", "not applicable")) -> Column:
    """One of the four ``answers`` for any of its words, such as 是, 否, 不清楚, 不適用; empty for any other word."""
    text = F.lower(F.trim(F.regexp_replace(F.trim(blank(column)), r"^\*+|\*+$", "")))
    found = F.when(text == "", "")
    for answer, words in zip(answers, ANSWER_WORDS, strict=True):
        found = found.when(text.isin(answer, *words), answer)
    return found.otherwise("")


def file_name(column: Column, most: int = 120) -> Column:
    """A name that file systems and note links accept."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"[\\/:*?\"<>|#^\[\]]", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", ""), r"\s+", " "))
    text = F.regexp_replace(F.trim(F.substring(text, 1, most)), r"[. ]+$", "")
    return F.when(text == "", "Untitled").otherwise(text)


def status_of_tag(tag: Column, prefix: str = "status/") -> Column:
    """The status in a tag, without decoration; empty if it is no status tag."""
    return F.when(tag.startswith(prefix), F.regexp_replace(F.substring(tag, F.lit(len(prefix) + 1), F.length(tag)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).otherwise("")


def findings(record: dict[str, Column]) -> Column:
    """What a record's fields should be: array of (field, problem, current, suggested, sure), empty if nothing is wrong.

    ``record`` has columns doi, pages, volume, issue, date and title.
    """
    from vellum.functions.identifiers import normalize_doi

    known = F.struct(
        *[blank(v).alias(k) for k, v in record.items()], record["title"].alias("own_title"), F.trim(F.regexp_replace(record["title"], r"\s+", " ")).alias("tidy"), split_volume(record["volume"]).alias("both"), roc_date(record["date"]).alias("roc"),
        normalize_doi(record["doi"]).alias("a_doi"), normalize_pages(record["pages"]).alias("a_pages"), clean_volume(record["volume"]).alias("a_volume"), clean_issue(record["issue"]).alias("a_issue"),
    )

    def finding(text: Column, field: str, problem: str, when: Column, suggested: Column, sure: bool | Column = True) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), text[field].alias("current"), suggested.alias("suggested"), (F.lit(sure) if isinstance(sure, bool) else sure).alias("sure")),
        )

    def found(k: Column) -> Column:
        doi, pages, volume, issue, both, roc, tidy = (k[name] for name in ("a_doi", "a_pages", "a_volume", "a_issue", "both", "roc", "tidy"))
        rows = [
            finding(k, "doi", "form", (k["doi"] != "") & (doi != "") & (doi != F.lower(k["doi"])), doi),
            finding(k, "doi", "invalid", (k["doi"] != "") & (doi == ""), F.lit(""), False),
            finding(k, "pages", "form", pages.isNotNull() & (pages != k["pages"]), pages),
            finding(k, "volume", "issue inside", both.isNotNull() & (k["issue"] == ""), both["volume"]),
            finding(k, "issue", "in volume", both.isNotNull() & (k["issue"] == ""), both["issue"]),
            finding(k, "volume", "form", volume.isNotNull() & (volume != k["volume"]), volume),
            finding(k, "issue", "form", issue.isNotNull() & (issue != k["issue"]), issue),
            finding(k, "date", "republic year", roc.isNotNull(), roc["date"], roc["sure"]),
            finding(k, "title", "spaces", tidy != k["own_title"], tidy),
        ]
        return F.filter(F.array(*rows), lambda x: x.isNotNull())

    return let(known, found)


def apply_findings(record: dict[str, Column], found: Column) -> dict[str, Column]:
    """The record's columns after the sure findings; of two for one field the later wins.

    ``found`` is named for each field, so it should be a column of the table rather than the expression that makes it.
    """
    sure = F.filter(found, lambda x: x["sure"])
    return {name: F.coalesce(F.try_element_at(_of_field(sure, name), F.lit(-1))["suggested"], column) for name, column in record.items()}


def _of_field(found: Column, name: str) -> Column:
    return F.filter(found, lambda x: x["field"] == name)
