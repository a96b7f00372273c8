"""One analyser over all fields of Chinese records: what each field should be, how sure that is, and what applying it writes.

A finding names its kind, a field, what stands there and what should, and its changes: new
values of fields, another item type, or other creators in place of one. Findings come in a
fixed order, and of two that change one field the later wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.creators import creator_repair
from vellum.functions.identifiers import detect_doi, repair_doi
from vellum.functions.metadata import clean_issue, clean_volume, half_width, normalize_pages, roc_date, split_volume
from vellum.functions.prose import is_chinese
from vellum.functions.quality import chinese_part, degree_of, guess_thesis, tidy_journal, tidy_title
from vellum.functions.text import HAN, guess_language

#: Item types with a DOI, with volume and issue, and those that a thesis is filed as.
DOI_TYPES = ("journalArticle", "conferencePaper", "preprint", "dataset", "standard", "report", "book", "bookSection", "thesis")
SERIAL_TYPES = ("journalArticle", "magazineArticle", "newspaperArticle")
THESIS_FROM = ("journalArticle", "report", "document", "book", "webpage", "manuscript")
#: Characters of traditional or of simplified Chinese alone, and names of the languages.
TRADITIONAL = "護體學與醫們個會這為對發現說時關國經過還應實當動從問點樣來後進產開數將變長讓種義業間員專區語計頭電環質讀檢驗療藥衛顧壓務營養態響類網隨機設證據權級運歷參請際準認識調職論雜誌預練傷統"
SIMPLIFIED = "护体学与医们个会这为对发现说时关国经过还应实当动从问点样来后进产开数将变长让种义业间员专区语计头电环质读检验疗药卫顾压务营养态响类网随机设证据权级运历参请际认识调职论杂预练伤统"
TRADITIONAL_NAMES = r"(?i)^(?:繁體中文|正體中文|繁中|traditional chinese|chinese \(traditional\))$"
SIMPLIFIED_NAMES = r"(?i)^(?:简体中文|簡體中文|简中|simplified chinese|chinese \(simplified\))$"
CHINESE_NAMES = r"(?i)^(?:zh|chi|zho|cmn|chinese|中文|華語|华语|漢語|汉语|國語|国语|中文\s*chinese|chinese\s*中文)$"

#: What a thesis of a degree is called.
DEGREES = {"master": "碩士論文", "doctor": "博士論文"}

CREATORS = "array<struct<lastName: string, firstName: string, name: string, creatorType: string>>"
FIELDS = ("itemType", "title", "date", "volume", "issue", "pages", "DOI", "url", "extra", "language", "publicationTitle", "publisher", "thesisType", "libraryCatalog")
FINDING = (
    "struct<kind: string, field: string, problem: string, sure: boolean, current: string, suggested: string, "
    f"fields: map<string, string>, itemType: string, place: int, replacement: {CREATORS}>"
)
#: All kinds, in the order of findings.
KINDS = (
    "itemType", "creator", "title", "title-english", "title-space", "publicationTitle", "publicationTitle-english", "date-missing", "date", "volume", "pages", "volume-missing", "DOI", "DOI-bad", "thesisType", "publisher", "language",
)


def _finding(kind: str, field: str, problem: Column | str, when: Column, current: Column, suggested: Column, sure: Column | bool, changes: dict[str, Column] | None = None, item_type: str | None = None) -> Column:
    """An array of one finding, or an empty one where ``when`` does not hold; values of ``changes`` that are null change nothing."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (changes or {}).items()]), lambda e: e["v"].isNotNull()) if changes else F.array().cast("array<struct<k: string, v: string>>")
    made = F.struct(
        F.lit(kind).alias("kind"), F.lit(field).alias("field"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"), (F.lit(sure) if isinstance(sure, bool) else sure).alias("sure"),
        current.alias("current"), suggested.alias("suggested"), F.map_from_entries(entries).alias("fields"), F.lit(item_type).cast("string").alias("itemType"), F.lit(None).cast("int").alias("place"), F.lit(None).cast(CREATORS).alias("replacement"),
    )
    return F.filter(F.array(F.when(F.coalesce(when, F.lit(False)), made).cast(FINDING)), lambda x: x.isNotNull())


def _creators(creators: Column, repairs: Column) -> Column:
    """A finding for every creator that has a repair, with its place and what to put there, of the same creator type."""
    shown = lambda p: F.coalesce(p["name"], F.concat_ws(" ", p["lastName"], p["firstName"]))

    def one(both: Column, place: Column) -> Column:
        c, repair = both["c"], both["r"]
        people = F.transform(repair["replacement"], lambda p: F.struct(p["lastName"], p["firstName"], p["name"], c["creatorType"].alias("creatorType")))
        said = F.array_join(F.transform(repair["replacement"], shown), "; ")
        return F.when(
            repair.isNotNull(),
            F.struct(
                F.lit("creator").alias("kind"), F.lit("creators").alias("field"), repair["problem"].alias("problem"), (repair["confidence"] == "sure").alias("sure"), shown(c).alias("current"), said.alias("suggested"),
                F.map_from_entries(F.array().cast("array<struct<k: string, v: string>>")).alias("fields"), F.lit(None).cast("string").alias("itemType"), place.alias("place"), people.alias("replacement"),
            ),
        ).cast(FINDING)

    return F.filter(F.transform(F.arrays_zip(creators.alias("c"), repairs.alias("r")), one), lambda x: x.isNotNull())


def _called(degree: Column) -> Column:
    return F.coalesce(*[F.when(degree.startswith(name), said) for name, said in DEGREES.items()])


def variant(text: Column) -> Column:
    """TW or CN by the characters that only one of them writes, whichever are more; empty on a tie."""
    count = lambda signs: F.regexp_count(text, F.lit(f"[{signs}]"))
    return F.when(count(TRADITIONAL) > count(SIMPLIFIED), "TW").when(count(SIMPLIFIED) > count(TRADITIONAL), "CN").otherwise("")


def analyse(records: DataFrame, surnames: str) -> DataFrame:
    """``records`` (columns FIELDS, null as empty, and ``creators``) with ``findings``; none for a record that is not Chinese.

    What several tests look at is a column of its own, computed once per record. Ties and
    repeated values need no rule: every test is about one record. Columns of other names
    pass through. ``records`` should come from a table: what derives its columns would be
    put in place of each of their uses.
    """
    c = lambda name: F.col(f"_a.{name}")
    none = F.lit("")

    def known(rows: DataFrame, **made: Column) -> DataFrame:
        return rows.withColumn("_a", F.struct(*([F.col("_a.*")] if "_a" in rows.columns else []), *[v.alias(k) for k, v in made.items()]))

    texts = {name: F.coalesce(name, none) for name in FIELDS}
    rows = known(records, **texts, people=F.coalesce("creators", F.array().cast(CREATORS)))
    bare = {name: F.trim(F.replace(c(name), F.lit("　"), F.lit(" "))) for name in FIELDS}
    lines = F.split(c("extra"), r"\r?\n")
    rows = known(
        rows,
        kind=F.when(bare["itemType"] == "", "journalArticle").otherwise(c("itemType")), tidy=tidy_title(c("title")), journal=tidy_journal(c("publicationTitle")), roc=roc_date(c("date")), half=F.trim(half_width(c("date"))),
        thesis=guess_thesis(c("url"), c("libraryCatalog"), c("publicationTitle"), c("publisher"), c("extra"), c("title")), degree=_called(degree_of(F.concat_ws("\n", *[c(n) for n in ("publicationTitle", "publisher", "extra", "title")]))),
        both=split_volume(c("volume")), one_volume=clean_volume(c("volume")), one_issue=clean_issue(c("issue")), listed=normalize_pages(c("pages")),
        own_doi=repair_doi(c("DOI")), doi_line=F.get(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*DOI\s*[:：]\s*\S+\s*$")), F.lit(0)),
        repairs=F.transform(c("people"), lambda p: creator_repair(p["lastName"], p["firstName"], p["name"], surnames)),
        written=variant(F.concat_ws(" ", c("title"), c("publicationTitle"), F.array_join(F.transform(c("people"), lambda p: F.concat_ws("", p["name"], p["lastName"], p["firstName"])), " "))),
        of_title=guess_language(c("title")),
    )
    rows = known(rows, english=chinese_part(c("tidy"), 3), two_names=chinese_part(c("journal"), 2), in_extra=detect_doi(c("doi_line"), none), in_url=detect_doi(none, c("url")))

    kind, tidy, journal, roc, half, both, doi = (c(n) for n in ("kind", "tidy", "journal", "roc", "half", "both", "own_doi"))
    english, two_names, pages = c("english"), c("two_names"), c("listed")
    translated = english.isNotNull() & (english != tidy)
    spaced = F.regexp_replace(tidy, rf"(?<={HAN})[ 　]+(?={HAN})", "：")
    serial = kind.isin(*SERIAL_TYPES)
    wide = roc.isNull() & ~c("date").rlike("[0-9]{4}") & half.rlike("[0-9]{4}")
    clash = (bare["issue"] != "") & ~c("one_issue").eqNullSafe(both["issue"])
    new_volume, new_issue = (F.when((bare[n] != "") & v.isNotNull() & (v != c(n)), v) for n, v in (("volume", c("one_volume")), ("issue", c("one_issue"))))
    same_pages = F.regexp_replace(F.trim(c("pages")), r"\s*[-–—]\s*", "-") == pages
    with_doi, no_doi = kind.isin(*DOI_TYPES), bare["DOI"] == ""
    has_line = c("in_extra") != ""
    elsewhere = F.when(has_line, c("in_extra")).otherwise(c("in_url"))
    extra = F.trim(F.array_join(F.filter(lines, lambda x: x != c("doi_line")), "\n"))

    language = bare["language"]
    standard = language.rlike(r"^zh-(?:TW|CN|HK|MO|SG|Hant|Hans)(?:-[A-Z]{2})?$")
    likely = F.when(c("written") == "CN", "zh-CN").otherwise("zh-TW")
    region = F.upper(F.regexp_extract(language, r"(?i)^zh[-_](tw|cn|hk|mo|sg)$", 1))
    plain = (language == "") | language.rlike(CHINESE_NAMES)
    ways = [
        (region != "", F.concat(F.lit("zh-"), region), F.lit(True), F.lit("code of another form")), (language.rlike(TRADITIONAL_NAMES), F.lit("zh-TW"), F.lit(True), F.lit("language in words")), (language.rlike(SIMPLIFIED_NAMES), F.lit("zh-CN"), F.lit(True), F.lit("language in words")),
        (plain, likely, c("written") == "TW", F.lit("no region")), (c("of_title") == "zh", likely, F.lit(False), F.lit("another language than the title's")),
    ]
    rows = known(rows, way=F.when(~standard, F.coalesce(*[F.when(test, F.struct(to.alias("to"), sure.alias("sure"), problem.alias("problem"))) for test, to, sure, problem in ways])))
    way, thesis, text = c("way"), c("thesis"), {name: c(name) for name in FIELDS}

    parts = [
        _finding("itemType", "itemType", "looks like a thesis", kind.isin(*THESIS_FROM) & thesis.isNotNull(), kind, F.lit("thesis"), False, {"thesisType": _called(thesis["degree"])}, "thesis"),
        _creators(c("people"), c("repairs")),
        _finding("title", "title", "form", (bare["title"] != "") & (tidy != text["title"]), text["title"], tidy, True, {"title": tidy}),
        _finding("title-english", "title", "translation behind", (bare["title"] != "") & translated, text["title"], english, False, {"title": english}),
        _finding("title-space", "title", "space inside", (bare["title"] != "") & ~translated & (spaced != tidy), text["title"], spaced, False, {"title": spaced}),
        _finding("publicationTitle", "publicationTitle", "form", serial & (bare["publicationTitle"] != "") & (journal != text["publicationTitle"]), text["publicationTitle"], journal, True, {"publicationTitle": journal}),
        _finding("publicationTitle-english", "publicationTitle", "two names", serial & (bare["publicationTitle"] != "") & two_names.isNotNull() & (two_names != journal), text["publicationTitle"], two_names, False, {"publicationTitle": two_names}),
        _finding("date-missing", "date", F.when(bare["date"] == "", "missing").otherwise("no year"), (bare["date"] == "") | (roc.isNull() & ~half.rlike("[0-9]{4}")), text["date"], none, False),
        _finding("date", "date", F.when(roc.isNotNull(), "republic year").otherwise("full-width digits"), (bare["date"] != "") & (roc.isNotNull() | wide), text["date"], F.coalesce(roc["date"], half), F.coalesce(roc["sure"], F.lit(True)), {"date": F.coalesce(roc["date"], half)}),
        _finding("volume", "volume", "issue inside", serial & both.isNotNull(), text["volume"], F.concat(both["volume"], F.lit("("), both["issue"], F.lit(")")), ~clash, {"volume": both["volume"], "issue": both["issue"]}),
        _finding("volume", "volume", "form", serial & both.isNull() & (new_volume.isNotNull() | new_issue.isNotNull()), F.concat_ws(" / ", text["volume"], text["issue"]), F.concat_ws(" / ", F.coalesce(new_volume, text["volume"]), F.coalesce(new_issue, text["issue"])), True, {"volume": new_volume, "issue": new_issue}),
        _finding("pages", "pages", "form", (bare["pages"] != "") & pages.isNotNull() & ~same_pages, text["pages"], pages, True, {"pages": pages}),
        _finding("volume-missing", "volume", F.concat_ws(", ", F.when(bare["volume"] == "", "volume"), F.when(bare["pages"] == "", "pages")), (kind == "journalArticle") & ((bare["volume"] == "") | (bare["pages"] == "")), none, none, False),
        _finding("DOI", "DOI", "form", with_doi & ~no_doi & (doi != "") & (doi != text["DOI"]), text["DOI"], doi, True, {"DOI": doi}),
        _finding("DOI-bad", "DOI", "invalid", with_doi & ~no_doi & (doi == ""), text["DOI"], none, False),
        _finding("DOI", "DOI", F.when(has_line, "in extra").otherwise("in the address"), with_doi & no_doi & (elsewhere != ""), F.when(has_line, c("doi_line")).otherwise(text["url"]), elsewhere, True, {"DOI": elsewhere, "extra": F.when(has_line, extra)}),
        _finding("thesisType", "thesisType", "missing", (kind == "thesis") & (bare["thesisType"] == ""), none, F.coalesce(c("degree"), none), False, {"thesisType": c("degree")}),
        _finding("publisher", "publisher", "missing", (kind == "thesis") & (bare["publisher"] == ""), none, none, False),
        _finding("language", "language", way["problem"], way.isNotNull(), text["language"], way["to"], way["sure"], {"language": way["to"]}),
    ]
    chinese = is_chinese(F.col("title"), F.transform(c("people"), lambda p: F.concat_ws("", p["name"], p["lastName"], p["firstName"])), F.col("language"))
    found = F.when(F.coalesce(chinese, F.lit(False)), F.flatten(F.array(*parts))).otherwise(F.array().cast(f"array<{FINDING}>"))
    return rows.withColumn("findings", found).drop("_a")


def sure_ones(findings: Column) -> Column:
    """Findings that a review starts with: sure ones that change something."""
    return F.filter(findings, lambda f: f["sure"] & ((F.size(f["fields"]) > 0) | f["itemType"].isNotNull() | f["replacement"].isNotNull()))


def applied(records: DataFrame, findings: str = "findings") -> DataFrame:
    """``records`` after the findings of a column: of two changes of a field the later wins, a creator may become several."""
    found = F.col(findings)
    start = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fields = F.aggregate(found, start, lambda all, f: F.map_zip_with(all, f["fields"], lambda k, old, new: F.coalesce(new, old)))
    typed = F.element_at(F.filter(F.transform(found, lambda f: f["itemType"]), lambda t: t.isNotNull()), -1)
    rows = records.withColumn("_new", fields).withColumn("_type", F.when(F.exists(found, lambda f: f["itemType"].isNotNull()), typed))
    put = lambda place: F.filter(found, lambda f: (f["place"] == place) & f["replacement"].isNotNull())
    people = F.flatten(F.transform("creators", lambda c, k: F.when(F.size(put(k)) > 0, F.get(put(k), F.size(put(k)) - 1)["replacement"]).otherwise(F.array(c))))
    changed = {name: F.coalesce("_type", name) if name == "itemType" else F.coalesce(F.try_element_at("_new", F.lit(name)), name) for name in FIELDS}
    return rows.withColumns(changed | {"creators": people}).drop("_new", "_type")
