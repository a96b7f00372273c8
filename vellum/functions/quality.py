"""Quality of records as column functions: issues, titles, journals, theses, tags, links, facts, callouts and embedded data."""

from __future__ import annotations

import unicodedata
from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.identifiers import blank
from vellum.functions.metadata import half_width, roc_date
from vellum.functions.prose import degree_of
from vellum.session import ship

HAN = r"\p{IsHan}"


def suspect_names(title: Column, authors: Column) -> Column:
    """Authors of a Han title whose Han names are not in one piece: with a comma or space, of one character, or mixed with Latin letters."""
    han_in = lambda name: F.regexp_count(name, F.lit(HAN))
    odd = lambda name: (han_in(name) > 0) & (name.rlike(r"[,，\s]") | (han_in(name) == 1) | name.rlike("[A-Za-z]"))
    names = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: blank(a))
    return F.when(F.coalesce(title, F.lit("")).rlike(HAN), F.filter(names, odd)).otherwise(F.array().cast("array<string>"))


def quality_issues(has_ai: Column, full_text: Column, item_type: Column, doi: Column, title: Column, authors: Column) -> Column:
    """Codes of what a record lacks: noAI, scanned, noDOI, zhNames; null counts as missing."""
    tests = {
        "noAI": ~F.coalesce(has_ai, F.lit(False)),
        "scanned": F.coalesce(full_text, F.lit("")).isin("none", "partial"),
        "noDOI": (blank(item_type) == "journalArticle") & (blank(doi) == ""),
        "zhNames": F.size(suspect_names(title, authors)) > 0,
    }
    return F.filter(F.array(*[F.when(test, code) for code, test in tests.items()]), lambda x: x.isNotNull())


#: Signs between Han characters: half-width, as they should be, and what may stand before and after them.
_CLOSED, _OPENED = r"[\p{IsHan}）」』》]", r"[\p{IsHan}（「『《]"
TITLE_SIGNS = (
    (r"\s*:\s*", "：", _CLOSED, _OPENED),
    (r"\s*,\s*", "，", HAN, HAN),
    (r"\s*;\s*", "；", HAN, HAN),
    (r"\s*\?", "？", HAN, rf"(?:{HAN}|\z)"),
    (r"[。.]", "", _CLOSED, r"\z"),
    (r"\x20{2,}", " ", "", ""),
)


def tidy_title(column: Column) -> Column:
    """Title without idle spaces, with full-width signs between Han characters, and no full stop after one."""
    text = F.regexp_extract(F.coalesce(column, F.lit("")), r"(?s)\A[\s　]*(.*?)[\s　]*\z", 1)
    for half, full, before, after in TITLE_SIGNS:
        text = F.regexp_replace(text, (f"(?<={before})" if before else "") + half + (f"(?={after})" if after else ""), full)
    return text


def chinese_part(column: Column, least_words: int) -> Column:
    """The Han part of a text that goes on with its English translation of so many words or more; null where it does not."""
    text = F.trim(F.coalesce(column, F.lit("")))
    shape = rf"^(.*{HAN}[）」』》〉？！]*)[\s=＝/／|｜:：。．.，,；;-]*([A-Za-z][^\p{{IsHan}}]*)$"
    words = F.regexp_count(F.regexp_extract(text, shape, 2), F.lit("[A-Za-z]{2,}"))
    return F.when(text.rlike(shape) & (words >= least_words), F.trim(F.regexp_extract(text, shape, 1)))


def tidy_journal(column: Column) -> Column:
    """Name of a journal without spaces and title marks around it."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"\A[\s　]+|[\s　]+\z", "")
    inner = F.regexp_extract(text, r"^[《〈「『]\s*(.+?)\s*[》〉」』]$", 1)
    return F.when(inner != "", inner).otherwise(text)


def title_findings(title: Column, journal: Column) -> Column:
    """What titles and journals should be: array of (field, problem, current, suggested, sure)."""
    tidy, name = tidy_title(title), tidy_journal(journal)
    english, both = chinese_part(tidy, 3), chinese_part(name, 2)
    spaced = F.regexp_replace(tidy, rf"(?<={HAN})[ 　]+(?={HAN})", "：")

    def finding(field: str, problem: str, when: Column, current: Column, suggested: Column, sure: bool) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), current.alias("current"), suggested.alias("suggested"), F.lit(sure).alias("sure")))

    rows = [
        finding("title", "form", (blank(title) != "") & (tidy != title), title, tidy, True),
        finding("title", "translation behind", english.isNotNull() & (english != tidy), title, english, False),
        finding("title", "space inside", english.isNull() & (spaced != tidy), title, spaced, False),
        finding("publicationTitle", "form", (blank(journal) != "") & (name != journal), journal, name, True),
        finding("publicationTitle", "two names", both.isNotNull() & (both != name), journal, both, False),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def date_findings(date: Column) -> Column:
    """What is wrong with a date: array of (field, problem, current, suggested, sure); a year of the Republic, full-width digits, no date or no year in it."""
    text, half, roc = F.coalesce(date, F.lit("")), F.trim(half_width(date)), roc_date(date)
    wide = roc.isNull() & ~text.rlike("[0-9]{4}") & half.rlike("[0-9]{4}")
    tests = (
        ("missing", F.trim(text) == "", F.lit(""), F.lit(False)),
        ("republic year", roc.isNotNull(), roc["date"], roc["sure"]),
        ("full-width digits", wide, half, F.lit(True)),
        ("no year", (F.trim(text) != "") & roc.isNull() & ~half.rlike("[0-9]{4}"), F.lit(""), F.lit(False)),
    )
    rows = [F.when(when, F.struct(F.lit("date").alias("field"), F.lit(problem).alias("problem"), text.alias("current"), suggested.alias("suggested"), sure.alias("sure"))) for problem, when, suggested, sure in tests]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def guess_thesis(url: Column, catalog: Column, journal: Column, publisher: Column, extra: Column, title: Column) -> Column:
    """Struct of degree (empty where none is named) and by (url, catalog, words) for a thesis filed as something else; null for no thesis. The title alone makes none."""
    words = F.concat_ws("\n", journal, publisher, extra)
    by = (
        F.when(F.coalesce(url, F.lit("")).rlike(r"(?i)ndltd\.ncl\.edu\.tw|hdl\.handle\.net/11296/"), "url")
        .when(F.coalesce(catalog, F.lit("")).rlike(r"(?i)臺灣博碩士|台灣博碩士|ndltd"), "catalog")
        .when(degree_of(words).isNotNull() | words.rlike("學位論文"), "words")
    )
    return F.when(by.isNotNull(), F.struct(F.coalesce(degree_of(words, title), F.lit("")).alias("degree"), by.alias("by")))


def note_tag(column: Column) -> Column:
    """A tag that notes accept: no leading #, hyphens for spaces, letters, digits, - _ and / only; empty for one of digits alone."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), "^#+", ""), r"\s+", "-"), r"[^\p{L}\p{N}_\-/]", "")
    return F.when(clean.rlike("^[0-9/]*$"), "").otherwise(clean)


def tag_value(tag: Column, prefix: str) -> Column:
    """What follows the prefix; empty for another tag."""
    return F.when(F.lit(prefix != "") & tag.startswith(prefix), F.trim(F.substring(tag, F.lit(len(prefix) + 1), F.length(tag)))).otherwise("")


def subject_headings(tags: Column, stop: tuple[str, ...] = (), most: int = 20) -> Column:
    """Tags that look like subject headings, without star and subheading, the first spelling of each; ``most`` is how many are asked for."""
    bare = F.transform(tags, lambda t: F.trim(F.substring_index(F.regexp_replace(F.coalesce(t, F.lit("")), r"^\*", ""), "/", 1)))
    good = F.filter(bare, lambda t: t.rlike(r"^[A-Z][A-Za-z0-9 ,'()-]{2,80}$") & ~F.lower(t).isin(*stop) if stop else t.rlike(r"^[A-Z][A-Za-z0-9 ,'()-]{2,80}$"))
    return F.slice(first_spellings(good), 1, most)


def first_spellings(values: Column) -> Column:
    """Values in order, the first of those that differ in case alone."""
    keys = F.transform(values, lambda v: F.lower(v))
    marked = F.transform(values, lambda v, i: F.struct(v.alias("v"), (F.array_position(keys, F.lower(v)) == i + 1).alias("first")))
    return F.transform(F.filter(marked, lambda x: x["first"]), lambda x: x["v"])


def ordered_union(first: Column, second: Column) -> Column:
    """Values of both lists in order, each once, without blanks; null lists count as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(first, none), F.coalesce(second, none)), lambda v: F.coalesce(v, F.lit("")) != ""))


def uri_component(column: Column) -> Column:
    """Percent-encoded as a part of an address: all but letters, digits and - _ . ! ~ * ' ( )."""
    encoded = F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return encoded


def doi_link(doi: Column) -> Column:
    """Resolver address of a DOI, safe inside a Markdown link."""
    encoded = uri_component(doi)
    for code, sign in (("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%2C", ","), ("%3F", "?"), ("%40", "@"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%24", "$"), ("(", "%28"), (")", "%29")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return F.concat(F.lit("https://doi.org/"), encoded)


def vault_link(vault: Column, path: Column) -> Column:
    """Address that opens a note of a vault."""
    return F.concat(F.lit("obsidian://open?vault="), uri_component(vault), F.lit("&file="), uri_component(F.regexp_replace(path, r"(?i)\.md$", "")))


def annotation_link(library: Column, key: Column, is_pdf: Column, page: Column, annotation: Column) -> Column:
    """Address of an annotation: in its PDF, at its page where that is a number; of another file, the item."""
    at = F.concat_ws("&", F.when(blank(page).rlike(r"^\d+$"), F.concat(F.lit("page="), blank(page))), F.concat(F.lit("annotation="), annotation))
    return F.when(is_pdf, F.concat(F.lit("zotero://open-pdf/"), library, F.lit("/items/"), key, F.lit("?"), at)).otherwise(F.concat(F.lit("zotero://select/"), library, F.lit("/items/"), key))


def facts_line(design: Column, size: Column, level: Column, jbi: Column, overall: Column, verified: Column, model_overall: Column) -> Column:
    """What is known of a study, by " · ": design, N, levels, and the appraisal with who made it."""
    shown = lambda column, form: F.when(blank(column) != "", F.format_string(form, blank(column)))
    judged = F.when(blank(overall) != "", F.concat(F.lit("評讀："), blank(overall), F.when(F.coalesce(verified, F.lit(False)), "（已核對）").otherwise("（待核對）"))).otherwise(shown(model_overall, "評讀：%s（AI 初評）"))
    return F.concat_ws(" · ", F.nullif(blank(design), F.lit("")), shown(size, "N = %s"), shown(level, "CEBM %s"), shown(jbi, "JBI %s"), judged)


def unwrap_callout(column: Column) -> Column:
    """Lines of a callout without its header and quote marks."""
    lines = F.filter(F.split(F.coalesce(column, F.lit("")), "\n"), lambda line: ~line.rlike(r"^>\s*\[!"))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda line: F.regexp_replace(line, r"^>[ \t]?", "")), "\n"), r"\A\s+|\s+\z", "")


def demote_headings(column: Column, by: int) -> Column:
    """Headings ``by`` levels lower, six at most; lines of fenced code stay."""
    lines = F.split(F.coalesce(column, F.lit("")), "\n")
    # A line is code where an odd number of fences stands before it; fences are few, so their places are looked up.
    fences = F.filter(F.transform(lines, lambda line, i: F.when(line.startswith("```"), i)), lambda i: i.isNotNull())

    def shown(line: Column, i: Column) -> Column:
        code = F.size(F.filter(fences, lambda f: f < i)) % 2 == 1
        marks = F.regexp_extract(line, r"^(#{1,6})\s", 1)
        lower = F.concat(F.repeat(F.lit("#"), F.least(F.length(marks) + by, F.lit(6))), F.substring(line, F.length(marks) + 1, F.length(line)))
        return F.when((marks == "") | code, line).otherwise(lower)

    return F.array_join(F.transform(lines, shown), "\n")


@F.arrow_udf(T.StructType([T.StructField("folded", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType()))]))
def _folded(texts: pa.Array) -> pa.Array:
    """What ``fold_with_offsets`` gives; places stand in one plain array of integers, not in a list of objects for each text."""
    folded, ends, places, signs = [], [0], array("i"), {}
    for text in texts:
        text = text.as_py()
        for ch in set(text or "") - signs.keys():
            signs[ch] = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.category(c).startswith("M")).lower()
        parts = [signs[ch] for ch in text or ""]
        folded.append(None if text is None else "".join(parts))
        for i, part in enumerate(parts):
            places.extend([i] * len(part))
        ends.append(len(places))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(places), [None, pa.py_buffer(places)]))
    return pa.StructArray.from_arrays([pa.array(folded, pa.string()), lists], ["folded", "starts"])


def fold_with_offsets(column: Column) -> Column:
    """Struct of the text without case, width and accents (``folded``), and for each of its characters the place of the one it came from (``starts``); null stays null.

    Signs of ASCII fold to one sign each, so texts of them alone need no Python and hold no batch of places.
    """
    plain = column.rlike(r"\A[\x00-\x7F]*\z")
    # Of texts with other signs the empty one is left to Python as any other would be; null stands for those that it need not see.
    other = _folded(F.when(~plain, column))
    places = F.when(column == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.length(column) - 1))
    return F.when(plain, F.struct(F.lower(column).alias("folded"), places.alias("starts"))).when(column.isNotNull(), F.struct(other["folded"].alias("folded"), other["starts"].alias("starts")))


def last_json_block(column: Column) -> Column:
    """The text of the last fenced block marked json; null where there is none. A block that is cut off runs to the end or to a warning line."""
    text = F.replace(F.coalesce(column, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*```+[ \t]*([\w-]*)[ \t]*$(.*?)(?:^[ \t]*```+[ \t]*$|(?=^>\s*⚠)|\z)"), F.lit(0))
    marked = F.filter(blocks, lambda b: b.rlike(r"(?i)\A[ \t]*```+[ \t]*json[ \t]*(?:\n|\z)"))
    body = F.regexp_replace(F.regexp_replace(F.element_at(marked, F.when(F.size(marked) > 0, -1).otherwise(None)), r"\A[ \t]*```+[^\n]*\n?", ""), r"\n?[ \t]*```+[ \t]*\z", "")
    return F.regexp_replace(body, r"\A\s+|\s+\z", "")


def without_json_block(column: Column) -> Column:
    """The text without its last json block and the heading or rule right before it."""
    text = F.replace(F.coalesce(column, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    last = r"(?s)(.*)(?m:^[ \t]*```+[ \t]*(?i:json)[ \t]*$)(?:(?!^[ \t]*```+[ \t]*(?i:json)[ \t]*$).)*?(?m:^[ \t]*```+[ \t]*$|(?=^>\s*⚠)|\z)(.*)"
    before, after = (F.regexp_extract(text, last, k) for k in (1, 2))
    heading = r"(?:\n?^#{1,6}\s+[^\n]*(?:結構化資料|(?i:json|structured data|study data))[^\n]*\s*\z)"
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(before, rf"(?m){heading}", ""), r"\s+\z", ""), r"(?m)(?:\n|\A)\s*(?:-{3,}|\*{3,}|_{3,})\s*\z", "")
    head, rest = F.regexp_replace(head, r"\s+\z", ""), F.regexp_replace(after, r"\A\s+|\s+\z", "")
    return F.when(text.rlike(last), F.concat(head, F.when(rest == "", "").otherwise(F.concat(F.lit("\n\n"), rest)))).otherwise(text)


def embedded_json(html: Column, form: str) -> Column:
    """JSON of the last ``pre`` element of a note whose "format" is the one asked for; null where there is none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    decoded = F.transform(found, lambda x: _entities(x))
    good = F.filter(decoded, lambda x: F.get_json_object(x, "$.format") == form)
    return F.element_at(good, F.when(F.size(good) > 0, -1).otherwise(None))


def note_html(title: Column, json: Column) -> Column:
    """A note that carries JSON in a ``pre`` element, readable by ``embedded_json``."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<h1>"), safe(title), F.lit("</h1><pre>"), safe(json), F.lit("</pre>"))


def _entities(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


ship(__name__)
