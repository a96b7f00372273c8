"""Text measures, cleaning and extraction as column functions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts of Chinese, Japanese and Korean text, in the notation of Java's patterns.
HAN, KANA, HANGUL = r"\p{IsHan}", r"[\p{IsHiragana}\p{IsKatakana}]", r"\p{IsHangul}"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
#: Code points among which all of these scripts lie: a plain range is told much faster than a script.
MAYBE_CJK = r"[\x{1100}-\x{11FF}\x{2E80}-\x{D7FF}\x{F900}-\x{10FFFF}]"


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def count_chars(column: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.translate(_text(column), " \t\n\x0b\f\r", ""))


def _count(text: Column, pattern: str, cjk: bool = True) -> Column:
    """Matches in a text; those of CJK scripts are looked for only where such a text can be."""
    found = F.regexp_count(text, F.lit(pattern))
    return F.when(text.rlike(MAYBE_CJK), found).otherwise(0) if cjk else found


def count_words(column: Column) -> Column:
    """Each Han character, and each word or number of other scripts: the runs of letters and digits, less the single marks that join two of them."""
    text, plain, mixed = _text(column), r"[\p{L}\p{N}]", r"[\p{L}\p{N}&&[^\p{IsHan}]]"

    def words(sign: str) -> Column:
        return _count(text, f"{sign}+", cjk=False) - _count(text, rf"{sign}['’.-](?={sign})", cjk=False)

    return F.when(text.rlike(MAYBE_CJK), F.regexp_count(text, F.lit(HAN)) + words(mixed)).otherwise(words(plain)).cast("long")


def estimate_tokens(column: Column) -> Column:
    """One token per CJK character and one per four others, rounded up."""
    text = _text(column)
    cjk = _count(text, CJK)
    return F.ceil(cjk + (F.length(text) - cjk) / 4.0).cast("long")


def guess_language(column: Column) -> Column:
    """ja by kana, ko by hangul, zh where Han weighs as much as Latin letters, else en; empty for no text."""
    text = _text(column)
    han = _count(text, HAN)
    return (
        F.when(F.trim(text) == "", "")
        .when(~text.rlike(MAYBE_CJK), "en")
        .when(text.rlike(KANA), "ja")
        .when(text.rlike(HANGUL), "ko")
        .when((han > 0) & (han * 4 >= _count(text, r"\p{IsLatin}")), "zh")
        .otherwise("en")
    )


def classify_source(is_pdf: Column, chars: Column, pages: Column) -> Column:
    """ok, partial or none from the characters per page; without a page count, or for other files, from all of them."""
    per_page = chars / pages
    return (
        F.when(~is_pdf, F.when(chars >= 200, "ok").otherwise("none"))
        .when(F.coalesce(pages, F.lit(0)) <= 0, F.when(chars < 20, "none").otherwise("ok"))
        .when(per_page < 100, "none")
        .when(per_page < 600, "partial")
        .otherwise("ok")
    )


def best_status(status: Column) -> Column:
    """Aggregate: the best of several sources."""
    ranked = F.when(status == "ok", 0).when(status == "partial", 1).when(status == "none", 2).otherwise(3)
    return F.coalesce(F.min_by(status, ranked), F.lit("no_pdf"))


def _span(opens: str, closes: str) -> str:
    """From one literal mark to the next other one, over lines."""
    return rf"\Q{opens}\E(?s:.*?)\Q{closes}\E"


def _lines(opens: str, closes: str) -> str:
    """Whole lines, from one that begins with a literal mark to one that is the other mark."""
    return rf"^\Q{opens}\E.*\R(?s:(?:.*?\R)??)\Q{closes}\E[ \t]*$"


def user_text(column: Column, start: str = "%% vellum:start", end: str = "%% vellum:end %%") -> Column:
    """A note's own words: without frontmatter, managed regions, code, comments, headings, links and citations.

    The note is read once. Each alternative below is a kind of span, the longer kinds
    first; what a span keeps of itself is its group, and most keep nothing.
    """
    spans = (
        r"\A\x{FEFF}?---[ \t]*\R(?s:(?:.*?\R)??)---[ \t]*(?:\R|\z)",
        _lines(start, end),
        _lines("```", "```"),
        _span("%%", "%%"),
        _span("<!--", "-->"),
        r"^#{1,6}\s.*$",
        r"!\[\[[^\]]*+\]\]",
        r"\[\[(?:[^\]|]*\|)?([^\]]*+)\]\]",
        r"\[-?@[^\]]*+\]",
        r"!?\[([^\]]*+)\]\([^)]*+\)",
        r"^>\s*\[![^\]]*+\][+-]?",
    )
    return F.regexp_replace(_text(column), f"(?m)(?:{'|'.join(spans)})", "$1$2")


def wikilinks(column: Column) -> Column:
    """Targets of [[links]] in order, aliases and embeds left out."""
    return F.regexp_extract_all(_text(column), F.lit(r"(?<!!)\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))


#: Numbers, with thousands commas and decimals, that are no part of a Latin word (a5, SF-36) or of a longer number.
NUMBER = r"(?<![\p{IsLatin}\d.])(?<!\p{IsLatin}[-‐‑–])(?:\d{1,3}(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?![\d])"


def plain_digits(column: Column) -> Column:
    """Full-width digits and signs as ASCII, and raised or full-width dots between digits as decimal points."""
    text = F.translate(_text(column), "０１２３４５６７８９％，－＋", "0123456789%,-+")
    return F.regexp_replace(text, r"(?<=\d)[·‧∙．](?=\d)", ".")


def canonical_number(raw: Column) -> Column:
    """Commas and idle zeros dropped: 1,234.50 is 1234.5, .001 is 0.001, 007 is 7. Works on digits, so of any length."""
    plain = F.regexp_replace(raw, ",", "")
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    whole = F.regexp_replace(plain, r"^0+(?=\d)", "")
    return F.when(whole.startswith("."), F.concat(F.lit("0"), whole)).when(whole == "", "0").otherwise(whole)


def numbers_in(column: Column) -> Column:
    """Canonical values of all numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(plain_digits(column), F.lit(NUMBER), F.lit(0)), canonical_number)


def edge_key(line: Column) -> Column:
    """A line as it repeats from page to page: trimmed, lower case, digits masked, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\d+", "#"), r"\s+", " ")


#: Beginnings of keys of services, names before a secret, and endings of documents.
KEY_PREFIXES = ("ntn_", "secret_", "sk-", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza", "pk_live_", "rk_live_")
SECRET_NAMES = ("x-api-key", "api-key", "api_key", "apikey", "access-token", "access_token", "accesstoken", "auth-token", "auth_token", "authtoken", "token", "password", "passwd", "secret", "authorization")
DOCUMENTS = ("md", "pdf", "base", "canvas", "bib", "ris", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "tsv", "txt", "rtf", "odt", "epub", "sqlite", "json", "sav", "dta", "htm", "html")

#: Hosts of public services, whose names tell nothing about a user.
KNOWN_HOSTS = (
    "api.notion.com", "notion.so", "www.notion.so", "api.anthropic.com", "api.openai.com", "eutils.ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov",
    "api.openalex.org", "api.crossref.org", "doi.org", "github.com", "api.github.com", "raw.githubusercontent.com", "www.zotero.org", "api.zotero.org",
)

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_WORD = r"\p{L}\p{N}_"
_PLAIN = r"[A-Za-z_$][\p{L}\p{N}_.$-]{0,40}"
_NAMED = rf"(?i:\b(?:{'|'.join(SECRET_NAMES)})\s*[=:]\s*(?:Bearer\s+)?)"

#: Grammar of paths, sign by sign. A path begins at a root; signs that no name holds end it. It goes on over
#: spaces where another separator follows a name, or a name that ends like a file, and over signs that close
#: a clause where a separator follows in the same word.
NO_NAME = r"\s\"'<>|*?"
CLAUSE = r",;)）」"
SEPARATOR = r"[\\/]"
ROOTS = (
    rf"(?<![{_WORD}])(?:[A-Za-z]:|%[A-Za-z_]+%){SEPARATOR}",  # a drive or a variable
    rf"\\\\[^\\{NO_NAME}]",  # a server
    rf"(?<![{_WORD}.~\\/-])~?/(?=[^\s{CLAUSE}])",  # the root or the home folder
)
_NAME_FOLLOWS = rf"(?=[^\\/\n\"'<>|*?]*+(?<=\S){SEPARATOR})"
_FILE_FOLLOWS = rf"(?=(?:[^\\/{NO_NAME}]++\x20++){{0,12}}?[^\\/{NO_NAME}]*?\.[A-Za-z0-9]{{1,6}}(?![{_WORD}]))"  # the name may have spaces
PATH_SIGN = rf"(?:[^{NO_NAME}{CLAUSE}]|[{CLAUSE}](?=[^{NO_NAME}]*{SEPARATOR})|\x20++{_NAME_FOLLOWS}|(?<!\.[A-Za-z0-9]{{1,6}})\x20++{_FILE_FOLLOWS})"
PATH = rf"(?:{'|'.join(ROOTS)}){PATH_SIGN}*+"
#: Without a root, two separators make a path of one word.
RELATIVE = rf"(?<![{_WORD}.~\\/-])(?:[^\\/{NO_NAME}:()=,;「」（）]++{SEPARATOR}){{2}}[^{NO_NAME}:{CLAUSE}]*+"

#: Signs that open and close quoted text; a straight single one only where no letter stands outside it.
QUOTES = (('"', '"'), ("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ("《", "》"))

#: Kinds of telling spans, by what they look like; where two begin at one place, the upper one holds.
SHAPES = (
    ("link", r"(?i:\b(?:data|blob|mailto):[^\s\"'<>]+)"),
    ("url", r"(?i:\b[a-z][a-z0-9+.-]{1,30}://[^\s\"'<>`()\[\]{}「」（）]*[^\s\"'<>`()\[\]{}「」（）.,;:!?])"),
    ("secret", r"(?i:\bBearer\s+[^\s\"'<>,;]+)"),
    ("secret", rf"{_NAMED}(?:\"[^\"]*\"|'[^']*'|[^\s,;&\"']{{6,}})"),
    ("email", _EMAIL),
    ("token", rf"\b(?:{'|'.join(KEY_PREFIXES)})[A-Za-z0-9_-]{{6,}}"),
    ("path", PATH),
    ("path", RELATIVE),
    ("file", rf"(?i:[^\\/{NO_NAME}]{{0,120}}\.(?:{'|'.join(DOCUMENTS)})(?![{_WORD}]))"),
    ("id", r"(?i:\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b)"),
    ("id", r"(?i:\b[0-9a-f]{32}\b)"),
    ("hidden", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+"),
    *[("quote", rf"{a}[^{b}\n]{{1,300}}{b}") for a, b in QUOTES],
    ("quote", rf"(?<![\p{{L}}\p{{N}}])'[^'\n]{{1,300}}'(?![\p{{L}}\p{{N}}])"),
)


#: Kinds of which none matches where a plain word begins: letters of ASCII up to white space, at most a sign that closes a clause between.
NOT_PLAIN = ("link", "url", "email", "path", "file", "hidden")
#: Between two letters or digits of ASCII only a file can begin, on white space nothing.
_INSIDE = r"(?<=[A-Za-z0-9])(?=[A-Za-z0-9])"
_NO_PLAIN_WORD = r"(?![A-Za-z]++[,.;]?+(?:\s|\z))"
#: A sign that no character has, set around the spans of a text.
MARK = "\uffff"


def guarded(shapes: Sequence[tuple[str, str]] = SHAPES) -> str:
    """One pattern of all the shapes, the upper one first, that finds what they find; most places of a running text are told by a sign or two."""
    kinds = [(name in NOT_PLAIN, "|".join(pattern for _, pattern in run)) for name, run in groupby(shapes, key=lambda x: x[0])]
    runs = [f"{_NO_PLAIN_WORD if plain else ''}(?:{'|'.join(pattern for _, pattern in run)})" for plain, run in groupby(kinds, key=lambda x: x[0])]
    files = "|".join(pattern for name, pattern in shapes if name == "file")
    return rf"(?!\s)(?:(?!{_INSIDE})(?:{'|'.join(runs)})|{_INSIDE}{_NO_PLAIN_WORD}(?:{files}))"


def _shown_url(span: Column) -> Column:
    """An address without what it says: only the name of a known host stays, with a sign for what follows it."""
    scheme, host, rest = (F.regexp_extract(span, r"(?i)\A(https?)://(?:[^/?#]*@)?([^/?#@:]*)(?::\d+)?([/?#].*)?\z", k) for k in (1, 2, 3))
    known = F.lower(host).isin(*KNOWN_HOSTS)
    return F.when(known, F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(rest.isin("", "/"), "").otherwise("/…"))).when((scheme == "") & ~span.rlike(r"(?i)\Ahttps?:"), "<link>").otherwise("<url>")


def redact(column: Column, known: tuple[str, ...] = ()) -> Column:
    """Text without what could tell who wrote it or on what: telling spans become <kind>, quoted text "…"; white space collapsed.

    Spans are cut out of the text in one pass, then each is named by its shape. A secret
    keeps the name before it and an address a known host. ``known`` are values of the user's
    own (names, folders) that are hidden wherever they stand. A quoted name as of a variable
    or setting stays.
    """
    own = "|".join(rf"(?<![{_WORD}])\Q{value}\E(?![{_WORD}])" if value.isascii() else rf"\Q{value}\E" for value in sorted(known, key=len, reverse=True))
    any_shape = f"(?i:{own})|{guarded()}" if own else guarded()
    text = _text(column)

    def named(span: Column) -> Column:
        kind = F.when(F.lit(False), span)
        if own:
            kind = kind.when(span.rlike(rf"(?i)\A(?:{'|'.join(f'(?:{chr(92)}Q{v}{chr(92)}E)' for v in known)})\z"), "<hidden>")
        shown = {
            "quote": F.when(span.rlike(rf"\A.{_PLAIN}.\z"), span).otherwise(F.concat(F.left(span, F.lit(1)), F.lit("…"), F.right(span, F.lit(1)))),
            "secret": F.concat(F.regexp_extract(span, rf"\A({_NAMED}|(?i:Bearer\s+))", 1), F.lit("<token>")),
            "url": _shown_url(span),
        }
        for name, pattern in SHAPES:
            kind = kind.when(span.rlike(rf"\A(?:{pattern})\z"), shown.get(name, f"<{name}>"))
        return kind.otherwise("<hidden>")

    # Spans are every other piece of a text that is marked in one pass; one that has the mark itself is read twice.
    marked = F.split(F.regexp_replace(text, any_shape, f"{MARK}$0{MARK}"), MARK, -1)
    plain, spans = F.split(text, any_shape, -1), F.regexp_extract_all(text, F.lit(any_shape), F.lit(0))
    pieces = F.when(F.contains(text, F.lit(MARK)), F.flatten(F.transform(plain, lambda x, k: F.array(x, F.coalesce(F.get(spans, k), F.lit("")))))).otherwise(marked)
    shown = F.transform(pieces, lambda x, k: F.when((k % 2 == 0) | (x == ""), x).otherwise(named(x)))
    return F.trim(F.regexp_replace(F.array_join(shown, ""), r"\s+", " "))


def redact_emails(column: Column) -> Column:
    """Only the e-mail addresses of a text redacted; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, _EMAIL, "<email>"), r"\s+", " "))


def csv_cell(value: Column) -> Column:
    """A CSV cell that no spreadsheet runs as a formula, quoted where it must be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    risky = text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(r"^[+-]?\d+(?:\.\d+)?$")
    guarded = F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(guarded.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in columns])


def headings(column: Column) -> Column:
    """Markdown headings as array of (level, title), in order, code blocks left out."""
    text = F.regexp_replace(_text(column), r"(?m)^```(?s:.*?)^```[ \t]*$", "")
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: line.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda line: F.struct(F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(line, r"^#+\s+|\s+#+\s*$", "")).alias("title")))


def term_score(term: str, text: Column) -> Column:
    """How well a search word fits: whole 100, start 80, start of a word 70, inside 60, letters in order 10 to 30."""
    at = F.instr(text, term)
    boundary = F.substring(text, F.greatest(at - 1, F.lit(1)), F.lit(1)).rlike(r"[\s(:/,-]")
    first, last = F.lit(0), F.lit(0)
    for k, letter in enumerate(term):
        last = F.when((last > 0) | F.lit(k == 0), F.locate(letter, text, 1) if k == 0 else _locate(letter, text, last + 1)).otherwise(0)
        first = last if k == 0 else first
    loose = F.when(last > 0, 10 + F.round(20.0 * len(term) / (last - first + 1))).otherwise(0) if len(term) > 1 else F.lit(0)
    return F.when(text == term, 100).when(at == 1, 80).when((at > 1) & boundary, 70).when(at > 1, 60).otherwise(loose).cast("int")


def _locate(letter: str, text: Column, start: Column) -> Column:
    """Place of a letter in the text from ``start`` on; 0 where there is none."""
    found = F.instr(F.substring(text, start, F.length(text)), letter)
    return F.when(found > 0, found + start - 1).otherwise(0)


def search_score(query: str, label: Column, keywords: Column, group: Column) -> Column:
    """Score of an entry; null where a word of the query fits nowhere. The label counts three times, keywords twice."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(_text(c)), r"\s+", " "))
    label, group = fold(label), fold(group)
    keywords = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), fold)
    total, covered, hit = F.lit(0), F.lit(0), F.lit(True)
    for term in " ".join(query.lower().split()).split(" ") if query.strip() else []:
        best = F.greatest(term_score(term, label) * 3, F.coalesce(F.array_max(_scores(term, keywords)), F.lit(0)) * 2, term_score(term, group))
        hit = hit & (best > 0)
        total = total + best
        covered = covered + F.when(label.contains(term), len(term)).otherwise(0)
    bonus = F.when(F.length(label) > 0, F.floor(20.0 * covered / F.length(label) + 0.5)).otherwise(0)
    return F.when(hit, (total + bonus).cast("int"))


def _scores(term: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: term_score(term, t))
