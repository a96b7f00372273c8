"""Identifiers and keys of bibliographic records, as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.session import ship


def blank(column: Column) -> Column:
    """Trimmed text; null counts as empty."""
    return F.trim(F.coalesce(column.cast("string"), F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: inside higher-order functions nothing else is shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_doi(column: Column) -> Column:
    """Lower-case DOI without resolver, prefix and trailing punctuation; empty if it is not one."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(blank(column)), r"^(?:https?://)?(?:dx\.)?doi\.org/", ""), r"^doi:\s*", "")
    # In a DOI a plus stands for itself, unlike in a form.
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    clean = F.regexp_replace(decoded, r"[\s.,;]+$", "")
    return F.when(clean.rlike(r"^10\.\d{4,9}/\S+$"), clean).otherwise("")


def loose_doi(column: Column) -> Column:
    """Lower-case DOI of any registrant form, without resolver and prefix; empty if it is not one."""
    bare = F.regexp_replace(F.lower(blank(column)), r"^(?:(?:https?://)?(?:dx\.)?doi\.org/)?(?:doi:\s*)?", "")
    return F.when(bare.rlike(r"^10\.\S+/\S+$"), bare).otherwise("")


def repair_doi(column: Column) -> Column:
    """DOI in its own case, half-width, without resolver, prefix and trailing punctuation; empty if it is not one.

    What trails is cut but for closing parentheses that have an opening one, and for a
    bracket in a DOI that opens one.
    """
    from vellum.functions.metadata import half_width

    text = F.trim(half_width(column))
    decoded = F.when(text.rlike(r"(?i)%2F|%28|%29"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)
    bare = F.trim(F.regexp_replace(decoded, r"^(?i:https?://(?:dx\.)?doi\.org/|doi\s*:\s*|doi\s+)", ""))
    square = bare.contains("[")
    part = lambda k: F.when(square, F.regexp_extract(bare, r"^(.*?)([.,;:。、'\"」』)]*)$", k)).otherwise(F.regexp_extract(bare, r"^(.*?)([.,;:。、'\"」』)\]]*)$", k))
    head, tail = part(1), part(2)
    n = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    due = F.least(n(bare, "(") - n(head, ")"), n(tail, ")"))
    clean = F.when(due > 0, F.concat(head, F.array_join(F.slice(F.split(tail, r"\)"), 1, due), ")"), F.lit(")"))).otherwise(head)
    return F.when(clean.rlike(r"^10\.\d{4,9}/\S+$"), clean).otherwise("")


def detect_doi(extra: Column, url: Column) -> Column:
    """A DOI kept outside its field: in a line "DOI: ..." of Extra, else in an address; empty if there is none."""
    lines = F.regexp_extract_all(F.coalesce(extra, F.lit("")), F.lit(r"(?im)^\s*DOI\s*[:：]\s*(\S+)[^\S\n]*$"), F.lit(1))
    found = F.filter(F.transform(lines, repair_doi), lambda d: d != "")
    address = blank(url)
    places = (r"(?i)^https?://(?:dx\.)?doi\.org/(.+)$", r"(?i)/doi/(?:abs/|full/|pdf/)?(10\.\d{4,9}/[^?#\s]+)", r"(?i)[?&]doi=(10(?:\.|%2E)[^&#\s]+)")
    inside = F.coalesce(*[F.nullif(F.regexp_extract(address, place, 1), F.lit("")) for place in places], F.lit(""))
    return F.coalesce(F.get(found, 0), repair_doi(inside))


def work_key(column: Column) -> Column:
    """Key of a work (W and digits) at the end of an id or address, in capitals; empty if there is none."""
    return F.upper(F.regexp_extract(blank(column), r"(?i)(W\d+)$", 1))


def candidate_key(doi: Column, pmid: Column) -> Column:
    """doi:... or pmid:..., the DOI first; empty for neither."""
    return F.when(blank(doi) != "", F.concat(F.lit("doi:"), blank(doi))).when(blank(pmid) != "", F.concat(F.lit("pmid:"), blank(pmid))).otherwise("")


def key_in_line(line: Column) -> Column:
    """candidate_key of the first DOI or PubMed address in a line of text; empty if there is none."""
    doi = normalize_doi(F.regexp_extract(F.coalesce(line, F.lit("")), r"(?i)https?://(?:dx\.)?doi\.org/([^\s)>\]]+)", 1))
    return candidate_key(doi, F.regexp_extract(F.coalesce(line, F.lit("")), r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d{1,9})", 1))


def is_key_for(key: Column, base: Column) -> Column:
    """Whether a citekey is its base, or the base with letters behind it; case aside."""
    key, base = F.lower(blank(key)), F.lower(blank(base))
    return key.startswith(base) & F.substring(key, F.length(base) + 1, F.length(key)).rlike("^[a-z]*$")


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Signs beyond ASCII that the compatibility form may change, alone or beside others, the soft hyphen, and the letter whose
#: lower case is two signs. Those left out are Latin letters and marks of print that are their own form and join no
#: neighbour. The range in front tells ASCII at one step.
MAYBE_UNFOLDED = r"[\x{80}-\x{10FFFF}&&[^\xA1-\xA7\xA9\xAB\xAC\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{12F}\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2010}\x{2012}-\x{2015}\x{2018}-\x{201E}]]"


def nfkc_of_odd(column: Column) -> Column:
    """Compatibility form of texts with a sign of ``MAYBE_UNFOLDED``; null for all others, which are in that form already and are not sent to Python."""
    return _nfkc(F.when(column.rlike(MAYBE_UNFOLDED), column))


def nfkc(column: Column) -> Column:
    """Compatibility form."""
    return F.coalesce(nfkc_of_odd(column), column)


def normalize_title(column: Column) -> Column:
    """Letters and digits only, lower case, accents and inline markup dropped."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"(?i)</?(?:i|b|sub|sup|span)[^>]*>", "")
    flat = F.regexp_replace(F.coalesce(_nfkd(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text), r"[̀-ͯ]", "")
    return F.regexp_replace(F.lower(flat), r"[^\p{L}\p{N}]+", "")


def year_of(year: Column, date: Column | None = None) -> Column:
    """First four digits of the year, else of the date; empty if there are none."""
    found = F.regexp_extract(blank(year), r"\d{4}", 0)
    return found if date is None else F.when(found != "", found).otherwise(F.regexp_extract(blank(date), r"\d{4}", 0))


def pmid_of(column: Column) -> Column:
    """PubMed id of an id, an address or a line "PMID: n"; empty if there is none."""
    text = blank(column)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?i)(?:pmid\s*:?\s*|pubmed[^\s]*/)(\d{1,9})", 1), F.lit("")), F.regexp_extract(text, r"^(\d{1,9})$", 1))


def concept_key(column: Column) -> Column:
    """Compatibility form, lower case, runs of hyphens, underscores and spaces as one space."""
    return F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(column, F.lit("")))), r"[\s\-‐-―_]+", " "))


def match_key(column: Column) -> Column:
    """Compatibility form, lower case, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(column, F.lit("")))), r"[\s\p{P}\p{S}]+", "")


def citekey_base(author: Column, year: Column, title: Column, stopwords: tuple[str, ...]) -> Column:
    """Folded author, year and first word of the title that is no stop word."""
    fold = lambda c: F.regexp_replace(F.regexp_replace(F.lower(_nfkd(F.coalesce(c, F.lit("")))), r"[̀-ͯ]", ""), r"[^a-z0-9]+", "")
    words = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"[\s\-]+"), lambda w: F.lower(w)), lambda w: (w != "") & ~w.isin(*stopwords))
    return F.concat(fold(author), F.coalesce(year.cast("string"), F.lit("")), fold(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))))


def suffix(n: int) -> str:
    """a, b, ..., z, aa, ab, ... for 0, 1, ...; used to tell equal keys apart."""
    out = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


@F.udf(StringType())
def _suffix_of(n):
    return suffix(n)


def key_suffix(place: Column) -> Column:
    """Suffix of the place (0: none) that a record has among those of one key; two letters at most stay in the JVM."""
    letter = lambda k: F.chr(F.lit(97) + k)
    n = place - 1
    two = F.concat(letter(F.floor(n / 26) - 1), letter(F.pmod(n, F.lit(26))))
    return F.when(place <= 0, "").when(n < 26, letter(n)).when(n < 26 * 27, two).otherwise(_suffix_of(n.cast("int")))


ship(__name__)
