"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

E-mail addresses, IP addresses, payment cards (Luhn), telephone numbers, IBANs (mod 97)
and social security numbers. Rows without a digit or an at sign never leave the JVM.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import ship

#: Kinds in order of report; the base kinds come first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Scores before context, words that raise them and how near they stand.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
NEAR, RAISED, LOWERED = 40, 0.3, 0.3
AGAINST = ("version", "example", "isbn", "sample")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and its digits summed, completes the sum to a multiple of 10."""
    total = 0
    for k, digit in enumerate(map(int, reversed(digits))):
        doubled = digit * (1 + k % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    left = 0
    for c in iban[4:] + iban[:4]:
        value = int(c, 36)
        left = (left * (100 if value > 9 else 10) + value) % 97
    return left == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of local part, at sign, domain with a dot: found from the at signs, in one pass."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of as many capitals and digits as the country's accounts have, in groups or not, that pass mod-97."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done or (length := IBAN_LENGTHS.get(m[0][:2])) is None:
            continue
        end, number = m.end(), m[0]
        while len(number) < length and end < len(text):
            k = end + (text[end] == " ")
            if k >= len(text) or not ("0" <= text[k] <= "9" or "A" <= text[k] <= "Z"):
                break
            number += text[k]
            end = k + 1
        glued = end < len(text) and text[end].isascii() and text[end].isalnum()
        if len(number) == length and not glued and mod97(number):
            yield m.start(), end
            done = end


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def propose(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    found += [("iban", a, b) for a, b in ibans(text)]
    found += [("ssn", *m.span()) for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    return found


def score(text: str, kind: str, begin: int, end: int) -> float:
    """The kind's score, raised by its context words nearby and lowered by words that speak against."""
    near = set(WORD.findall(f"{text[max(0, begin - NEAR) : begin]} {text[end : end + NEAR]}".lower()))
    value = SCORES[kind] + RAISED * bool(near & set(CONTEXT[kind])) - LOWERED * bool(near & set(AGAINST))
    return round(min(1.0, max(0.0, value)), 2)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {k: [] for k in (*[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "scores")}
        for x in batch.column(1):
            text = x.as_py() or ""
            found = propose(text) if text else []
            for kind in BASE_KINDS:
                columns[f"n_{kind}"].append(sum(k == kind for k, _, _ in found))
            named = [f"{k}:{a}:{b}" for k, a, b in found]
            columns["base_sha256"].append(hashlib.sha256(",".join(n for n, f in zip(named, found, strict=True) if f[0] in BASE_KINDS).encode()).hexdigest())
            columns["spans"].append(",".join(named))
            columns["scores"].append(",".join(f"{score(text, *f):.2f}" for f in found))
        types = [pa.int64()] * len(BASE_KINDS) + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)]], ["doc_id", *columns])


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    Whole texts are searched; null and empty ones have no spans. ``scores`` follows
    ``spans``. Repeated rows get equal results; only doc_id and text are read, so extra
    columns cannot clash; an empty table gives none.
    """
    text = F.when(F.col("text").rlike("[@0-9]"), F.col("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, scores string"
    return docs.select("doc_id", text.alias("text")).mapInArrow(_report, schema)


ship(__name__)
