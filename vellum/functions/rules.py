"""Boolean rule language, compiled to Catalyst predicates.

    title:"burn out" AND (year>=2020 OR tag:review*) NOT type:book

NOT binds tighter than AND, AND tighter than OR; terms side by side are joined by AND.
Terms without a field look into title and abstract. A rule list has one ``name =
condition`` per line; lines that start with # or // are comments.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("title", "abstract", "text", "journal", "author", "type", "language", "tag", "year")
OPERATORS = (">=", "<=", ">", "<", ":", "=")
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』"}
MAX_NAME = 80


class RuleError(ValueError):
    """A condition that cannot be read."""


@dataclass(frozen=True)
class Term:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    parts: tuple


_WORD = re.compile(r"[^\s()\"“「『]+")
_FIELD = re.compile(r"([A-Za-z]+)\s*(>=|<=|>|<|:|=)\s*")
_VALUE = re.compile(r"[^\s()]+")


def _tokens(text: str) -> list:
    text = unicodedata.normalize("NFKC", text)
    found, at = [], 0

    def quoted() -> str:
        nonlocal at
        end = text.find(QUOTES[text[at]], at + 1)
        if end < 0:
            raise RuleError(f"quote {text[at]} is not closed")
        value = text[at + 1 : end].strip()
        at = end + 1
        if not value:
            raise RuleError("nothing between the quotes")
        return value

    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] in "()":
            found.append(text[at])
            at += 1
        elif (m := _FIELD.match(text, at)) and m[1].lower() in FIELDS:
            at = m.end()
            if at < len(text) and text[at] in QUOTES:
                value = quoted()
            else:
                v = _VALUE.match(text, at)
                value = v[0] if v else ""
                at += len(value)
            if not value:
                raise RuleError(f"{m[1]}{m[2]} needs a value")
            found.append(_checked(Term(m[1].lower(), m[2], value)))
        elif text[at] in QUOTES:
            found.append(Term("text", ":", quoted()))
        else:
            word = _WORD.match(text, at)[0]
            at += len(word)
            found.append(word.upper() if word.upper() in ("AND", "OR", "NOT") else Term("text", ":", word))
    return found


def _checked(term: Term) -> Term:
    if term.field == "year":
        if not re.fullmatch(r"\d{4}(\s*[-–~]\s*\d{4})?", term.value) or (len(term.value) > 4 and term.op not in (":", "=")):
            raise RuleError(f"year needs four digits or a range, not {term.value!r}")
    elif term.op not in (":", "="):
        raise RuleError(f"only year can be compared with {term.op}")
    return term


def parse(text: str) -> Term | Node:
    """Tree of a condition; raises RuleError."""
    tokens = _tokens(text)
    if not tokens:
        raise RuleError("the condition is empty")
    at = 0

    def here():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        parts = [both()]
        while here() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both():
        nonlocal at
        parts = [negated()]
        while here() not in (None, "OR", ")"):
            if here() == "AND":
                at += 1
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def negated():
        nonlocal at
        if here() == "NOT":
            at += 1
            return Node("not", (negated(),))
        token = here()
        at += 1
        if token == "(":
            inner = either()
            if here() != ")":
                raise RuleError("a closing parenthesis is missing")
            at += 1
            return inner
        if not isinstance(token, Term):
            raise RuleError("a condition is missing" if token is None else f"{token} is out of place")
        return token

    tree = either()
    if here() is not None:
        raise RuleError("one closing parenthesis too many")
    return tree


def parse_rules(text: str) -> tuple[list[tuple[str, Term | Node]], list[tuple[int, str]]]:
    """Rules (name, tree) of a list, in order, and errors (line, message)."""
    rules, errors = [], []
    for number, line in enumerate((text or "").splitlines(), 1):
        line = line.strip()
        if not line or line.startswith(("#", "//")):
            continue
        name, equals, condition = line.replace("＝", "=", 1).partition("=")
        name = " ".join(unicodedata.normalize("NFKC", name).split())
        try:
            if not equals:
                raise RuleError("write it as: name = condition")
            if not name or len(name) > MAX_NAME:
                raise RuleError("the name is missing" if not name else "the name is too long")
            rules.append((name, parse(condition)))
        except RuleError as wrong:
            errors.append((number, str(wrong)))
    return rules, errors


def _folded(value: Column) -> Column:
    return F.lower(F.coalesce(value, F.lit("")))


def _any(values: Column, test) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: test(_folded(v)))


def _term(term: Term, columns: dict[str, Column], type_aliases: dict[str, str]) -> Column:
    value = term.value.lower()
    get = lambda name: columns.get(name, F.lit(None).cast("string"))
    if term.field in ("title", "abstract"):
        return _folded(get(term.field)).contains(value)
    if term.field == "text":
        return _folded(get("title")).contains(value) | _folded(get("abstract")).contains(value)
    if term.field in ("journal", "author"):
        return _any(columns[term.field], lambda v: v.contains(value)) if term.field in columns else F.lit(False)
    if term.field == "type":
        return _folded(get("type")) == type_aliases.get(value, value).lower()
    if term.field == "language":
        return (_folded(get("language")) != "") & _folded(get("language")).contains(value)
    if term.field == "tag":
        if "tag" not in columns:
            return F.lit(False)
        return _any(columns["tag"], (lambda v: v.startswith(value[:-1])) if value.endswith("*") else (lambda v: v == value))
    year = F.coalesce(get("year").try_cast("int"), F.lit(0))
    bounds = [int(y) for y in re.findall(r"\d{4}", term.value)]
    if len(bounds) == 2:
        return year.between(min(bounds), max(bounds))
    known = year != 0  # a record without a year matches no comparison
    return known & {">=": year >= bounds[0], "<=": year <= bounds[0], ">": year > bounds[0], "<": year < bounds[0]}.get(term.op, year == bounds[0])


def compile_rule(rule: str | Term | Node, columns: dict[str, Column], type_aliases: dict[str, str] | None = None) -> Column:
    """Predicate of a rule over ``columns`` (field name to column; tag, journal and author are arrays).

    Every term is true or false, never null, so NOT sees false where a value is missing.
    """
    tree = parse(rule) if isinstance(rule, str) else rule
    if isinstance(tree, Term):
        return _term(tree, columns, type_aliases or {})
    parts = [compile_rule(p, columns, type_aliases) for p in tree.parts]
    if tree.kind == "not":
        return ~parts[0]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole & part if tree.kind == "and" else whole | part
    return whole
