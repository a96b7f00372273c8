"""Repair of Chinese creators: several people in one field, mixed scripts, swapped or wrongly split names, stray spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.metadata import clean_han

#: Surnames of two characters.
COMPOUND_SURNAMES = (
    "歐陽", "司馬", "諸葛", "上官", "東方", "皇甫", "尉遲", "公孫", "慕容", "長孫", "宇文", "司徒", "夏侯", "軒轅", "令狐", "鍾離", "端木", "張簡", "范姜", "張廖",
    "欧阳", "诸葛", "东方", "尉迟", "公孙", "长孙", "轩辕", "钟离", "张简", "张廖",
)
HAN_NAME = r"^[\p{IsHan}·‧・]{2,6}$"
LIST_SEPARATOR = r"\s*[、;；，,／/]\s*"
REPAIR = "struct<problem: string, confidence: string, replacement: array<struct<lastName: string, firstName: string, name: string>>>"


def creator_repair(last: Column, first: Column, whole: Column, surnames: str, compound: tuple[str, ...] = COMPOUND_SURNAMES) -> Column:
    """What to put for a creator: struct of problem, confidence (sure or check) and replacement; null where there is nothing to repair.

    A creator has either ``whole`` (its name in one field, else null) or ``last`` and
    ``first``. ``surnames`` is a string of the usual surnames of one character. Names
    without Han characters are left alone.
    """
    single = whole.isNotNull()
    last, first = F.coalesce(whole, last, F.lit("")), F.when(single, "").otherwise(F.coalesce(first, F.lit("")))
    pair = "|".join(compound)
    is_surname = lambda c: c.rlike(rf"^(?:{pair}|[{surnames}])$")
    begins = lambda c: c.rlike(rf"^(?:{pair}|[{surnames}])")
    is_pair = lambda c: c.isin(*compound)
    person = lambda family=None, given=None, name=None: F.struct(*[(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("lastName", family), ("firstName", given), ("name", name))])
    repair = lambda problem, confidence, *people: F.struct(F.lit(problem), F.lit(confidence) if isinstance(confidence, str) else confidence, people[0] if len(people) == 1 else F.array(*people)).cast(REPAIR)

    text = F.trim(F.replace(last, F.lit("　"), F.lit(" ")))
    listed = F.filter(F.transform(F.split(text, LIST_SEPARATOR), clean_han), lambda n: n != "")
    spaced = F.filter(F.split(text, r"\s+"), lambda n: n != "")
    by_space = (F.size(spaced) >= 2) & F.forall(spaced, lambda n: (F.length(n) >= 2) & begins(n) & ~is_pair(n))
    names = F.when(F.size(listed) >= 2, listed).when(by_space, spaced)
    several = (single | (F.trim(first) == "")) & F.coalesce(F.forall(names, lambda n: n.rlike(HAN_NAME)), F.lit(False))

    runs = F.regexp_extract_all(F.regexp_replace(F.replace(F.concat_ws(" ", last, first), F.lit("　"), F.lit(" ")), r"(\p{IsHan})\s+(?=\p{IsHan})", "$1"), F.lit(r"[\p{IsHan}·‧・]+"), F.lit(0))
    one_run = (F.size(runs) == 1) & F.get(runs, 0).rlike(HAN_NAME)
    both = F.concat(last, first)
    family, given = clean_han(last), clean_han(first)
    filled, tidied = (family != "") & (given != ""), (family != last) | (given != first)
    joined = F.concat(family, F.substring(given, 1, 1))
    return (
        F.when(~both.rlike(r"\p{IsHan}"), F.lit(None))
        .when(several, repair("several people in one field", F.when(F.size(listed) >= 2, "sure").otherwise("check"), F.transform(names, lambda n: person(name=n))))
        .when(both.rlike(r"\p{IsLatin}"), F.when(one_run, repair("two scripts in one name", "check", F.array(person(name=F.get(runs, 0))))))
        .when(single, F.when((family != last) & family.rlike(HAN_NAME), repair("spaces in the name", "sure", F.array(person(name=family)))))
        .when(filled & is_surname(given) & ~begins(family), repair("names swapped", "sure", F.array(person(given, family))))
        .when(filled & (F.length(given) == 1) & is_surname(given) & (F.length(family) >= 2) & begins(family) & ~is_pair(family), repair("names perhaps swapped", "check", F.array(person(given, family))))
        .when((F.length(family) == 1) & (F.length(given) >= 2) & is_pair(joined), repair("surname of two characters split", "check", F.array(person(joined, F.substring(given, F.lit(2), F.length(given))))))
        .when((F.length(family) >= 2) & (F.length(given) >= 2) & begins(family) & begins(given) & ~is_pair(family) & ~is_pair(given), repair("two people in one creator", "check", person(name=family), person(name=given)))
        .when(tidied & F.concat(family, given).rlike(HAN_NAME), repair("spaces in the name", "sure", F.array(person(family, given))))
    )
