"""First-match routing and ordered classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lies_under(paths: Column, top: str) -> Column:
    """Whether one of the paths is ``top`` or below it."""
    return F.exists(F.coalesce(paths, F.array().cast("array<string>")), lambda p: (p == top) | p.startswith(top + "/"))


def first_match(rules: list[dict], library: Column, collections: Column, defaults: dict[str, str], targets: tuple[str, ...]) -> Column:
    """Struct of ``rule`` and the targets of the first enabled rule that fits a record.

    A rule names a ``library`` ("*": any) and a ``collection`` ("": any) that one of the
    record's collections must equal or lie under. Empty targets fall back to the
    defaults one by one. Rules are a short ordered list, so the choice is one CASE.
    """

    def outcome(name: str, values: dict) -> Column:
        return F.struct(F.lit(name).alias("rule"), *[F.lit(values.get(t) or defaults.get(t, "")).alias(t) for t in targets])

    chosen = None
    for rule in rules:
        if rule.get("enabled", True) is False:
            continue
        test = F.lit(True)
        if (wanted := str(rule.get("library") or "*")) != "*":
            test = library.eqNullSafe(wanted)
        if path := (rule.get("collection") or "").strip("/").strip():
            test = test & lies_under(collections, path)
        then = outcome(rule.get("name", ""), rule)
        chosen = F.when(test, then) if chosen is None else chosen.when(test, then)
    return outcome("", {}) if chosen is None else chosen.otherwise(outcome("", {}))


def classify_first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that is found in the text; null where none is."""
    chosen = None
    for name, pattern in patterns:
        test = F.coalesce(text, F.lit("")).rlike(pattern)
        chosen = F.when(test, name) if chosen is None else chosen.when(test, name)
    return F.lit(None).cast("string") if chosen is None else chosen


def layered(*evidence: tuple[Column, str]) -> Column:
    """Struct of value and source of the first evidence that has a value; null where none has."""
    return F.coalesce(*[F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(source).alias("source"))) for value, source in evidence])


def longest_prefix(df: DataFrame, key: str, prefixes: list[str], separator: str = "-") -> DataFrame:
    """``df`` with ``matched``: the prefix equal to the key, else the longest one that the key continues after ``separator``."""
    options = F.array(*[F.when((F.col(key) == p) | F.col(key).startswith(p + separator), F.struct(F.lit(len(p)).alias("size"), F.lit(p).alias("prefix"))) for p in prefixes])
    return df.withColumn("matched", F.array_max(F.filter(options, lambda o: o.isNotNull()))["prefix"])
