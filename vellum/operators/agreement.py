"""Agreement of two raters, checklist summaries and matrices of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_APPLICABLE = "not applicable"


def kappa(pairs: DataFrame, a: str, b: str, *groups: str) -> DataFrame:
    """Cohen's kappa: ``n, po, pe, kappa`` per group, or over all rows; kappa is null where chance alone agrees in full.

    Pairs with a missing side are left out. Only the table of answer pairs is joined.
    """
    cells = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*groups, a, b).agg(F.count(F.lit(1)).alias("c"))
    totals = cells.groupBy(*groups).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy(*groups, F.col(a).alias("answer")).agg(F.sum("c").alias("na"))
    right = cells.groupBy(*groups, F.col(b).alias("answer")).agg(F.sum("c").alias("nb"))
    chance = left.join(right, [*groups, "answer"]).groupBy(*groups).agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    joined = totals.join(chance, list(groups), "left") if groups else totals.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("s"), F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(F.coalesce("s", F.lit(0)) < F.col("n") * F.col("n"), (po - pe) / (F.lit(1.0) - pe))
    return joined.filter("n > 0").select(*groups, "n", po.alias("po"), pe.alias("pe"), value.alias("kappa"))


def kappa_label(k: Column) -> Column:
    """The usual words for a kappa."""
    bands = [(0.0, "poor"), (0.21, "slight"), (0.41, "fair"), (0.61, "moderate"), (0.81, "substantial")]
    label = F.when(k.isNull(), None)
    for below, word in bands:
        label = label.when(k < below, word)
    return label.otherwise("almost perfect")


def answer_pairs(catalog: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``item, a, b`` of every item of a checklist; an answer that is missing is null."""
    return catalog.select("item").join(first.select("item", F.col("answer").alias("a")), "item", "left").join(second.select("item", F.col("answer").alias("b")), "item", "left")


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs with ``agree``: null where a side is missing."""
    return pairs.withColumn("agree", F.col("a") == F.col("b"))


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("a") != F.col("b"))


def answer_summary(answers: DataFrame, *groups: str) -> DataFrame:
    """Per group: items, answered, yes, no, unclear, not applicable, and the whole per cent of yes among applicable answers.

    Open items are not scored; empty answers count as missing.
    """
    from vellum.operators.facets import percent

    n = lambda value: F.count_if(F.col("answer") == value)
    scored = answers.filter(~F.coalesce(F.col("open"), F.lit(False)))
    counted = scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.coalesce(F.col("answer"), F.lit("")) != "").alias("answered"),
        n("yes").alias("yes"),
        n("no").alias("no"),
        n("unclear").alias("unclear"),
        n(NOT_APPLICABLE).alias("not_applicable"),
    )
    return counted.withColumn("yes_percent", percent(F.col("yes"), F.col("answered") - F.col("not_applicable")))


def matrix(answers: DataFrame, items: list[str]) -> DataFrame:
    """Studies by items; each cell an answer, or null."""
    return answers.groupBy("study").pivot("item", items).agg(F.min("answer"))


def consensus(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group, value, variants``: the value if all non-empty ones agree after folding, else null with their number."""
    folded = F.lower(F.trim(F.col(value)))
    return rows.filter(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(group).agg(F.countDistinct(folded).alias("variants"), F.min(value).alias("least")).select(group, F.when(F.col("variants") == 1, F.col("least")).alias("value"), "variants")
