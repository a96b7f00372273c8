"""Data parts of reports: evidence by design, readiness, saved views, charts from small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def evidence_summary(rows: DataFrame, primary: list[str]) -> DataFrame:
    """Per design: studies, participants of primary studies, studies that lack a number."""
    is_primary = F.col("design").isin(*primary)
    return rows.groupBy("design").agg(
        F.count(F.lit(1)).alias("studies"), F.coalesce(F.sum(F.when(is_primary, F.col("n"))), F.lit(0)).cast("long").alias("participants"), F.count_if(is_primary & F.col("n").isNull()).alias("without_n")
    )


def readiness(catalog: DataFrame, answers: DataFrame, study: str = "study") -> DataFrame:
    """Per study: closed items without an answer, and whether it is ready."""
    closed = catalog.filter(~F.coalesce(F.col("open"), F.lit(False))).select("item")
    grid = answers.select(study).distinct().crossJoin(F.broadcast(closed))
    joined = grid.join(answers.filter(F.coalesce("answer", F.lit("")) != "").select(study, "item", "answer").distinct(), [study, "item"], "left")
    return joined.groupBy(study).agg(F.count_if(F.col("answer").isNull()).alias("missing")).withColumn("ready", F.col("missing") == 0)


def save_views(spark: SparkSession, notes: DataFrame, views: dict[str, dict]) -> None:
    """Register views over notes: a filter, columns and an order each."""
    for name, view in views.items():
        found = notes.filter(view.get("filter", "true"))
        if view.get("order"):
            found = found.orderBy(*view["order"])
        found.select(*view.get("columns", ["*"])).createOrReplaceTempView(name)


def mermaid_pie(title: str, counts: list[tuple[str, int]]) -> str:
    """Pie chart text from a few counts; zero parts are left out."""
    parts = [f'  "{name.replace(chr(34), chr(39))}" : {n}' for name, n in counts if n]
    return "\n".join([f"pie title {title}", *parts]) if parts else ""


def mermaid_graph(edges: list[tuple[str, str, int]]) -> str:
    """Undirected graph text from a few edges."""
    names = list(dict.fromkeys(x for a, b, _ in edges for x in (a, b)))
    label = lambda x: x.replace('"', "'")
    return "\n".join(["graph LR", *[f'  n{k}["{label(x)}"]' for k, x in enumerate(names)], *[f"  n{names.index(a)} ---|{n}| n{names.index(b)}" for a, b, n in edges]])
