"""Metering: calls rolled up by month and model, priced by the longest matching price, summarised and forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.routing import longest_prefix

COUNTERS = ("calls", "input", "output", "cache_read", "cache_write", "cache_write_1h")
#: Cache prices as factors of the input price where a price gives none, and the batch discount.
CACHE_FACTORS = {"cache_read": 0.1, "cache_write": 1.25, "cache_write_1h": 2.0}
BATCH_DISCOUNT = 0.5
BATCH_SUFFIX = " (batch)"


def counter(column: Column) -> Column:
    """A count that is missing, negative or not finite counts as 0."""
    value = column.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf")), F.lit(0.0)).otherwise(value)


def rollup_usage(calls: DataFrame) -> DataFrame:
    """``month, model, calls, ...`` per month and model, and per month with model null, in one pass.

    ``calls`` has ts, model and the token counters except ``calls``.
    """
    month = F.date_format("ts", "yyyy-MM")
    sums = [F.sum(counter(F.col(c))).alias(c) for c in COUNTERS if c != "calls"]
    rows = calls.select(month.alias("month"), "model", *[c for c in COUNTERS if c != "calls"])
    return rows.groupingSets([[F.col("month"), F.col("model")], [F.col("month")]], "month", "model").agg(F.count(F.lit(1)).alias("calls"), *sums, F.grouping("model").alias("is_total"))


def keep_months(rollup: DataFrame, months: int) -> DataFrame:
    """Only the newest ``months`` months that have entries."""
    newest = rollup.select("month").distinct().orderBy(F.col("month").desc()).limit(months)
    return rollup.join(newest, "month", "left_semi")


def month_spine(rollup: DataFrame, last: str, months: int) -> DataFrame:
    """One row for each of the ``months`` months up to ``last`` (yyyy-MM), zeros where nothing was called."""
    end = F.to_date(F.lit(f"{last}-01"))
    spine = rollup.sparkSession.range(1).select(F.explode(F.sequence(F.add_months(end, -(months - 1)), end, F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    numbers = [c for c in rollup.columns if c != "month"]
    return spine.join(rollup, "month", "left").select("month", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])


def priced(usage: DataFrame, prices: dict[str, dict[str, float]]) -> DataFrame:
    """``usage`` by model with ``price_key``, ``batch``, ``cost``, ``cache_savings`` and ``batch_savings``; null where no price fits."""
    batch = F.col("model").endswith(BATCH_SUFFIX)
    base = F.when(batch, F.expr(f"substring(model, 1, length(model) - {len(BATCH_SUFFIX)})")).otherwise(F.col("model"))
    rows = longest_prefix(usage.withColumn("batch", batch).withColumn("base_model", base), "base_model", list(prices))
    of = lambda name, factor=None: F.element_at(
        F.create_map(*[x for key, p in prices.items() for x in (F.lit(key), F.lit(float(p.get(name, p["input"] * factor if factor else 0.0))))]), F.col("matched")
    )
    read, write, write1h = (of(name, CACHE_FACTORS[name]) for name in ("cache_read", "cache_write", "cache_write_1h"))
    n = {c: counter(F.col(c)) for c in COUNTERS}
    long = F.least(n["cache_write_1h"], n["cache_write"])
    cost = (n["input"] * of("input") + n["output"] * of("output") + n["cache_read"] * read + (n["cache_write"] - long) * write + long * write1h) / 1e6
    saved = (n["cache_read"] * (of("input") - read) - (n["cache_write"] - long) * (write - of("input")) - long * (write1h - of("input"))) / 1e6
    rate = F.when(F.col("batch"), BATCH_DISCOUNT).otherwise(1.0)
    return (
        rows.withColumn("cost", cost * rate)
        .withColumn("cache_savings", saved * rate)
        .withColumn("batch_savings", F.when(F.col("matched").isNotNull(), cost * (1.0 - rate)))
        .withColumnRenamed("matched", "price_key")
        .drop("base_model")
    )


def summarize(priced_usage: DataFrame) -> DataFrame:
    """Per month: calls, tokens, cost of priced models, calls without a price, batch calls and what was saved."""
    tokens = sum((counter(F.col(c)) for c in ("input", "output", "cache_read", "cache_write")), F.lit(0.0))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return priced_usage.groupBy("month").agg(
        F.sum("calls").alias("calls"),
        F.sum(tokens).alias("tokens"),
        zero("cost").alias("cost"),
        zero("cache_savings").alias("cache_savings"),
        zero("batch_savings").alias("batch_savings"),
        F.sum(F.when(F.col("price_key").isNull(), F.col("calls")).otherwise(0)).alias("unpriced_calls"),
        F.sum(F.when(F.col("batch"), F.col("calls")).otherwise(0)).alias("batch_calls"),
    )


def forecast(usage: DataFrame, prices: dict[str, dict[str, float]], n: int) -> DataFrame:
    """Per price: mean tokens of past calls at that price, cost per call and of ``n`` more. Prices without history are left out."""
    rows = priced(usage, prices).filter(F.col("price_key").isNotNull())
    means = rows.groupBy("price_key").agg(F.sum("calls").alias("samples"), *[F.sum(counter(F.col(c))).alias(f"sum_{c}") for c in COUNTERS if c not in ("calls", "cache_write_1h")]).filter("samples > 0")
    average = means.select(F.col("price_key").alias("model"), "samples", F.lit(1).alias("calls"), F.lit(0.0).alias("cache_write_1h"), *[(F.col(f"sum_{c}") / F.col("samples")).alias(c) for c in ("input", "output", "cache_read", "cache_write")])
    return priced(average, prices).select("price_key", "samples", F.col("cost").alias("per_call"), (F.col("cost") * n).alias("total"))
