"""Funnel accounting over screening records: state from tags, one stage per record, counts, reasons, sources, issues.

A record has ``id``, ``tags`` (array of strings) and ``catalog``. Tags follow a small
vocabulary: ``ta/<decision>`` and ``ft/<decision>`` for the two stages, ``reason/<text>``,
``source/<name>`` and ``duplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_REASON = "(no reason given)"
NO_SOURCE = "(no source)"
DECISIONS = {"ta": ("include", "exclude", "maybe"), "ft": ("include", "exclude", "notRetrieved")}

COUNTERS = ("identified", "duplicates", "screened", "ta_excluded", "ta_pending", "sought", "not_retrieved", "assessed", "ft_excluded", "ft_pending", "included")


def _values(tags: Column, prefix: str) -> Column:
    return F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 1 << 20)))


def read_state(tags: Column) -> Column:
    """Struct of what the tags say: ta, ft (null on none or on conflict), all decisions, reasons, sources, duplicate."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    ta, ft = (F.array_intersect(_values(tags, f"{stage}/"), F.array(*map(F.lit, known))) for stage, known in DECISIONS.items())
    only = lambda a: F.when(F.size(a) == 1, F.element_at(a, 1))
    return F.struct(
        only(ta).alias("ta"),
        only(ft).alias("ft"),
        ta.alias("ta_all"),
        ft.alias("ft_all"),
        _values(tags, "reason/").alias("reasons"),
        _values(tags, "source/").alias("sources"),
        F.array_contains(tags, "duplicate").alias("duplicate"),
    )


def stage_of(duplicate: Column, ta: Column, ft: Column) -> Column:
    """The one stage of a record. Any full-text decision implies inclusion by title and abstract."""
    return (
        F.when(F.coalesce(duplicate, F.lit(False)), "duplicate")
        .when(ft == "include", "included")
        .when(ft == "exclude", "ft_excluded")
        .when(ft == "notRetrieved", "not_retrieved")
        .when(ta == "include", "ft_pending")
        .when(ta == "exclude", "ta_excluded")
        .otherwise("ta_pending")
    )


def staged(records: DataFrame, other_sources: tuple[str, ...] = ()) -> DataFrame:
    """Records with ``state``, ``stage`` and ``other``: whether all their sources are other methods than databases."""
    sources = F.col("state.sources")
    other = F.lit(False) if not other_sources else (F.size(sources) > 0) & F.forall(sources, lambda s: s.isin(*other_sources))
    return (
        records.withColumn("state", read_state(F.col("tags")))
        .withColumn("stage", stage_of(F.col("state.duplicate"), F.col("state.ta"), F.col("state.ft")))
        .withColumn("other", other)
    )


def funnel_counts(rows: DataFrame) -> DataFrame:
    """One row per side of the funnel (``other``) with the counters and ``broken``, the sums that do not hold.

    Takes ``staged`` rows. Sides without records are left out.
    """
    n = lambda *names: F.count_if(F.col("stage").isin(*names))
    c = F.col
    counts = rows.groupBy("other").agg(
        F.count(F.lit(1)).alias("identified"),
        n("duplicate").alias("duplicates"),
        F.count_if(c("stage") != "duplicate").alias("screened"),
        n("ta_excluded").alias("ta_excluded"),
        n("ta_pending").alias("ta_pending"),
        n("ft_pending", "ft_excluded", "included", "not_retrieved").alias("sought"),
        n("not_retrieved").alias("not_retrieved"),
        n("ft_pending", "ft_excluded", "included").alias("assessed"),
        n("ft_excluded").alias("ft_excluded"),
        n("ft_pending").alias("ft_pending"),
        n("included").alias("included"),
    )
    return counts.withColumn("broken", check_counts())


def checked_counts(counts: DataFrame, reasons: DataFrame) -> DataFrame:
    """``counts`` (by ``other``) with ``broken`` by all five sums, that of the counts by reason (``other, reason, n``) among them."""
    total = reasons.groupBy(F.col("other").alias("_other")).agg(F.sum("n").alias("_reasons"))
    joined = counts.join(total, F.col("other").eqNullSafe(F.col("_other")), "left")
    return joined.withColumn("broken", check_counts(F.coalesce("_reasons", F.lit(0)))).drop("_other", "_reasons")


def check_counts(reasons: Column | None = None) -> Column:
    """Names of the sums of the funnel that the counters of a row break; ``reasons`` is the sum of the counts by reason."""
    c = F.col
    rules = {
        "identified": c("duplicates") + c("screened"),
        "screened": c("ta_excluded") + c("ta_pending") + c("sought"),
        "sought": c("not_retrieved") + c("assessed"),
        "assessed": c("ft_excluded") + c("included") + c("ft_pending"),
    }
    if reasons is not None:
        rules["ft_excluded"] = reasons
    return F.array_join(F.filter(F.array(*[F.when(c(name) != total, name) for name, total in rules.items()]), lambda x: x.isNotNull()), ",")


def primary_reason(reasons: Column, order: tuple[str, ...]) -> Column:
    """The reason that comes first in ``order``; of unlisted ones the first by code point; NO_REASON for none."""
    listed = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")
    ranked = F.transform(reasons, lambda r: F.struct(F.when(F.array_contains(listed, r), F.array_position(listed, r)).otherwise(len(order) + 1).alias("rank"), r.alias("reason")))
    return F.coalesce(F.array_min(ranked)["reason"], F.lit(NO_REASON))


def reason_counts(rows: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """``other, reason, n`` of the records excluded at full text, each under its primary reason."""
    return rows.filter(F.col("stage") == "ft_excluded").groupBy("other", primary_reason(F.col("state.reasons"), order).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def source_counts(rows: DataFrame) -> DataFrame:
    """``other, source, n``; a record counts once under each of its sources, else under its catalog."""
    catalog = F.trim(F.coalesce(F.col("catalog"), F.lit("")))
    own = F.when(F.size("state.sources") > 0, F.col("state.sources")).otherwise(F.array(F.when(catalog == "", NO_SOURCE).otherwise(catalog)))
    return rows.select("other", F.explode(own).alias("source")).groupBy("other", "source").agg(F.count(F.lit(1)).alias("n"))


def issue_codes() -> Column:
    """Codes of what is inconsistent or missing in a staged record."""
    s = F.col("state")
    decided = F.size(s["ta_all"]) + F.size(s["ft_all"]) + F.size(s["reasons"]) > 0
    live = ~s["duplicate"]
    tests = {
        "taConflict": F.size(s["ta_all"]) > 1,
        "ftConflict": F.size(s["ft_all"]) > 1,
        "duplicateDecided": s["duplicate"] & decided,
        "ftWithoutTA": live & s["ft"].isNotNull() & ~s["ta"].eqNullSafe("include") & ~F.col("other"),
        "noReason": (F.col("stage") == "ft_excluded") & (F.size(s["reasons"]) == 0),
        "manyReasons": (F.col("stage") == "ft_excluded") & (F.size(s["reasons"]) > 1),
        "reasonWithoutExclude": live & (F.size(s["reasons"]) > 0) & ~s["ft"].eqNullSafe("exclude"),
        "taPending": F.col("stage") == "ta_pending",
        "ftPending": F.col("stage") == "ft_pending",
    }
    return F.filter(F.array(*[F.when(test, code) for code, test in tests.items()]), lambda x: x.isNotNull())


def issue_counts(rows: DataFrame) -> DataFrame:
    """``code, n`` of the issues found."""
    return rows.select(F.explode(issue_codes()).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def plan_change(tags: Column, stage: Column, decision: Column) -> Column:
    """Struct of tags to remove and to add for a decision at a stage; both empty if nothing changes."""
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    old = F.filter(tags, lambda t: t.startswith(F.concat(stage, F.lit("/"))))
    new = F.when(decision == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(stage, F.lit("/"), decision)))
    return F.struct(F.array_except(old, new).alias("remove"), F.array_except(new, old).alias("add"))
