"""Queries of the screening funnel, over ``orders`` read as screening records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import funnel
from vellum.plans.registry import query
from vellum.session import table

OTHER_SOURCES = ("citations", "websites")
REASON_ORDER = ("population", "outcome")

#: The tags of a record, as an expression that Spark and DuckDB read alike.
PARTS = {
    "dup": "CASE WHEN o_orderpriority = '5-LOW' THEN 'duplicate' END",
    "ta": "CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 3 = 0 THEN CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'ta/exclude' ELSE 'ta/include' END END",
    "ta2": "CASE WHEN o_orderkey % 97 = 0 THEN 'ta/maybe' END",
    "ft": "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'ft/notRetrieved' ELSE 'ft/include' END WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'ft/exclude' END",
    "r1": "CASE WHEN o_orderkey % 7 < 3 THEN 'reason/outcome' END",
    "r2": "CASE WHEN o_orderkey % 11 < 3 THEN 'reason/population' END",
    "r3": "CASE WHEN o_orderkey % 13 = 0 THEN 'reason/language' END",
    "s1": "CASE WHEN o_orderkey % 4 = 0 THEN 'source/citations' END",
    "s2": "CASE WHEN o_orderkey % 6 = 1 THEN 'source/registry' END",
}


def screening_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.filter(F.array(*[F.expr(x) for x in PARTS.values()]), lambda t: t.isNotNull())
    catalog = F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("db"), (F.col("o_custkey") % 3).cast("string")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), tags.alias("tags"), catalog.alias("catalog"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.staged(screening_records(spark, sf_dir), OTHER_SOURCES)


STAGED_SQL = f"""
WITH p AS (SELECT o_orderkey, o_custkey, {", ".join(f"{x} AS {k}" for k, x in PARTS.items())} FROM orders),
t AS (
  SELECT *, dup IS NOT NULL AS duplicate,
         CASE WHEN (ta IS NULL) <> (ta2 IS NULL) THEN coalesce(ta, ta2) END AS ta1,
         CASE WHEN ta IS NOT NULL AND ta2 IS NOT NULL THEN 2 WHEN ta IS NULL AND ta2 IS NULL THEN 0 ELSE 1 END AS n_ta,
         (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT AS n_reasons,
         s1 IS NOT NULL AND s2 IS NULL AS other
  FROM p),
s AS (
  SELECT *, CASE WHEN duplicate THEN 'duplicate' WHEN ft = 'ft/include' THEN 'included' WHEN ft = 'ft/exclude' THEN 'ft_excluded'
                 WHEN ft = 'ft/notRetrieved' THEN 'not_retrieved' WHEN ta1 = 'ta/include' THEN 'ft_pending'
                 WHEN ta1 = 'ta/exclude' THEN 'ta_excluded' ELSE 'ta_pending' END AS stage
  FROM t)
"""

COUNTS_SQL = STAGED_SQL + """
SELECT other, count(*) AS identified, count(*) FILTER (stage = 'duplicate') AS duplicates, count(*) FILTER (stage <> 'duplicate') AS screened,
       count(*) FILTER (stage = 'ta_excluded') AS ta_excluded, count(*) FILTER (stage = 'ta_pending') AS ta_pending,
       count(*) FILTER (stage IN ('ft_pending', 'ft_excluded', 'included', 'not_retrieved')) AS sought,
       count(*) FILTER (stage = 'not_retrieved') AS not_retrieved,
       count(*) FILTER (stage IN ('ft_pending', 'ft_excluded', 'included')) AS assessed,
       count(*) FILTER (stage = 'ft_excluded') AS ft_excluded, count(*) FILTER (stage = 'ft_pending') AS ft_pending,
       count(*) FILTER (stage = 'included') AS included, '' AS broken
FROM s GROUP BY other
"""


@query("funnel_counts", COUNTS_SQL)
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.funnel_counts(staged(spark, sf_dir))


REASONS_SQL = STAGED_SQL + """
SELECT other, CASE WHEN r2 IS NOT NULL THEN 'population' WHEN r1 IS NOT NULL THEN 'outcome' WHEN r3 IS NOT NULL THEN 'language'
                   ELSE '(no reason given)' END AS reason, count(*) AS n
FROM s WHERE stage = 'ft_excluded' GROUP BY ALL
"""


@query("funnel_reasons", REASONS_SQL)
def funnel_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.reason_counts(staged(spark, sf_dir), REASON_ORDER)


SOURCES_SQL = STAGED_SQL + """
, e AS (
  SELECT other, unnest(CASE WHEN s1 IS NULL AND s2 IS NULL
      THEN [CASE WHEN o_orderkey % 10 = 0 THEN '(no source)' ELSE 'db' || (o_custkey % 3) END]
      ELSE list_filter([replace(s1, 'source/', ''), replace(s2, 'source/', '')], lambda x: x IS NOT NULL) END) AS source
  FROM s)
SELECT other, source, count(*) AS n FROM e GROUP BY ALL
"""


@query("funnel_sources", SOURCES_SQL)
def funnel_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.source_counts(staged(spark, sf_dir))


ISSUES_SQL = STAGED_SQL + """
, i AS (
  SELECT unnest([CASE WHEN n_ta > 1 THEN 'taConflict' END,
    CASE WHEN duplicate AND (n_ta > 0 OR ft IS NOT NULL OR n_reasons > 0) THEN 'duplicateDecided' END,
    CASE WHEN NOT duplicate AND ft IS NOT NULL AND ta1 IS DISTINCT FROM 'ta/include' AND NOT other THEN 'ftWithoutTA' END,
    CASE WHEN stage = 'ft_excluded' AND n_reasons = 0 THEN 'noReason' END,
    CASE WHEN stage = 'ft_excluded' AND n_reasons > 1 THEN 'manyReasons' END,
    CASE WHEN NOT duplicate AND n_reasons > 0 AND ft IS DISTINCT FROM 'ft/exclude' THEN 'reasonWithoutExclude' END,
    CASE WHEN stage = 'ta_pending' THEN 'taPending' END, CASE WHEN stage = 'ft_pending' THEN 'ftPending' END]) AS code FROM s)
SELECT code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY code
"""


@query("funnel_issues", ISSUES_SQL)
def funnel_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.issue_counts(staged(spark, sf_dir))
