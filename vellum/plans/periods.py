"""Queries of facts by period and of Markdown as blocks."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import blocks
from vellum.operators import progress
from vellum.plans.registry import query
from vellum.session import table

FIRST = date(2024, 1, 1)
#: Five weeks, and the month that holds them.
PERIODS = [(f"week {k + 1}", FIRST + timedelta(7 * k), FIRST + timedelta(7 * k + 6)) for k in range(5)] + [("month", FIRST, date(2024, 1, 31))]
PERIODS_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ") v(period, first, last))"


def periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERIODS, "period string, start date, end date")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("period_changes", f"""
WITH {PERIODS_SQL},
e AS (SELECT user_id, ts, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'none' END AS old, event_type AS new FROM events),
c AS (SELECT period, user_id::VARCHAR AS key, arg_min(old, (ts, new)) AS before, arg_max(new, (ts, new)) AS after, count(*) AS entries FROM e JOIN p ON e.ts::DATE BETWEEN first AND last GROUP BY ALL)
SELECT * FROM c WHERE before <> after
""")
def period_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose status at a period's end differs from that at its beginning."""
    log = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "at", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("none").alias("old"), F.col("event_type").alias("new"))
    return progress.status_changes(log, periods(spark))


@query("period_snapshots", f"""
WITH {PERIODS_SQL},
s AS (SELECT user_id AS review, ts, event_id AS included, value FROM events WHERE event_id % 5 = 0),
r AS (SELECT review, min(ts) AS first_ts FROM s GROUP BY review),
a AS (SELECT review, period, first::TIMESTAMP AS t0, (last + 1)::TIMESTAMP AS t1 FROM r, p WHERE first_ts < (last + 1)::TIMESTAMP),
x AS (SELECT a.*, s.included, s.value FROM a ASOF JOIN s ON a.review = s.review AND a.t1 > s.ts),
y AS (SELECT x.review, x.period, x.included, x.value, s.included AS i0, s.value AS v0 FROM x ASOF LEFT JOIN s ON x.review = s.review AND x.t0 > s.ts)
SELECT review, period, included, value, included - i0 AS included_change, value - v0 AS value_change FROM y
""")
def period_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every user's last snapshot in each period, against the last one before it."""
    snapshots = _events(spark, sf_dir).filter("event_id % 5 = 0").select(F.col("user_id").alias("review"), "at", F.col("event_id").alias("included"), "value")
    return progress.snapshot_changes(snapshots, periods(spark), ["included", "value"])


@query("period_totals", f"""
WITH {PERIODS_SQL},
v AS (SELECT user_id AS draft, ts, event_id % 1000 AS words FROM events),
e AS (SELECT period, (SELECT coalesce(sum(w), 0) FROM (SELECT arg_max(words, ts) AS w FROM v WHERE ts < (last + 1)::TIMESTAMP GROUP BY draft)) AS total, (SELECT coalesce(sum(w), 0) FROM (SELECT arg_max(words, ts) AS w FROM v WHERE ts < first::TIMESTAMP GROUP BY draft)) AS earlier,
             (SELECT count(DISTINCT draft) FROM v WHERE ts::DATE BETWEEN first AND last) AS updated FROM p)
SELECT period, total::BIGINT AS total, (total - earlier)::BIGINT AS change, updated FROM e
""")
def period_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all drafts at the end of each period, from the versions of every draft."""
    versions = _events(spark, sf_dir).select(F.col("user_id").alias("draft"), "at", (F.col("event_id") % 1000).alias("words"))
    return progress.totals_by_period(versions, periods(spark))


@query("period_counts_by_field", f"""
WITH {PERIODS_SQL}
SELECT period, (SELECT count(*) FROM events WHERE ts::DATE BETWEEN first AND last) AS added, (SELECT count(*) FROM events WHERE event_id % 3 = 0 AND (ts + INTERVAL 9 DAY)::DATE BETWEEN first AND last) AS appraised FROM p
""")
def period_counts_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _events(spark, sf_dir).select(F.col("at").alias("added"), F.when(F.col("event_id") % 3 == 0, F.col("at") + F.expr("INTERVAL 9 DAYS")).alias("appraised"))
    return progress.dated_counts(items, periods(spark), ["added", "appraised"])


@query("events_as_of", """
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), f AS (SELECT user_id, ts, event_id AS last_purchase, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, f.last_purchase, f.value FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts
""")
def events_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but purchases with the last purchase of its user before it."""
    rows = _events(spark, sf_dir)
    facts = rows.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("last_purchase"), "value")
    return progress.as_of(rows.filter("event_type <> 'purchase'").select("event_id", "user_id", "at"), facts, "user_id", "at", ["last_purchase", "value"]).select("event_id", "last_purchase", "value")


BLOCK_LINES = r"regexp_matches(x, '^\p{L}[^\t]*$')"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: a heading, a nested list, a quote, and the lines that begin with a letter as paragraphs."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"^\p{L}[^\t]*$"))
    id = F.col("doc_id").cast("string")
    text = F.concat(F.lit("# Doc "), id, F.lit("\n\n- one\n  - two "), id, F.lit("\n\n> quoted "), id, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("\n\n"), F.rtrim(x))), ""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


NOTES_SQL = rf"""d AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {BLOCK_LINES}) AS lines FROM documents)"""


@query("note_blocks", rf"""
WITH {NOTES_SQL}
SELECT doc_id, 0 AS pos, -1 AS parent, 0 AS place, 0 AS depth, 'heading' AS kind, 'Doc ' || doc_id AS text FROM d
UNION ALL SELECT doc_id, 1, -1, 1, 0, 'bullet', 'one' FROM d UNION ALL SELECT doc_id, 2, 1, 0, 1, 'bullet', 'two ' || doc_id FROM d UNION ALL SELECT doc_id, 3, -1, 2, 0, 'quote', '' FROM d UNION ALL SELECT doc_id, 4, 3, 0, 1, 'paragraph', 'quoted ' || doc_id FROM d
UNION ALL SELECT doc_id, (4 + k)::INT, -1, (2 + k)::INT, 0, 'paragraph', rtrim(line, ' ') FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS k FROM d)
""")
def note_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_rows(_notes(spark, sf_dir), "doc_id").drop("more")


@query("blocks_written", rf"""
WITH {NOTES_SQL}
SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || '- one' || chr(10) || '  - two ' || doc_id || chr(10) || chr(10) || '> quoted ' || doc_id || array_to_string(list_transform(lines, lambda x: chr(10) || chr(10) || rtrim(x, ' ')), '') AS text FROM d
""")
def blocks_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes read into blocks and written again."""
    return blocks.markdown_of(blocks.block_rows(_notes(spark, sf_dir), "doc_id"), "doc_id")
