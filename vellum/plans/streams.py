"""Queries of the streaming operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.logs import LOG_SQL
from vellum.plans.registry import query
from vellum.sources import notes, sinks
from vellum.session import table
from vellum.streaming import events

SESSIONS_SQL = """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "end", count(*) AS n FROM s GROUP BY user_id, k
"""


def _micros(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("batch_sessions", SESSIONS_SQL)
def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(events.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("stream_sessions", """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start, epoch_us(z) AS "end", n FROM g WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions: those that end before the watermark, an hour behind the last event."""
    return _micros(events.run_available(events.sessions(events.read_events(spark, sf_dir)), "sessions"))


@query("stream_ledger", """
SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS calls, sum(event_id % 100)::BIGINT AS units FROM events GROUP BY 1, 2
""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.latest(events.run_available(events.monthly_ledger(events.read_events(spark, sf_dir)), "ledger", "update"), "month", "event_type")


@query("stream_status_log", LOG_SQL + "SELECT key, seq, old, new FROM log")
def stream_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events.read_events(spark, sf_dir)
    changes = e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("none").alias("old"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("new")
    )
    return events.run_available(events.status_log(changes), "status-log")


@query("stream_watch", "SELECT DISTINCT event_id % 40 AS watch, user_id AS id FROM events")
def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as hits of forty saved searches, each reported once."""
    hits = events.read_events(spark, sf_dir).select((F.col("event_id") % 40).alias("watch"), F.col("user_id").alias("id"), F.col("event_id").alias("pos"))
    return events.run_available(events.unseen_ids(hits), "watch")


@query("upsert_merge", """
WITH c AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal, c_acctbal < 0 AS gone FROM customer WHERE c_mktsegment = 'BUILDING'
           UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal, false FROM supplier)
SELECT coalesce(c.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE t.c_name END AS c_name,
       CASE WHEN c.c_custkey IS NOT NULL THEN c.c_acctbal ELSE t.c_acctbal END AS c_acctbal
FROM customer t FULL JOIN c ON t.c_custkey = c.c_custkey WHERE NOT coalesce(c.gone, false)
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "customer")
    updates = target.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_acctbal") < 0).alias("gone"))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"), F.lit(False).alias("gone"))
    return sinks.upsert(target.select("c_custkey", "c_name", "c_acctbal"), updates.unionByName(new), "c_custkey", "gone")


@query("write_if_changed", """
SELECT p_partkey, p_name FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_name AS old, p_size FROM part) WHERE p_name <> old OR p_size = 7
""")
def write_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    new = part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return sinks.changed_only(new, part.filter("p_size <> 7").select("p_partkey", "p_name"), "p_partkey")


@query("jsonl_events", """
SELECT event_id AS id, (props::JSON->>'k')::BIGINT AS k, event_id % 10 > 0 AS good FROM events
""")
def jsonl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as lines of JSON, every tenth line broken: rows and errors together."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 > 0, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "p": '), "props", F.lit("}"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(" "), "props"))
    good, bad = notes.json_lines(e.select(line.alias("value")), "id long, p struct<k: long>")
    broken = bad.select(F.regexp_extract("line", r"^(\d+)", 1).cast("long").alias("id"), F.get_json_object(F.regexp_replace("line", r"^\d+ ", ""), "$.k").cast("long").alias("k"), F.lit(False).alias("good"))
    return good.select("id", "p.k", F.lit(True).alias("good")).unionByName(broken)


@query("vault_frontmatter", """
SELECT 'N' || s_suppkey AS key, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'a b,' || s_nationkey ELSE '' END AS tags FROM supplier
""")
def vault_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as notes in two copies, read back by frontmatter, the first copy of each key."""
    tags = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("tags:\n  - a b\n  - "), F.col("s_nationkey").cast("string"), F.lit("\n"))).otherwise(F.lit("tags: []\n"))
    copy = F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", tags.alias("tags"), copy)
    text = F.concat(F.lit('---\nkey: "N'), F.col("s_suppkey").cast("string"), F.lit('"\ntitle: '), F.when(F.col("copy") == 1, F.col("s_name")).otherwise(F.lit("old")), F.lit("\n"), F.col("tags"), F.lit("---\nbody"))
    vault = rows.select(F.concat(F.col("copy").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), notes.frontmatter_map(notes.split_frontmatter(text)["frontmatter"]).alias("m"))
    keyed = vault.select("path", F.element_at(F.col("m")["key"], 1).alias("key"), F.element_at(F.col("m")["title"], 1).alias("title"), F.array_join(F.col("m")["tags"], ",").alias("tags"))
    return notes.first_copy(keyed, "key").select("key", "title", "tags")


@query("watch_plan", """
WITH b AS (SELECT l_suppkey AS watch, l_partkey AS id, l_orderkey AS pos, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS rank FROM lineitem WHERE l_returnflag <> 'R'),
s AS (SELECT DISTINCT l_suppkey AS watch, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT watch, id, min(rank * 1000000000 + pos) AS o FROM b ANTI JOIN s USING (watch, id) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY watch ORDER BY o, id) AS n FROM f)
SELECT watch, id, n FROM n WHERE n <= 50
""")
def watch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("watch"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("pos"), "l_returnflag")
    take, _ = events.plan_watch(items.filter("l_returnflag = 'R'"), items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'N'"), 50)
    return take
