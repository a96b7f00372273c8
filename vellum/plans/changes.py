"""Queries of gathered change notices, bucketed upserts, views kept from changes, lists read along cursors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.registry import query
from vellum.session import table
from vellum.sources import buckets, cited
from vellum.storage import shared_dir
from vellum.streaming import bursts, events

CHANNELS = 5
DEBOUNCE_MS = 480_000
COALESCE_MS = 1_200_000


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among the session's scratch tables."""
    return f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _notices(rows: DataFrame) -> DataFrame:
    """Events as notices: every 211th affects everything, every fourth takes its id out."""
    key = F.col("event_id")
    return rows.select(
        (F.col("user_id") % CHANNELS).cast("string").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.when(key % 211 != 0, (key % 10).cast("string")).alias("id"), F.when(key % 4 == 0, "delete").otherwise("modify").alias("kind")
    )


def _flat(flushed: DataFrame) -> DataFrame:
    return flushed.select("channel", F.unix_micros("flushed").alias("flushed"), "notices", "everything", F.array_join("changed", ",").alias("changed"), F.array_join("removed", ",").alias("removed"))


NOTICES_SQL = f"""
n AS (SELECT DISTINCT (user_id % {CHANNELS})::VARCHAR AS channel, epoch_us(ts) AS ts, CASE WHEN event_id % 211 <> 0 THEN (event_id % 10)::VARCHAR END AS id, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'modify' END AS kind FROM events)"""

FLUSHED_SQL = """
l AS (SELECT channel, due, id, arg_max(kind, (ts, kind)) AS kind, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT channel, due AS flushed, sum(n)::BIGINT AS notices, bool_or(id IS NULL) AS everything, coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind <> 'delete'), '') AS changed, coalesce(string_agg(id, ',' ORDER BY id) FILTER (kind = 'delete'), '') AS removed FROM l GROUP BY ALL)
SELECT channel, flushed, notices, everything, CASE WHEN everything THEN '' ELSE changed END AS changed, CASE WHEN everything THEN '' ELSE removed END AS removed FROM f"""

DEBOUNCED_SQL = f"""
WITH {NOTICES_SQL},
o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < {DEBOUNCE_MS * 1000} THEN 0 ELSE 1 END AS starts FROM n WINDOW w AS (PARTITION BY channel ORDER BY ts, id NULLS FIRST, kind)),
b AS (SELECT *, sum(starts) OVER (PARTITION BY channel ORDER BY ts, id NULLS FIRST, kind ROWS UNBOUNDED PRECEDING) AS k FROM o),
g AS (SELECT *, max(ts) OVER (PARTITION BY channel, k) + {DEBOUNCE_MS * 1000} AS due FROM b),{FLUSHED_SQL}"""

COALESCED_SQL = f"""
WITH RECURSIVE {NOTICES_SQL},
s AS (SELECT channel, min(ts) AS start FROM n GROUP BY channel
      UNION ALL SELECT s.channel, (SELECT min(ts) FROM n WHERE n.channel = s.channel AND n.ts >= s.start + {COALESCE_MS * 1000}) AS start FROM s WHERE s.start IS NOT NULL),
g AS (SELECT n.*, s.start + {COALESCE_MS * 1000} AS due FROM n ASOF JOIN (SELECT * FROM s WHERE start IS NOT NULL) s ON n.channel = s.channel AND n.ts >= s.start),{FLUSHED_SQL}"""

PASSED_SQL = " WHERE flushed <= (SELECT epoch_us(max(ts)) FROM events) - 3600000000"


@query("batch_debounce", DEBOUNCED_SQL)
def batch_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(bursts.debounced(_notices(table(spark, sf_dir, "events")), DEBOUNCE_MS))


@query("stream_debounce", DEBOUNCED_SQL + PASSED_SQL)
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flushes that the watermark has passed, an hour behind the last event."""
    return _flat(events.run_available(bursts.debounce(_notices(events.read_events(spark, sf_dir)), DEBOUNCE_MS, "1 hour"), "debounce"))


@query("stream_coalesce", COALESCED_SQL + PASSED_SQL)
def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events.run_available(bursts.coalesce(_notices(events.read_events(spark, sf_dir)), COALESCE_MS, "1 hour"), "coalesce"))


USERS_SQL = """
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id)
SELECT user_id, event_id, event_type, value FROM l WHERE event_type <> 'error'
"""
USERS = "user_id bigint, event_id bigint, event_type string, value double"


def _users(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))


@query("bucket_upserts", USERS_SQL)
def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, from three arrivals of events of which the second comes twice; an error takes the user out."""
    rows = table(spark, sf_dir, "events")
    kept = buckets.BucketTable(spark, _folder(spark, "users"), USERS, "user_id", 16)
    cut = [r[0] for r in rows.agg(F.percentile_approx("event_id", [0.4, 0.7]).alias("c")).select(F.explode("c")).collect()]
    parts = [F.col("event_id") <= cut[0], (F.col("event_id") > cut[0]) & (F.col("event_id") <= cut[1]), F.col("event_id") > cut[1]]
    for number in (0, 1, 1, 2):
        kept.apply(_users(rows.filter(parts[number])), number, F.col("event_id"), "gone")
    return kept.read()


@query("stream_upserts", USERS_SQL)
def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream; what it applies twice changes nothing."""
    kept = buckets.BucketTable(spark, _folder(spark, "users"), USERS, "user_id", 16)
    for checkpoint in (_folder(spark, "check"), _folder(spark, "check")):  # the second run has lost its checkpoint and replays all
        buckets.drain_into(_users(events.read_events(spark, sf_dir)), kept, checkpoint, F.col("event_id"), "gone")
    return kept.read()


VERSIONS_SQL = """
WITH v AS (SELECT 0 AS b, l_orderkey AS note, false AS gone, l_partkey || '/' || l_quantity::INT AS key FROM lineitem WHERE l_linenumber <= 3
  UNION ALL SELECT 1, l_orderkey, false, l_partkey || '/' || l_quantity::INT FROM lineitem WHERE l_orderkey % 7 = 0
  UNION ALL SELECT 2, l_orderkey, true, NULL FROM lineitem WHERE l_orderkey % 11 = 0
  UNION ALL SELECT 3, l_orderkey, false, CASE WHEN l_linenumber >= 2 THEN l_partkey || '/' || l_quantity::INT END FROM lineitem WHERE l_orderkey % 13 = 0),
o AS (SELECT note, max(b) AS b FROM v GROUP BY note),
m AS (SELECT key, v.note, count(*) FILTER (v.b = o.b) AS times FROM v JOIN o USING (note) WHERE key IS NOT NULL GROUP BY key, v.note)
SELECT key, count(*) FILTER (times > 0) AS n_notes, sum(times)::BIGINT AS n_mentions, count(*) FILTER (times > 0) = 0 AS orphan FROM m GROUP BY key
"""


def note_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders as notes that name their parts: all, some changed, some deleted, some cut down."""
    key = F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_quantity").cast("int").cast("string"))
    lines = table(spark, sf_dir, "lineitem")

    def notes(rows: DataFrame, mentioned, gone: bool = False) -> DataFrame:
        return rows.groupBy(F.col("l_orderkey").alias("note")).agg(F.collect_list(F.when(mentioned, key)).alias("keys")).withColumn("deleted", F.lit(gone))

    every = F.lit(True)
    return [
        notes(lines.filter("l_linenumber <= 3"), every), notes(lines.filter("l_orderkey % 7 = 0"), every),
        notes(lines.filter("l_orderkey % 11 = 0"), every, gone=True), notes(lines.filter("l_orderkey % 13 = 0"), F.col("l_linenumber") >= 2),
    ]


@query("kept_counts", VERSIONS_SQL)
def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and orphans of the keys that notes name, kept up to date by three batches of changed notes."""
    view = buckets.CountView(spark, _folder(spark, "counts"), buckets=32)
    for number, batch in enumerate(note_batches(spark, sf_dir)):
        view.apply(batch, number)
    return view.read()


@query("rebuilt_counts", VERSIONS_SQL)
def rebuilt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.rebuilt(note_batches(spark, sf_dir))


PAGE, CITED_CAP = 4, 10
WORKS_SQL = f"""
SELECT 'c' || o_custkey AS seed, 'forward' AS direction, place::INT AS place, 'W' || o_orderkey AS work, '10.1000/o' || o_orderkey AS doi, o_orderpriority AS title, year(o_orderdate)::INT AS year, 'article' AS kind, 0::BIGINT AS cited_by, (o_orderkey + 1)::VARCHAR AS pmid
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place < {CITED_CAP}
"""


def _recorded(spark: SparkSession, sf_dir: str) -> str:
    """Orders of each customer as citing works, recorded in pages of four."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), key.cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.1000/O"), key.cast("string")).alias("doi"), F.col("o_orderpriority").alias("display_name"), F.year("o_orderdate").alias("publication_year"),
        F.lit("article").alias("type"), F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (key + 1).cast("string")).alias("pmid")).alias("ids"),
    )
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    seed = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(seed.alias("seed"), "o_custkey", place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("n"), work.alias("work"))
    paged = rows.groupBy("seed", "n", F.floor(F.col("place") / PAGE).cast("int").alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "work"))), lambda x: x["work"]).alias("results"))
    cursor = lambda page: F.concat(F.lit("p"), page.cast("string"))
    after = F.when((F.col("page") + 1) * PAGE < F.col("n"), cursor(F.col("page") + 1))
    answer = F.to_json(F.struct(F.struct(F.col("n").alias("count"), after.alias("next_cursor")).alias("meta"), "results"))
    path = _folder(spark, "pages")
    cited.record_pages(paged.select("seed", F.lit("forward").alias("direction"), "page", F.when(F.col("page") == 0, cited.FIRST_CURSOR).otherwise(cursor(F.col("page"))).alias("cursor"), answer.alias("json")), path)
    return path


@query("cited_works", WORKS_SQL)
def cited_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of every seed, read along the cursors of its pages, ten at most."""
    return cited.parsed_works(cited.read_works(spark, _recorded(spark, sf_dir), CITED_CAP))


@query("stream_cited_works", WORKS_SQL)
def stream_cited_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream of pages."""
    return cited.parsed_works(events.run_available(cited.read_works(spark, _recorded(spark, sf_dir), CITED_CAP, streaming=True), "works"))


@query("cited_reports", f"""
SELECT 'c' || o_custkey AS seed, 'forward' AS direction, least(count(*), {CITED_CAP})::BIGINT AS works, count(*) AS total, count(*) > {CITED_CAP} AS capped FROM orders GROUP BY o_custkey
""")
def cited_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cited.list_reports(cited.read_works(spark, _recorded(spark, sf_dir), CITED_CAP), CITED_CAP)


@query("seed_addresses", f"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'https://api.example.org/works/doi:10.1000/s' || s_suppkey || '?select={cited.SEED_FIELDS}' WHEN s_suppkey % 3 = 1 THEN 'https://api.example.org/works/pmid:' || (s_suppkey + 100) || '?select={cited.SEED_FIELDS}' END AS seed,
       'https://api.example.org/works?filter=' || CASE WHEN s_suppkey % 2 = 0 THEN 'cites' ELSE 'cited_by' END || ':W' || s_suppkey || '&select={cited.WORK_FIELDS}&sort=cited_by_count:desc&per-page=200&cursor=' || CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE 'c%3D' || s_nationkey END || '&mailto=s' || s_suppkey || '@example.org' AS list FROM supplier
""")
def seed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of seeds' records and of the pages of their lists."""
    key = F.col("s_suppkey")
    doi = F.when(key % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/S"), key.cast("string")))
    pmid = F.when(key % 3 == 1, F.concat(F.lit("PMID: "), (key + 100).cast("string")))
    cursor = F.when(key % 5 != 0, F.concat(F.lit("c="), F.col("s_nationkey").cast("string")))
    base, email = "https://api.example.org", F.concat(F.lit("s"), key.cast("string"), F.lit("@example.org"))
    direction = F.when(key % 2 == 0, "forward").otherwise("backward")
    return table(spark, sf_dir, "supplier").select(key.alias("id"), cited.seed_address(base, doi, pmid).alias("seed"), cited.list_address(base, F.concat(F.lit("W"), key.cast("string")), direction, cursor, email=email).alias("list"))
