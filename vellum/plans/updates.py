"""Queries of state that changes from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import updates
from vellum.plans.registry import query
from vellum.session import table


@query("last_messages", "SELECT event_id, user_id FROM (SELECT * FROM events WHERE event_type = 'click' AND user_id % 3 = 0 ORDER BY event_id DESC LIMIT 20)")
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return updates.last_matching(events, (F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), "event_id", 20).select("event_id", "user_id")


@query("all_match", "SELECT o_custkey, coalesce(bool_and(o_orderstatus = 'F') FILTER (o_orderkey % 5 > 0), false) AS all_match FROM orders GROUP BY o_custkey")
def all_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom every order with a status has the same one."""
    return updates.all_match(table(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), "F", "o_custkey")


@query("meaning_groups", """
SELECT source, CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS place, CASE lang WHEN 'fr' THEN 'method' WHEN 'en' THEN 'result' ELSE 'other' END AS meaning, count(*) AS marks FROM documents GROUP BY ALL
""")
def meaning_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.meaning_groups(table(spark, sf_dir, "documents").select("source", F.upper("lang").alias("color")), [("fr", "method"), ("EN", "result")], "color", "source")


@query("preset_differences", """
WITH c AS (SELECT count(*) FILTER ((p_size % 2 = 0) <> (p_partkey % 2 = 0)) AS a, count(*) FILTER ((p_size % 2 = 0) <> (p_brand < 'Brand#3')) AS b FROM part)
SELECT 'guided' AS preset, a AS differs, a <= b AS nearest FROM c UNION ALL SELECT 'advanced', b, b < a FROM c
""")
def preset_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    switches = table(spark, sf_dir, "part").selectExpr("p_size % 2 = 0 AS value", "p_partkey % 2 = 0 AS guided", "p_brand < 'Brand#3' AS advanced")
    return updates.preset_differences(switches, "value", ["guided", "advanced"])


@query("pending_failures", """
WITH p AS (SELECT l_orderkey AS ref, l_returnflag AS target, CASE WHEN l_linestatus = 'F' THEN 'all' ELSE 'missing' END AS action FROM lineitem)
SELECT ref, string_agg(DISTINCT target, ',' ORDER BY target) AS targets, CASE WHEN min(action) = max(action) THEN min(action) ELSE 'missing' END AS action FROM p GROUP BY ref
""")
def pending_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_orderkey").alias("ref"), F.array("l_returnflag").alias("targets"), F.when(F.col("l_linestatus") == "F", "all").otherwise("missing").alias("action"))
    merged = updates.merge_failures(rows.filter("l_linenumber <= 2"), rows.filter("l_linenumber > 2"))
    return merged.withColumn("targets", F.array_join("targets", ","))


@query("digest_merge", """
WITH old AS (SELECT event_type AS name, user_id AS pmid, event_id FROM events WHERE event_id % 10 = 0),
new AS (SELECT event_type AS name, user_id * 2 AS pmid, event_id, row_number() OVER (PARTITION BY user_id * 2 ORDER BY event_id, event_type) AS n FROM events WHERE event_id % 10 > 0)
SELECT name, pmid, event_id, false AS new FROM old UNION ALL SELECT name, pmid, event_id, true FROM new WHERE n = 1 AND pmid NOT IN (SELECT pmid FROM old)
""")
def digest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    listed = events.filter("event_id % 10 = 0").select(F.col("event_type").alias("name"), F.col("user_id").alias("pmid"), "event_id")
    found = events.filter("event_id % 10 > 0").select(F.col("event_type").alias("name"), (F.col("user_id") * 2).alias("pmid"), "event_id")
    return updates.merge_digest(listed, found, "pmid", "name", "event_id")


@query("stale_files", """
WITH f AS (SELECT lpad(l_orderkey::VARCHAR, 8, '0') AS owner, lpad(l_partkey::VARCHAR, 8, '0') AS part, l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber <> 3),
k AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT owner || '-' || part || '.png' AS file, owner, part FROM f WHERE o IN (SELECT o FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.o = f.o AND k.p = f.p)
""")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    key = lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    files = lines.select(F.concat(key("l_orderkey"), F.lit("-"), key("l_partkey"), F.when(F.col("l_linenumber") == 3, ".jpg").otherwise(".png")).alias("file"))
    return updates.stale_files(files, lines.filter("l_linenumber % 2 = 0").select(key("l_orderkey").alias("owner"), key("l_partkey").alias("part")))


UNDO_SQL = """
WITH m AS (SELECT 'n' || c_nationkey AS container, c_custkey AS item, c_nationkey AS k FROM customer), left_ AS (SELECT * FROM m WHERE NOT (item % 2 = 0 OR k < 10)),
n AS (SELECT 'n' || n_nationkey AS key, n_regionkey AS r, n_nationkey < 12 AS made, 'n' || n_nationkey IN (SELECT container FROM left_) AS filled FROM nation)
"""


def _undo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers filed under nations, nations under regions; a run filed some and made some containers."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), (F.col("n_nationkey") < 12).alias("made"))
    tree = tree.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(True).alias("made")))
    filed = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("container"), F.col("c_custkey").alias("item"), "c_nationkey")
    return updates.undo(filed.select("container", "item"), filed.filter("item % 2 = 0 OR c_nationkey < 10"), tree.filter("made"), tree.select("key", "parent"))


@query("undo_memberships", UNDO_SQL + "SELECT container, item FROM left_")
def undo_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undo(spark, sf_dir)[0]


@query("undo_containers", UNDO_SQL + """
SELECT key, NOT filled AS deleted FROM n WHERE made UNION ALL SELECT 'r' || r_regionkey, coalesce(bool_and(made AND NOT filled), true) FROM region LEFT JOIN n ON r = r_regionkey GROUP BY r_regionkey
""")
def undo_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _undo(spark, sf_dir)[1]


@query("tombstones", """
WITH n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'deleted' ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS before,
                  CASE WHEN c_custkey % 4 = 0 THEN '2026-01-01' END AS deleted_at, c_custkey % 6 = 0 AS gone FROM customer)
SELECT key, CASE WHEN gone THEN 'deleted' WHEN deleted_at IS NOT NULL THEN before ELSE status END AS status,
       CASE WHEN gone AND deleted_at IS NOT NULL THEN before WHEN gone THEN status END AS before, CASE WHEN gone THEN coalesce(deleted_at, '2026-10-01') END AS deleted_at FROM n
""")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "CASE WHEN c_custkey % 4 = 0 THEN 'deleted' ELSE c_mktsegment END AS status", "CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS before", "CASE WHEN c_custkey % 4 = 0 THEN '2026-01-01' END AS deleted_at"
    )
    return updates.tombstones(notes, notes.filter("key % 6 = 0"), F.lit("2026-10-01"))


@query("ticked_links", """
WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1000/o' || (o_orderkey % 50) WHEN o_orderkey % 3 = 1 THEN 'pmid:' || (o_orderkey % 50) END AS key FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, min(o_orderkey) AS o_orderkey, key, 'T*' || min(o_orderkey) AS title FROM l WHERE key IS NOT NULL GROUP BY o_custkey, key
""")
def ticked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('[a](https://doi.org/10.1000/O', o_orderkey % 50, ').') WHEN o_orderkey % 3 = 1 THEN concat('https://pubmed.ncbi.nlm.nih.gov/', o_orderkey % 50, '/') ELSE 'no link' END")
    line = F.concat(F.when(F.col("o_orderstatus") == "F", "  - [x] **").otherwise("- [ ] **"), F.lit(r"T\*"), F.col("o_orderkey").cast("string"), F.lit("** "), link)
    return updates.ticked(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", line.alias("line")), "o_custkey", "o_orderkey")


@query("batch_outcomes", """
WITH r AS (SELECT l_orderkey AS ref, bool_or(l_returnflag = 'N') AS ok FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
SELECT o_orderkey AS ref, CASE WHEN o_custkey % 4 = 0 THEN 'gone' WHEN o_orderstatus = 'P' THEN 'skipped' WHEN ok THEN 'ok' WHEN ok IS NOT NULL THEN 'failed' ELSE 'missing' END AS outcome
FROM orders LEFT JOIN r ON o_orderkey = ref
""")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    results = table(spark, sf_dir, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("ref"), F.when(F.col("l_returnflag") == "N", "succeeded").otherwise("errored").alias("type"))
    requests = orders.select(F.col("o_orderkey").alias("ref"), (F.col("o_orderstatus") == "P").alias("done"))
    return updates.settled(requests, results, orders.filter("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("ref")))


@query("source_order", """
WITH s AS (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'any' END AS lang FROM nation)
SELECT n_nationkey, lang, row_number() OVER (ORDER BY CASE lang WHEN 'zh' THEN 0 WHEN 'any' THEN 1 ELSE 2 END, n_nationkey)::INT AS place FROM s
""")
def source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "CASE n_regionkey WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'any' END AS lang")
    return updates.by_language(sources, F.lit(True), "n_nationkey")


@query("list_numbers", """
WITH RECURSIVE i AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS pos, l_linenumber AS number, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem),
r AS (
  SELECT l_suppkey, pos, number, k, 0::BIGINT AS off, number::BIGINT AS n FROM i WHERE k = 1
  UNION ALL
  SELECT i.l_suppkey, i.pos, i.number, i.k, CASE WHEN i.number <= r.number THEN r.n WHEN r.off <> 0 AND i.number IN (r.n, r.n + 1) THEN 0 ELSE r.off END,
         i.number + CASE WHEN i.number <= r.number THEN r.n WHEN r.off <> 0 AND i.number IN (r.n, r.n + 1) THEN 0 ELSE r.off END
  FROM r JOIN i ON i.l_suppkey = r.l_suppkey AND i.k = r.k + 1)
SELECT l_suppkey, pos, number, '' AS letter, n FROM r
""")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lists that start again with every order of a supplier; each depends on the row before."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_linenumber").alias("number"), F.lit("").alias("letter"))
    return updates.numbered(items, "l_suppkey", "pos")


@query("budget_picks", """
WITH RECURSIVE i AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
r AS (
  SELECT source, doc_id, size, k, coalesce(size <= 20000, false) AS taken, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used, CASE WHEN size <= 20000 THEN 1 ELSE 0 END AS n FROM i WHERE k = 1
  UNION ALL
  SELECT source, doc_id, size, k, t, used + CASE WHEN t THEN size ELSE 0 END, n + t::INT
  FROM (SELECT i.source, i.doc_id, i.size, i.k, r.used, r.n, coalesce(r.n < 20 AND i.size <= 20000 AND r.used + i.size <= 60000, false) AS t FROM r JOIN i ON i.source = r.source AND i.k = r.k + 1))
SELECT source, doc_id, coalesce(size, 20001)::BIGINT AS size, taken FROM r
""")
def budget_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source taken in turn under three limits; what does not fit is passed over."""
    entries = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return updates.within_budget(entries, "source", "doc_id", 20, 20_000, 60_000)
