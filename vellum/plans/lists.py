"""Queries of ordered lists, trees, plans and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import lists, reports
from vellum.plans.registry import query
from vellum.session import table


@query("round_robin_top", """
WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS round FROM customer)
SELECT * FROM r WHERE round <= 12 ORDER BY round, c_mktsegment LIMIT 12
""")
def round_robin_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.round_robin(table(spark, sf_dir, "customer"), "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")], 12).select("c_mktsegment", "c_custkey", "round")


#: A conversation as a note: every fifth turn is a heading, the others are check boxes.
LINE = "CASE WHEN turn % 5 = 0 THEN '## Part ' || turn ELSE CASE WHEN turn % 2 = 0 THEN '- [x] ' ELSE '- [ ] ' END || role END"


@query("digest_counts", """
WITH h AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN 'Part ' || turn END AS own FROM conversations),
a AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM h)
SELECT heading, count(*) AS items, count(*) FILTER (turn % 2 = 0) AS ticked FROM a WHERE own IS NULL GROUP BY heading
""")
def digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(LINE).alias("line"))
    return lists.checklist_counts(lists.under_headings(notes, "conv_id", "turn", F.col("line")), F.col("line"), "heading")


@query("unique_names", """
WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS n FROM r)
SELECT id, CASE WHEN n = 1 THEN name ELSE name || ' ' || n END AS file FROM n
""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return lists.unique_names(rows, "name", "id").select("id", "file")


@query("collection_subtree", """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS key, 'top' AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
                     UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
s AS (SELECT key, name AS path, 0 AS level FROM e WHERE key = 'r1' UNION ALL SELECT e.key, s.path || '/' || e.name, s.level + 1 FROM e JOIN s ON e.parent = s.key)
SELECT key, path, level FROM s
""")
def collection_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    tag = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = region.select(tag("r", "r_regionkey").alias("key"), F.lit("top").alias("parent"), F.col("r_name").alias("name"))
    edges = edges.unionByName(nation.select(tag("n", "n_nationkey").alias("key"), tag("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    edges = edges.unionByName(supplier.select(tag("s", "s_suppkey").alias("key"), tag("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name")))
    return lists.descendants(edges, "r1")


@query("top_level_items", """
WITH i AS (SELECT o_orderkey AS id, NULL::BIGINT AS parent, o_orderstatus = 'P' AS deleted FROM orders UNION ALL SELECT l_orderkey * 10 + l_linenumber + 1000000000, l_orderkey, false FROM lineitem),
s AS (SELECT DISTINCT coalesce(parent, id) AS id FROM i WHERE id > 1000000000)
SELECT id FROM s WHERE id IN (SELECT id FROM i WHERE parent IS NULL AND NOT deleted)
""")
def top_level_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent"), (F.col("o_orderstatus") == "P").alias("deleted"))
    children = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1000000000).alias("id"), F.col("l_orderkey").alias("parent"), F.lit(False).alias("deleted"))
    return lists.top_level(top.unionByName(children), children.select("id"))


@query("aligned_answers", """
WITH c AS (SELECT r_name AS item, r_regionkey AS pos FROM region), a AS (SELECT s_nationkey AS study, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
b AS (SELECT a.study, a.pos, CASE a.s_suppkey % 3 WHEN 0 THEN 'ASIA' WHEN 1 THEN 'EUROPE' ELSE 'X' END AS item, s_suppkey AS answer, count(*) OVER (PARTITION BY study) AS n FROM a)
SELECT study, c.item, answer FROM b JOIN c ON CASE WHEN n = (SELECT count(*) FROM c) THEN b.pos = c.pos ELSE b.item = c.item END
""")
def aligned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    catalog = table(spark, sf_dir, "region").select(F.col("r_name").alias("item"), F.col("r_regionkey").alias("pos"))
    pos = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    item = F.when(F.col("s_suppkey") % 3 == 0, "ASIA").when(F.col("s_suppkey") % 3 == 1, "EUROPE").otherwise("X")
    answers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("study"), pos.alias("pos"), item.alias("item"), F.col("s_suppkey").alias("answer"))
    return lists.aligned(answers, catalog, "study")


@query("match_by_any", """
SELECT DISTINCT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal) = floor(s_acctbal)
UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON floor(c_acctbal / 10) = floor(s_acctbal / 10) AND c_nationkey = s_nationkey
""")
def match_by_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda nation, balance, width: F.concat_ws("|", F.col(nation).cast("string"), F.floor(F.col(balance) / width).cast("string"))
    left = table(spark, sf_dir, "customer").select("c_custkey", band("c_nationkey", "c_acctbal", 1).alias("a"), F.array(band("c_nationkey", "c_acctbal", 10)).alias("b"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", band("s_nationkey", "s_acctbal", 1).alias("c"), band("s_nationkey", "s_acctbal", 10).alias("d"))
    return lists.match_any(left, right, [("a", "c"), ("b", "d")], ("c_custkey", "s_suppkey"))


@query("plan_memberships", """
WITH w AS (SELECT DISTINCT p_brand AS container, l_orderkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
h AS (SELECT DISTINCT p_brand AS container, l_orderkey AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' AND p_size < 26 AND p_brand < 'Brand#41')
SELECT container, count(*) FILTER (h.item IS NULL) AS adds, count(*) FILTER (h.item IS NOT NULL) AS already, container NOT IN (SELECT container FROM h) AS new FROM w LEFT JOIN h USING (container, item) GROUP BY container
""")
def plan_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumns({"container": F.col("p_brand"), "item": F.col("l_orderkey")})
    return lists.plan_memberships(joined.filter("l_returnflag = 'R'").select("container", "item"), joined.filter("l_linestatus = 'F' AND p_size < 26 AND p_brand < 'Brand#41'").select("container", "item"))


@query("carried_goals", """
WITH b AS (SELECT event_type AS goal, max(event_id % 7 = 0) AS ticked FROM events WHERE user_id % 2 = 0 GROUP BY 1), n AS (SELECT DISTINCT event_type || CASE WHEN event_id % 50 = 0 THEN '!' ELSE '' END AS goal FROM events)
SELECT n.goal, coalesce(b.ticked, false) AS ticked FROM n LEFT JOIN b USING (goal)
""")
def carried_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.select(F.concat("event_type", F.when(F.col("event_id") % 50 == 0, "!").otherwise("")).alias("goal")).distinct().withColumn("ticked", F.lit(False))
    return lists.carried_over(now, e.filter("user_id % 2 = 0").select(F.col("event_type").alias("goal"), (F.col("event_id") % 7 == 0).alias("ticked")), "goal", "ticked")


@query("shared_values", """
SELECT lang AS dimension, lower(trim(v)) AS key, arg_min(trim(v), doc_id) AS value, count(DISTINCT doc_id) AS items, count(DISTINCT doc_id) >= 40 AS shared
FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN upper(source) || ' ' ELSE source END AS v FROM documents) GROUP BY 1, 2
""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("source"), F.lit(" "))).otherwise(F.col("source"))
    return lists.shared_values(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dimension"), value.alias("v")), "dimension", "v", "doc_id", 40)


@query("evidence_summary", """
WITH r AS (SELECT p_type AS design, CASE WHEN p_size % 5 > 0 THEN p_size END AS n FROM part)
SELECT design, count(*) AS studies, coalesce(sum(n) FILTER (design < 'PROMO'), 0)::BIGINT AS participants, count(*) FILTER (design < 'PROMO' AND n IS NULL) AS without_n FROM r GROUP BY design
""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("design"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).alias("n"))
    primary = [r["design"] for r in rows.select("design").distinct().filter("design < 'PROMO'").collect()]  # the few designs there are
    return reports.evidence_summary(rows, primary)


@query("appraisal_readiness", """
WITH c AS (SELECT r_name AS item FROM region WHERE r_name <> 'ASIA'), a AS (SELECT DISTINCT n_name AS item, s_nationkey % 7 AS study FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT * FROM (SELECT DISTINCT s_suppkey % 40 AS study FROM supplier), c),
b AS (SELECT DISTINCT s_suppkey % 40 AS study, r_name AS item FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT g.study, count(*) FILTER (b.item IS NULL) AS missing, count(*) FILTER (b.item IS NULL) = 0 AS ready FROM g LEFT JOIN b ON g.study = b.study AND g.item = b.item GROUP BY g.study
""")
def appraisal_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    catalog = region.select(F.col("r_name").alias("item"), (F.col("r_name") == "ASIA").alias("open"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return reports.readiness(catalog, joined.select((F.col("s_suppkey") % 40).alias("study"), F.col("r_name").alias("item"), F.lit("yes").alias("answer")))


@query("status_views", """
SELECT 'open' AS view, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'dear', o_orderkey FROM orders WHERE o_totalprice > 200000
""")
def status_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved views, read back by name."""
    reports.save_views(spark, table(spark, sf_dir, "orders"), {"vellum_open": {"filter": "o_orderstatus = 'O'", "columns": ["o_orderkey"]}, "vellum_dear": {"filter": "o_totalprice > 200000", "columns": ["o_orderkey"], "order": ["o_totalprice"]}})
    part = lambda name: spark.table(f"vellum_{name}").select(F.lit(name).alias("view"), F.col("o_orderkey").alias("id"))
    return part("open").unionByName(part("dear"))


@query("unfiled_count", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def unfiled_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a parent that no child of a kind refers to: inner join and anti-join."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    children = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return orders.join(children, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
