"""Queries of facets, routing and the rule language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.rules import compile_rule
from vellum.operators import facets, routing
from vellum.plans.registry import query
from vellum.session import table

STATUSES = ["F", "O", "P"]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes: status, collections from priority and segment, one day added."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    groups = F.when(F.col("o_orderkey") % 8 == 0, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment", "o_orderpriority"))
    return joined.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), groups.alias("groups"), "o_orderdate", "o_totalprice", "c_mktsegment")


NOTES_SQL = """
WITH notes AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate, o_totalprice, c_mktsegment,
         CASE WHEN o_orderkey % 8 = 0 OR c_mktsegment IS NULL AND o_orderpriority IS NULL THEN ['(none)']
              ELSE list_filter([c_mktsegment, o_orderpriority], lambda x: x IS NOT NULL) END AS groups
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


@query("facet_counts", NOTES_SQL + """
, c AS (SELECT value, count(*) AS n FROM (SELECT unnest(groups) AS value FROM notes) GROUP BY value)
SELECT value, n, row_number() OVER (ORDER BY value = '(none)', n DESC, value) AS place FROM c
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.ranked_counts(facets.count_by(notes(spark, sf_dir), facets.values_of(F.col("groups"))))


@query("facet_fixed_domain", """
WITH c AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT unnest(['purchase', 'refund', 'view']) AS value, unnest([0, 1, 2]) AS place)
SELECT coalesce(d.value, c.value) AS value, coalesce(n, 0) AS n, coalesce(place, 3) AS place FROM d FULL JOIN c ON d.value = c.value
""")
def facet_fixed_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = facets.count_by(table(spark, sf_dir, "events"), facets.values_of(F.array("event_type")))
    return facets.fixed_domain(counts, ["purchase", "refund", "view"])


@query("status_pivot", NOTES_SQL + """
, e AS (SELECT unnest(groups) AS name, status FROM notes)
SELECT name, count(*) AS total, count(*) FILTER (status = 'F') AS done, count(*) FILTER (status = 'F') AS "n_F",
       count(*) FILTER (status = 'O') AS "n_O", count(*) FILTER (status = 'P') AS "n_P",
       floor(count(*) FILTER (status = 'F') * 100.0 / count(*) + 0.5)::BIGINT AS done_percent
FROM e GROUP BY name
""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.status_pivot(notes(spark, sf_dir), facets.values_of(F.col("groups")), F.col("status"), STATUSES, ["F"])


@query("top_unread", NOTES_SQL + """
, o AS (SELECT id, o_orderdate, o_totalprice FROM notes WHERE status = 'O')
SELECT id, o_orderdate, (SELECT greatest(count(*) - 10, 0) FROM o) AS more FROM o ORDER BY o_orderdate, id LIMIT 10
""")
def top_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = notes(spark, sf_dir).filter("status = 'O'").select("id", "o_orderdate")
    return facets.top_with_tail(unread, 10, F.col("o_orderdate"), F.col("id"))


@query("facet_bundle", NOTES_SQL + """
, e AS (SELECT 'status' AS facet, status AS value FROM notes
        UNION ALL SELECT 'group', unnest(groups) FROM notes
        UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR FROM notes)
SELECT facet, value, count(*) AS n FROM e GROUP BY ALL
""")
def facet_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_bundle(
        notes(spark, sf_dir),
        {"status": facets.values_of(F.array("status")), "group": facets.values_of(F.col("groups")), "year": facets.values_of(F.array(F.year("o_orderdate").cast("string")))},
    )


RULES = [
    {"name": "off", "library": "*", "database": "x", "enabled": False},
    {"name": "build", "library": "BUILDING", "collection": "rich", "database": "d1"},
    {"name": "auto", "library": "AUTOMOBILE", "collection": "", "folder": "cars"},
    {"name": "poor", "library": "*", "collection": "/poor/", "database": "d2", "folder": "low"},
]


@query("first_match_route", """
SELECT c_custkey AS id,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 THEN 'build' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'auto'
       WHEN c_acctbal < 0 THEN 'poor' ELSE '' END AS rule,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 THEN 'd1' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'main'
       WHEN c_acctbal < 0 THEN 'd2' ELSE 'main' END AS database,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal >= 5000 THEN '' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'cars'
       WHEN c_acctbal < 0 THEN 'low' ELSE '' END AS folder
FROM customer
""")
def first_match_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("c_acctbal") < 0, "poor/debt").when(F.col("c_acctbal") >= 5000, "rich").otherwise("middle")
    found = routing.first_match(RULES, F.col("c_mktsegment"), F.array(band), {"database": "main"}, ("database", "folder"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), found.alias("r")).select("id", "r.*")


@query("classify_parts", """
SELECT p_partkey AS id, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN regexp_matches(p_name, '(?i)\\bred\\b') THEN 'red' WHEN p_size > 0 AND regexp_matches(p_type, '^(STANDARD|PROMO)') THEN 'plain' END AS class
FROM part
""")
def classify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = routing.classify_first(F.col("p_type"), [("brass", "BRASS")])
    by_name = routing.classify_first(F.col("p_name"), [("red", r"(?i)\bred\b")])
    plain = routing.classify_first(F.col("p_type"), [("plain", "^(STANDARD|PROMO)")])
    found = routing.layered((by_type, "type"), (by_name, "name"), (plain, "type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), found["value"].alias("class"))


PART_RULES = {
    "rule_filter_text": ('"the" AND NOT ciónez OR type:fr', "(contains(lower(text), 'the') AND NOT contains(lower(text), 'ciónez')) OR lower(lang) = 'fr'"),
    "rule_filter_tag": ("(tag:src1* OR author:SRC7) year>=2005", "(starts_with(source, 'src1') OR source = 'src7') AND 2000 + doc_id % 20 >= 2005 AND doc_id % 9 > 0"),
    "rule_filter_not_year": ("NOT year:2003-2001 language:en", "NOT (doc_id % 9 > 0 AND 2000 + doc_id % 20 BETWEEN 2001 AND 2003) AND lang = 'en'"),
}


def _rule_query(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        year = F.when(F.col("doc_id") % 9 > 0, (2000 + F.col("doc_id") % 20).cast("string"))
        columns = {"abstract": F.col("text"), "type": F.col("lang"), "language": F.col("lang"), "tag": F.array("source"), "author": F.array("source"), "year": year}
        return docs.filter(compile_rule(rule, columns)).select("doc_id")

    return run


for _name, (_rule, _where) in PART_RULES.items():
    query(_name, f"SELECT doc_id FROM documents WHERE {_where}")(_rule_query(_rule))
