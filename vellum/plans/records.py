"""Queries of duplicates, look-ups, concept graphs and citation candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.identifiers import normalize_title
from vellum.operators import dedup, graph
from vellum.plans.registry import query
from vellum.session import table
from vellum.storage import store


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: some share a made-up DOI, titles are the first sentence, years go by source."""
    docs = table(spark, sf_dir, "documents")
    doi = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), F.floor(F.col("doc_id") / 15).cast("string")))
    return docs.select(
        F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("title"), (2000 + F.length("source")).cast("string").alias("year"), F.lit(None).cast("string").alias("date"), doi.alias("doi"),
        (F.col("doc_id") % 11 == 0).alias("is_duplicate"), (F.col("doc_id") % 3 == 0).alias("screened"), (F.col("n_chars") > 500).alias("has_abstract"), (F.col("n_chars") % 4).alias("attachments"), F.col("lang").alias("date_added"),
    )


RECORDS_SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id AS id, (2000 + length(source))::VARCHAR AS y, CASE WHEN doc_id % 5 = 0 THEN '10.1000/x' || floor(doc_id / 15)::BIGINT END AS doi,
         regexp_replace(lower(strip_accents(split_part(text, '.', 1))), '[^\\p{L}\\p{N}]+', '', 'g') AS t,
         coalesce((doc_id % 11 = 0), false)::INT AS k1, (NOT (doc_id % 3 = 0))::INT AS k2, (doc_id % 5 <> 0)::INT AS k3, (NOT (n_chars > 500))::INT AS k4, -(n_chars % 4) AS k5, lang AS k6
  FROM documents),
b AS (SELECT t, y, count(DISTINCT doi) > 1 AS split, min(id) AS a, min(id) FILTER (doi IS NULL) AS bare FROM r WHERE length(t) >= 10 GROUP BY t, y),
links AS (
  SELECT r.id AS u, m.a AS v FROM r JOIN (SELECT doi, min(id) AS a FROM r WHERE doi IS NOT NULL GROUP BY doi) m USING (doi) WHERE r.id <> m.a
  UNION SELECT r.id, CASE WHEN split THEN bare ELSE a END FROM r JOIN b USING (t, y) WHERE (NOT split OR doi IS NULL) AND r.id <> CASE WHEN split THEN bare ELSE a END),
e AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS id, u AS other FROM e UNION SELECT reach.id, e.v FROM reach JOIN e ON reach.other = e.u),
g AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
"""


@query("dedup_components", RECORDS_SQL + "SELECT id, group_id FROM g")
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(records(spark, sf_dir))


@query("dedup_survivor", RECORDS_SQL + """
, o AS (SELECT id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY k1, k2, k3, k4, k5, k6, id) AS place FROM g JOIN r USING (id))
SELECT id, group_id, place, place = 1 AS keep FROM o
""")
def dedup_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(spark, sf_dir)
    return dedup.survivors(found, store(dedup.duplicate_groups(found), "groups"))


@query("title_keys", """
SELECT doc_id, regexp_replace(lower(strip_accents(split_part(text, '.', 1))), '[^\\p{L}\\p{N}]+', '', 'g') AS title_key FROM documents
""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalize_title(F.substring_index("text", ".", 1)).alias("title_key"))


@query("library_lookup", """
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '10.1000/d' || (o_orderkey % 5000) END AS doi, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 700)::VARCHAR END AS pmid,
                  'orderforcustomer' || (o_custkey % 97) AS t, 1990 + o_orderkey % 9 AS y FROM orders),
l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '10.1000/d' || c_custkey END AS doi, CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 900)::VARCHAR END AS pmid,
             'orderforcustomer' || (c_custkey % 101) AS t, 1990 + c_custkey % 9 AS y FROM customer),
d AS (SELECT doi, min(id) AS hit FROM l WHERE doi IS NOT NULL GROUP BY 1),
p AS (SELECT pmid, min(id) AS hit FROM l WHERE pmid IS NOT NULL GROUP BY 1),
t AS (SELECT t, y, min(id) AS hit, arg_min(coalesce(doi, ''), id) AS hit_doi FROM l GROUP BY 1, 2),
m AS (SELECT c.id, arg_min(t.hit, t.y) AS hit FROM c JOIN t ON c.t = t.t AND t.y BETWEEN c.y - 1 AND c.y + 1 WHERE c.doi IS NULL OR t.hit_doi = '' OR t.hit_doi = c.doi GROUP BY c.id)
SELECT c.id, coalesce(d.hit, p.hit, m.hit) AS match_id, CASE WHEN d.hit IS NOT NULL THEN 'doi' WHEN p.hit IS NOT NULL THEN 'pmid' WHEN m.hit IS NOT NULL THEN 'title' END AS match_by
FROM c LEFT JOIN d USING (doi) LEFT JOIN p USING (pmid) LEFT JOIN m ON c.id = m.id
""")
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shaped(df, key, cust, doi_if, doi, pmid_if, pmid, titles):
        k = F.col(key)
        return df.select(
            k.alias("id"), k.alias("pos"), F.when(doi_if(k), F.concat(F.lit("doi:10.1000/D"), doi(k).cast("string"))).alias("doi"), F.when(pmid_if(k), pmid(k).cast("string")).alias("pmid"),
            F.concat(F.lit("Order for <i>Customer</i> "), (F.col(cust) % titles).cast("string")).alias("title"), (1990 + k % 9).cast("string").alias("year"),
        )

    cand = shaped(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", lambda k: k % 3 == 0, lambda k: k % 5000, lambda k: k % 4 == 0, lambda k: k % 700, 97)
    lib = shaped(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", lambda k: k % 2 == 0, lambda k: k, lambda k: k % 5 == 0, lambda k: k % 900, 101)
    return dedup.library_lookup(cand, lib).select("id", "match_id", "match_by")


@query("unseen_candidates", """
SELECT l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1
""")
def unseen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return dedup.unseen(items, table(spark, sf_dir, "part").filter("p_size < 25").select(F.col("p_partkey").alias("id")))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands as concepts that orders mention."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 3 == 0, F.upper("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("_#")))
    kind = F.element_at(F.array(*map(F.lit, graph.TYPE_ORDER)), (F.col("p_size") % 3 + 1).cast("int"))
    return joined.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("pos"), name.alias("name"), kind.alias("type"))


ALIASES = ["# names of one maker", "Brand_#11 = BRAND#11 = Eleven", "Brand #12 = Brand#13", "broken"]
MENTIONS_SQL = """
WITH m AS (SELECT l_orderkey AS paper, l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN upper(p_brand) ELSE replace(p_brand, '#', '_#') END AS name,
                  CASE p_size % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'measure' ELSE 'outcome' END AS type
           FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT *, trim(regexp_replace(lower(name), '[\\s_-]+', ' ', 'g')) AS own FROM m),
c AS (SELECT *, CASE own WHEN 'brand#11' THEN 'brand #11' WHEN 'brand#13' THEN 'brand #12' ELSE own END AS key,
             CASE WHEN own IN ('brand #11', 'brand#11') THEN 'Brand_#11' WHEN own IN ('brand #12', 'brand#13') THEN 'Brand #12' END AS fixed FROM k)
"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(list(enumerate(ALIASES)), "pos int, line string")
    return graph.resolved(mentions(spark, sf_dir), graph.alias_rows(lines))


@query("concept_nodes", MENTIONS_SQL + """
, s AS (SELECT key, name, count(*) AS n, min(paper * 100 + pos) AS first, max(fixed) AS fixed FROM c GROUP BY 1, 2),
best AS (SELECT key, arg_max(name, n * 1000000000 - first) AS spelling, max(fixed) AS fixed, count(*) AS n_variants FROM s GROUP BY 1),
p AS (SELECT key, count(DISTINCT paper) AS n_papers, list_sort(list(DISTINCT type)) AS kinds FROM c GROUP BY 1)
SELECT key, coalesce(fixed, spelling) AS name, n_papers, n_variants, array_to_string(kinds, ',') AS types FROM p JOIN best USING (key)
""")
def concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.concept_nodes(concepts(spark, sf_dir))


PAIRS_SQL = MENTIONS_SQL + """
, d AS (SELECT DISTINCT paper, key FROM c),
e AS (SELECT x.key AS a, y.key AS b, count(*) AS n FROM d x JOIN d y ON x.paper = y.paper AND x.key < y.key GROUP BY 1, 2)
"""


@query("cooccurrence", PAIRS_SQL + "SELECT a, b, n FROM e")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence(concepts(spark, sf_dir))


@query("top_edges", PAIRS_SQL + """
, f AS (SELECT a AS node, b AS other, n FROM e UNION ALL SELECT b, a, n FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, other) AS place FROM f)
SELECT node, other, n, place FROM r WHERE place <= 10
""")
def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_edges(graph.cooccurrence(concepts(spark, sf_dir)), 10)


@query("candidate_merge", """
WITH h AS (SELECT DISTINCT l_partkey AS work, CASE WHEN l_returnflag = 'R' THEN 'backward' ELSE 'forward' END AS direction, l_suppkey AS seed FROM lineitem),
c AS (SELECT l_partkey AS work, max(l_quantity) AS cited_by FROM lineitem GROUP BY 1)
SELECT h.work, count(*) AS links, count(DISTINCT seed) AS seeds, count(*) FILTER (direction = 'forward') AS forward, any_value(cited_by) AS cited_by
FROM h JOIN c USING (work) GROUP BY h.work
""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.when(F.col("l_returnflag") == "R", "backward").otherwise("forward").alias("direction"), F.col("l_suppkey").alias("seed"), F.col("l_quantity").alias("cited_by")
    )
    return graph.merge_candidates(hits, F.col("l_partkey"))


@query("concept_orphans", """
SELECT p_brand AS key, 0::BIGINT AS n_papers FROM (SELECT DISTINCT p_brand FROM part)
WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 AND p_size < 3)
""")
def concept_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    used = parts.filter("p_size < 3").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 49"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return graph.orphans(parts.select(F.col("p_brand").alias("key")).distinct(), used.select(F.col("p_brand").alias("key")))
