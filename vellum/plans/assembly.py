"""Queries of the pieces that notes and reports are assembled from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import assembly as A
from vellum.operators import lists, reports
from vellum.plans.quality import pick
from vellum.plans.registry import query
from vellum.session import table
from vellum.sources import notes


@query("text_pieces", """
SELECT conv_id, turn, i::INT AS pos, substr(text, i * 200 + 1, 200) AS piece FROM conversations, LATERAL (SELECT unnest(range(0, CASE WHEN text = '' THEN 0 ELSE (length(text) + 199) // 200 END)) AS i) WHERE text IS NOT NULL
""")
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(A.text_pieces(F.col("text"), 200)).alias("pos", "piece"))


@query("memberships_under", """
SELECT c_custkey AS item, r_name AS "group", n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0
""")
def memberships_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions below a named container (all but one), nations below regions, customers filed in nations."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.when(F.col("r_regionkey") != 0, "top").otherwise("else").alias("parent"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    tops = spark.createDataFrame([("top", None, "Topics"), ("else", None, "Other")], "key string, parent string, name string")
    filed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("container"))
    return A.memberships_under(tops.unionByName(regions).unionByName(nations), filed, "Topics")


@query("batch_topics", """
WITH b AS (SELECT c_custkey, c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 10 AS batch FROM customer)
SELECT c_custkey::VARCHAR AS id, CASE WHEN batch % 3 = 2 OR batch % 3 = 1 THEN 'failed' WHEN c_custkey % 4 = 3 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN batch % 3 = 0 AND c_custkey % 4 IN (0, 1) THEN 'a,b' ELSE '' END AS topics FROM b
""")
def batch_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten; of three batches one is answered, one broken and one not answered at all."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    batches = A.request_batches(rows, "nation", F.col("id").asc(), 10)
    entry = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": '), F.when(F.col("id") % 4 < 2, '[" b", "a", "b", "unknown"]').otherwise('["unknown"]'))
    json = F.concat(F.lit("{"), F.array_join(F.collect_list(F.when(F.col("id") % 4 != 3, entry)), ", "), F.lit("}"))
    answers = batches.groupBy("nation", "batch").agg(F.when(F.col("batch") % 3 == 0, json).otherwise("no json").alias("json")).filter("batch % 3 <> 2")
    topics = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    return A.batch_topics(batches, answers, topics, "nation").withColumn("topics", F.array_join("topics", ","))


@query("import_outcomes", "SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'chunk' WHEN o_custkey % 3 = 1 THEN 'single' ELSE 'missing' END AS outcome FROM orders")
def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return A.import_outcomes(ids, ids.filter("id % 3 = 0"), ids.filter("id % 3 < 2"))


@query("decided_answers", """
SELECT o_orderkey AS item, 'q' AS question, CASE WHEN o_orderkey % 4 = 1 THEN 'no' ELSE 'yes' END AS answer, CASE o_orderkey % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'new' ELSE '' END AS note FROM orders
""")
def decided_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.lit("q").alias("question"), F.lit("yes").alias("answer"))
    first = record.filter("item % 4 < 2").select("item", "question", F.lit("changed").alias("decision"), F.lit("no").alias("suggested"), F.lit("old").alias("why"), F.lit(1).alias("at"))
    second = first.withColumns({"decision": F.when(F.col("item") % 4 == 0, "kept").otherwise("changed"), "why": F.when(F.col("item") % 4 == 0, "kept").otherwise("new"), "at": F.lit(2)})
    return A.decided(record, first.unionByName(second))


@query("patched_entries", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def patched_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    patches = entries.filter("id % 2 = 0").select(F.col("id"), F.concat("name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("segment"))
    return A.patched(entries, patches.unionByName(patches.limit(1).withColumn("id", F.lit(-1).cast("long"))), "id")


@query("synthesis_sources", """
WITH s AS (SELECT p_partkey AS id, p_size AS year, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || chr(10) || 'h1' || chr(10) || 'h2' WHEN 2 THEN 'h1' || chr(10) || 'h2' END AS text, CASE WHEN p_partkey % 4 = 0 THEN 'note' ELSE 'abstract' END AS kind FROM part)
SELECT row_number() OVER (ORDER BY year, id)::INT AS place, id, text, kind FROM s WHERE text IS NOT NULL ORDER BY year, id LIMIT 60
""")
def synthesis_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    marks = F.when(k.isin(1, 2), F.array(F.lit("h1"), F.lit("h2"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("year"), F.when(k == 0, F.col("p_name")).otherwise(" ").alias("note"), F.when(k == 1, F.col("p_brand")).alias("abstract"), marks.alias("highlights"))
    return A.synthesis_sources(rows, 60)


@query("note_places", """
SELECT s_suppkey AS key, CASE s_suppkey % 4 WHEN 0 THEN 'a/N' || s_suppkey || '.md' WHEN 1 THEN 'b/M' || s_suppkey || '.md' WHEN 2 THEN 'z/' || s_suppkey || '.md' END AS path, CASE s_suppkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'other' WHEN 2 THEN 'index' END AS by FROM supplier
""")
def note_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = k.cast("string")
    wanted = table(spark, sf_dir, "supplier").select(k.alias("key"), F.concat(F.lit("N"), n).alias("name"), F.concat(F.lit("M"), n).alias("other"))
    path = lambda folder, name: F.concat(F.lit(f"{folder}/"), F.col(name), F.lit(".md"))
    files = wanted.filter("key % 4 = 0").select(path("b", "name").alias("path")).unionByName(wanted.filter("key % 4 = 0").select(path("a", "name").alias("path"))).unionByName(wanted.filter("key % 4 < 2").select(path("b", "other").alias("path")))
    index = wanted.filter("key % 4 < 3").select("key", F.concat(F.lit("z/"), F.col("key").cast("string"), F.lit(".md")).alias("path"), F.lit(2).alias("at"))
    return A.note_places(wanted, files, index.unionByName(index.withColumns({"path": F.lit("old.md"), "at": F.lit(1)})))


@query("suggestion_rows", """
SELECT p_partkey AS id, 'design' AS kind, p_type AS value, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE '' END AS confidence, p_partkey % 2 = 0 AS picked FROM part UNION ALL SELECT p_partkey, 'pico', p_brand, 'low', false FROM part
""")
def suggestion_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind, value, sure: F.struct(F.lit(kind).alias("kind"), value.alias("value"), sure.alias("confidence"))
    k = F.col("p_partkey")
    given = F.array(one("design", F.concat(F.lit(" "), F.col("p_type")), pick(k, "High", "0.6", "85%", "perhaps")), one("pico", F.col("p_brand"), F.lit("12")), one("pico", F.lit(" "), F.lit("high")))
    return A.suggestion_rows(table(spark, sf_dir, "part").select(k.alias("id"), given.alias("suggestions")))


@query("rater_disagreements", """
WITH r AS (SELECT o_orderkey AS item, ['yes', 'no', 'unclear'][o_orderkey % 3 + 1] AS a, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ['yes', 'no'][o_orderkey % 2 + 1] END AS b FROM orders)
SELECT item, 'q' AS question, a AS first, b AS second FROM r WHERE a <> b
""")
def rater_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.lit("q").alias("question"))
    return A.disagreements(orders.withColumn("answer", pick(F.col("item"), "是", "N", "不清楚")), orders.filter("item % 5 <> 0").withColumn("answer", pick(F.col("item"), "Y", "否")))


@query("checklist_answers", """
SELECT c_custkey AS item, 'q1' AS question, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'unclear' END AS answer, c_name AS evidence FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'q2', '', '' FROM customer WHERE c_custkey % 3 <> 0
""")
def checklist_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("c_custkey") % 2 == 0, "是").otherwise("Can't tell")
    json = F.concat(F.lit('[{"id": "q1", "answer": "'), answer, F.lit('", "evidence": " '), F.col("c_name"), F.lit('"}, {"id": " q2", "answer": "perhaps"}, {"id": "q1", "answer": "no"}, {"id": "q9", "answer": "yes"}]'))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.when(F.col("c_custkey") % 3 == 0, "broken").otherwise(json).alias("json"))
    return A.checklist_answers(rows, spark.createDataFrame([("q1",), ("q2",), ("q3",)], "question string"))


@query("quote_pages", """
WITH f AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t, substr(text, 1, 30) AS quote FROM conversations),
q AS (SELECT DISTINCT conv_id AS id, quote, regexp_replace(lower(quote), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM f WHERE turn % 2 = 1 UNION SELECT DISTINCT conv_id, 'not in any page', 'notinanypage' FROM f)
SELECT q.id, q.quote, (SELECT min(turn) FROM f WHERE f.conv_id = q.id AND q.k <> '' AND contains(f.t, q.k)) AS page FROM q
""")
def quote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), "text")
    items = turns.filter("page % 2 = 1").select("id", F.substring("text", 1, 30).alias("quote")).unionByName(turns.select("id", F.lit("not in any page").alias("quote")))
    return A.quote_pages(items, turns)


@query("page_paragraphs", r"""
SELECT conv_id, turn, 'The implementation of care' || chr(10) || '護理研究' || chr(10) || '| a | b |' || chr(10) || 'Turn ' || turn || ' of [\[it=\=' || chr(10) || '\# no head' AS paragraphs FROM conversations
""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("The implemen-\ntation  of\ncare\r\n\n護理\n研究\n\n| a | b |\nTurn "), F.col("turn").cast("string"), F.lit("\nof [[it==\n\n# no head\n"))
    shown = F.transform(A.page_paragraphs(page), lambda p: F.when(p.startswith("|"), p).otherwise(A.escaped(p)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(shown, "\n").alias("paragraphs"))


@query("note_heads", """
SELECT event_id, 'K' || event_id AS key FROM events
""")
def note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of notes from their heads; where the frontmatter does not end within the head, from the whole note."""
    n = F.col("event_id").cast("string")
    long = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("- tag\n"), 40)).otherwise("")
    note = F.concat(F.lit("---\ntags:\n"), long, F.lit("key: K"), n, F.lit("\n---\nbody\n"))
    return table(spark, sf_dir, "events").select("event_id", notes.head_value(note, "key", 64).alias("key"))


@query("status_pie", """
WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT 'pie title Status' || chr(10) || string_agg('  "' || s || '" : ' || n, chr(10) ORDER BY s) AS chart FROM c
""")
def status_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of a fixed set are few, so their counts go to the driver."""
    counts = {r["s"]: r["n"] for r in table(spark, sf_dir, "orders").filter("o_orderstatus IN ('F', 'O', 'P')").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return spark.createDataFrame([(reports.mermaid_pie("Status", sorted(counts.items())),)], "chart string")


@query("resolved_columns", """
SELECT s_suppkey::VARCHAR AS key, s_name AS title, NULL::DATE AS seen, trunc(s_acctbal)::BIGINT AS balance, s_nationkey FROM supplier
UNION ALL SELECT c_custkey::VARCHAR, c_name, NULL, trunc(c_acctbal)::BIGINT, c_nationkey FROM customer
""")
def resolved_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers brought to one schema by the names that their tables give to its fields."""
    want = [{"key": "key", "names": ["id", "s_suppkey", "c_custkey"], "type": "string"}, {"key": "title", "names": ["s_name", "c_name"], "type": "string"}, {"key": "seen", "names": ["last_seen"], "type": "date"}, {"key": "balance", "names": ["s_acctbal", "c_acctbal"], "type": "bigint"}]
    parts = [lists.evolved(table(spark, sf_dir, name), want).withColumnRenamed(f"{name[0]}_nationkey", "s_nationkey").select(*[f["key"] for f in want], "s_nationkey") for name in ("supplier", "customer")]
    return parts[0].unionByName(parts[1])
