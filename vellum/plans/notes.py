"""Queries of reminders about reports, notes that two hands write, and the list of work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import regions
from vellum.operators import reminders
from vellum.operators.worklist import WorkList
from vellum.plans.changes import _folder
from vellum.plans.registry import query
from vellum.session import table

REPORTS_SQL = """
l AS (SELECT l_orderkey AS k, n, 'S' || n AS id, 'Part ' || l_partkey || '.' || n AS citation, l_partkey % 50 = 0 AS chinese,
             CASE l_suppkey % 5 WHEN 0 THEN 'meta-analysis' WHEN 1 THEN 'RCT' ELSE 'cohort' END AS design, CASE WHEN l_quantity < 10 THEN '' ELSE '2' END AS level, CASE l_returnflag WHEN 'R' THEN 'JBI' WHEN 'A' THEN 'casp 2024' END AS tool
      FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)),
o AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AS no_title, CASE WHEN o_orderkey % 17 = 0 THEN 1300 ELSE 3 END AS zh, CASE WHEN o_orderkey % 19 = 0 THEN 6100 ELSE 5 END AS words, o_orderkey % 4 <> 0 AS appraised,
             o_orderkey % 5 AS scenario, o_orderkey % 3 = 0 AS no_comparison, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'PubMed' WHEN 2 THEN 'Cochrane, MEDLINE, CINAHL' ELSE 'CINAHL' END AS dbs, CASE WHEN o_orderkey % 8 = 0 THEN 'harm' ELSE '' END AS kind,
             o_orderkey % 6 = 0 AS no_prisma, o_orderkey % 7 AS pending, o_orderkey % 10 = 0 AS auto, o_orderkey % 11 AS todo, o_orderkey % 13 = 0 AS no_ai FROM orders)"""


@query("report_reminders", f"""
WITH {REPORTS_SQL},
s AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(reviews, 0) AS reviews, unleveled, leveled, tools, chinese, unappraised FROM o LEFT JOIN (
  SELECT k, count(*) AS n, count(*) FILTER (design = 'meta-analysis') AS reviews, string_agg(citation, '; ' ORDER BY n) FILTER (level = '') AS unleveled, count(*) FILTER (level <> '') AS leveled,
         string_agg(citation || ': ' || tool, '; ' ORDER BY n) FILTER (tool = 'JBI') AS tools, string_agg(citation, '; ' ORDER BY n) FILTER (chinese) AS chinese, string_agg(citation, '; ' ORDER BY n) FILTER (id <> 'S1') AS unappraised FROM l GROUP BY k) USING (k)),
f AS (
  SELECT k, 'missingSection' AS code, 'warn' AS level, 'title' AS evidence FROM s WHERE no_title UNION ALL SELECT k, 'missingSection', 'warn', 'appraisal' FROM s WHERE NOT appraised
  UNION ALL SELECT k, 'missingAppraisal', 'warn', unappraised FROM s WHERE appraised AND unappraised IS NOT NULL
  UNION ALL SELECT k, 'fewStudies', 'warn', n::VARCHAR FROM s WHERE n < 2 UNION ALL SELECT k, 'manyStudies', 'info', n::VARCHAR FROM s WHERE n > 5 UNION ALL SELECT k, 'noReview', 'info', '' FROM s WHERE n > 0 AND reviews = 0
  UNION ALL SELECT k, 'withoutAI', 'warn', 'S1' FROM s WHERE no_ai UNION ALL SELECT k, 'noLevel', 'warn', unleveled FROM s WHERE unleveled IS NOT NULL UNION ALL SELECT k, 'cebmColumn', 'warn', kind FROM s WHERE kind <> '' AND leveled > 0
  UNION ALL SELECT k, 'tool', 'warn', tools FROM s WHERE tools IS NOT NULL UNION ALL SELECT k, 'noScenario', 'warn', '' FROM s WHERE scenario = 0 UNION ALL SELECT k, 'noQuote', 'info', '' FROM s WHERE scenario > 1
  UNION ALL SELECT k, 'pico', 'warn', 'C' FROM s WHERE no_comparison UNION ALL SELECT k, 'noDatabases', 'warn', '' FROM s WHERE dbs = ''
  UNION ALL SELECT k, 'databases', 'warn', CASE WHEN dbs = 'PubMed' THEN 'Cochrane Library' ELSE 'Cochrane Library; PubMed' END FROM s WHERE dbs IN ('PubMed', 'CINAHL') UNION ALL SELECT k, 'cinahl', 'info', '' FROM s WHERE dbs = 'PubMed'
  UNION ALL SELECT k, 'searchDate', 'info', '' FROM s UNION ALL SELECT k, 'autoQuery', 'warn', 'falls' FROM s WHERE auto UNION ALL SELECT k, 'noPrisma', 'warn', '' FROM s WHERE no_prisma
  UNION ALL SELECT k, 'prismaPending', 'warn', 'taPending: ' || pending FROM s WHERE NOT no_prisma AND pending > 0 UNION ALL SELECT k, 'abstractLength', 'warn', 'abstractZh: ' || zh FROM s WHERE zh > 1200
  UNION ALL SELECT k, 'bodyLength', 'warn', (words + 4 + appraised::INT)::VARCHAR FROM s WHERE words > 6000 UNION ALL SELECT k, 'todos', 'info', todo::VARCHAR FROM s WHERE todo > 0
  UNION ALL SELECT k, 'chineseRefs', 'info', chinese FROM s WHERE chinese IS NOT NULL UNION ALL SELECT k, 'appraisers', 'info', '' FROM s)
SELECT k::VARCHAR AS report, code, level, evidence FROM f
""")
def report_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports whose studies are their lines."""
    part, returned = F.col("l_partkey"), F.col("l_returnflag")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    id, citation = F.concat(F.lit("S"), F.col("n").cast("string")), F.concat(F.lit("Part "), part.cast("string"), F.lit("."), F.col("n").cast("string"))
    design = F.when(F.col("l_suppkey") % 5 == 0, "meta-analysis").when(F.col("l_suppkey") % 5 == 1, "RCT").otherwise("cohort")
    row = F.struct(id.alias("id"), design.alias("design"), F.when(F.col("l_quantity") < 10, "").otherwise("2").alias("level"), F.when(returned == "R", "JBI").when(returned == "A", "casp 2024").alias("tool"))
    entry = F.struct(id.alias("id"), citation.alias("citation"), (part % 50 == 0).alias("chinese"))
    lines = table(spark, sf_dir, "lineitem").withColumn("n", number).groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("n"), entry.alias("e"), row.alias("r")))).alias("x"))
    k = F.col("o_orderkey")
    texts = {
        "title": F.when(k % 9 != 0, "A title").otherwise(" "), "abstractZh": F.when(k % 17 == 0, "長" * 1300).otherwise("長長長"), "abstractEn": F.lit("an abstract"), "intro": F.when(k % 19 == 0, "word " * 6100).otherwise("word " * 5),
        "question": F.lit("## heading\nx"), "appraisal": F.when(k % 4 != 0, "### [S1, p. 5]\nread"), "synthesis": F.lit("x"), "application": F.lit("x [S1]"), "conclusion": F.concat(F.lit("x\n#### "), F.expr("repeat('〔待補〕', cast(o_orderkey % 11 as int))")),
    }
    databases = F.when(k % 4 == 1, "PubMed").when(k % 4 == 2, "Cochrane, MEDLINE, CINAHL").when(k % 4 == 3, "CINAHL")
    scenario = F.when(k % 5 == 0, " ").when(k % 5 == 1, "she said 「痛」").otherwise("no words of hers")
    answer = F.struct(
        F.when(k % 8 == 0, "harm").alias("questionType"), scenario.alias("scenario"), F.lit("p").alias("population"), F.lit("i").alias("intervention"), F.when(k % 3 != 0, "c").alias("comparison"), F.lit("o").alias("outcome"),
        databases.alias("databases"), F.lit(None).cast("string").alias("searchDate"), F.lit("falls").alias("query"),
    )
    written = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(*[x for name, text in texts.items() for x in (F.lit(name), text)]).alias("sections"))
    orders = written.join(lines, k == F.col("k"), "left")
    reports = orders.select(
        k.cast("string").alias("report"), "sections", F.transform("x", lambda x: x["e"]).alias("entries"), F.transform("x", lambda x: x["r"]).alias("rows"),
        answer.alias("answer"), F.when(k % 6 != 0, F.struct((k % 7).cast("int").alias("taPending"), F.lit(0).alias("ftPending"))).alias("prisma"),
        F.when(k % 10 == 0, F.struct(F.lit("falls").alias("query"), F.lit("尚未實際檢索").alias("queryNote"))).alias("search"), F.when(k % 13 == 0, F.array(F.lit("S1"))).alias("withoutAI"),
    )
    return reminders.report_reminders(reports).select("report", "code", "level", F.array_join("evidence", "; ").alias("evidence"))


@query("merged_notes", """
SELECT doc_id, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'rating: 5' || chr(10) || 'mine:' || chr(10) || '  - a' || chr(10) || '---' || chr(10) || chr(10) || '# Doc' || chr(10) || left(text, 200) || chr(10) || '%% vellum:main:start v2 %%' || chr(10) || chr(10) || 'lang ' || lang || chr(10) || chr(10) || '%% vellum:main:end %%'
       || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '%% vellum:ai:start v2 %%' || chr(10) || chr(10) || 'source ' || source || chr(10) || chr(10) || '%% vellum:ai:end %%' ELSE '' END || chr(10) || chr(10) || '## Mine' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'my line' || chr(10) || chr(10) ELSE '' END || text AS note,
       CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE 'same' END AS state FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
""")
def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the user's own text in notes whose keys and regions are renewed; every third user has written into a region."""
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    above, below = F.concat(F.lit("# Doc\n"), F.left("text", F.lit(200)), F.lit("\n")), F.concat(F.lit("\n\n## Mine\n"), F.col("text"))
    front = F.lit("---\ntitle: old\nrating: 5\nyear: 1999\nmine:\n  - a\n---\n")
    region = lambda inside: F.concat(F.lit("%% vellum:main:start — of old %%\nfirst\n"), inside, F.lit("%% vellum:main:end %%"))
    base = F.concat(front, above, region(F.lit("")), below)
    mine = F.concat(front, above, region(F.when(F.col("doc_id") % 3 == 0, "my line\n").otherwise("")), below)
    managed = F.array(F.struct(F.lit("title").alias("key"), F.concat(F.lit("title: Doc "), F.col("doc_id").cast("string")).alias("text")))
    parts = [("main", F.concat(F.lit("lang "), F.col("lang"))), ("ai", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("source "), F.col("source"))))]
    note = regions.merged_note(base, mine, managed, ["title", "year"], parts, 2, "## Mine")
    return rows.select("doc_id", note.alias("note"), regions.region_state(base, mine, "main").alias("state"))


@query("worked_items", """
SELECT c_custkey::VARCHAR AS ref, CASE WHEN c_acctbal >= 0 THEN 'done' ELSE 'failed' END AS state, CASE WHEN c_acctbal >= 0 THEN c_name END AS value, CASE WHEN c_acctbal >= 0 THEN 0 ELSE 2 END::INT AS attempts FROM customer
""")
def worked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as work that fails for those in debt, tried twice; the first run is killed after its claim."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref"), "c_name", "c_acctbal")
    path = _folder(spark, "work")
    work = WorkList(spark, path, "value string", 8)
    n = customers.count()
    work.add(customers.select("ref", F.array(F.lit("notes")).alias("targets"), F.lit("missing").alias("mode")))
    work.claim(n // 2 + 1)
    again = WorkList(spark, path, "value string", 8)
    again.drain(lambda items: items.join(customers, "ref").select("ref", (F.col("c_acctbal") >= 0).alias("ok"), F.col("c_name").alias("value")), n, most_attempts=2)
    done = again.results.read().select("ref", F.lit("done").alias("state"), "value", F.lit(0).alias("attempts"))
    return done.unionByName(again.items.read().select("ref", "state", F.lit(None).cast("string").alias("value"), "attempts"))
