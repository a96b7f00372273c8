"""Queries of prose functions: messages, quotes, citations, numbers worth checking, short forms, token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import prose
from vellum.functions.creators import creator_repair
from vellum.plans.registry import query
from vellum.session import table


@query("plain_messages", r"""
SELECT conv_id, turn, '【' || role || '】' || chr(10) || CASE WHEN turn % 2 = 0 THEN '☑ ' ELSE '☐ ' END || 'turn ' || turn || chr(10) || '・note' || turn AS message FROM conversations
""")
def plain_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as Markdown with comments, a callout, boxes and links, as plain messages."""
    note = F.expr("concat('%% made %%\n## ', role, '\n> [!note] x\n> y\n- [', CASE WHEN turn % 2 = 0 THEN 'x' ELSE ' ' END, '] **turn ', turn, '**\n* [[notes/note', turn, ']]')")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.plain_text(note).alias("message"))


@query("short_texts", r"""
WITH d AS (SELECT doc_id, trim(text) AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 60)) || '…' END AS clipped,
       CASE WHEN length(one) <= 60 THEN one ELSE regexp_replace(substr(one, 1, 59), '\s+\S{0,13}$', '') || '…' END AS short FROM d
""")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prose.clip(F.col("text"), 60).alias("clipped"), prose.shorten(F.col("text"), 60).alias("short"))


@query("longest_quotes", """
SELECT p_partkey, CASE WHEN length(p_brand) > length(p_type) THEN p_brand ELSE p_type END AS quote FROM part
""")
def longest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat(p_name, ' \"', p_brand, '\" and “', p_type, '”, 「x」')")
    return table(spark, sf_dir, "part").select("p_partkey", prose.longest_quote(line).alias("quote"))


@query("cited_sources", """
WITH c AS (SELECT 'S' || l_suppkey AS source, 'p. ' || l_linenumber AS locator FROM lineitem UNION ALL SELECT 'S' || l_partkey, '' FROM lineitem)
SELECT source, count(*) AS n_cited, count(DISTINCT locator) FILTER (locator <> '') AS n_pages FROM c GROUP BY source
""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often sources are cited, and on how many pages."""
    text = F.expr("concat('so [S', l_suppkey, ', p. ', l_linenumber, '; S', l_partkey, '] and [Sx]')")
    cited = table(spark, sf_dir, "lineitem").select(F.inline(prose.citations(text)))
    return cited.groupBy(F.col("id").alias("source")).agg(F.count(F.lit(1)).alias("n_cited"), F.countDistinct(F.when(F.col("locator") != "", F.col("locator"))).alias("n_pages"))


@query("numbers_to_check", """
SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey >= 10 THEN p_partkey::VARCHAR END, CASE WHEN p_size % 12 >= 10 THEN (p_size % 12)::VARCHAR END, p_size::VARCHAR) AS numbers FROM part
""")
def numbers_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('95% CI of ', p_partkey, ' people, then ', p_size % 12, ' more in 2020 年; ', p_size, '%')")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(prose.checkable_numbers(text), " ").alias("numbers"))


@query("period_counts", """
SELECT event_type, count(*) FILTER (ts::DATE BETWEEN DATE '2024-01-08' AND DATE '2024-01-21') AS in_period, count(*) AS all_events FROM events GROUP BY event_type
""")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a period of whole days, both ends included."""
    day = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    inside = prose.in_period(day, F.lit("2024-01-08").cast("date"), F.lit("2024-01-21").cast("date"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(inside).alias("in_period"), F.count(F.lit(1)).alias("all_events"))


@query("told_numbers", """
SELECT c_custkey, CASE WHEN c_nationkey - 12 > 0 THEN '+' ELSE '' END || (c_nationkey - 12) AS change, CASE WHEN c_custkey < 100 THEN '<100' WHEN c_custkey <= 1000 THEN '100–1000' ELSE '>1000' END AS size,
       CASE WHEN c_custkey % 7 = 0 THEN 5 ELSE least(200, greatest(3, c_custkey)) END AS clamped, 'US$' || c_custkey || '.50' AS price FROM customer
""")
def told_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    clamped = prose.clamp_int(F.when(key % 7 == 0, "n/a").otherwise(key.cast("string")), 3, 200, 5)
    return table(spark, sf_dir, "customer").select("c_custkey", prose.signed(F.col("c_nationkey") - 12).alias("change"), prose.size_bucket(key).alias("size"), clamped.alias("clamped"), prose.format_usd(key + 0.5).alias("price"))


@query("answer_usage", """
SELECT event_type, sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id - event_id // 2 END)::BIGINT AS input, sum(user_id)::BIGINT AS output, sum(event_id // 2)::BIGINT AS cache_read FROM events GROUP BY event_type
""")
def answer_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of answers of two providers."""
    body = F.when(F.col("event_id") % 2 == 0, F.expr("concat('{\"usage\":{\"input_tokens\":', event_id, ',\"output_tokens\":', user_id, ',\"cache_read_input_tokens\":', event_id DIV 2, '}}')")).otherwise(
        F.expr("concat('{\"usage\":{\"prompt_tokens\":', event_id, ',\"completion_tokens\":', user_id, ',\"prompt_tokens_details\":{\"cached_tokens\":', event_id DIV 2, '}}}')")
    )
    rows = table(spark, sf_dir, "events").select("event_type", prose.usage_counts(body).alias("u"))
    return rows.groupBy("event_type").agg(*[F.sum(f"u.{c}").alias(c) for c in ("input", "output", "cache_read")])


@query("joined_hyphens", """
SELECT p_partkey, 'inter' || split_part(p_name, ' ', 1) || ' self-' || split_part(p_name, ' ', 1) || ' pre- and post-test' AS text FROM part
""")
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = "split_part(p_name, ' ', 1)"
    text = F.expr(f"concat('inter-\n', {word}, ' self- ', {word}, ' pre- and post-test')")
    return table(spark, sf_dir, "part").select("p_partkey", prose.join_hyphens(text).alias("text"))


@query("heading_sections", """
SELECT c_nationkey % 4 AS kind, c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'methods' WHEN 1 THEN 'references' WHEN 2 THEN 'results' END AS section FROM customer
""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_nationkey") % 4
    line = F.when(kind == 0, F.concat(F.col("c_custkey") % 90 + 1, F.lit(". Methods:"))).when(kind == 1, "R E F E R E N C E S").when(kind == 2, "IV. Results and  Discussion").otherwise(F.concat(F.lit("Methods were "), "c_name"))
    return table(spark, sf_dir, "customer").select(kind.alias("kind"), "c_custkey", prose.heading_id(line).alias("section"))


@query("trimmed_sections", """
WITH s AS (SELECT conv_id, turn, repeat('body text. ', turn::INT * 3 + 8) AS body FROM conversations), p AS (SELECT *, '# T' || chr(10) || body || chr(10) || '## Methods' || chr(10) || body || chr(10) AS top FROM s)
SELECT conv_id, turn, rtrim(top, chr(10)) || chr(10) || 'Table 1 kept' AS md, 'references:' || (length('## 5. References') + 1 + length(body) + 1) || ',coi:' || length('## Disclosure' || chr(10) || 'None.' || chr(10)) AS cut FROM p
""")
def trimmed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers without references and interests; a table behind the references stays."""
    body = "repeat('body text. ', CAST(turn AS INT) * 3 + 8)"
    paper = F.expr(f"concat('# T\n', {body}, '\n## Methods\n', {body}, '\n## 5. References\n', {body}, '\nTable 1 kept\n## Disclosure\nNone.\n')")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.trim_sections(paper).alias("t"))
    cut = F.array_join(F.transform("t.cut", lambda c: F.concat_ws(":", c["id"], c["chars"].cast("string"))), ",")
    return rows.select("conv_id", "turn", F.col("t.md").alias("md"), cut.alias("cut"))


@query("creator_repairs", """
SELECT CASE c_custkey % 5 WHEN 0 THEN 'several people in one field' WHEN 1 THEN 'names swapped' WHEN 2 THEN 'spaces in the name' WHEN 3 THEN 'two scripts in one name' END AS problem,
       CASE WHEN c_custkey % 5 < 3 THEN 'sure' WHEN c_custkey % 5 = 3 THEN 'check' END AS confidence, count(*) AS n FROM customer GROUP BY ALL
""")
def creator_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on creators, counted."""
    kind = F.col("c_custkey") % 5
    last = F.when(kind == 0, "陳美玲、林小華").when(kind == 1, "美玲").when(kind == 2, "陳 ").when(kind == 3, "陳美玲 Chen").otherwise(F.col("c_name"))
    first = F.when(kind == 1, "陳").when(kind == 2, "美 玲").otherwise("")
    found = table(spark, sf_dir, "customer").select(creator_repair(last, first, F.lit(None).cast("string"), "陳林王李").alias("r"))
    return found.groupBy(F.col("r.problem").alias("problem"), F.col("r.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
