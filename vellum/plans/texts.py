"""Queries of text measures, cleaning, verification and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions.identifiers import citekey_base, key_suffix
from vellum.operators import verify
from vellum.operators.lists import numbered_within
from vellum.plans.registry import query
from vellum.session import table
from vellum.storage import store


@query("text_measures", r"""
SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) AS chars, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’.-][\p{L}\p{N}]+)*'))::BIGINT AS words,
       ceil(length(text) / 4.0)::BIGINT AS tokens, CASE WHEN trim(text) = '' THEN '' ELSE 'en' END AS language FROM documents
""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.count_chars(text).cast("long").alias("chars"), T.count_words(text).alias("words"), T.estimate_tokens(text).alias("tokens"), T.guess_language(text).alias("language"))


@query("text_quality", r"""
WITH c AS (SELECT doc_id, source, length(regexp_replace(text, '\s+', '', 'g')) AS chars, doc_id % 4 AS pages, doc_id % 5 > 0 AS is_pdf FROM documents),
s AS (SELECT *, CASE WHEN NOT is_pdf THEN CASE WHEN chars >= 200 THEN 'ok' ELSE 'none' END WHEN pages = 0 THEN CASE WHEN chars < 20 THEN 'none' ELSE 'ok' END
                     WHEN chars / pages < 100 THEN 'none' WHEN chars / pages < 600 THEN 'partial' ELSE 'ok' END AS status FROM c)
SELECT source, arg_min(status, CASE status WHEN 'ok' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) AS best, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'partial') AS n_partial,
       count(*) FILTER (status = 'none') AS n_none FROM s GROUP BY source
""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", T.classify_source(F.col("doc_id") % 5 > 0, T.count_chars(F.col("text")), F.col("doc_id") % 4).alias("status"))
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return docs.groupBy("source").agg(T.best_status(F.col("status")).alias("best"), n("ok"), n("partial"), n("none"))


@query("numbers_in_text")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical numbers of every text; the pattern looks behind, which the oracle's language cannot."""
    found = T.numbers_in(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.array_join(found, " ").alias("numbers"))


@query("number_support", """
WITH c AS (SELECT o_orderkey AS id, unnest([o_custkey % 40, o_orderkey % 30])::VARCHAR AS number FROM orders), s AS (SELECT l_orderkey AS id, unnest([l_linenumber, l_quantity::INT])::VARCHAR AS number FROM lineitem)
SELECT DISTINCT id, number FROM c ANTI JOIN s USING (id, number)
""")
def number_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in sentences about orders that none of the sentences about their lines has."""
    words = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("int").cast("string") for p in parts])
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), words("In ", F.col("o_custkey") % 40, " cases of ", F.col("o_orderkey") % 30, ".").alias("text"))
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), words("Saw ", F.col("l_linenumber"), ", then ", F.col("l_quantity"), "!").alias("text"))
    return verify.unsupported_numbers(claims, sources, ["id"])


REDACT_SQL = r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '<email>', 'g'), '\s+', ' ', 'g')) AS text
FROM documents
"""


@query("redact_email", REDACT_SQL)
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one shape that stands alone."""
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_emails(F.col("text")).alias("text"))


@query("redact_all")
def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query("repeated_lines", r"""
WITH p AS (SELECT source AS doc, doc_id AS page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
e AS (SELECT DISTINCT doc, page, unnest(list_concat(l[1:3], l[greatest(len(l) - 2, 1):])) AS line FROM p),
k AS (SELECT DISTINCT doc, page, regexp_replace(regexp_replace(lower(trim(line)), '\d+', '#', 'g'), '\s+', ' ', 'g') AS key FROM e),
t AS (SELECT doc, count(DISTINCT page) AS total FROM p GROUP BY doc)
SELECT doc, key, count(*) AS n_pages FROM k JOIN t USING (doc) GROUP BY doc, key, total HAVING count(*) >= greatest(3, ceil(total * 0.01))
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return verify.repeated_edges(pages, share=0.01)


def asked_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), verify.match_tokens(F.col("text")).alias("tokens"))
    return store(quotes.filter(F.size("tokens") > 0), "quotes")


@query("quote_exact", r"""
WITH q AS (SELECT item_id AS quote_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), ' ') || ' ' AS t FROM benchmark),
d AS (SELECT doc_id AS text_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'), ' ') || ' ' AS t FROM documents)
SELECT quote_id, text_id FROM q JOIN d ON contains(d.t, q.t)
""")
def quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), verify.match_tokens(F.col("text")).alias("tokens"))
    return verify.exact_quotes(asked_quotes(spark, sf_dir), store(texts, "texts"))


@query("quote_fuzzy")
def quote_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fuzzy_quotes(asked_quotes(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query("chunk_requests", """
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
c AS (
  SELECT conv_id, turn, i, 0::BIGINT AS chunk, size AS used, 1 AS n FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.turn, t.i, c.chunk + (c.used + t.size > 2000 OR c.n >= 4)::BIGINT, CASE WHEN c.used + t.size > 2000 OR c.n >= 4 THEN t.size ELSE c.used + t.size END,
         CASE WHEN c.used + t.size > 2000 OR c.n >= 4 THEN 1 ELSE c.n + 1 END
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.i = c.i + 1)
SELECT conv_id, turn, chunk FROM c
""")
def chunk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.greedy_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text"), 2000, 4)


STOPWORDS = ("a", "an", "the", "of", "on", "in", "and", "for", "to", "with")


@query("citekeys", r"""
WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[\s-]+'), lambda x: x <> '' AND x NOT IN ('a','an','the','of','on','in','and','for','to','with')) AS words, p_brand, p_size FROM part),
b AS (SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') || (2000 + p_size % 3) || regexp_replace(coalesce(words[1], ''), '[^a-z0-9]+', '', 'g') AS base FROM w),
r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM b)
SELECT id, base || CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr((96 + n)::INT) ELSE chr((96 + (n - 1) // 26)::INT) || chr((97 + (n - 1) % 26)::INT) END AS citekey FROM r
""")
def citekeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = citekey_base(F.col("p_brand"), 2000 + F.col("p_size") % 3, F.col("p_name"), STOPWORDS)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), base.alias("base"))
    return numbered_within(rows, "base", F.col("id").asc()).select("id", F.concat("base", key_suffix(F.col("n") - 1)).alias("citekey"))


@query("ranked_search", r"""
WITH f AS (SELECT p_partkey AS id, lower(p_name) AS label, unnest([lower(p_name), lower(p_type), lower(p_brand)]) AS txt, unnest([3, 2, 1]) AS weight FROM part),
t AS (SELECT id, label, weight, term, txt, strpos(txt, term) AS pos, strpos(txt, term[1]) AS a FROM f, (VALUES ('re'), ('st')) v(term)),
u AS (SELECT *, CASE WHEN a > 0 AND strpos(substr(txt, a + 1), term[2]) > 0 THEN a + strpos(substr(txt, a + 1), term[2]) ELSE 0 END AS z FROM t),
s AS (SELECT id, label, term, max(weight * CASE WHEN txt = term THEN 100 WHEN pos = 1 THEN 80 WHEN pos > 1 AND regexp_matches(substr(txt, pos - 1, 1), '[\s(:/,-]') THEN 70 WHEN pos > 1 THEN 60 WHEN z > 0 THEN 10 + round(40.0 / (z - a + 1)) ELSE 0 END) AS best FROM u GROUP BY ALL),
r AS (SELECT id, min(best) AS least, sum(best) + floor(20.0 * sum(CASE WHEN contains(label, term) THEN 2 ELSE 0 END) / any_value(length(label)) + 0.5) AS score FROM s GROUP BY id)
SELECT id, score::INT AS score FROM r WHERE least > 0 ORDER BY score DESC, id LIMIT 50
""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best parts for a query; the limit is the feature."""
    score = T.search_score("re st", F.col("p_name"), F.array("p_type"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), score.alias("score")).filter("score IS NOT NULL").orderBy(F.col("score").desc(), "id").limit(50)


@query("guarded_csv", r"""
WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '=' || s_name WHEN s_suppkey % 3 = 1 THEN s_name || ', "Ltd"' ELSE s_name END AS a, floor(s_acctbal)::BIGINT::VARCHAR AS b FROM supplier),
g AS (SELECT s_suppkey, CASE WHEN regexp_matches(a, '^[=+@-]') THEN '''' || a ELSE a END AS a, b FROM c)
SELECT s_suppkey AS id, CASE WHEN regexp_matches(a, '[",]') THEN '"' || replace(a, '"', '""') || '"' ELSE a END || ',' || b AS line FROM g
""")
def guarded_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("="), "s_name")).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(', "Ltd"'))).otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.csv_line(name, F.floor("s_acctbal").cast("long")).alias("line"))
