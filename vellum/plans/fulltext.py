"""Queries of page texts, quotes placed in texts, and evidence verified by its quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import fulltext, placement
from vellum.plans.registry import query
from vellum.session import table

PAGE_LINES = 8


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of eight lines with a running head and a page number."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.split("text", "\n").alias("lines"))
    page = F.explode(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / PAGE_LINES).cast("int"))).alias("page")
    paged = lines.select("doc", "lines", page)
    number = (F.col("page") + 1).cast("string")
    body = F.array_join(F.slice("lines", F.col("page") * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n")
    return paged.select("doc", "page", F.concat(F.lit("Journal of Trials "), number, F.lit("\n"), body, F.lit("\n"), number).alias("text"))


@query("page_text", rf"""
WITH b AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
l AS (SELECT doc, k // {PAGE_LINES} AS page, k % {PAGE_LINES} + 1 AS line, text FROM b
      UNION ALL SELECT DISTINCT doc, k // {PAGE_LINES}, 0, 'Journal of Trials ' || (k // {PAGE_LINES} + 1) FROM b UNION ALL SELECT DISTINCT doc, k // {PAGE_LINES}, 99, (k // {PAGE_LINES} + 1)::VARCHAR FROM b),
t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS own FROM l),
e AS (SELECT *, sum((own <> '')::INT) OVER (PARTITION BY doc, page ORDER BY line) AS down, sum((own <> '')::INT) OVER (PARTITION BY doc, page) AS total, max(page) OVER (PARTITION BY doc) + 1 AS pages FROM t),
k AS (SELECT *, CASE WHEN own <> '' AND (down <= 3 OR down > total - 3) THEN regexp_replace(lower(own), '\d+', '#', 'g') END AS key FROM e),
n AS (SELECT doc, key, count(DISTINCT page) AS n FROM k WHERE key IS NOT NULL GROUP BY ALL),
r AS (SELECT k.* FROM k LEFT JOIN n USING (doc, key) WHERE NOT coalesce(pages >= 3 AND n >= greatest(3, ceil(pages * 0.3)) AND NOT ((length(own) > 60 AND regexp_matches(own, '[.!?]$')) OR (length(own) > 100 AND NOT (length(own) <= 250 AND regexp_matches(lower(own), 'https?://|www\.|downloaded|copyright|©|all rights reserved|licen[cs]e|terms and conditions')))), false)),
s AS (SELECT *, sum((own <> '')::INT) OVER (PARTITION BY doc, page ORDER BY line) AS d, sum((own <> '')::INT) OVER (PARTITION BY doc, page ORDER BY line DESC) AS u FROM r),
x AS (SELECT doc, page, line, own FROM s WHERE NOT (pages > 1 AND own <> '' AND (d = 1 OR u = 1) AND regexp_matches(lower(own), '^(?:(?:page|pp?\.?)\s*)?[-–—]?\s*\d{{1,4}}\s*[-–—]?(?:\s*(?:of|/)\s*\d{{1,4}})?$'))),
p AS (SELECT doc, own AS a, lead(own) OVER (PARTITION BY doc ORDER BY page, line) AS b FROM x),
w AS (SELECT doc, count(*) >= 3 AND count(*) FILTER (regexp_matches(b, '^\p{{Ll}}') OR regexp_matches(a, '\p{{L}}-$')) >= count(*) * 0.25 AS wrapped FROM p WHERE a <> '' AND b <> '' AND a[1] <> '|' AND b[1] <> '|' GROUP BY doc),
i AS (SELECT x.*, coalesce(lag(own) OVER o, '') = '' OR own[1] = '|' OR lag(own) OVER o LIKE '|%' OR NOT coalesce(wrapped, false) AS starts FROM x LEFT JOIN w USING (doc) WINDOW o AS (PARTITION BY doc, page ORDER BY line)),
j AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc ORDER BY page, line) AS part FROM i),
q AS (SELECT doc, part, page, string_agg(own, ' ' ORDER BY line) AS text FROM j WHERE own <> '' GROUP BY ALL),
y AS (SELECT *, lag(page) OVER o = page OR lag(text) OVER o LIKE '|%' OR text[1] = '|' OR regexp_matches(lag(text) OVER o, '[.!?:;\])”"''’]\s*$') OR NOT regexp_matches(text, '^\p{{Ll}}') AS starts FROM q WINDOW o AS (PARTITION BY doc ORDER BY part)),
z AS (SELECT *, sum(coalesce(starts, true)::INT) OVER (PARTITION BY doc ORDER BY part) AS island FROM y)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY island) - 1 AS pos, min(page) AS first_page, max(page) AS last_page, CASE WHEN string_agg(text, ' ' ORDER BY part)[1] = '|' THEN 'table' ELSE 'text' END AS kind, string_agg(text, ' ' ORDER BY part) AS text
FROM z GROUP BY doc, island
""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents read from pages, without running heads and page numbers."""
    return fulltext.paragraphs(book_pages(spark, sf_dir)).select("doc", "pos", F.col("first_page").cast("long").alias("first_page"), F.col("last_page").cast("long").alias("last_page"), "kind", "text")


EVERY, LONG = 20, 6

WORDS_SQL = r"""
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+') AS w, string_split_regex(coalesce(text, ''), '[\p{L}\p{M}\p{N}]+') AS g FROM documents)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)).alias("w"))


@query("placed_quotes", rf"""
WITH RECURSIVE {WORDS_SQL},
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(g[:len(w)]) AS gap FROM d),
o AS (SELECT doc_id, i, sum(length(word) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(word) AS size FROM u),
q AS (SELECT doc_id, len(w) // {EVERY} AS n, list_transform(w, lambda x: lower(x)) AS w FROM d),
m AS (SELECT doc_id, n, ' ' || array_to_string(w, ' ') || ' ' AS line, list_transform(range(n), lambda k: ' ' || array_to_string(list_slice(w, k * {EVERY} + 1, k * {EVERY} + {LONG}), ' ') || ' ') AS quotes FROM q WHERE n > 0),
r AS (SELECT doc_id, -1 AS pos, 1::BIGINT AS from_sign, 0::BIGINT AS place FROM m
      UNION ALL
      SELECT doc_id, pos, place + length(quote) - 1, place FROM (SELECT r.doc_id, pos + 1 AS pos, quotes[pos + 2] AS quote, from_sign - 1 + strpos(substr(line, from_sign), quotes[pos + 2]) AS place FROM r JOIN m USING (doc_id) WHERE pos + 1 < n)),
s AS (SELECT doc_id, pos, length(substr(line, 1, place)) - length(replace(substr(line, 1, place), ' ', '')) AS first FROM r JOIN m USING (doc_id) WHERE pos >= 0)
SELECT s.doc_id, s.pos::INT AS pos, (a.stop - a.size)::INT AS start, b.stop::INT AS "end" FROM s JOIN o a ON a.doc_id = s.doc_id AND a.i = s.first JOIN o b ON b.doc_id = s.doc_id AND b.i = s.first + {LONG} - 1
""")
def placed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six words of every twenty of each document, with other signs between them, placed in its text in reading order."""
    words = _words(spark, sf_dir)
    n = F.floor(F.size("w") / EVERY).cast("int")
    # Only quotes leave the words of a text: exploded beside them, each quote would carry all.
    quote = lambda pos: F.struct(pos.alias("pos"), F.array_join(F.slice("w", pos * EVERY + 1, F.lit(LONG)), " - ").alias("quote"))
    quotes = words.select(F.col("doc_id").alias("text_id"), F.explode(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), quote))).alias("q")).select("text_id", "q.pos", F.col("q.pos").alias("quote_id"), "q.quote")
    found = placement.placed(quotes, words.select(F.col("doc_id").alias("text_id"), "text"))
    return found.select(F.col("text_id").alias("doc_id"), "pos", F.get(F.get("spans", F.lit(0)), F.lit(0)).alias("start"), F.get(F.get("spans", F.lit(0)), F.lit(1)).alias("end"))


PAGE_WORDS = 50


@query("verified_evidence", rf"""
WITH {WORDS_SQL},
e AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w, unnest(range(len(w) // {EVERY})) AS n FROM d),
q AS (SELECT *, CASE WHEN n % 3 = 1 THEN ['never', 'xq' || n, 'said', 'xr' || n, 'by', 'xs' || n] ELSE w[n * {EVERY} + 1:n * {EVERY} + {LONG}] END AS quote FROM e),
v AS (SELECT doc_id, n, n % 3 <> 1 AS kept, CASE WHEN n % 3 <> 1 THEN (SELECT min(p) FROM range(len(w) // {PAGE_WORDS} + 1) r(p) WHERE contains(' ' || array_to_string(w[p * {PAGE_WORDS} + 1:p * {PAGE_WORDS} + {PAGE_WORDS}], ' ') || ' ', ' ' || array_to_string(quote, ' ') || ' ')) END AS page FROM q)
SELECT doc_id, n // 6 AS item, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, count(page) AS located, count(*) FILTER (kept) = 0 AS low_confidence FROM v GROUP BY ALL
""")
def verified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every document, a third of them made up, verified in its text and on its pages of fifty words; six quotes an item."""
    words = _words(spark, sf_dir)
    n = F.floor(F.size("w") / EVERY).cast("int")
    made_up = F.concat_ws(" ", F.lit("never"), *[x for sign, word in (("xq", "said"), ("xr", "by"), ("xs", "")) for x in (F.concat(F.lit(sign), F.col("n").cast("string")), F.lit(word))])
    piece = lambda k, every, size: F.struct(k.alias("k"), F.array_join(F.slice("w", k * every + 1, F.lit(size)), " ").alias("text"))
    numbers = F.sequence(F.lit(0), n - 1)
    said = words.select(F.col("doc_id").alias("text_id"), F.explode(F.when(n > 0, F.transform(numbers, lambda k: piece(k, EVERY, LONG)))).alias("q")).select("text_id", F.col("q.k").alias("n"), "q.text")
    quotes = said.select("text_id", F.floor(F.col("n") / 6).alias("item"), "n", F.when(F.col("n") % 3 == 1, made_up).otherwise(F.col("text")).alias("quote"), F.lit(None).cast("int").alias("page"))
    every_page = F.sequence(F.lit(0), F.floor(F.size("w") / PAGE_WORDS).cast("int"))
    pages = words.select(F.col("doc_id").alias("text_id"), F.explode(F.transform(every_page, lambda k: piece(k, PAGE_WORDS, PAGE_WORDS))).alias("p")).select("text_id", F.col("p.k").alias("page"), "p.text")
    verified = placement.verified_quotes(quotes, words.select(F.col("doc_id").alias("text_id"), "text"), pages)
    return placement.verified_items(quotes.select("text_id", "item"), verified).withColumnRenamed("text_id", "doc_id")
