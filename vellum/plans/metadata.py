"""Queries of metadata repair, study data and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import analyser, markup
from vellum.functions import metadata as M
from vellum.functions.text import headings
from vellum.plans.registry import query
from vellum.session import spread, table
from vellum.storage import store

FIELDS = {
    "doi": "CASE p_partkey % 4 WHEN 0 THEN 'https://doi.org/10.1000/' || p_size WHEN 1 THEN '10.1000/' || p_size WHEN 2 THEN 'n/a' END",
    "pages": "CASE p_partkey % 5 WHEN 0 THEN 'pp. ' || p_size || '~' || (p_size + 9) WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN 'p.' || p_size WHEN 3 THEN 'see p_size' END",
    "volume": "CASE p_partkey % 3 WHEN 0 THEN p_size || ' (2)' WHEN 1 THEN 'Vol. ' || p_size ELSE CAST(p_size AS STRING) END",
    "issue": "CASE p_partkey % 7 WHEN 0 THEN 'No. 3' WHEN 1 THEN '4' END",
    "date": "CASE p_partkey % 6 WHEN 0 THEN '112/04' WHEN 1 THEN '2020' WHEN 2 THEN '99.13.01' END",
    "title": "p_name",
}


@query("metadata_findings", f"""
WITH r AS (SELECT p_partkey AS id, p_size AS n, {", ".join(f"{x.replace('CAST(p_size AS STRING)', 'p_size::VARCHAR')} AS {k}" for k, x in FIELDS.items())} FROM part),
f AS (
  SELECT id, 'doi' AS field, 'form' AS problem, doi AS current, '10.1000/' || n AS suggested, true AS sure FROM r WHERE id % 4 = 0
  UNION ALL SELECT id, 'doi', 'invalid', doi, '', false FROM r WHERE id % 4 = 2
  UNION ALL SELECT id, 'pages', 'form', pages, n || '-' || (n + 9), true FROM r WHERE id % 5 = 0
  UNION ALL SELECT id, 'pages', 'form', pages, n::VARCHAR, true FROM r WHERE id % 5 = 2
  UNION ALL SELECT id, 'volume', 'issue inside', volume, n::VARCHAR, true FROM r WHERE id % 3 = 0 AND issue IS NULL
  UNION ALL SELECT id, 'issue', 'in volume', '', '2', true FROM r WHERE id % 3 = 0 AND issue IS NULL
  UNION ALL SELECT id, 'volume', 'form', volume, n::VARCHAR, true FROM r WHERE id % 3 = 1
  UNION ALL SELECT id, 'issue', 'form', issue, '3', true FROM r WHERE id % 7 = 0
  UNION ALL SELECT id, 'date', 'republic year', date, '2023-04', false FROM r WHERE id % 6 = 0)
SELECT * FROM f
""")
def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = {k: F.expr(x) for k, x in FIELDS.items()}
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select(F.col("p_partkey").alias("id"), F.inline(M.findings(record)))


@query("metadata_repaired", f"""
WITH r AS (SELECT p_partkey AS id, p_size AS n, {", ".join(f"{x.replace('CAST(p_size AS STRING)', 'p_size::VARCHAR')} AS {k}" for k, x in FIELDS.items())} FROM part)
SELECT id, CASE WHEN id % 4 = 0 THEN '10.1000/' || n ELSE doi END AS doi, CASE WHEN id % 5 = 0 THEN n || '-' || (n + 9) WHEN id % 5 = 2 THEN n::VARCHAR ELSE pages END AS pages,
       CASE WHEN id % 3 = 0 AND issue IS NULL OR id % 3 = 1 THEN n::VARCHAR ELSE volume END AS volume, CASE WHEN id % 3 = 0 AND issue IS NULL THEN '2' WHEN id % 7 = 0 THEN '3' ELSE issue END AS issue, date, title FROM r
""")
def metadata_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = {k: F.expr(x) for k, x in FIELDS.items()}
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select(F.col("p_partkey").alias("id"), *[c.alias(k) for k, c in record.items()])
    fields = {k: F.col(k) for k in record}
    found = rows.withColumn("found", M.findings(fields))
    return found.select("id", *[c.alias(k) for k, c in M.apply_findings(fields, F.col("found")).items()])


@query("study_data", r"""
WITH r AS (SELECT p_partkey AS id, p_size AS n, ['RCT of x', 'Systematic review and meta-analysis', 'n/a', 'a survey', 'before-and-after', 'odd'][(p_partkey % 6 + 1)::INT] AS d FROM part)
SELECT id, CASE id % 6 WHEN 0 THEN 'RCT' WHEN 1 THEN 'meta-analysis' WHEN 2 THEN '' WHEN 3 THEN 'cross-sectional' WHEN 4 THEN 'quasi-experimental' ELSE 'other' END AS design,
       CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN 1000 + n ELSE n END::BIGINT AS sample_size, CASE n % 4 WHEN 0 THEN '4' WHEN 1 THEN '2' WHEN 2 THEN '' ELSE '3' END AS level FROM r
""")
def study_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    design = F.element_at(F.array(*map(F.lit, ["RCT of x", "Systematic review and meta-analysis", "n/a", "a survey", "before-and-after", "odd"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    size = F.when(n % 3 == 0, "not reported").when(n % 3 == 1, F.concat(F.lit("N = 1,"), F.lpad(n.cast("string"), 3, "0"))).otherwise(F.concat(n.cast("string"), F.lit(" adults")))
    level = F.when(n % 4 == 0, "Level IV").when(n % 4 == 1, "CEBM 2011 level 2").when(n % 4 == 2, "unclear").otherwise("3b")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), M.normalize_design(design).alias("design"), M.sample_size(size).alias("sample_size"), M.evidence_level(level).alias("level"))


@query("short_citations", """
WITH a AS (SELECT p_partkey, list(DISTINCT s_name ORDER BY s_name) AS names FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
b AS (SELECT p_partkey, list_filter(names, lambda x: x IS NOT NULL) AS names FROM a)
SELECT p_partkey AS id, '(' || CASE WHEN coalesce(len(names), 0) = 0 THEN 'Anonymous' WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 THEN names[1] || ' & ' || names[2] ELSE names[1] || ' et al.' END || ', n.d.)' AS citation FROM b
""")
def short_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, items, suppliers = (table(spark, sf_dir, t) for t in ("part", "lineitem", "supplier"))
    links = items.select("l_partkey", "l_suppkey").distinct().join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    creator = F.struct(F.col("s_name").alias("lastName"), F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("name"), F.lit("author").alias("creatorType"))
    by = links.groupBy("l_partkey").agg(F.sort_array(F.collect_list(creator)).alias("creators"))
    joined = parts.join(by, F.col("p_partkey") == F.col("l_partkey"), "left")
    return joined.select(F.col("p_partkey").alias("id"), M.short_citation(M.author_names(F.col("creators")), F.lit(None).cast("string")).alias("citation"))


@query("answer_words", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'unclear' WHEN 4 THEN 'not applicable' ELSE '' END AS answer FROM lineitem
""")
def answer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.coalesce(F.get(F.array(*map(F.lit, ["**Yes**", "N", "Can't tell", "n/a", "perhaps"])), (F.col("l_linenumber") - 1).cast("int")), F.lit(""))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.normalize_answer(word).alias("answer"))


@query("html_to_md")
def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_to_md(F.col("html")).alias("markdown"))


@query("md_outline")
def md_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of every page, by way of its Markdown."""
    rows = table(spark, sf_dir, "pages").select("page_id", markup.html_to_md(F.col("html")).alias("md"))
    return rows.select("page_id", F.posexplode(headings(F.col("md"))).alias("pos", "h")).select("page_id", "pos", "h.level", "h.title")


@query("loose_json", """
SELECT event_id AS id, CASE WHEN event_id % 4 < 3 THEN '{"k":' || (props::JSON->>'k') || '}' END AS parsed FROM events
""")
def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e = F.col("props"), F.col("event_id")
    text = F.when(e % 4 == 0, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nDone"))).when(e % 4 == 1, F.replace(p, F.lit("}"), F.lit(",}"))).when(e % 4 == 2, F.replace(p, F.lit("}"), F.lit(", \"cut"))).otherwise(F.lit("none"))
    return table(spark, sf_dir, "events").select(e.alias("id"), markup.parse_loose(text).alias("parsed"))


ANALYSED = (
    ("date", "民國112年", "2023"), ("volume", "70(2)", "70(2)"), ("pages", "第45至56頁", "45-56"), ("DOI", "doi:10.6224/JN.1", "10.6224/JN.1"), ("DOI-bad", "10.6224", ""), ("language", "繁體中文", "zh-TW"), ("publicationTitle", "《護理雜誌》", "護理雜誌"), ("title", "護理,研究。", "護理，研究"),
)


@query("analysed_records", f"""
WITH k(i, kind, suggested) AS (VALUES {", ".join(f"({i}, '{kind}', '{suggested}')" for i, (kind, _, suggested) in enumerate(ANALYSED))})
SELECT p_partkey AS id, kind, suggested, kind <> 'DOI-bad' AS sure FROM part JOIN k ON i = p_partkey % {len(ANALYSED) + 1}
UNION ALL SELECT p_partkey, 'volume-missing', '', false FROM part WHERE p_size % 5 = 0 AND p_partkey % {len(ANALYSED) + 1} <> 2
""")
def analysed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Chinese records with one thing wrong each, and some without pages; every ninth is right."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    wrong = lambda name, right: F.coalesce(*[F.when(F.col("p_partkey") % (len(ANALYSED) + 1) == i, bad) for i, (kind, bad, _) in enumerate(ANALYSED) if kind.split("-")[0] == name], F.lit(right))
    right = {"itemType": "journalArticle", "title": "護理人員的經驗", "date": "2023-04", "volume": "70", "pages": "45-56", "DOI": "10.6224/JN.7", "language": "zh-TW", "publicationTitle": "護理雜誌"}
    fields = {name: wrong(name, right[name]) if name in right else F.lit(None).cast("string") for name in analyser.FIELDS}
    fields["pages"] = F.when((F.col("p_size") % 5 == 0) & (F.col("p_partkey") % (len(ANALYSED) + 1) != 2), F.lit(None)).otherwise(fields["pages"])
    records = part.select(F.col("p_partkey").alias("id"), *[column.alias(name) for name, column in fields.items()], F.lit(None).cast(analyser.CREATORS).alias("creators"))
    found = store(analyser.analyse(store(records, "records"), "陳林王李張黃").select("id", "findings"), "findings")
    found = found.select("id", F.explode("findings").alias("f"))  # of a stored table: else the tests for findings would be repeated below it
    return found.select("id", "f.kind", "f.suggested", "f.sure")
