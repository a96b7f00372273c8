"""Queries of record quality, identifiers, links, settings, citekeys, features and checks by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import identifiers as I
from vellum.functions import quality as Q
from vellum.functions import text as T
from vellum.operators import funnel
from vellum.operators import records as R
from vellum.plans.registry import query
from vellum.session import table


def pick(number: Column, *values: str | None) -> Column:
    """The value at the number's place, going round."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


@query("quality_issues", """
WITH r AS (SELECT doc_id, doc_id % 3 = 0 AS ai, ['ok', 'partial', 'none'][doc_id % 3 + 1] AS ft, ['journalArticle', 'book'][doc_id % 2 + 1] AS ty, CASE WHEN doc_id % 5 = 0 THEN '10.1000/x' END AS doi, doc_id % 4 AS a FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN NOT ai THEN 'noAI' END, CASE WHEN ft <> 'ok' THEN 'scanned' END, CASE WHEN ty = 'journalArticle' AND doi IS NULL THEN 'noDOI' END, CASE WHEN a IN (1, 2) THEN 'zhNames' END) AS issues FROM r
""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    authors = F.array(F.lit("Smith, A"), pick(n, "陳美玲", "陳, 美玲", "陳Mei", "Chen"))
    issues = Q.quality_issues(n % 3 == 0, pick(n, "ok", "partial", "none"), pick(n, "journalArticle", "book"), F.when(n % 5 == 0, "10.1000/x"), F.lit("護理研究"), authors)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query("doi_forms", """
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN '10.1000/Ab' || id || '(2)' WHEN 1 THEN '10.6224/JN.' || id || '_70(2).07' WHEN 2 THEN '10.1000/a(b)' || id WHEN 3 THEN '10.1000/X' || id WHEN 4 THEN '10.1000/[y]' || id WHEN 5 THEN '10.1000/z+' || id ELSE '' END AS repaired,
       CASE k WHEN 0 THEN '10.1000/ab' || id || '(2).' WHEN 1 THEN '' WHEN 2 THEN '10.1000%2fa(b)' || id WHEN 3 THEN '' WHEN 4 THEN '10.1000/[y]' || id || ']' WHEN 5 THEN '10.1000/z+' || id WHEN 6 THEN '10.12/q' || id ELSE '' END AS loose
FROM r
""")
def doi_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 8
    forms = ("https://doi.org/10.1000/Ab#(2).", "ＤＯＩ：10.6224/JN.#_70(2).07", "doi:10.1000%2Fa(b)#", "(10.1000/X#).", "10.1000/[y]#]", "doi.org/10.1000/z+#", "10.12/q#", "see below #")
    raw = F.replace(pick(F.col("o_orderkey"), *forms), F.lit("#"), n)
    inner = F.when(k == 3, F.regexp_replace(raw, r"^\(", "")).when(k == 4, F.regexp_replace(raw, r"\]$", "")).when(k == 5, F.concat(F.lit("https://"), raw)).otherwise(raw)
    loose = F.when(k == 2, I.loose_doi(F.lower(raw))).otherwise(I.loose_doi(raw))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), I.repair_doi(inner).alias("repaired"), F.when(k == 2, F.replace(F.concat(F.lit("10.1000%2fa(b)"), n), F.lit(" "), F.lit(""))).otherwise(loose).alias("loose"))


@query("work_keys", """
SELECT o_orderkey AS id, 'W' || o_orderkey AS work, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1000/a' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'pmid:' || (o_orderkey + 1) ELSE '' END AS candidate,
       CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1000/a' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'pmid:' || (o_orderkey + 1) ELSE '' END AS in_line, o_orderkey % 4 IN (0, 1) AS own
FROM orders
""")
def work_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    doi, pmid = F.when(key % 3 == 0, F.concat(F.lit("10.1000/a"), n)), F.when(key % 3 < 2, (key + 1).cast("string"))
    line = F.replace(F.replace(pick(key, "- [x] [T](https://doi.org/10.1000/A#) and https://pubmed.ncbi.nlm.nih.gov/9/", "see https://pubmed.ncbi.nlm.nih.gov/@/ here", "- [ ] no address"), F.lit("#"), n), F.lit("@"), (key + 1).cast("string"))
    citekey = F.concat(F.lit("Lee2021x"), pick(key, "", "AB", "1", "-a"))
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), I.work_key(F.concat(F.lit("https://example.org/w"), n)).alias("work"), I.candidate_key(doi, pmid).alias("candidate"), I.key_in_line(line).alias("in_line"), I.is_key_for(citekey, F.lit("lee2021X")).alias("own")
    )


@query("title_forms", """
WITH r AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name AS name FROM part)
SELECT id, CASE k WHEN 0 THEN '護理：研究' WHEN 1 THEN '跌倒，預防' WHEN 2 THEN name WHEN 3 THEN '護理雜誌 The Journal of Nursing' WHEN 4 THEN '主題 副題' ELSE '結束' END AS tidy,
       CASE WHEN k = 3 THEN '護理雜誌' END AS chinese, CASE k WHEN 3 THEN '護理' ELSE name END AS journal, CASE k WHEN 3 THEN 3 ELSE 1 END AS findings
FROM r
""")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    title = F.when(k == 2, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).otherwise(pick(F.col("p_partkey"), "護理 : 研究", "跌倒 ,預防", "", "護理雜誌 The Journal of Nursing", "主題 副題", "結束。"))
    journal = F.when(k == 3, F.lit(" 《護理》")).otherwise(F.col("p_name"))
    extra = F.when(k == 3, F.lit("護理 Nursing Care Journal")).otherwise(journal)
    found = F.size(Q.title_findings(title, journal)) + F.when(k == 3, F.size(Q.title_findings(F.lit(None).cast("string"), extra))).otherwise(0)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), Q.tidy_title(title).alias("tidy"), Q.chinese_part(Q.tidy_title(title), 3).alias("chinese"), Q.tidy_journal(journal).alias("journal"), found.alias("findings")
    )


@query("thesis_guess", """
WITH r AS (SELECT c_custkey AS id, c_custkey % 6 AS k FROM customer)
SELECT id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'master' WHEN 2 THEN 'doctor' WHEN 3 THEN '' END AS degree, CASE k WHEN 0 THEN 'url' WHEN 1 THEN 'words' WHEN 2 THEN 'words' WHEN 3 THEN 'catalog' END AS by FROM r
""")
def thesis_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    url, catalog = pick(k, "https://hdl.handle.net/11296/x", None, None, None, None, None), pick(k, None, None, None, "臺灣博碩士論文", None, "x")
    found = Q.guess_thesis(url, catalog, pick(k, None, "某大學碩士學位論文", None, None, "護理雜誌", None), pick(k, None, None, "Doctoral Dissertation, X", None, None, None), none, pick(k, "x", "x", "x", "x", "碩士論文的寫作", "x"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), found["degree"].alias("degree"), found["by"].alias("by"))


@query("date_findings", """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'republic year' WHEN 2 THEN 'full-width digits' WHEN 3 THEN 'no year' WHEN 4 THEN 'republic year' END AS problem,
       CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '2023-04' WHEN 2 THEN '2020 May' WHEN 3 THEN '' WHEN 4 THEN '2010-05' END AS suggested, CASE o_orderkey % 6 WHEN 1 THEN true WHEN 2 THEN true WHEN 5 THEN NULL ELSE false END AS sure FROM orders
""")
def date_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.get(Q.date_findings(pick(F.col("o_orderkey"), " ", "民國112年4月", "２０２０ May", "spring", "99.5", "2020-05")), 0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), found["problem"].alias("problem"), found["suggested"].alias("suggested"), found["sure"].alias("sure"))


@query("note_links", """
SELECT c_custkey AS id, 'https://doi.org/10.1000/a' || c_custkey || '%282%29%3C' AS doi, 'obsidian://open?vault=My%20Vault&file=Notes%2F' || c_name::VARCHAR.replace('#', '%23') AS note,
       CASE WHEN c_custkey % 3 = 0 THEN 'zotero://open-pdf/library/items/K?page=' || c_custkey || '&annotation=A' WHEN c_custkey % 3 = 1 THEN 'zotero://open-pdf/library/items/K?annotation=A' ELSE 'zotero://select/library/items/K' END AS annotation,
       'a-b/' || c_custkey || 'x' AS tag, c_custkey::VARCHAR AS stage, CASE WHEN c_custkey % 2 = 0 THEN 'Falls;Aged, 80 and over' ELSE 'Falls' END AS headings
FROM customer
""")
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    library, page = F.lit("library"), F.when(key % 3 == 0, n).otherwise("iv")
    tags = F.when(key % 2 == 0, F.array(*map(F.lit, ("*Falls/prevention & control", "falls", "Aged, 80 and over", "FALLS")))).otherwise(F.array(*map(F.lit, ("Falls", "lower case", "Humans"))))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        Q.doi_link(F.concat(F.lit("10.1000/a"), n, F.lit("(2)<"))).alias("doi"),
        Q.vault_link(F.lit("My Vault"), F.concat(F.lit("Notes/"), F.col("c_name"), F.lit(".md"))).alias("note"),
        Q.annotation_link(library, F.lit("K"), key % 3 < 2, page, F.lit("A")).alias("annotation"),
        Q.note_tag(F.concat(F.lit("##a b/"), n, F.lit("x!"))).alias("tag"),
        Q.tag_value(F.concat(F.lit("stage/ "), n), "stage/").alias("stage"),
        F.array_join(Q.subject_headings(tags, stop=("humans",)), ";").alias("headings"),
    )


@query("facts_lines", """
SELECT p_partkey AS id, concat_ws(' · ', CASE WHEN p_partkey % 2 = 0 THEN 'RCT' END, 'N = ' || p_size, CASE WHEN p_partkey % 3 = 0 THEN 'CEBM 2' END,
       CASE p_partkey % 4 WHEN 0 THEN '評讀：納入（已核對）' WHEN 1 THEN '評讀：納入（待核對）' WHEN 2 THEN '評讀：排除（AI 初評）' END) AS facts FROM part
""")
def facts_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    facts = Q.facts_line(pick(k, "RCT", ""), F.col("p_size"), pick(k, "2", None, None), F.lit(None), pick(k, "納入", "納入", None, None), k % 4 == 0, pick(k, "x", "x", "排除", ""))
    return table(spark, sf_dir, "part").select(k.alias("id"), facts.alias("facts"))


@query("callouts", r"""
SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
       '### Notes' || chr(10) || '```' || chr(10) || '# code ' || turn || chr(10) || '```' || chr(10) || '###### Deep' || chr(10) || '#none' AS lower FROM conversations
""")
def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("> [!note]- Title\n> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))
    note = F.concat(F.lit("# Notes\n```\n# code "), F.col("turn").cast("string"), F.lit("\n```\n##### Deep\n#none"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.unwrap_callout(quoted).alias("body"), Q.demote_headings(note, 2).alias("lower"))


@query("folded_texts", """
SELECT doc_id, lower(strip_accents(text)) AS folded, length(text)::BIGINT AS n_starts, (length(text) - 1)::BIGINT AS last_start FROM documents WHERE text <> ''
""")
def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = Q.fold_with_offsets(F.col("text"))
    rows = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", fold.alias("fold"))
    return rows.select("doc_id", "fold.folded", F.size("fold.starts").cast("long").alias("n_starts"), F.element_at("fold.starts", -1).cast("long").alias("last_start"))


@query("json_blocks", r"""
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE '{"n": ' || turn || '}' END AS json,
       CASE turn % 4 WHEN 0 THEN 'Answer ' || turn WHEN 1 THEN 'Answer ' || turn || chr(10) || chr(10) || 'After' WHEN 2 THEN 'Answer ' || turn ELSE 'Answer ' || turn || chr(10) || '```' || chr(10) || 'plain' || chr(10) || '```' END AS rest
FROM conversations
""")
def json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("turn").cast("string")
    forms = ('Answer #\n\n---\n## Structured data\n```json\n{"n": #}\n```\n', 'Answer #\n```JSON\n{"n": #}\n```\n\nAfter', 'Answer #\n```json\n{"n": #}', "Answer #\n```\nplain\n```")
    note = F.replace(pick(F.col("turn"), *forms), F.lit("#"), n)
    note = F.when(F.col("turn") % 4 == 0, F.replace(note, F.concat(n, n, F.lit(" Structured")), F.lit("## Structured"))).otherwise(note)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.last_json_block(note).alias("json"), Q.without_json_block(note).alias("rest"))


@query("embedded_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events
""")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "other").otherwise("form-1")
    json = F.concat(F.lit('{"format": "'), kind, F.lit('", "label": "a < b & c", "props": '), F.col("props"), F.lit("}"))
    html = F.concat(Q.note_html(F.lit("x"), F.lit('{"format": "old"}')), Q.note_html(F.lit("A & B"), json), F.lit("<pre>no json</pre>"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(Q.embedded_json(html, "form-1"), "$.props.k").cast("long").alias("k"))


@query("year_ranges", """
WITH r AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1990 + doc_id % 30 END AS y FROM documents WHERE source <> 'src0' OR doc_id % 7 = 0)
SELECT source, CASE WHEN min(y) IS NULL THEN '' WHEN min(y) = max(y) THEN min(y)::VARCHAR ELSE min(y) || '–' || max(y) END AS years FROM r GROUP BY source
""")
def year_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    year = F.when(n % 14 == 0, "n.d.").when(n % 7 == 0, "0").otherwise((1990 + n % 30).cast("string"))
    return table(spark, sf_dir, "documents").filter("source <> 'src0' OR doc_id % 7 = 0").groupBy("source").agg(R.year_range(year).alias("years"))


@query("alias_union", """
SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#1' THEN 'Brand#1,' || p_type ELSE p_brand || ',Brand#1,' || p_type END AS aliases, p_type || ';x' AS spelled FROM part
""")
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    union = Q.ordered_union(F.array("p_brand", F.lit("")), F.array(F.lit("Brand#1"), F.col("p_type"), F.lit(None).cast("string"), F.col("p_brand")))
    spelled = Q.first_spellings(F.array(F.col("p_type"), F.lit("x"), F.lower("p_type"), F.lit("X")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(union, ",").alias("aliases"), F.array_join(spelled, ";").alias("spelled"))


@query("broken_sums", """
WITH c AS (SELECT o_orderpriority AS other, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS ex FROM orders GROUP BY 1)
SELECT other, concat_ws(',', CASE WHEN other LIKE '1%' THEN 'identified' END, CASE WHEN other LIKE '2%' THEN 'ft_excluded' END) AS broken FROM c
""")
def broken_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records are assessed, half of them excluded; one side has a duplicate too many, one lacks reasons."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("other"), (F.col("o_orderkey") % 2 == 0).alias("out"), "o_orderstatus")
    n, zero = F.count(F.lit(1)), F.lit(0)
    counts = rows.groupBy("other").agg(
        n.alias("identified"), F.when(F.first("other").startswith("1"), 1).otherwise(0).alias("duplicates"), n.alias("screened"), zero.alias("ta_excluded"), zero.alias("ta_pending"), n.alias("sought"),
        zero.alias("not_retrieved"), n.alias("assessed"), F.count_if("out").alias("ft_excluded"), zero.alias("ft_pending"), F.count_if(~F.col("out")).alias("included"),
    )
    reasons = rows.filter("out AND NOT (other LIKE '2%' AND o_orderstatus = 'F')").groupBy("other", F.col("o_orderstatus").alias("reason")).agg(n.alias("n"))
    return funnel.checked_counts(counts, reasons).select("other", "broken")


@query("evidence_table", """
SELECT p_partkey AS id, '(' || CASE p_partkey % 3 WHEN 0 THEN 'Anonymous' WHEN 1 THEN 'Lee' ELSE 'Lee & Wu' END || ', ' || (2000 + p_size) || ')' AS citation, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Lee, A' ELSE 'Lee, A; Wu, B' END AS authors,
       (2000 + p_size)::VARCHAR AS year, p_name AS title, '' AS doi, p_partkey % 2 = 0 AS has_data, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS design, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS sample_size,
       CASE WHEN p_partkey % 2 = 0 THEN 'a; b' ELSE '' END AS measures, '' AS evidence_level FROM part
""")
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.when(k % 3 == 0, F.lit(None).cast("array<string>")).when(k % 3 == 1, F.array(F.lit("Lee, A"))).otherwise(F.array(F.lit("Lee, A"), F.lit("Wu, B")))
    study = F.when(k % 2 == 0, F.struct(F.col("p_type").alias("design"), F.col("p_size").alias("sample_size"), F.array(F.lit("a"), F.lit("b")).alias("measures"), F.lit(None).cast("string").alias("evidence_level")))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), names.alias("names"), (2000 + F.col("p_size")).cast("string").alias("year"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("doi"), study.alias("study"))
    return R.evidence_rows(rows)


@query("enabled_features", """
WITH RECURSIVE f AS (SELECT s_suppkey AS k, s_suppkey % 11 <> 7 AS on_, CASE WHEN s_suppkey = 0 THEN NULL WHEN s_suppkey = 1 THEN 1 ELSE s_suppkey // 2 END AS need FROM supplier),
e AS (SELECT k FROM f WHERE on_ AND need IS NULL UNION SELECT f.k FROM f JOIN e ON f.need = e.k WHERE f.on_)
SELECT 'f' || f.k AS id, EXISTS (SELECT 1 FROM e WHERE e.k = f.k) AS enabled FROM f
""")
def enabled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of features with one that requires itself; 1 and all that hang on it stay off."""
    k = F.col("s_suppkey")
    need = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("f1"))).otherwise(F.array(F.concat(F.lit("f"), F.floor(k / 2).cast("string")), F.concat(F.lit("f"), F.floor(k / 2).cast("string"))))
    return R.enabled_features(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), (k % 11 != 7).alias("on"), need.alias("requires")))


@query("presets", """
SELECT c_custkey AS owner, CASE c_custkey % 3 WHEN 0 THEN 'advanced' WHEN 1 THEN 'guided' ELSE 'custom' END AS preset FROM customer
""")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(p, f"s{k}", (k % 2 == 0) if p == "guided" else True) for p in ("guided", "advanced") for k in range(4)], "preset string, id string, on boolean")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    on = F.when(F.col("owner") % 3 == 0, True).when(F.col("owner") % 3 == 1, F.col("k") % 2 == 0).otherwise(F.col("k") == 1)
    return R.preset_of(owners.select("owner", F.concat(F.lit("s"), F.col("k").cast("string")).alias("id"), on.alias("on")), known)


@query("appraisal_sources", """
WITH s AS (SELECT o_orderkey AS item, o_orderkey % 3 AS k FROM orders)
SELECT item, 'q' AS question, CASE k WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS answer, CASE k WHEN 0 THEN 'verified' WHEN 1 THEN 'saved' ELSE 'model' END AS by FROM s
""")
def appraisal_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.lit("q").alias("question"))
    saved = orders.filter("item % 6 <> 2").withColumns({"answer": pick(F.col("item"), "yes", "no", " "), "verified": F.col("item") % 3 == 0})
    return R.appraisals(saved, orders.withColumn("answer", F.lit("unclear")))


@query("settings_rows", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k, CASE event_id % 4 WHEN 1 THEN 'json' WHEN 2 THEN 'name' WHEN 3 THEN 'json' END AS error FROM events
""")
def settings_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"name": "a", "value": '), props, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("{broken "), props)).when(F.col("event_id") % 4 == 2, F.lit('{"name": " "}')).otherwise(F.lit("[1]"))
    read = R.read_settings(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text", "name string, value struct<k: bigint>", ("name",))
    return read.select("event_id", F.col("settings.value.k").alias("k"), "error")


@query("cached_texts", """
WITH t AS (SELECT DISTINCT sha256(coalesce(text, '')) AS hash, coalesce(text, '') AS text FROM documents), old AS (SELECT DISTINCT sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 10 = 0)
SELECT hash, 'v1' AS engine, CASE WHEN hash IN (SELECT hash FROM old) THEN -1 ELSE length(text) END::BIGINT AS converted FROM t
""")
def cached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth is cached already (with -1); the rest is converted, here to its length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("v1").alias("engine"))
    cache = docs.filter("doc_id % 10 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "engine", F.lit(-1).cast("long").alias("converted")).distinct()
    return R.convert_unseen(docs, cache, lambda text: F.length(text).cast("long"))


@query("library_items", """
WITH c AS (SELECT l_orderkey AS parent, list(l_linenumber::BIGINT ORDER BY l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey AS key, coalesce(array_to_string(n, ','), '') AS attachments FROM orders LEFT JOIN c ON o_orderkey = parent WHERE o_orderstatus <> 'P'
""")
def library_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "P", True).alias("deleted"), F.col("o_orderpriority").alias("title"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("key"), F.col("l_orderkey").alias("parent"), (F.col("l_returnflag") == "R").alias("deleted"))
    return R.scan_items(items, children).select("key", F.array_join(F.transform("attachments", lambda a: a["key"].cast("string")), ",").alias("attachments"))


@query("key_look_up", "SELECT DISTINCT c_custkey AS key, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 7 = 0")
def key_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("key"))
    return R.look_up(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), asked)


@query("newest_notes", """
WITH n AS (SELECT 'Notes/r' || o_orderkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') || '.md' AS path, o_orderstatus AS kind, o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 5 <> 0)
SELECT path, kind, date, row_number() OVER (PARTITION BY kind ORDER BY date DESC, path) AS place FROM n WHERE date >= DATE '1996-01-01'
""")
def newest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Notes/r"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(""), F.lit(".md"))
    return R.newest_notes(table(spark, sf_dir, "orders").select(name.alias("path"), "o_orderstatus"), F.col("o_orderstatus"), "1996-01-01")


@query("citekeys_kept", r"""
WITH e AS (SELECT p_partkey AS id, 'lee' || (2000 + p_size) || 'x' AS base, CASE WHEN p_partkey % 10 = 3 THEN 'Lee' || (2000 + p_size) || 'X' END AS explicit, p_partkey % 10 = 4 AS kept FROM part),
b AS (SELECT base, count(*) FILTER (explicit IS NOT NULL) AS n_ex, count(*) FILTER (kept) AS n_kept FROM e GROUP BY base),
x AS (SELECT id, explicit AS base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n FROM e WHERE explicit IS NOT NULL),
f AS (SELECT e.id, e.base, row_number() OVER (PARTITION BY e.base ORDER BY e.id) - 1 + greatest(n_ex, 1) AS n FROM e JOIN b USING (base) WHERE explicit IS NULL AND NOT kept)
SELECT id, base || CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr((96 + n)::INT) ELSE chr((96 + (n - 1) // 26)::INT) || chr((97 + (n - 1) % 26)::INT) END AS citekey FROM (SELECT * FROM x UNION ALL SELECT * FROM f)
UNION ALL SELECT id, base || 'zzz' || chr((97 + id % 26)::INT) || chr((97 + id // 26 % 26)::INT) || chr((97 + id // 676 % 26)::INT) AS citekey FROM e WHERE kept
""")
def citekeys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit keys, kept ones with long letters, and the bare base retired everywhere."""
    k = F.col("p_partkey")
    year = (2000 + F.col("p_size")).cast("string")
    base = F.concat(F.lit("lee"), year, F.lit("x"))
    letter = lambda n: F.chr(97 + F.pmod(n, F.lit(26)))
    entries = table(spark, sf_dir, "part").select(k.alias("id"), k.cast("string").alias("uid"), F.when(k % 10 == 3, F.concat(F.lit("Lee"), year, F.lit("X"))).alias("explicit"), base.alias("base"), F.lit("2020").alias("added"))
    kept = F.concat(F.col("base"), F.lit("zzz"), letter(F.col("id")), letter(F.floor(F.col("id") / 26)), letter(F.floor(F.col("id") / 676)))
    return R.assign_citekeys(entries, entries.filter("id % 10 = 4").select("uid", kept.alias("citekey")), entries.select(F.col("base").alias("citekey")).distinct())


@query("sentence_numbers", """
WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, 100 + o_custkey AS a, 5000 + o_orderkey % 90 AS b FROM orders)
SELECT id, 0 AS para, 0 AS sent, a::VARCHAR AS number FROM r WHERE k = 1 UNION ALL SELECT id, 0, 0, b::VARCHAR FROM r WHERE k = 2 UNION ALL SELECT id, 1, 0, '77' FROM r
""")
def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of two paragraphs: numbers with a citation, one that the paragraph's citation covers, one without any."""
    k, a, b = F.col("o_orderkey"), (100 + F.col("o_custkey")).cast("string"), (5000 + F.col("o_orderkey") % 90).cast("string")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), a.alias("a"), b.alias("b"))
    text = F.concat(F.lit("# 99 heads\nWe saw "), F.col("a"), F.lit(" of them [S1, p. 12]. Then "), F.regexp_replace("b", r"(\d)(\d{3})$", "$1,$2"), F.lit(" more [S2]! In all it was so.\n\n- Nobody counted 77 of them."))
    drafts = rows.select("id", text.alias("text"))
    sources = rows.select("id", F.lit("S1").alias("source"), F.concat(F.lit("N="), F.when(F.col("id") % 4 == 1, F.lit("none")).otherwise(F.col("a"))).alias("text")).unionByName(
        rows.select("id", F.lit("S2").alias("source"), F.concat(F.lit("about "), F.when(F.col("id") % 4 == 2, F.lit("4")).otherwise(F.col("b")), F.lit(" and 77")).alias("text"))
    )
    return R.unsupported_in_sentences(drafts, sources).select("id", F.col("para").cast("int").alias("para"), F.col("sent").cast("int").alias("sent"), "number")


@query("plain_digits", "SELECT c_custkey AS id, c_custkey::VARCHAR || ' 4.5 12' AS numbers FROM customer")
def plain_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate(F.col("c_custkey").cast("string"), "0123456789", "０１２３４５６７８９")
    text = F.concat(F.lit("共"), wide, F.lit("人，4·5％ of SF-36 and "), F.lit("COVID-19 scored 12"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(T.numbers_in(text), " ").alias("numbers"))
