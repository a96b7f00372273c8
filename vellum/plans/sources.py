"""Queries of recorded pages, exports, note regions, codecs, own words, redaction and bounded stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import identifiers as I
from vellum.functions import markup, metadata, prose
from vellum.functions import text as T
from vellum.operators import funnel, statuslog
from vellum.plans.quality import pick
from vellum.plans.registry import query
from vellum.session import table
from vellum.sources import notes, records, sinks
from vellum.streaming import events


@query("search_pages", """
WITH i AS (SELECT c_nationkey AS watch, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer)
SELECT watch, c_custkey::VARCHAR AS id, pos::INT AS pos, total::BIGINT AS total FROM i
""")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recorded search page per nation."""
    ids = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("watch")).agg(F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    page = F.to_json(F.struct(F.struct(F.size("ids").cast("string").alias("count"), F.transform("ids", lambda x: x.cast("string")).alias("idlist")).alias("esearchresult")))
    return records.found_ids(ids.select("watch", page.alias("json")))


@query("summary_pages", """
SELECT p_partkey::VARCHAR AS id, p_name AS title, (2000 + p_size)::VARCHAR AS year, p_brand AS journal, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/p' || p_partkey ELSE '' END AS doi, 'Lee A;Wu B' AS authors FROM part WHERE p_partkey % 5 <> 0
""")
def summary_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded summaries, one page per part; every fifth entry is an error."""
    key = F.col("p_partkey").cast("string")
    ids = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.lit("pubmed").alias("idtype"), key.alias("value")), F.struct(F.lit("doi").alias("idtype"), F.concat(F.lit("10.1000/P"), key).alias("value")))).otherwise(F.array(F.struct(F.lit("pubmed").alias("idtype"), key.alias("value"))))
    entry = F.struct(
        key.alias("uid"), F.concat("p_name", F.lit(".")).alias("title"), F.concat((2000 + F.col("p_size")).cast("string"), F.lit(" Mar")).alias("pubdate"), F.col("p_brand").alias("source"),
        F.when(F.col("p_partkey") % 5 == 0, "not found").alias("error"), F.array(F.struct(F.lit("Lee A").alias("name")), F.struct(F.lit("Wu B").alias("name"))).alias("authors"), ids.alias("articleids"),
    )
    page = F.concat(F.lit('{"result": {"uids": ["'), key, F.lit('"], "'), key, F.lit('": '), F.to_json(entry), F.lit("}}"))
    found = records.summaries(table(spark, sf_dir, "part").select(page.alias("json")))
    return found.withColumn("authors", F.array_join("authors", ";"))


@query("citation_pages", """
SELECT o_custkey AS seed, 'cites' AS direction, 'W' || o_orderkey AS work, '10.1000/o' || o_orderkey AS doi, o_orderpriority AS title, year(o_orderdate)::INT AS year, 'article' AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END::BIGINT AS cited_by, (o_orderkey + 1)::VARCHAR AS pmid FROM orders
""")
def citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded pages of citing works, one per customer."""
    key = F.col("o_orderkey")
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), key.cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.1000/O"), key.cast("string")).alias("doi"), F.col("o_orderpriority").alias("display_name"), F.year("o_orderdate").alias("publication_year"),
        F.lit("article").alias("type"), F.when(key % 2 == 0, key).alias("cited_by_count"), F.struct(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), (key + 1).cast("string")).alias("pmid")).alias("ids"),
    )
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seed")).agg(F.to_json(F.struct(F.collect_list(work).alias("results"))).alias("json"))
    return records.works(pages.select("seed", F.lit("cites").alias("direction"), "json"))


@query("search_addresses", """
SELECT c_custkey AS id, 'https://example.org/s?db=pubmed&term=' || replace(c_name, '#', '%23') || '%20AND%20x' AS address, CASE WHEN c_custkey % 2 = 0 THEN '("older adults" OR aged) AND falls' ELSE 'falls' END AS terms FROM customer
""")
def search_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = records.search_address("https://example.org/s", db="pubmed", term=F.concat("c_name", F.lit(" AND x")), key="")
    terms = records.pico_query([F.when(F.col("c_custkey") % 2 == 0, "older adults; aged, aged"), F.lit("falls"), F.lit("")])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), address.alias("address"), terms.alias("terms"))


@query("export_entries", r"""
SELECT p_partkey AS id, '@article{k' || p_partkey || ',' || chr(10) || '  author = {Lee, A and WHO},' || chr(10) || '  title = {' || replace(p_brand, '#', '\#') || '},' || chr(10) || '  year = {' || (2000 + p_size) || '}' || chr(10) || '}' AS text,
       p_brand AS title, (2000 + p_size)::BIGINT AS year, 'Lee' AS family, 'WHO' AS literal FROM part
""")
def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    creators = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("lastName", "firstName", "name"), x, strict=True)]) for x in (("Lee", "A", ""), ("", "", "WHO"))])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.lit("article").alias("type"), F.col("p_brand").alias("title"), (2000 + F.col("p_size")).cast("string").alias("year"), F.lit("").alias("doi"), creators.alias("creators")
    )
    value = lambda path: F.get_json_object("json", path)
    csl = records.csl_json(rows).select("id", value("$.title").alias("title"), value("$.issued.date-parts[0][0]").cast("long").alias("year"), value("$.author[0].family").alias("family"), value("$.author[1].literal").alias("literal"))
    return records.bibtex(rows).join(csl, "id")


@query("note_regions", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'mine' || chr(10) || '<s>' || chr(10) || event_type || chr(10) || '<e>' || chr(10) || 'after' WHEN 1 THEN 'own words' || chr(10) || chr(10) || '<s>' || chr(10) || event_type || chr(10) || '<e>' || chr(10) ELSE '<s>' || chr(10) || event_type || chr(10) || '<e>' END AS text FROM events
""")
def note_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = pick(F.col("event_id"), "mine\n<s>\nold\n<e>\nafter", "own words \n", "")
    return table(spark, sf_dir, "events").select("event_id", notes.replace_region(note, F.col("event_type"), "<s>", "<e>").alias("text"))


@query("config_lines", "SELECT n_nationkey AS owner, 2 AS pos, n_name || ' = x' AS line FROM nation UNION ALL SELECT n_nationkey, 5, 'last' FROM nation")
def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner"), F.concat(F.lit("# head\n  "), F.col("n_name"), F.lit(" = x \n\n// no\r\nlast")).alias("text"))
    return notes.config_lines(rows, "owner")


@query("codecs", """
SELECT o_orderkey AS id, 'u-' || o_orderkey || '_002ea' AS encoded, 'u/' || o_orderkey || '.a' AS decoded, lower(substr(md5(o_orderkey::VARCHAR), 1, 8) || '-' || substr(md5(o_orderkey::VARCHAR), 9, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 13, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 17, 4) || '-' || substr(md5(o_orderkey::VARCHAR), 21)) AS uuid,
       o_orderstatus AS status, o_orderkey::VARCHAR AS pmid, 'a b ' || o_orderkey AS file, 'x;' || o_orderpriority AS parts, 'A < B & C' || chr(10) || 'd' AS entities FROM orders
""")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    encoded = markup.encoded_id(F.concat(F.lit("u/"), key, F.lit(".a")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), encoded.alias("encoded"), markup.decoded_id(encoded).alias("decoded"), prose.uuid_of(F.concat(F.lit("https://x.example/Title-"), F.upper(F.md5(key)), F.lit("?v=1"))).alias("uuid"),
        metadata.status_of_tag(F.concat(F.lit("status/"), F.col("o_orderstatus"), F.lit(" ✅"))).alias("status"), I.pmid_of(F.concat(F.lit("PMID: "), key)).alias("pmid"), metadata.file_name(F.concat(F.lit("a/b: "), key, F.lit("?."))).alias("file"),
        F.array_join(prose.split_values(F.concat(F.lit("x；n/a; "), F.col("o_orderpriority"), F.lit("，x"))), ";").alias("parts"), prose.decode_entities(F.lit("<b>A &lt; B &amp; C</b><br/>d")).alias("entities"),
    )


@query("chinese_items", """
SELECT p_partkey AS id, p_partkey % 4 IN (0, 2) AS chinese FROM part
""")
def chinese_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.array(pick(k, "Lee", "陳美玲", "陳美玲", "Lee"))
    return table(spark, sf_dir, "part").select(k.alias("id"), prose.is_chinese(pick(k, "護理", "Nursing", "", "看護のテスト"), names, F.lit("en")).alias("chinese"))


SIGNS = "#[]%<>`!@|-"


@query("own_words", f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{SIGNS}', '') AS t FROM documents)
SELECT doc_id, chr(10) || t || ' of alias and plain' || chr(10) || chr(10) || chr(10) || 'end ' AS words, 'plain,target' || doc_id AS links FROM d
""")
def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, without signs of markup, as the own words of notes full of everything else."""
    text = F.translate(F.coalesce("text", F.lit("")), SIGNS, "")
    note = F.concat(F.lit("---\na: 1\n---\n# Head\n"), text, F.lit(" of [[x|alias]] and [[plain]]![[pic]]\n```\ncode [[no]]\n```\n%% vellum:start %%\nmine\n%% vellum:end %%\n<!-- a\nb -->end [-@cite2020]%% c\nd %%"))
    links = F.array_join(F.array_sort(T.wikilinks(F.concat(F.lit("[[target"), F.col("doc_id").cast("string"), F.lit("|x]] [[plain#h]] ![[no]]")))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", T.user_text(note).alias("words"), links.alias("links"))


@query("redacted_logs", """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'open <path> at line ' || o_orderkey WHEN 1 THEN 'GET <url> failed ' || o_orderkey WHEN 2 THEN 'mail <email>, key <token>' WHEN 3 THEN 'page <id> of "…"' WHEN 4 THEN 'token=<token> in <file> ' || o_orderkey ELSE 'pref "a.b" of <hidden> and/or ' || o_orderkey END AS text FROM orders
""")
def redacted_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = (
        "open C:\\Users\\Bob Chen\\My Vault\\x #.md at line #", "GET https://api.example.org/v1?q=#  failed\n#", "mail bob.#@ntu.edu.tw, key pk_live_abcdef#", 'page 01234567-89ab-cdef-0123-456789abcdef of "Title no #"',
        "token=abcdef# in paper#.pdf #", 'pref "a.b" of My Vault and/or #',
    )
    text = F.replace(pick(F.col("o_orderkey"), *forms), F.lit("#"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.redact(text, ("My Vault",)).alias("text"))


@query("tag_changes", """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'ta/exclude' WHEN 1 THEN 'ta/exclude' ELSE '' END AS removed, CASE o_orderkey % 3 WHEN 0 THEN 'ta/include' ELSE '' END AS added FROM orders
""")
def tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.when(k % 3 == 2, F.array(F.lit("x"), F.lit("ta/include"))).otherwise(F.array(F.lit("ta/exclude"), F.lit("x"), F.lit("ft/include")))
    plan = funnel.plan_change(tags, F.lit("ta"), F.when(k % 3 == 1, F.lit("")).otherwise("include"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.array_join(plan["remove"], ",").alias("removed"), F.array_join(plan["add"], ",").alias("added"))


@query("own_changes", """
SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND e.ts BETWEEN o.ts AND o.ts + INTERVAL 16 SECOND)
""")
def own_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("user_id").alias("key"), "ts", "event_type")
    return events.suppress_own(seen, seen.filter("event_type = 'error'").select("key", "ts")).select("event_id", "user_id")


@query("kept_scopes", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n <= 3
""")
def kept_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuslog.keep_last(table(spark, sf_dir, "events"), 3, "ts", "user_id").select("user_id", "event_id")


@query("versions_kept", """
SELECT c_custkey AS id, 1 AS version, 'history' AS part, c_name AS name FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END, 'current', CASE WHEN c_custkey % 3 = 0 THEN c_name || '*' ELSE c_name END FROM customer
""")
def versions_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    changes = current.filter("id % 3 = 0").select("id", F.concat("name", F.lit("*")).alias("name"), F.lit(2).alias("version"))
    now, history = sinks.with_history(current, current.limit(0), changes, "id", "version")
    return now.withColumn("part", F.lit("current")).unionByName(history.withColumn("part", F.lit("history"))).select("id", "version", "part", "name")
