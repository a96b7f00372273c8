"""Queries of usage, agreement and status logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import agreement, ledger, statuslog
from vellum.plans.registry import query
from vellum.session import table

PRICES = {"view": {"input": 3.0, "output": 15.0}, "view-2024": {"input": 1.0, "output": 5.0, "cache_read": 0.25}, "click": {"input": 2.0, "output": 8.0, "cache_write": 3.0}}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model calls; the counters follow from ids so that sums are exact."""
    e = F.col("event_id")
    model = F.concat("event_type", F.element_at(F.array(*map(F.lit, ["", "-2024-05", "-x (batch)", "-2024 (batch)"])), (F.col("user_id") % 4 + 1).cast("int")))
    shifted = F.col("ts") + F.make_dt_interval(days=(F.col("user_id") % 90).cast("int"))
    return table(spark, sf_dir, "events").select(
        shifted.alias("ts"), model.alias("model"), (e % 100).alias("input"), (e % 17).alias("output"), (e % 50).alias("cache_read"), (e % 40).alias("cache_write"), (e % 60).alias("cache_write_1h")
    )


CALLS_SQL = """
WITH calls AS (
  SELECT strftime(ts + to_days((user_id % 90)::INT), '%Y-%m') AS month,
         event_type || ['', '-2024-05', '-x (batch)', '-2024 (batch)'][(user_id % 4 + 1)::INT] AS model,
         event_id % 100 AS input, event_id % 17 AS output, event_id % 50 AS cache_read, event_id % 40 AS cache_write, event_id % 60 AS cache_write_1h
  FROM events),
u AS (
  SELECT month, model, count(*) AS calls, sum(input)::DOUBLE AS input, sum(output)::DOUBLE AS output, sum(cache_read)::DOUBLE AS cache_read,
         sum(cache_write)::DOUBLE AS cache_write, sum(cache_write_1h)::DOUBLE AS cache_write_1h FROM calls GROUP BY month, model),
m AS (SELECT *, ends_with(model, ' (batch)') AS batch, replace(model, ' (batch)', '') AS base FROM u),
k AS (SELECT *, CASE WHEN base = 'view-2024' OR starts_with(base, 'view-2024-') THEN 'view-2024' WHEN base = 'view' OR starts_with(base, 'view-') THEN 'view'
                     WHEN base = 'click' OR starts_with(base, 'click-') THEN 'click' END AS price_key FROM m),
p AS (SELECT *, CASE price_key WHEN 'view' THEN 3.0::DOUBLE WHEN 'view-2024' THEN 1.0::DOUBLE WHEN 'click' THEN 2.0::DOUBLE END AS pi,
                CASE price_key WHEN 'view' THEN 15.0::DOUBLE WHEN 'view-2024' THEN 5.0::DOUBLE WHEN 'click' THEN 8.0::DOUBLE END AS po FROM k),
q AS (SELECT *, CASE price_key WHEN 'view-2024' THEN 0.25::DOUBLE ELSE pi * 0.1::DOUBLE END AS pr, CASE price_key WHEN 'click' THEN 3.0::DOUBLE ELSE pi * 1.25::DOUBLE END AS pw,
                pi * 2.0::DOUBLE AS p1, least(cache_write_1h, cache_write) AS long FROM p),
c AS (SELECT *, (input * pi + output * po + cache_read * pr + (cache_write - long) * pw + long * p1) / 1e6::DOUBLE AS full_cost,
                (cache_read * (pi - pr) - (cache_write - long) * (pw - pi) - long * (p1 - pi)) / 1e6::DOUBLE AS saved FROM q)
"""


def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rollup_usage(calls(spark, sf_dir)).filter("is_total = 0").drop("is_total")


@query("usage_ledger", CALLS_SQL + """
SELECT month, model, sum(calls)::BIGINT AS calls, sum(input) AS input, sum(output) AS output, sum(cache_read) AS cache_read, sum(cache_write) AS cache_write,
       sum(cache_write_1h) AS cache_write_1h, grouping(model) AS is_total
FROM u GROUP BY GROUPING SETS ((month, model), (month))
""")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.rollup_usage(calls(spark, sf_dir)).withColumn("is_total", F.col("is_total").cast("long"))


@query("month_spine", CALLS_SQL + """
, s AS (SELECT unnest(['2023-11', '2023-12', '2024-01', '2024-02', '2024-03', '2024-04', '2024-05', '2024-06']) AS month)
SELECT s.month, coalesce(sum(calls), 0)::BIGINT AS calls FROM s LEFT JOIN u ON s.month = u.month GROUP BY s.month
""")
def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.month_spine(by_model(spark, sf_dir).groupBy("month").agg(F.sum("calls").alias("calls")), "2024-06", 8)


@query("longest_prefix_price", CALLS_SQL + "SELECT month, model, batch, price_key FROM k")
def longest_prefix_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.priced(by_model(spark, sf_dir), PRICES).select("month", "model", "batch", "price_key")


@query("cost_summary", CALLS_SQL + """
SELECT month, sum(calls)::BIGINT AS calls, sum(input + output + cache_read + cache_write) AS tokens, round(coalesce(sum(full_cost * CASE WHEN batch THEN 0.5 ELSE 1 END), 0), 9) AS cost,
       round(coalesce(sum(saved * CASE WHEN batch THEN 0.5 ELSE 1 END), 0), 9) AS cache_savings, round(coalesce(sum(CASE WHEN batch THEN full_cost * 0.5 ELSE 0 END), 0), 9) AS batch_savings,
       (sum(calls) FILTER (price_key IS NULL))::BIGINT AS unpriced_calls, (sum(calls) FILTER (batch))::BIGINT AS batch_calls
FROM c GROUP BY month
""")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.summarize(ledger.priced(by_model(spark, sf_dir), PRICES))
    return rows.withColumns({c: F.round(F.col(c), 9) for c in ("cost", "cache_savings", "batch_savings")})


@query("cost_forecast", CALLS_SQL + """
, s AS (SELECT price_key, sum(calls)::BIGINT AS samples, any_value(pi) AS pi, any_value(po) AS po, any_value(pr) AS pr, any_value(pw) AS pw,
               sum(input) AS i, sum(output) AS o, sum(cache_read) AS r, sum(cache_write) AS w FROM q WHERE price_key IS NOT NULL GROUP BY 1)
SELECT price_key, samples, round((i * pi + o * po + r * pr + w * pw) / samples / 1e6, 12) AS per_call, round((i * pi + o * po + r * pr + w * pw) / samples / 1e6 * 40, 9) AS total FROM s
""")
def cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.forecast(by_model(spark, sf_dir), PRICES, 40)
    return rows.withColumns({"per_call": F.round("per_call", 12), "total": F.round("total", 9)})


@query("ledger_keep_months", CALLS_SQL + "SELECT month, model, calls FROM u WHERE month IN (SELECT DISTINCT month FROM u ORDER BY month DESC LIMIT 2)")
def ledger_keep_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.keep_months(by_model(spark, sf_dir), 2).select("month", "model", "calls")


def _kappa_sql(group: str) -> str:
    keys, by, using = (f"{group}, ", f"GROUP BY {group}", f"USING ({group})") if group else ("", "", "ON true")
    return f"""
WITH r AS (SELECT quality AS a, toxic AS b, {"doc_id % 3 AS fold" if group else "0 AS z"} FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
t AS (SELECT {keys}count(*) AS n, count(*) FILTER (a = b) AS same FROM r {by}),
x AS (SELECT {keys}a AS v, count(*) AS na FROM r GROUP BY {keys}a), y AS (SELECT {keys}b AS v, count(*) AS nb FROM r GROUP BY {keys}b),
s AS (SELECT {"x." + keys if group else ""}sum(na * nb) AS s FROM x JOIN y ON x.v = y.v {"AND x." + group + " = y." + group if group else ""} {"GROUP BY x." + group if group else ""})
SELECT {keys}n, round(same / n, 12) AS po, round(coalesce(s, 0)::DOUBLE / (n * n), 12) AS pe,
       round(CASE WHEN coalesce(s, 0) < n * n THEN (same / n - coalesce(s, 0)::DOUBLE / (n * n)) / (1 - coalesce(s, 0)::DOUBLE / (n * n)) END, 12) AS kappa
FROM t LEFT JOIN s {using}
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 12) for c in ("po", "pe", "kappa")})


@query("kappa_pooled", _kappa_sql(""))
def kappa_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("kappa", _kappa_sql("fold"))
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(agreement.kappa(table(spark, sf_dir, "labels").withColumn("fold", F.col("doc_id") % 3), "quality", "toxic", "fold"))


ANSWER = "CASE p_size % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' WHEN 3 THEN 'not applicable' WHEN 4 THEN '' ELSE 'yes' END"


@query("answer_summary", f"""
WITH a AS (SELECT p_brand AS study, {ANSWER} AS answer, p_size % 7 = 0 AS open FROM part),
c AS (SELECT study, count(*) AS items, count(*) FILTER (answer <> '') AS answered, count(*) FILTER (answer = 'yes') AS yes, count(*) FILTER (answer = 'no') AS no,
             count(*) FILTER (answer = 'unclear') AS unclear, count(*) FILTER (answer = 'not applicable') AS not_applicable FROM a WHERE NOT open GROUP BY study)
SELECT *, CASE WHEN answered > not_applicable THEN floor(yes * 100.0 / (answered - not_applicable) + 0.5)::BIGINT ELSE 0 END AS yes_percent FROM c
""")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.expr(ANSWER).alias("answer"), (F.col("p_size") % 7 == 0).alias("open"))
    return agreement.answer_summary(rows, "study")


@query("answer_matrix", f"""
WITH a AS (SELECT p_brand AS study, 'i' || (p_partkey % 4) AS item, min({ANSWER}) AS answer FROM part GROUP BY 1, 2)
SELECT study, min(answer) FILTER (item = 'i0') AS i0, min(answer) FILTER (item = 'i1') AS i1, min(answer) FILTER (item = 'i2') AS i2, min(answer) FILTER (item = 'i3') AS i3 FROM a GROUP BY study
""")
def answer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), F.concat(F.lit("i"), (F.col("p_partkey") % 4).cast("string")).alias("item"), F.expr(ANSWER).alias("answer"))
    return agreement.matrix(rows, ["i0", "i1", "i2", "i3"])


@query("rater_compare", f"""
WITH c AS (SELECT p_partkey AS item FROM part), a AS (SELECT p_partkey AS item, {ANSWER} AS answer FROM part WHERE p_size <> 7),
b AS (SELECT p_partkey AS item, {ANSWER.replace("p_size", "(p_size + p_partkey % 2)")} AS answer FROM part WHERE p_size <> 9)
SELECT item, a.answer AS a, b.answer AS b, a.answer = b.answer AS agree FROM c LEFT JOIN a USING (item) LEFT JOIN b USING (item)
""")
def rater_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("item", F.col("p_partkey"))
    first = part.filter("p_size <> 7").select("item", F.expr(ANSWER).alias("answer"))
    second = part.filter("p_size <> 9").select("item", F.expr(ANSWER.replace("p_size", "(p_size + p_partkey % 2)")).alias("answer"))
    return agreement.compare(agreement.answer_pairs(part, first, second))


@query("consensus", """
WITH v AS (SELECT s_nationkey AS g, CASE WHEN s_acctbal > 5000 THEN 'High' WHEN s_acctbal > 0 THEN ' high ' ELSE '' END AS x FROM supplier),
c AS (SELECT g, count(DISTINCT lower(trim(x))) AS variants, min(x) AS least FROM v WHERE trim(x) <> '' GROUP BY g)
SELECT g, CASE WHEN variants = 1 THEN least END AS value, variants FROM c
""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.expr("CASE WHEN s_acctbal > 5000 THEN 'High' WHEN s_acctbal > 0 THEN ' high ' ELSE '' END").alias("x"))
    return agreement.consensus(rows, "g", "x")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status changes of their users."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.to_date("ts").alias("date"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("none").alias("old"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("new"),
    )


LOG_SQL = """
WITH ch AS (SELECT user_id AS key, event_id AS seq, ts::DATE AS date, CASE WHEN event_id % 4 = 0 THEN event_type ELSE 'none' END AS old,
                   CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS new FROM events),
l AS (SELECT *, lag(new) OVER (PARTITION BY key ORDER BY seq) AS last FROM ch WHERE new <> '' AND new <> old),
log AS (SELECT key, seq, date, old, new FROM l WHERE new IS DISTINCT FROM last)
"""


@query("status_log", LOG_SQL + "SELECT * FROM log")
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuslog.appended(changes(spark, sf_dir))


@query("log_cap", LOG_SQL + """
, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log),
i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM n WHERE n <= 20)
SELECT key, seq, date, old, new FROM i WHERE date >= DATE '2024-01-21' ORDER BY date DESC, i DESC, key LIMIT 500
""")
def log_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuslog.capped(status_log(spark, sf_dir), F.lit("2024-01-31").cast("date"), entries=500, days=10)


@query("reading_changes", LOG_SQL + """
, w AS (SELECT * FROM log WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-19')
SELECT key, arg_max(date, seq) AS date, arg_min(old, seq) AS old, arg_max(new, seq) AS new FROM w GROUP BY key HAVING arg_max(new, seq) IN ('purchase', 'click')
""")
def reading_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return statuslog.reading_changes(status_log(spark, sf_dir), day("2024-01-05"), day("2024-01-19"), ["purchase", "click"])


@query("previous_date", "SELECT max(ts::DATE) AS previous FROM events WHERE ts::DATE < DATE '2024-01-15'")
def previous_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuslog.previous_date(table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")), F.lit("2024-01-15").cast("date"))


SIDES = {
    "notes": "CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' read ' ELSE event_type END",
    "library": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'deleted' WHEN 2 THEN 'read' ELSE 'todo' END",
    "table": "CASE event_id % 3 WHEN 0 THEN 'todo' WHEN 1 THEN 'cited' END",
}
BASE = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'deleted' ELSE 'todo' END"


@query("status_merge", f"""
WITH s AS (SELECT event_id AS id, {BASE} AS base, {", ".join(f'{x} AS "{k}"' for k, x in SIDES.items())} FROM events),
c AS (SELECT id, CASE WHEN base = 'deleted' OR base IS NULL THEN '' ELSE base END AS b, trim(notes) AS n0, trim(library) AS l0, trim("table") AS t0,
             CASE WHEN trim(notes) = 'deleted' THEN '' ELSE coalesce(trim(notes), '') END AS n, CASE WHEN library = 'deleted' THEN '' ELSE coalesce(library, '') END AS l, coalesce("table", '') AS t FROM s),
d AS (SELECT *, list_filter([CASE WHEN n <> '' AND n <> b THEN n END, CASE WHEN l <> '' AND l <> b THEN l END, CASE WHEN t <> '' AND t <> b THEN t END], lambda x: x IS NOT NULL) AS ch,
             CASE WHEN n <> '' AND n <> b THEN 'notes' WHEN l <> '' AND l <> b THEN 'library' WHEN t <> '' AND t <> b THEN 'table' WHEN b <> '' THEN 'base' ELSE 'default' END AS source FROM c),
v AS (SELECT *, CASE WHEN len(ch) > 0 THEN ch[1] WHEN b <> '' THEN b ELSE 'todo' END AS value FROM d)
SELECT id, value, source, len(list_distinct(ch)) > 1 AS conflict,
       array_to_string(list_filter([CASE WHEN n0 <> value THEN 'notes' END, CASE WHEN l0 <> value THEN 'library' END, CASE WHEN t0 <> value THEN 'table' END], lambda x: x IS NOT NULL), ',') AS writes FROM v
""")
def status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = statuslog.merge_status(F.expr(BASE), {k: F.expr(x) for k, x in SIDES.items()}, "todo")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), merged.alias("m")).select("id", "m.*")


STATUS = "CASE {0} % 4 WHEN 0 THEN 'todo' WHEN 1 THEN 'reading' WHEN 2 THEN 'read' ELSE '' END"
RECONCILE_SQL = f"""
WITH i AS (SELECT o_orderkey AS key, {STATUS.format("o_orderkey")} AS item FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT l_orderkey AS key, min(struct_pack(a := l_linenumber, s := {STATUS.format("l_suppkey")})).s AS note FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
p AS (SELECT l_orderkey AS key, min(struct_pack(a := l_linenumber, s := {STATUS.format("l_partkey")})).s AS page FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
j AS (SELECT key, item, note, page, CASE WHEN key % 3 > 0 THEN {STATUS.format("(o_custkey // 2)")} END AS base FROM i JOIN orders ON key = o_orderkey LEFT JOIN n USING (key) LEFT JOIN p USING (key) WHERE note IS NOT NULL OR page IS NOT NULL),
c AS (SELECT *, coalesce(base, '') AS b, list_filter([note, item, page], lambda x: x IS NOT NULL AND x <> '' AND x <> coalesce(base, '')) AS ch FROM j),
v AS (SELECT *, CASE WHEN len(ch) > 0 THEN ch[1] WHEN b <> '' THEN b ELSE 'todo' END AS value,
             CASE WHEN coalesce(note, '') NOT IN ('', b) THEN 'notes' WHEN item NOT IN ('', b) THEN 'library' WHEN coalesce(page, '') NOT IN ('', b) THEN 'table' WHEN b <> '' THEN 'base' ELSE 'default' END AS source FROM c),
m AS (SELECT key, value, source, len(list_distinct(ch)) > 1 AS conflict, concat_ws(',', CASE WHEN note <> value THEN 'notes' END, CASE WHEN item <> value THEN 'library' END, CASE WHEN page <> value THEN 'table' END) AS writes FROM v)
"""


def _reconciled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as items, their lines as notes and pages; the merged statuses and the bases before."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    status = lambda c: F.expr(STATUS.format(c)).alias("status")
    items = orders.select(F.col("o_orderkey").alias("key"), status("o_orderkey"), (F.col("o_orderstatus") == "P").alias("deleted"))
    notes = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), status("l_suppkey"), F.col("l_linenumber").alias("path"))
    pages = lines.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("key"), status("l_partkey"), F.col("l_linenumber").alias("pos"))
    bases = orders.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("key"), status("(o_custkey DIV 2)").alias("base"))
    return statuslog.reconcile(items, notes, pages, bases, "todo"), bases


@query("status_reconcile", RECONCILE_SQL + "SELECT * FROM m")
def status_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir)[0]


@query("status_new_bases", RECONCILE_SQL + f"""
SELECT o_orderkey AS key, coalesce(CASE WHEN o_orderkey % 7 > 0 THEN value END, CASE WHEN o_orderkey % 3 > 0 THEN {STATUS.format("(o_custkey // 2)")} END) AS base FROM orders LEFT JOIN m ON key = o_orderkey
WHERE o_orderkey % 3 > 0 OR (value IS NOT NULL AND o_orderkey % 7 > 0)
""")
def status_new_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases after a pass in which the writes of every seventh key failed."""
    merged, bases = _reconciled(spark, sf_dir)
    return statuslog.new_bases(bases, merged, merged.filter("key % 7 = 0").select("key", F.lit("notes").alias("side")))


@query("snapshot_diff", """
WITH m AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM m WHERE y = 1996), b AS (SELECT * FROM m WHERE y = 1995)
SELECT a.k, a.n, a.f, a.n - b.n AS d_n, a.f - b.f AS d_f FROM a LEFT JOIN b ON a.k = b.k
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return statuslog.snapshot_diff(by.filter("y = 1996"), by.filter("y = 1995"), ["k"], ["n", "f"])
