"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger
holds the pairs of blob and rule version that have been scanned, with what was found.
A scan takes the blobs that the ledger lacks for the present rules, reads the text of
one representative row for each, and joins the findings back to all paths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import HOT_KEYS, join_back, store


class Rule(NamedTuple):
    """Spans of ``pattern`` are reported where the group ``measured`` has at least ``least`` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1
    base: bool = False


#: Fixed values. Base kinds first; hex and access runs are maximal either way, so their least length stands in the pattern.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULE_VERSION = 1

SPAN = T.StructType([T.StructField(name, T.IntegerType()) for name in ("start", "kind", "stop")])
LEDGER_SCHEMA = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.IntegerType()), T.StructField("spans", T.ArrayType(SPAN))])


def blob_of(text: Column) -> Column:
    """Content address: SHA-256 of the text as UTF-8; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def empty_ledger(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], LEDGER_SCHEMA)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, spans`` for the blobs (blob, text, copies) in which a rule finds something.

    Whether a rule finds anything is asked of rows with copies only, which keeps the
    optimizer from asking it of every row before the join that picks the unseen blobs. Text is cut at the matches of a rule; the lengths of what lies before a match add
    up to its start. Spans are in order of start, then of the rules, in code points.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = text.rlike(rules[0].pattern)
    for rule in rules[1:]:
        some = some | text.rlike(rule.pattern)

    def hits_of(k: int, rule: Rule) -> Column:
        """Number, size and preceding gap of each match of a rule."""
        matches, group = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.measured))
        return F.transform(
            F.arrays_zip(matches, F.split(text, rule.pattern, -1), group),
            lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["0"]).alias("size"), F.length(x["1"]).alias("gap"), (F.length(x["2"]) >= rule.least).alias("long_enough")),
        )

    per_rule = [hits_of(k, rule) for k, rule in enumerate(rules)]
    hits = blobs.filter(F.when(F.col("copies") > 0, some)).select("blob", F.inline(F.filter(F.flatten(F.array(*per_rule)), lambda x: x["size"].isNotNull()))).dropDuplicates(["blob", "kind", "i"])
    stop = F.expr("sum(size + gap) OVER (PARTITION BY blob, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").cast("int")
    spans = hits.withColumn("stop", stop).filter("long_enough")
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct((F.col("stop") - F.col("size")).alias("start"), "kind", "stop"))).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Returns the versions (path, blob, copies) and the ledger with the new entries.

    ``versions`` has ``path`` and ``text``. Repeated versions share one blob and are
    scanned once; blobs without findings enter the ledger with no spans, so that they
    are not scanned again. A new rule version scans every blob anew.
    """
    ledger = empty_ledger(versions) if ledger is None else ledger
    paths = store(versions.select("path", blob_of(F.col("text")).alias("blob")), "paths")
    blobs = paths.groupBy("blob").agg(F.min("path").alias("rep"), F.count(F.lit(1)).alias("copies"))
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
    unseen = store(blobs.join(seen, "blob", "left_anti"), "unseen")
    # Only representative rows carry their text on.
    reps = unseen.select(F.col("blob").alias("b"), "rep", "copies")
    texts = versions.select("path", "text", blob_of(F.col("text")).alias("blob")).join(reps, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("rep")))
    found = store(find_spans(texts.select("blob", "text", "copies"), rules), "findings")
    empty = F.array().cast(LEDGER_SCHEMA["spans"].dataType)
    entries = unseen.select("blob").join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", empty).alias("spans"))
    return paths, ledger.unionByName(entries)


def joined_spans(spans: Column, rules: tuple[Rule, ...], base_only: bool = False) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"].isin([k for k, r in enumerate(rules) if r.base]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans.

    Null and empty texts have no spans. Repeated rows get equal results. Only doc_id and
    text are read, so extra columns cannot clash; an empty table gives none.
    """
    paths, known = scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger, rules, rule_version)
    known = store(known.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans"), "known")
    # The most copied blobs are joined back by broadcast, whether or not they hold a secret.
    copies = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    wanted = known.select("blob").unionByName(copies.orderBy(F.col("copies").desc(), "blob").limit(HOT_KEYS).select("blob")).distinct()
    weighed = store(wanted.join(copies, "blob").join(known, "blob", "left").select("blob", "spans", "copies"), "weighed")
    spread = F.unhex(F.sha2(F.coalesce(F.col("path").cast("string"), F.lit("")), 256))
    joined = join_back(paths, weighed, "blob", "copies", spread).withColumn("spans", F.coalesce("spans", F.array().cast(LEDGER_SCHEMA["spans"].dataType)))
    kinds = [r.kind for r in rules]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kinds.index(kind))).cast("long")
    return joined.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined_spans(F.col("spans"), rules, base_only=True), 256).alias("base_sha256"),
        joined_spans(F.col("spans"), rules).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def arrivals_report(docs: DataFrame, first: Column, rules: tuple[Rule, ...] = RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """As ``secret_report``, of documents that come in two arrivals: those of ``first`` are scanned into a ledger that is kept, and of the others only the blobs that it lacks."""
    _, ledger = scan(docs.filter(first).select(F.col("doc_id").alias("path"), "text"), None, rules, rule_version)
    return secret_report(docs, store(ledger, "ledger"), rules, rule_version)
