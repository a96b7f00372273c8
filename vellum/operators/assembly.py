"""Pieces that notes and reports are assembled from: batches, memberships, decisions, sources, places, suggestions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.identifiers import blank
from vellum.functions.metadata import normalize_answer
from vellum.functions.text import CJK
from vellum.operators.lists import numbered_within


def text_pieces(column: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters, in order; none for null and the empty text."""
    text = F.coalesce(column, F.lit(""))
    starts = F.when(text == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(text), F.lit(size)))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))


def memberships_under(containers: DataFrame, memberships: DataFrame, top: str) -> DataFrame:
    """``item, group, name`` of items filed two levels below containers named ``top``: in a container (name) of a group of it."""
    tree = containers.select("key", "parent", "name")
    tops = tree.filter(F.col("name") == top).select(F.col("key").alias("_top"))
    groups = tree.join(tops, F.col("parent") == F.col("_top")).select(F.col("key").alias("_group"), F.col("name").alias("group"))
    leaves = tree.join(groups, F.col("parent") == F.col("_group")).select(F.col("key").alias("container"), "group", "name")
    return memberships.join(leaves, "container").select("item", "group", "name").distinct()


def request_batches(rows: DataFrame, group: str, order: Column, size: int) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows of a group in order, numbered from 0."""
    return numbered_within(rows, group, order).withColumn("batch", F.floor((F.col("n") - 1) / size)).drop("n")


def batch_topics(batches: DataFrame, answers: DataFrame, topics: DataFrame, group: str) -> DataFrame:
    """``id, status, topics`` of batched rows (group, batch, id) by the answers to their batches (group, batch, json).

    An answer is a JSON object of topic lists by id. A batch without an answer, or with
    one that is no object, fails alone (status failed). Topics not in ``topics`` (topic)
    are dropped, repeated ones count once; an id left out by its answer is missing.
    """
    read = answers.select(group, "batch", F.from_json("json", "map<string, array<string>>").alias("found"))
    entries = read.filter("found IS NOT NULL").select(group, "batch", F.explode("found").alias("id", "named"))
    good = entries.select(group, "batch", "id", F.explode(F.array_distinct(F.transform("named", lambda t: F.trim(t)))).alias("topic")).join(topics.select("topic").distinct(), "topic")
    kept = good.groupBy(group, "batch", "id").agg(F.sort_array(F.collect_list("topic")).alias("topics"))
    answered = read.filter("found IS NOT NULL").select(group, "batch", F.map_keys("found").alias("ids"))
    rows = batches.withColumn("id", F.col("id").cast("string"))
    joined = rows.join(answered, [group, "batch"], "left").join(kept, [group, "batch", "id"], "left")
    status = F.when(F.col("ids").isNull(), "failed").when(F.array_contains("ids", F.col("id")), "ok").otherwise("missing")
    return joined.select("id", status.alias("status"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))


def import_outcomes(requested: DataFrame, in_chunks: DataFrame, alone: DataFrame) -> DataFrame:
    """``id, outcome`` of a bulk import: chunk, single (came only when asked for alone) or missing; ids repeated count once."""
    by = requested.select("id").distinct().join(in_chunks.select("id").distinct().withColumn("_c", F.lit(True)), "id", "left").join(alone.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left")
    return by.select("id", F.when(F.col("_c"), "chunk").when(F.col("_s"), "single").otherwise("missing").alias("outcome"))


def decided(record: DataFrame, decisions: DataFrame) -> DataFrame:
    """``item, question, answer, note`` after decisions (item, question, decision, suggested, why, at): the last one counts.

    A decision "changed" takes the suggested answer, "kept" leaves it; both leave their reason as the note.
    """
    last = decisions.groupBy("item", "question").agg(F.max_by(F.struct("decision", "suggested", "why"), "at").alias("d"))
    joined = record.select("item", "question", "answer").join(last, ["item", "question"], "left")
    return joined.select("item", "question", F.when(F.col("d.decision") == "changed", F.coalesce("d.suggested", "answer")).otherwise(F.col("answer")).alias("answer"), F.coalesce("d.why", F.lit("")).alias("note"))


def patched(entries: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``entries`` with the fields that a patch of their key gives; null fields of a patch change nothing, patches of no entry are dropped."""
    fields = [c for c in patches.columns if c != key and c in entries.columns]
    given = patches.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in fields])
    joined = entries.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in entries.columns])


def synthesis_sources(items: DataFrame, most: int) -> DataFrame:
    """``place, id, text, kind`` of the first ``most`` items by year and id: their note, else abstract and highlights; items with neither are left out. The limit is the feature."""
    note = F.nullif(blank(F.col("note")), F.lit(""))
    other = F.nullif(F.concat_ws("\n", F.nullif(blank(F.col("abstract")), F.lit("")), F.nullif(F.concat_ws("\n", "highlights"), F.lit(""))), F.lit(""))
    found = items.select("id", "year", F.coalesce(note, other).alias("text"), F.when(note.isNotNull(), "note").otherwise("abstract").alias("kind")).filter("text IS NOT NULL")
    first = found.orderBy("year", "id").limit(most)
    return first.select(F.row_number().over(Window.orderBy("year", "id")).alias("place"), "id", "text", "kind")


def note_places(notes: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """``key, path, by`` of notes (key, name, other): the file of its name, else that of its other name, else the latest the index has; null for none.

    ``files`` has path; ``index`` has key, path and at.
    """
    named = files.select("path", F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("base")).filter("base <> ''").groupBy("base").agg(F.min("path").alias("path"))
    first, second = (named.select(F.col("base").alias(f"_{k}"), F.col("path").alias(f"path_{k}")) for k in ("name", "other"))
    last = index.groupBy("key").agg(F.max_by("path", F.struct("at", "path")).alias("path_index"))
    found = notes.join(first, F.col("name") == F.col("_name"), "left").join(second, F.col("other") == F.col("_other"), "left").join(last, "key", "left")
    by = F.when(F.col("path_name").isNotNull(), "name").when(F.col("path_other").isNotNull(), "other").when(F.col("path_index").isNotNull(), "index")
    return found.select("key", F.coalesce("path_name", "path_other", "path_index").alias("path"), by.alias("by"))


def confidence(column: Column) -> Column:
    """high, medium or low for a word or a share; empty for anything else."""
    text = F.lower(blank(column))
    number = F.regexp_replace(text, "%$", "").try_cast("double")
    share = F.when(text.endswith("%") | (number > 1), number / 100).otherwise(number)
    return F.when(text.isin("high", "高"), "high").when(text.isin("medium", "moderate", "中"), "medium").when(text.isin("low", "低"), "low").when(share >= 0.8, "high").when(share >= 0.5, "medium").when(share >= 0, "low").otherwise("")


def suggestion_rows(records: DataFrame) -> DataFrame:
    """``id, kind, value, confidence, picked`` of the suggestions (array of kind, value, confidence) of records; sure ones are picked, blank ones left out."""
    rows = records.select("id", F.explode("suggestions").alias("s")).select("id", F.col("s.kind").alias("kind"), blank(F.col("s.value")).alias("value"), confidence(F.col("s.confidence")).alias("confidence"))
    return rows.filter("value <> ''").distinct().withColumn("picked", F.col("confidence") == "high")


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """``item, question, first, second`` where two raters gave different answers, or one gave none."""
    of = lambda df, name: df.select("item", "question", normalize_answer(F.col("answer")).alias(name))
    both = of(first, "first").join(of(second, "second"), ["item", "question"], "full")
    return both.select("item", "question", F.coalesce("first", F.lit("")).alias("first"), F.coalesce("second", F.lit("")).alias("second")).filter("first <> second")


def checklist_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``item, question, answer, evidence`` from model answers (item, json): an array of {id, answer, evidence}; unknown questions are dropped, the first of repeated ones counts."""
    read = answers.select("item", F.posexplode(F.from_json("json", "array<struct<id: string, answer: string, evidence: string>>")).alias("pos", "a"))
    first = read.groupBy("item", F.trim("a.id").alias("question")).agg(F.min_by("a", "pos").alias("a"))
    return first.join(questions.select("question").distinct(), "question").select("item", "question", normalize_answer(F.col("a.answer")).alias("answer"), blank(F.col("a.evidence")).alias("evidence"))


def quote_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, quote, page`` of quotes (id, quote): the first page of their text that has them, letters, digits and Han characters alone compared; null for none or an empty quote.

    Pages (id, page, text) are joined by id, and a page is looked at once for all quotes of its id.
    """
    folded = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    wanted = items.select("id", "quote", folded(F.col("quote")).alias("_q")).distinct()
    met = wanted.filter("_q <> ''").join(pages.select("id", "page", folded(F.col("text")).alias("_t")), "id").filter(F.col("_t").contains(F.col("_q")))
    found = met.groupBy("id", "quote").agg(F.min("page").alias("page"))
    return wanted.select("id", "quote").join(found, ["id", "quote"], "left")


def page_paragraphs(column: Column) -> Column:
    """Paragraphs of a page whose lines are wrapped: lines joined (words broken by a hyphen and CJK text without a space), table rows and blank lines apart."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(column, F.lit("")), r"\r\n?", "\n"), r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(\|[^\n]*)$", "\n$1\n")
    text = F.regexp_replace(text, r"(?<=\p{L})[-\x{AD}\x{2010}][ \t]*\n[ \t]*(?=\p{Ll})", "")
    text = F.regexp_replace(text, rf"(?<={CJK})[ \t]*\n[ \t]*(?={CJK})", "")
    text = F.regexp_replace(text, r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ")
    return F.filter(F.transform(F.split(text, r"\s*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"[ \t]+", " "))), lambda p: p != "")


def escaped(paragraph: Column) -> Column:
    """A paragraph that no reader takes for Markdown: signs that begin a block, rules, and marks of notes are escaped."""
    block = paragraph.rlike(r"^(?:#{1,6}\s|>|\|)") | paragraph.rlike(r"^(?:-{3,}|\*{3,}|_{3,}|={3,})$")
    text = F.when(block, F.concat(F.lit("\\"), paragraph)).otherwise(paragraph)
    return F.replace(F.replace(F.replace(text, F.lit("=="), F.lit("=\\=")), F.lit("%%"), F.lit("%\\%")), F.lit("[["), F.lit("[\\["))
