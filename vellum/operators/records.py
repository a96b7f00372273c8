"""Records as tables: scans, settings with error rows, cached conversions, citekeys, features, evidence rows, checks by sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import metadata, prose
from vellum.functions.identifiers import blank, key_suffix, suffix
from vellum.functions.text import numbers_in
from vellum.operators.lists import numbered_within
from vellum.storage import discard, store


def year_range(year: Column) -> Column:
    """Aggregate: least and greatest year as 2001–2020, one year alone, or empty; values that are no years above zero are left out."""
    number = year.try_cast("int")
    good = F.when(number > 0, number)
    low, high = F.min(good), F.max(good)
    return F.when(low.isNull(), "").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def scan_items(items: DataFrame, children: DataFrame) -> DataFrame:
    """Live top-level items with ``attachments``, the nested records of their live children in order of key; an item without any has none.

    ``items`` and ``children`` have ``key`` and ``deleted`` (null is live); children have ``parent``.
    """
    live = lambda df: df.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted")
    below = live(children).filter("parent IS NOT NULL")
    fields = [c for c in below.columns if c != "parent"]
    nested = below.groupBy(F.col("parent").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("key", *[c for c in fields if c != "key"]))).alias("attachments"))
    empty = F.array().cast(nested.schema["attachments"].dataType)
    return live(items).join(nested, F.col("key") == F.col("_of"), "left").drop("_of").withColumn("attachments", F.coalesce("attachments", empty))


def look_up(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``key`` is asked for, each once however often it is asked; null keys match nothing."""
    return rows.join(keys.select("key").filter("key IS NOT NULL").distinct(), "key", "left_semi")


def newest_notes(notes: DataFrame, kind: Column, since: str | None = None) -> DataFrame:
    """Notes of a project, by ``kind`` the newest first: path, kind, date, place. The date is that in the file's name; notes without one are left out."""
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date")
    dated = notes.select("path", kind.alias("kind"), date.alias("date")).filter("date IS NOT NULL")
    dated = dated if since is None else dated.filter(F.col("date") >= F.lit(since).cast("date"))
    return numbered_within(dated, "kind", F.col("date").desc(), F.col("path").asc()).withColumn("place", F.col("n")).drop("n")


def read_settings(rows: DataFrame, text: str, schema: str, needed: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``settings`` (by ``schema``) and ``error``: null, "json" where the text is no object, or the first needed field that is missing.

    Every row comes back, with settings or with an error, never with both.
    """
    read = F.from_json(F.col(text), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    known = rows.withColumn("_read", read)
    broken = F.col("_read").isNull() | F.col("_read._bad").isNotNull() | ~F.coalesce(F.trim(F.col(text)), F.lit("")).startswith("{")
    error = F.when(broken, "json")
    for name in needed:
        error = error.when(blank(F.col(f"_read.{name}")) == "", name)
    known = known.withColumn("error", error)
    return known.withColumn("settings", F.when(F.col("error").isNull(), F.col("_read").dropFields("_bad"))).drop("_read")


def convert_unseen(sources: DataFrame, cache: DataFrame, convert) -> DataFrame:
    """The cache with one row more for each text it lacks: hash, engine, converted.

    ``sources`` has ``text`` and ``engine``; equal texts are converted once by an engine,
    and what the cache has is not converted again. ``convert`` is a column function.
    """
    wanted = sources.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "engine", "text").dropDuplicates(["hash", "engine"])
    unseen = wanted.join(cache.select("hash", "engine"), ["hash", "engine"], "left_anti")
    return cache.select("hash", "engine", "converted").unionByName(unseen.select("hash", "engine", convert(F.coalesce("text", F.lit(""))).alias("converted")))


def evidence_rows(records: DataFrame) -> DataFrame:
    """One row of the evidence table per record: citation, authors, year, title, doi, has_data, design, sample_size, measures, evidence_level.

    ``records`` has id, names, year, title, doi and ``study`` (a struct, null where there is none). Nulls become empty text.
    """
    of = lambda name: blank(F.col(f"study.{name}"))
    return records.select(
        "id",
        metadata.short_citation(F.coalesce("names", F.array().cast("array<string>")), F.col("year")).alias("citation"),
        F.concat_ws("; ", "names").alias("authors"),
        blank(F.col("year")).alias("year"),
        F.coalesce("title", F.lit("")).alias("title"),
        blank(F.col("doi")).alias("doi"),
        F.col("study").isNotNull().alias("has_data"),
        of("design").alias("design"),
        of("sample_size").alias("sample_size"),
        F.concat_ws("; ", "study.measures").alias("measures"),
        of("evidence_level").alias("evidence_level"),
    )


def enabled_features(features: DataFrame) -> DataFrame:
    """``id, enabled`` of features (id, on, requires): on, and all they require enabled. What requires itself, or what does not exist, is not enabled.

    Level by level: a feature is enabled once all it requires are; what no round reaches stays off.
    """
    features = features.select("id", F.coalesce("on", F.lit(False)).alias("on"), F.array_distinct(F.coalesce("requires", F.array().cast("array<string>"))).alias("requires"))
    needs = store(features.filter("on").select("id", F.explode_outer("requires").alias("need"), F.size("requires").alias("n")), "needs")
    done = store(needs.filter("n = 0").select("id").distinct(), "enabled")
    known = -1
    while (now := done.count()) != known:
        known = now
        met = needs.join(done.withColumnRenamed("id", "need"), "need", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"))
        last, done = done, store(done.unionByName(met.filter("met = n").select("id")).distinct(), "enabled")
        discard(last)
    return features.join(done.withColumn("enabled", F.lit(True)), "id", "left").select("id", F.coalesce("enabled", F.lit(False)).alias("enabled"))


def preset_of(values: DataFrame, presets: DataFrame) -> DataFrame:
    """``owner, preset``: the first preset by name that all switches (id, on) of an owner match, else custom."""
    n = presets.groupBy("preset").agg(F.count(F.lit(1)).alias("n"))
    same = values.join(presets.withColumnRenamed("on", "want"), "id").filter(F.col("on").eqNullSafe(F.col("want"))).groupBy("owner", "preset").agg(F.countDistinct("id").alias("same"))
    fit = same.join(n, "preset").filter("same = n").groupBy("owner").agg(F.min("preset").alias("preset"))
    return values.select("owner").distinct().join(fit, "owner", "left").select("owner", F.coalesce("preset", F.lit("custom")).alias("preset"))


def appraisals(saved: DataFrame, suggested: DataFrame) -> DataFrame:
    """``item, question, answer, by``: a saved answer that is not empty goes before the model's; ``by`` is verified, saved or model."""
    mine = saved.select("item", "question", F.nullif(blank(F.col("answer")), F.lit("")).alias("own"), F.coalesce("verified", F.lit(False)).alias("verified"))
    both = mine.join(suggested.select("item", "question", F.nullif(blank(F.col("answer")), F.lit("")).alias("model")), ["item", "question"], "full")
    by = F.when(F.col("own").isNotNull() & F.col("verified"), "verified").when(F.col("own").isNotNull(), "saved").when(F.col("model").isNotNull(), "model")
    return both.select("item", "question", F.coalesce("own", "model", F.lit("")).alias("answer"), F.coalesce(by, F.lit("")).alias("by"))


def assign_citekeys(entries: DataFrame, store_keys: DataFrame, retired: DataFrame) -> DataFrame:
    """``id, citekey`` unique but for case; entries have id, uid, explicit, base and added.

    Explicit keys stay, the oldest of equal ones bare. A key that the store (uid, citekey)
    has for an entry stays while it is one of the entry's base. All others take, the oldest
    first, the first of base, basea, baseb, ... that no explicit, kept or retired key
    (citekey), no key of an entry that is gone and no other base has.
    """
    entries = store(entries.select("id", "uid", F.nullif(blank(F.col("explicit")), F.lit("")).alias("explicit"), blank(F.col("base")).alias("base"), blank(F.col("added")).alias("added")), "entries")
    folded = lambda c: F.lower(F.col(c))
    fixed = entries.filter("explicit IS NOT NULL").select("id", F.col("explicit").alias("base"), "added")
    own = store_keys.select("uid", F.col("citekey").alias("kept"))
    held = entries.filter("explicit IS NULL").join(own, "uid", "left")
    explicit_names = fixed.select(F.lower("base").alias("name")).distinct()
    same = F.lower("kept").startswith(F.lower("base")) & F.substring(F.lower("kept"), F.length("base") + 1, F.length("kept")).rlike("^[a-z]*$")
    held = held.join(explicit_names, F.lower("kept") == F.col("name"), "left").withColumn("keeps", F.coalesce(same & F.col("name").isNull(), F.lit(False)))
    held = store(held.drop("name"), "held")
    kept = held.filter("keeps").select("id", F.col("kept").alias("citekey"))
    fresh = held.filter("NOT keeps").select("id", "base", "added")
    taken = retired.select(F.lower("citekey").alias("key")).unionByName(store_keys.select(F.lower("citekey").alias("key")))
    explicit = store(_suffixed(fixed, taken.limit(0), folded), "explicit")
    taken = store(taken.unionByName(explicit.select(F.lower("citekey").alias("key"))).distinct(), "taken")
    return explicit.unionByName(kept).unionByName(_suffixed(fresh, taken, folded))


def _suffixed(rows: DataFrame, taken: DataFrame, folded) -> DataFrame:
    """``id, citekey``: rows of a base in order of age at its free places.

    The row of number k (from 0) passes each occupied place that, less the occupied ones before
    it, is at most k. So rows and occupied places of a base, put in order by these two, are
    numbered by the places that the rows take; no row meets a base's list of places.
    """
    rows = store(numbered_within(rows.withColumn("name", folded("base")), "name", F.col("added").asc(), F.col("id").asc()), "numbered")
    bases = store(rows.select("name").distinct(), "bases")
    # A key takes a place of each base that it begins with, if letters follow, at most as many as the last place can have; another base takes no bare place.
    most = len(suffix(rows.count() + taken.count() + bases.count()))
    cut = lambda least: F.explode(F.filter(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.struct(F.left("key", F.length("key") - n).alias("name"), F.right("key", n).alias("rest"))), lambda x: x["rest"].rlike("^[a-z]*$"))).alias("x")
    places = taken.select(cut(0)).unionByName(bases.select(F.col("name").alias("key")).select(cut(1)))
    letters = F.transform(F.split(F.col("x.rest"), ""), lambda c: F.ascii(c) - 96)
    number = F.when(F.col("x.rest") == "", F.lit(0).cast("long")).otherwise(F.aggregate(letters, F.lit(0).cast("long"), lambda total, c: total * 26 + c))
    occupied = places.select("x.name", number.alias("place")).join(bases, "name", "left_semi").distinct()
    passed = numbered_within(occupied, "name", F.col("place").asc()).select("name", (F.col("place") - F.col("n") + 1).alias("at"), F.lit(0).alias("kind"))
    line = rows.select("name", (F.col("n") - 1).alias("at"), F.lit(1).alias("kind"), "id", "base").unionByName(passed, allowMissingColumns=True)
    return numbered_within(line, "name", F.col("at").asc(), F.col("kind").asc()).filter("kind = 1").select("id", F.concat("base", key_suffix(F.col("n") - 1)).alias("citekey"))


def draft_sentences(drafts: DataFrame) -> DataFrame:
    """``id, para, sent, sentence, cited``: sentences of body text with the sources they cite, or, where they cite none, those of their paragraph.

    Sentences end with ! or ?, or with a full stop of Han text; a plain dot ends none, since it stands in numbers and short forms.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?ms)^\s*```.*?(?:^\s*```[^\n]*$|\z)", "\n"), r"(?m)^(?:#{1,6}\s.*|%%.*%%\s*)$", "\n")
    # Each list item and table row is a paragraph of its own.
    paras = F.split(F.regexp_replace(text, r"\n(?=\s*(?:[-*+]|\d+[.)])\s|\s*\|)", "\n\n"), r"\n[^\S\n]*\n\s*")
    rows = drafts.select("id", F.posexplode(F.filter(paras, lambda p: F.trim(p) != "")).alias("para", "p"))
    ids = lambda c: F.array_distinct(prose.citations(c).cast("array<struct<id: string, locator: string>>")["id"])
    rows = rows.select("id", "para", ids(F.col("p")).alias("of_para"), F.posexplode(F.split("p", "(?<=[。！？!?])")).alias("sent", "sentence"))
    own = ids(F.col("sentence"))
    return rows.filter(F.trim("sentence") != "").select("id", "para", "sent", F.trim("sentence").alias("sentence"), F.when(F.size(own) > 0, own).otherwise(F.col("of_para")).alias("cited"))


def unsupported_in_sentences(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, para, sent, number``: numbers worth checking that none of the sources has that their sentence rests on.

    ``drafts`` has id and text; ``sources`` has id (the draft's), source (S1, S2, ...) and text.
    A sentence that rests on no source has all its numbers unsupported.
    """
    bare = F.regexp_replace("sentence", r"(?i)\[\s*S\d+[^\]]*\]", " ")
    claims = draft_sentences(drafts).select("id", "para", "sent", "cited", F.explode(F.array_distinct(prose.checkable_numbers(bare))).alias("number"))
    known = sources.select("id", F.col("source").alias("cite"), F.explode(numbers_in(F.col("text"))).alias("number")).distinct()
    met = claims.select("id", "para", "sent", "number", F.explode("cited").alias("cite")).join(known, ["id", "cite", "number"]).select("id", "para", "sent", "number").distinct()
    return claims.select("id", "para", "sent", "number").join(met, ["id", "para", "sent", "number"], "left_anti")
