"""Likely duplicates among records, the record to keep of a group, and look-ups by several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.identifiers import normalize_doi, normalize_title, year_of
from vellum.operators.components import connected_components
from vellum.storage import store

MIN_TITLE_CHARS = 10


def keyed(records: DataFrame) -> DataFrame:
    """Records with ``doi_key``, ``title_key`` and ``year_key``; null where a key is missing or too short."""
    title = normalize_title(F.col("title"))
    return records.withColumns(
        {
            "doi_key": F.nullif(normalize_doi(F.col("doi")), F.lit("")),
            "title_key": F.when(F.length(title) >= MIN_TITLE_CHARS, title),
            "year_key": F.coalesce(F.nullif(year_of(F.col("year"), F.col("date")), F.lit("")), F.lit("")),
        }
    )


def duplicate_links(records: DataFrame) -> DataFrame:
    """Links ``u, v, basis`` from each bucket's smallest id to the others: a star, never all pairs.

    Records share a bucket by DOI, or by title and year. A title bucket with two DOIs or
    more links only its records without one.
    """
    rows = store(keyed(records).select("id", "doi_key", "title_key", "year_key"), "keys")
    by_doi = rows.filter("doi_key IS NOT NULL")
    doi_first = by_doi.groupBy("doi_key").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    doi_links = by_doi.join(doi_first, "doi_key").select(F.col("id").alias("u"), "v", F.lit("doi").alias("basis"))
    by_title = rows.filter("title_key IS NOT NULL")
    bare = F.when(F.col("doi_key").isNull(), F.col("id"))
    buckets = by_title.groupBy("title_key", "year_key").agg(
        F.min("doi_key").alias("one"), F.max("doi_key").alias("other"), F.min("id").alias("first"), F.min(bare).alias("first_bare"), F.count(F.lit(1)).alias("n"), F.count(bare).alias("n_bare")
    )
    split = F.col("one").isNotNull() & (F.col("one") != F.col("other"))
    buckets = buckets.withColumn("split", F.coalesce(split, F.lit(False))).filter(F.when(F.col("split"), F.col("n_bare")).otherwise(F.col("n")) > 1)
    title_links = (
        by_title.join(buckets, ["title_key", "year_key"])
        .filter(~F.col("split") | F.col("doi_key").isNull())
        .select(F.col("id").alias("u"), F.when(F.col("split"), F.col("first_bare")).otherwise(F.col("first")).alias("v"), F.lit("title").alias("basis"))
    )
    return doi_links.unionByName(title_links)


def duplicate_groups(records: DataFrame) -> DataFrame:
    """``id, group_id`` of the records that have a duplicate; group_id is the smallest id of the group."""
    return connected_components(duplicate_links(records).select("u", "v")).select(F.col("node").alias("id"), F.col("root").alias("group_id"))


def survivors(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``id, group_id, place, keep``: members of a group, best first, one of them kept.

    Order: not marked duplicate, screened, with DOI, with abstract, most attachments,
    added first, smallest id. Records need is_duplicate, screened, doi, has_abstract,
    attachments, date_added.
    """
    no = lambda c: F.coalesce(~c, F.lit(True)).cast("int")
    order = [
        F.coalesce(F.col("is_duplicate"), F.lit(False)).cast("int"),
        no(F.col("screened")),
        (normalize_doi(F.col("doi")) == "").cast("int"),
        no(F.col("has_abstract")),
        -F.coalesce(F.col("attachments"), F.lit(0)),
        F.coalesce(F.col("date_added"), F.lit("")),
        F.col("id"),
    ]
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(*order))
    return groups.join(records, "id").withColumn("place", place).select("id", "group_id", "place", (F.col("place") == 1).alias("keep"))


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """``key`` with the struct ``hit`` of its first row in order; rows without a key are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("hit"))


def library_lookup(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """``candidates`` with ``match_id`` and ``match_by`` (doi, pmid or title) of the library's record; null where there is none.

    Keys are tried in that order and the first record in the library's ``pos`` wins per
    key. Titles match with years at most one apart, the earlier year first, unless both
    sides carry different DOIs. Both need id, doi, pmid, title and year; ids are unique.
    """
    lib = keyed(library.withColumn("date", F.lit(None).cast("string"))).select("id", "pos", "doi_key", "title_key", F.col("year_key").try_cast("int").alias("y"), "pmid")
    lib = store(lib, "library")
    cand = store(keyed(candidates.withColumn("date", F.lit(None).cast("string"))).withColumn("y", F.col("year_key").try_cast("int")), "candidates")
    by_doi = lib.filter("doi_key IS NOT NULL").groupBy("doi_key").agg(F.min_by("id", "pos").alias("hit"))
    by_pmid = lib.filter("pmid IS NOT NULL AND pmid <> ''").groupBy("pmid").agg(F.min_by("id", "pos").alias("hit"))
    by_title = lib.filter("title_key IS NOT NULL AND y > 0").groupBy("title_key", "y").agg(F.min_by(F.struct("id", "doi_key"), "pos").alias("first"))
    # Stored tables are small as files and large in memory, so nothing is left to a broadcast; candidates without a key join nothing, so nulls do not gather in one task.
    probe = lambda key: cand.filter(F.col(key).isNotNull()).select("id", key)
    hit = lambda rank, by: F.struct(F.lit(rank).alias("rank"), (F.col("y") if by == "title" else F.lit(0)).alias("y"), F.col("hit").alias("match_id"), F.lit(by).alias("match_by"))
    by_key = [probe(key).join(first.hint("merge"), key).select("id", hit(rank, by).alias("m")) for rank, (key, first, by) in enumerate([("doi_key", by_doi, "doi"), ("pmid", by_pmid, "pmid")])]
    probes = cand.filter("title_key IS NOT NULL AND y > 0").select("id", F.col("doi_key").alias("own_doi"), "title_key", F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"))
    same_work = F.col("own_doi").isNull() | F.col("first.doi_key").isNull() | (F.col("own_doi") == F.col("first.doi_key"))
    titled = probes.join(by_title.hint("merge"), ["title_key", "y"]).filter(same_work).withColumn("hit", F.col("first.id")).select("id", hit(2, "title").alias("m"))
    best = by_key[0].unionByName(by_key[1]).unionByName(titled).groupBy("id").agg(F.min("m").alias("m"))
    return cand.join(best.hint("merge"), "id", "left").select(*candidates.columns, F.col("m.match_id").alias("match_id"), F.col("m.match_by").alias("match_by"))


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose key was not seen, once each, at the earliest ``pos``."""
    return candidates.join(seen.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min("pos").alias("pos"))
