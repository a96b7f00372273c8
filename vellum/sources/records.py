"""Bibliographic pages and exports: recorded REST answers as rows, addresses of requests, CSL-JSON and BibTeX text.

Requests themselves are not made; pages are read from wherever they were recorded, one
JSON text per row, through Spark's own readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.identifiers import blank, normalize_doi

ESEARCH = "struct<esearchresult: struct<count: string, idlist: array<string>, ERROR: string>>"
ESUMMARY = "struct<result: map<string, string>>"
SUMMARY = "struct<uid: string, title: string, pubdate: string, source: string, error: string, authors: array<struct<name: string>>, articleids: array<struct<idtype: string, value: string>>>"
WORKS = "struct<meta: struct<count: long, next_cursor: string>, results: array<struct<id: string, doi: string, display_name: string, publication_year: int, type: string, cited_by_count: long, ids: struct<pmid: string>>>>"


def percent_encode(column: Column) -> Column:
    """As in a query string, a space as %20."""
    return F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))


def search_address(base: str, **params: Column | str) -> Column:
    """Address with parameters in order; empty ones are left out."""
    pairs = [F.when(blank(c if isinstance(c, Column) else F.lit(c)) != "", F.concat(F.lit(f"{k}="), percent_encode(c if isinstance(c, Column) else F.lit(c)))) for k, c in params.items()]
    return F.concat(F.lit(base + "?"), F.array_join(F.filter(F.array(*pairs), lambda p: p.isNotNull()), "&"))


def found_ids(pages: DataFrame, key: str = "watch") -> DataFrame:
    """``key, id, pos, total`` of the ids that search pages (key, json) list, in their order."""
    parsed = pages.select(key, F.from_json("json", ESEARCH)["esearchresult"].alias("r"))
    return parsed.select(key, F.posexplode("r.idlist").alias("pos", "id"), F.col("r.count").try_cast("long").alias("total")).select(key, "id", "pos", "total")


def summaries(pages: DataFrame) -> DataFrame:
    """``id, title, year, journal, doi, authors`` of the entries of summary pages; entries with an error are left out."""
    entries = pages.select(F.explode(F.map_filter(F.from_json("json", ESUMMARY)["result"], lambda k, v: k != "uids")).alias("uid", "entry"))
    e = F.from_json("entry", SUMMARY)
    rows = entries.select(e.alias("e")).filter(F.col("e.uid").isNotNull() & F.col("e.error").isNull())
    doi = F.filter("e.articleids", lambda a: a["idtype"] == "doi")
    return rows.select(
        F.col("e.uid").alias("id"),
        F.regexp_replace(blank(F.col("e.title")), r"\.$", "").alias("title"),
        F.regexp_extract(blank(F.col("e.pubdate")), r"\d{4}", 0).alias("year"),
        blank(F.col("e.source")).alias("journal"),
        normalize_doi(F.try_element_at(doi, F.lit(1))["value"]).alias("doi"),
        F.transform(F.coalesce("e.authors", F.array().cast("array<struct<name: string>>")), lambda a: a["name"]).alias("authors"),
    )


def works(pages: DataFrame) -> DataFrame:
    """``seed, direction, work, doi, title, year, kind, cited_by, pmid`` of citation pages (seed, direction, json)."""
    rows = pages.select("seed", "direction", F.explode(F.from_json("json", WORKS)["results"]).alias("w"))
    return rows.select(
        "seed", "direction", F.regexp_extract(blank(F.col("w.id")), r"(W\d+)$", 1).alias("work"), normalize_doi(F.col("w.doi")).alias("doi"), blank(F.col("w.display_name")).alias("title"), F.col("w.publication_year").alias("year"),
        F.col("w.type").alias("kind"), F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by"), F.regexp_extract(blank(F.col("w.ids.pmid")), r"(\d+)/?$", 1).alias("pmid"),
    )


def csl_json(rows: DataFrame) -> DataFrame:
    """``id, json`` of entries (id, type, title, year, doi, creators), as CSL-JSON; empty fields are left out."""
    names = F.transform("creators", lambda c: F.struct(F.nullif(c["lastName"], F.lit("")).alias("family"), F.nullif(c["firstName"], F.lit("")).alias("given"), F.nullif(c["name"], F.lit("")).alias("literal")))
    issued = F.when(F.col("year").rlike(r"^\d{4}$"), F.struct(F.array(F.array(F.col("year").try_cast("int"))).alias("date-parts")))
    entry = F.struct("id", "type", F.nullif("title", F.lit("")).alias("title"), F.nullif("doi", F.lit("")).alias("DOI"), issued.alias("issued"), F.when(F.size("creators") > 0, names).alias("author"))
    return rows.select("id", F.to_json(entry).alias("json"))


def bibtex(rows: DataFrame) -> DataFrame:
    """``id, text`` of entries (id, key, type, title, year, doi, creators), as BibTeX."""
    names = F.array_join(F.transform("creators", lambda c: F.coalesce(F.nullif(c["name"], F.lit("")), F.array_join(F.filter(F.array(c["lastName"], c["firstName"]), lambda x: x != ""), ", "))), " and ")
    safe = lambda c: F.regexp_replace(blank(c), r"([&%$#_])", r"\\$1")
    field = lambda name, value: F.when(value != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    fields = F.filter(F.array(field("author", safe(names)), field("title", safe(F.col("title"))), field("year", blank(F.col("year"))), field("doi", blank(F.col("doi")))), lambda x: x.isNotNull())
    return rows.select("id", F.concat(F.lit("@"), "type", F.lit("{"), "key", F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}")).alias("text"))


def pico_query(parts: list[Column]) -> Column:
    """Search text: terms of a part joined by OR, parts by AND; phrases are quoted, empty parts left out."""
    def block(part: Column) -> Column:
        terms = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(part, F.lit("")), r"[;,\n]"), lambda t: F.trim(t)), lambda t: t != ""))
        quoted = F.transform(terms, lambda t: F.when(t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
        return F.when(F.size(terms) == 1, quoted[0]).when(F.size(terms) > 1, F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")))

    return F.array_join(F.filter(F.array(*[block(p) for p in parts]), lambda b: b.isNotNull()), " AND ")
