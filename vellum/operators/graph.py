"""Concept nodes and co-occurrence edges of mentions, citation candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.identifiers import concept_key
from vellum.storage import store

TYPE_ORDER = ("concept", "measure", "outcome")


def alias_rows(lines: DataFrame) -> DataFrame:
    """``alias_key, key, name`` of alias groups (``pos``, ``line``: names joined by "="); the first name leads, the first group wins a clash."""
    names = F.filter(F.transform(F.split("line", "="), lambda n: F.trim(n)), lambda n: n != "")
    groups = lines.filter(~F.trim("line").rlike(r"^(#|//)")).select("pos", names.alias("names")).filter(F.size("names") > 1)
    rows = groups.select("pos", F.element_at("names", 1).alias("name"), F.posexplode("names").alias("i", "alias")).select("pos", "i", "name", concept_key(F.col("alias")).alias("alias_key"), concept_key(F.col("name")).alias("key"))
    return rows.groupBy("alias_key").agg(F.min_by(F.struct("key", "name"), F.struct("pos", "i")).alias("g")).select("alias_key", "g.key", "g.name")


def resolved(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Mentions (``paper``, ``pos``, ``name``, ``type``) with their concept ``key`` and a fixed name where an alias gives one."""
    rows = mentions.withColumn("own_key", concept_key(F.col("name"))).filter("own_key <> ''")
    if aliases is None:
        return rows.withColumn("key", F.col("own_key")).withColumn("fixed", F.lit(None).cast("string")).drop("own_key")
    return rows.join(aliases.withColumnRenamed("name", "fixed"), F.col("own_key") == F.col("alias_key"), "left").withColumn("key", F.coalesce("key", "own_key")).drop("own_key", "alias_key")


def concept_nodes(rows: DataFrame) -> DataFrame:
    """``key, name, n_papers, n_variants, types``: the alias's name, else the most used spelling (on a tie the one seen first)."""
    rows = store(rows.select("key", "name", "type", "paper", "pos", "fixed"), "resolved")
    spelled = rows.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("paper", "pos")).alias("first"), F.max("fixed").alias("fixed"))
    # Of the most used spellings the one seen first: the largest count with the smallest place.
    best = spelled.groupBy("key").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n_variants"), F.max("fixed").alias("fixed"))
    named = spelled.join(best.select("key", "most"), "key").filter("n = most").groupBy("key").agg(F.min_by("name", "first").alias("spelling"))
    papers = rows.groupBy("key").agg(F.countDistinct("paper").alias("n_papers"), F.collect_set("type").alias("kinds"))
    types = F.array_join(F.array_intersect(F.array(*map(F.lit, TYPE_ORDER)), F.col("kinds")), ",")
    return papers.join(best, "key").join(named, "key").select("key", F.coalesce("fixed", "spelling").alias("name"), "n_papers", "n_variants", types.alias("types"))


#: Concepts of a paper that are paired with all others of it in one task.
PAIRED = 1_000


def cooccurrence(rows: DataFrame, paper: str = "paper", key: str = "key") -> DataFrame:
    """``a, b, n`` with a < b: papers that mention both.

    A paper of n concepts has n (n - 1) / 2 pairs, which is what is asked for; they are
    counted in parts of PAIRED concepts against all, so no task has more than that of a paper.
    """
    sets = store(rows.select(paper, F.col(key).alias("a")).filter(F.col(paper).isNotNull() & F.col("a").isNotNull()).distinct(), "concepts")
    parts = sets.groupBy(paper).agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("int").alias("parts"))
    sized = sets.join(parts, paper)
    left = sized.select(paper, "a", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    right = sized.select(paper, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, [paper, "part"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """``node, other, n, place``: each node's ``k`` strongest neighbours, ties by name."""
    edges = store(edges, "edges")
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "other"))
    return both.withColumn("place", place).filter(F.col("place") <= k)


def merge_candidates(hits: DataFrame, key: Column) -> DataFrame:
    """One row per work: distinct links (direction, seed), distinct seeds, most cited first."""
    links = hits.select(key.alias("work"), "direction", "seed", "cited_by").groupBy("work", "direction", "seed").agg(F.max("cited_by").alias("cited_by"))
    return links.groupBy("work").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("seed").alias("seeds"), F.count_if(F.col("direction") == "forward").alias("forward"), F.max("cited_by").alias("cited_by")
    )


def orphans(existing: DataFrame, current: DataFrame, key: str = "key") -> DataFrame:
    """Existing nodes that nothing mentions any more, kept with a count of 0."""
    return existing.join(current.select(key), key, "left_anti").withColumn("n_papers", F.lit(0).cast("long"))
