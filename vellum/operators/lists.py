"""Ordered lists and trees: rounds, headings, unique names, subtrees, alignments, plans and carry-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.storage import store


def round_robin(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first of every group, then the second of every group, ... ``k`` rows in all, groups by name."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("round", place).filter(F.col("round") <= k).orderBy("round", group).limit(k)


def under_headings(lines: DataFrame, doc: str, pos: str, line: Column) -> DataFrame:
    """Lines of Markdown with ``heading``: the last heading above them in their document; null before the first."""
    title = F.when(line.rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace(line, r"^#+\s+", "")))
    above = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_own", title).withColumn("heading", F.last("_own", ignorenulls=True).over(above)).filter("_own IS NULL").drop("_own")


def checklist_counts(lines: DataFrame, line: Column, *groups: str) -> DataFrame:
    """Check boxes under each group: all and ticked."""
    box = line.rlike(r"^\s*[-*] \[[ xX]\] ")
    return lines.filter(box).groupBy(*groups).agg(F.count(F.lit(1)).alias("items"), F.count_if(line.rlike(r"^\s*[-*] \[[xX]\] ")).alias("ticked"))


def numbered_within(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``n``, their number (from 1) in their group by ``order``; equal rows are numbered in any order.

    Rows lie in ranges of group and order, so that a group of any size is spread over
    many tasks; a range's numbers go on from those of the ranges before it.
    """
    ranged = store(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    parts = parts.select("_g", "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    met = ranged.withColumn("_inside", inside).join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.withColumn("n", F.col("_before") + F.col("_inside")).drop("_part", "_p", "_g", "_before", "_inside")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with ``file``: names that differ only in case get " 2", " 3", ... by order."""
    placed = numbered_within(rows.withColumn("_name", F.lower(name)), "_name", F.col(order).asc())
    return placed.withColumn("file", F.when(F.col("n") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" "), F.col("n").cast("string")))).drop("_name", "n")


def descendants(edges: DataFrame, top: str) -> DataFrame:
    """``key, path, level`` of all below ``top`` in a tree (key, parent, name), level by level until a level is empty.

    A key is met once, at its first level, so that a loop ends; siblings of one key and level each give a path.
    """
    edges = edges.select("key", "parent", "name")
    level = store(edges.filter(F.col("key") == top).select("key", F.col("name").alias("path"), F.lit(0).alias("level")), "level")
    found, depth = level, 0
    while level.limit(1).count():
        depth += 1
        below = edges.join(level.select(F.col("key").alias("parent"), F.col("path").alias("_above")), "parent").join(found.select("key").distinct(), "key", "left_anti")
        level = store(below.select("key", F.concat_ws("/", "_above", "name").alias("path"), F.lit(depth).alias("level")), "level")
        found = found.unionByName(level)
    return found


def top_level(items: DataFrame, selected: DataFrame) -> DataFrame:
    """The live top-level items of a selection of items and their children, once each."""
    chosen = selected.join(items, "id").select(F.coalesce("parent", "id").alias("id")).distinct()
    return chosen.join(items.filter("parent IS NULL AND NOT deleted"), "id", "left_semi")


def aligned(answers: DataFrame, catalog: DataFrame, *groups: str) -> DataFrame:
    """Answers on the items of a catalog (item, pos): by position where their number is the catalog's, else by item."""
    n = catalog.agg(F.count(F.lit(1)).alias("_n"))
    counted = answers.join(answers.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c")), list(groups)).crossJoin(F.broadcast(n)).withColumn("_by_pos", F.col("_c") == F.col("_n"))
    items = catalog.select(F.col("item").alias("_item"), F.col("pos").alias("_pos"))
    by_pos = counted.filter("_by_pos").join(items, F.col("pos") == F.col("_pos"))
    by_item = counted.filter("NOT _by_pos").join(items, F.col("item") == F.col("_item"))
    return by_pos.unionByName(by_item).select(*groups, F.col("_item").alias("item"), "answer")


def match_any(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keys: tuple[str, str]) -> DataFrame:
    """Pairs of keys that agree in any of several columns: a union of equi-joins, never a join on OR."""
    found = None
    for a, b in pairs:
        part = left.select(F.col(keys[0]), F.explode(a).alias("_v") if dict(left.dtypes)[a].startswith("array") else F.col(a).alias("_v")).join(right.select(F.col(keys[1]), F.col(b).alias("_v")), "_v").select(*keys)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def plan_memberships(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Per container: memberships (container, item) to add and those already there; ``new`` containers are to be created."""
    have = present.select("container", "item", F.lit(True).alias("_have")).distinct()
    known = present.select("container").distinct().withColumn("_known", F.lit(True))
    rows = wanted.distinct().join(have, ["container", "item"], "left").join(known, "container", "left")
    return rows.groupBy("container").agg(F.count_if(F.col("_have").isNull()).alias("adds"), F.count_if(F.col("_have")).alias("already"), F.bool_and(F.col("_known").isNull()).alias("new"))


def carried_over(now: DataFrame, before: DataFrame, key: str, state: str) -> DataFrame:
    """``now`` with the state that the same key had before; its own where it is new."""
    old = before.groupBy(key).agg(F.max(state).alias("_old"))
    return now.join(old, key, "left").withColumn(state, F.coalesce("_old", state)).drop("_old")


def shared_values(rows: DataFrame, dimension: str, value: str, item: str, least: int = 2) -> DataFrame:
    """Values of a dimension by folded key: spelling used first, items that have it, whether enough share it."""
    key = F.lower(F.trim(F.col(value)))
    return rows.filter(F.coalesce(F.trim(value), F.lit("")) != "").groupBy(dimension, key.alias("key")).agg(F.min_by(F.trim(value), item).alias("value"), F.countDistinct(item).alias("items")).withColumn("shared", F.col("items") >= least)


def resolve_columns(have: list[tuple[str, str, str]], want: list[dict]) -> dict[str, str]:
    """Which column (id, name, type) serves each wanted field: by stored id, else by the first of its names, its type preferred."""
    by_id = {i: name for i, name, _ in have}
    found = {}
    for field in want:
        if field.get("id") in by_id:
            found[field["key"]] = by_id[field["id"]]
            continue
        for name in field["names"]:
            fitting = sorted((kind != field["type"], name) for _, have_name, kind in have if have_name == name)
            if fitting and name not in found.values():
                found[field["key"]] = name
                break
    return found


def evolved(rows: DataFrame, want: list[dict]) -> DataFrame:
    """``rows`` in the wanted schema: fields (key, names, type) that a column serves are renamed and cast, others are added as nulls, and columns that no field asks for stay behind them.

    A column that is left over and bears a wanted field's name is put aside as ``<name>_old``, so nothing is overwritten.
    """
    served = resolve_columns([(f.name, f.name, f.dataType.simpleString()) for f in rows.schema], want)
    used = set(served.values())
    fields = [(F.col(served[f["key"]]).try_cast(f["type"]) if f["key"] in served else F.lit(None).cast(f["type"])).alias(f["key"]) for f in want]
    taken = {f["key"] for f in want}
    return rows.select(*fields, *[F.col(c).alias(f"{c}_old" if c in taken else c) for c in rows.columns if c not in used])
