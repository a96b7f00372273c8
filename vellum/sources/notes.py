"""Notes as files: frontmatter, managed regions, first copy per key; line and JSON sources with their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_vault(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, text`` of all Markdown files below the folders, hidden ones left out."""
    files = spark.read.text(list(folders), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").rlike(r"/\."))


def split_frontmatter(text: Column) -> Column:
    """Struct of frontmatter and body; the frontmatter is null where there is none."""
    pattern = r"^\x{FEFF}?---\r?\n(?s:(.*?))(?:\r?\n)?---[ \t]*(?:\r?\n|$)"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("frontmatter"), F.when(has, F.regexp_replace(text, pattern, "")).otherwise(text).alias("body"))


def frontmatter_map(frontmatter: Column) -> Column:
    """Map of key to its values: scalars, [inline, lists] and dashed lists; the last of a repeated key wins, quotes are dropped."""
    unquote = lambda v: F.regexp_replace(F.trim(v), r"^(['\"])(.*)\1$", "$2")
    blocks = F.filter(F.split(F.coalesce(frontmatter, F.lit("")), r"\r?\n(?=[^\s\-#][^:\n]*:)"), lambda b: b.rlike(r"^[^\s\-#:][^:\n]*:"))

    def values(block: Column) -> Column:
        rest = F.trim(F.regexp_replace(block, r"^[^:\n]*:", ""))
        dashed = F.regexp_extract_all(rest, F.lit(r"(?m)^\s*-\s+(.*)$"), F.lit(1))
        inline = F.split(F.regexp_extract(rest, r"^\[(.*)\]$", 1), r"\s*,\s*")
        found = F.when(rest.rlike(r"(?m)^\s*-\s+"), dashed).when(rest.rlike(r"^\[.*\]$"), inline).otherwise(F.array(rest))
        return F.filter(F.transform(found, unquote), lambda v: v != "")

    pairs = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^([^:\n]*):", 1)).alias("key"), values(b).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def head_value(text: Column, key: str, head: int = 4_096) -> Column:
    """A frontmatter value, read from the first characters where the frontmatter ends within them, else from the whole note; null without one."""
    first = F.left(text, F.lit(head))
    closed = first.rlike(r"\A\x{FEFF}?---[ \t]*\r?\n(?s:.*?\n)?---[ \t]*\r?\n")
    value = lambda note: F.nullif(F.regexp_extract(split_frontmatter(note)["frontmatter"], rf"(?m)^\Q{key}\E:[ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))
    return F.when(closed, value(first)).otherwise(value(text))


def first_copy(notes: DataFrame, key: str, order: str = "path") -> DataFrame:
    """One note per key, the first by path; notes without a key are left out."""
    rest = [c for c in notes.columns if c != key]
    return notes.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_n")).select(key, "_n.*")


def replace_region(text: Column, block: Column, start: str, end: str) -> Column:
    """``text`` with what stands between the markers replaced; a text without markers gets the region at its end.

    What the user wrote outside the region stays as it is.
    """
    region = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    at, stop = F.instr(text, start), F.instr(text, end)
    inside = (at > 0) & (stop > at)
    kept = F.concat(F.substring(text, F.lit(1), at - 1), region, F.substring(text, stop + len(end), F.length(text)))
    return F.when(inside, kept).when(F.coalesce(text, F.lit("")) == "", region).otherwise(F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), region, F.lit("\n")))


def config_lines(text: DataFrame, *keys: str) -> DataFrame:
    """``keys, pos, line`` of configurations (column ``text``): trimmed, comments and blank lines left out, positions from 1."""
    lines = text.select(*keys, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("pos"), F.trim("line").alias("line"))
    return lines.filter(~F.col("line").rlike(r"^(#|//|$)"))


def json_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of the lines that are JSON of the schema, and the lines that are not; blank lines are neither."""
    fields = T.StructType.fromDDL(schema)
    whole = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim(column) != "").select(F.from_json(column, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.col(column).alias("_line"))
    good = parsed.filter(F.col("r").isNotNull() & F.col("r._bad").isNull() & F.trim("_line").startswith("{"))
    bad = parsed.filter(F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.trim("_line").startswith("{"))
    return good.select(*[f"r.{f.name}" for f in fields]), bad.select(F.col("_line").alias("line"))


def subtree(items: DataFrame, path: str, top: str) -> DataFrame:
    """Items in a collection or any below it."""
    return items.filter((F.col(path) == top) | F.col(path).startswith(top + "/"))
