"""What several operators share: stored intermediate tables, joins safe against hot keys, shipping of code."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import ship
from vellum.storage import store

__all__ = ["LOCATOR", "chunks", "join_back", "located", "ship", "store"]

#: Keys that get a broadcast row of their own in a join back; any other key then holds under 1/256 of the rows.
HOT_KEYS = 256


def join_back(rows: DataFrame, verdicts: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join of many ``rows`` per key with one row of ``verdicts`` per key.

    The 256 keys of the largest ``weight`` (rows they stand for) are broadcast, which
    leaves under 1/256 of the rows to any key that is shuffled. Rows already matched
    are dealt out by ``spread`` (a column of the key's type, different for every row).
    ``verdicts`` must be stored or cheap: it is read twice. Null keys match no verdict.
    """
    payload = [c for c in verdicts.columns if c != key]
    hot = F.broadcast(verdicts.orderBy(F.col(weight).desc(), F.col(key)).limit(HOT_KEYS).select(F.col(key).alias("_hk"), F.struct(*payload).alias("_hot")))
    cold = verdicts.select(F.col(key).alias("_ck"), F.struct(*payload).alias("_cold"))
    dealt = rows.join(hot, F.col(key) == F.col("_hk"), "left").withColumn("_k", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key)))
    joined = dealt.join(cold, F.col("_k") == F.col("_ck"), "left")
    value = lambda c: F.when(F.col("_hk").isNotNull(), F.col(f"_hot.{c}")).when(F.col(key).isNotNull(), F.col(f"_cold.{c}"))
    return joined.select(*rows.columns, *[value(c).alias(c) for c in payload])


#: Names of the columns that tell every row of a table from every other.
LOCATOR = ("_file", "_row")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with LOCATOR: a hash of its file's path and its number in the file, the same whenever it is read.

    Tables of other than Parquet files are stored first. Columns of those names are replaced.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = store(docs, "rows")
    return docs.withColumns({LOCATOR[0]: F.xxhash64("_metadata.file_path"), LOCATOR[1]: F.col("_metadata.row_index")})


def chunks(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    now, size = [], 0
    for text in texts:
        now.append(text)
        size += len(text or "")
        if size >= chars:
            yield now
            now, size = [], 0
    if now:
        yield now


ship(__name__)
