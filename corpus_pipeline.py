"""Corpus pipeline over ``documents``: language ID, exact dedup, SimHash near-dedup, mixing, BPE encoding.

Every stage is (spark, docs, sf_dir) -> DataFrame. It works on all rows that the stage
before it kept; each result is written as Parquet and read again as the next stage's docs.
Extra columns of any name pass through all stages but the last.
A stage decides about rows, told by their place in the files, not about doc_ids: rows
without a doc_id or with one that others have are each judged by their own text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import bpe_encode
from vellum.llm.common import LOCATOR, located, store
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.langid import held_out, identify, train
from vellum.llm.mixing import mix
from vellum.llm.simhash import simhash_groups
from vellum.storage import stage


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(function: Stage) -> Stage:
    """A stage whose input may have columns of any name: those that could clash with names of its own bear others inside it."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        mark = next(m for k in range(len(taken) + 1) if not any(c.startswith(m := f"own{k}x") for c in taken))
        names = {c: f"{mark}{k}" for k, c in enumerate(docs.columns) if c.startswith("_")}
        return function(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({inside: c for c, inside in names.items()})

    return run


def _without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """Located ``docs`` without the rows named; what is named is stored, so Spark knows its size and broadcasts it only if small."""
    return docs.join(store(losers.select(*LOCATOR), "losers"), list(LOCATOR), "left_anti").drop(*LOCATOR)


@_apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the classifier does not reject; all columns pass through.

    Null texts and texts without a letter go; repeated rows share their verdict.
    """
    model = train(docs, ~held_out(F.col("doc_id")))
    return identify(docs, model, keep=tuple(docs.columns), only_accepted=True)


@_apart
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep one row: one with the largest doc_id, or any row if none has a doc_id. Null equals the empty text."""
    rows = located(docs)
    first = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))
    return _without(rows, exact_dedup(rows, first, keep=LOCATOR).filter("NOT kept"))


@_apart
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, keep one row: the smallest doc_id, nulls last, then the first in the files."""
    rows = located(docs)
    groups = store(simhash_groups(rows, keep=LOCATOR), "groups")
    winners = groups.groupBy("root_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *LOCATOR)).alias("best")).select(*[F.col(f"best.{c}").alias(c) for c in LOCATOR])
    return _without(rows, groups.join(winners, list(LOCATOR), "left_anti"))


@_apart
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights; the null source is one of them, rows without words stay as often as their whole source."""
    rows = located(docs)
    taken = store(mix(rows, keep=LOCATOR).filter("repeats > 0").select(*LOCATOR, F.col("repeats").alias("_repeats")), "taken")
    # Nearly every row is taken, so the texts are shuffled at every size; a broadcast below some size would only hide it.
    return rows.join(taken.hint("merge"), list(LOCATOR)).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_repeats"))).alias("_copy")).drop("_copy")


@_apart
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every document's token ids and digest of their round trip; null texts have no tokens."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("encoding", encoding)]

#: No SQL can train and apply the classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        with stage():
            docs = store(function(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
