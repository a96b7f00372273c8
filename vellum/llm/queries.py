"""Queries of this subpackage and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm.alignment import align
from vellum.llm.bpe import bpe_encode
from vellum.llm.collocations import collocations
from vellum.llm.exact_dedup import exact_dedup
from vellum.llm.hnsw import nearest
from vellum.llm.html import extract
from vellum.llm.langid import held_out, identify, train
from vellum.llm.mixing import mix
from vellum.llm.oracles import ORACLES
from vellum.llm.packing import pack
from vellum.llm.passages import passage_removals
from vellum.llm.pii import pii_report
from vellum.llm.secrets import arrivals_report, secret_report
from vellum.llm.simhash import simhash_groups
from vellum.session import table

__all__ = ["ORACLES", "QUERIES"]


def first_arrival():
    """Rows that come first where a table is taken as two arrivals: about half of them, by a hash of doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.lit(False))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two arrivals: the first is indexed as history, the second looked up in it."""
    return exact_dedup(table(spark, sf_dir, "documents"), first_arrival())


def language_model(docs: DataFrame):
    """Fitted on a bounded sample of the labelled rows outside the held-out fold."""
    return train(docs, ~held_out(F.col("doc_id")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; lang, source and doc_id are no inputs of a prediction."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, ... of their sources, three epochs at most."""
    return mix(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in two documents or more, over all paragraphs of all documents."""
    return passage_removals(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, scanned once per distinct blob against an empty ledger."""
    return secret_report(table(spark, sf_dir, "documents"))


def secrets_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two arrivals: the second meets the ledger that the first has left."""
    return arrivals_report(table(spark, sf_dir, "documents"), first_arrival())


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii_report(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings for every hundredth id."""
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents")).drop("root_fp")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the public 50k byte-level vocabulary, and the round trip."""
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 first collocations of every language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under two public vocabularies, aligned, with the corpus-wide counts of its links."""
    import public_tokenizers

    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN, with_groups=False)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2,048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_secrets": op4_secrets,
    "op5_html": op5_html,
    "op6_pii": op6_pii,
    "op7_hnsw": op7_hnsw,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_alignment": op12_alignment,
    "op13_packing": op13_packing,
    "secrets_in_arrivals": secrets_in_arrivals,
    "pipeline": corpus_pipeline.run,
}
