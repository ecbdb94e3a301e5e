"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as
the next stage's docs. All but the last return the columns of ``documents``: quality drops rejected documents,
near keeps one document of each class, pii replaces personal data by its kind, mix repeats or leaves out
documents so that sources meet their targets (a document used twice is two rows), pack returns the pieces of
every row with their sequence and place. SQL cannot express the forest, the signatures, the flow and the packing, so
ORACLE_SQL is None and tests compare each stage with plain computation on its own input.

Null and empty texts, and those of less than 50 words, go with quality; null doc_ids, ties, repeated rows, very long
texts, empty tables and extra columns, whatever their names, pass through every stage: repeated rows are copies to near
and separate documents to the others, and a null source is a source of its own to mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import op6_mix, op7_pii, op8_quality, op9_pack, op10_near
from tidewatch.llm.common import new_folder, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_quality.keep_documents(docs, table(spark, sf_dir, "labels"), new_folder(spark, "quality"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_near.keep_one(docs, new_folder(spark, "near"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_pii.redact(docs, new_folder(spark, "pii"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mix.mix_documents(docs, new_folder(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op9_pack.pack_documents(docs, new_folder(spark, "pack"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near", near), ("pii", pii), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
