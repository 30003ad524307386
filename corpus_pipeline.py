"""A corpus from raw documents to token ids: five stages, each an operator of orthant.llm.

Each stage reads what its predecessor wrote. All but the last give back the columns of documents, further
columns of whatever name among them. No rows in give no rows out. What a stage does with nulls, ties and repeated rows
is said with the stage; ids may be null or repeat everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthant.llm import decontam, mixing, neardup, quality, storage, tokens
from orthant.llm.queries import read, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null, empty or short text fails; repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates. Of repeated rows (same id and text) one
    stays; different texts of one id are documents of their own; null ids come after all others; texts without a word stay."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none; null and empty items are in none; repeated
    rows are judged alike."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; of the document at the edge of its source's last pass a text of
    the words that are taken once more. A null source is a source; documents without a word stay once; repeated rows
    share what is taken of them."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token files: null ids first, rows of one id
    in an order of their texts. A null or empty text is an end id."""
    return tokens.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Signatures, tokenizers and the repetition verdict can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    folder = storage.shared_dir(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), folder, name)
    return docs
