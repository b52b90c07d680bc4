"""A training corpus from raw documents, in stages. Each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlens.llm import language_id, line_dedup, packing, simhash, substring_index
from boxlens.llm.common import Workspace, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go. The network learns from the labelled texts that came in."""
    return language_id.stage(docs, docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Multi-line chunks that an earlier document (by id) or line has go from the text; every document stays."""
    return line_dedup.stage(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays, whole."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that windows cover which also start elsewhere go from the text; every document stays."""
    return substring_index.stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places in token sequences of what is left."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_chunks),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substrings),
    ("best_fit_packing", best_fit_packing),
]

#: Stages apply a trained model, XXH64 and a tokenizer: no SQL gives their rows. Tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
