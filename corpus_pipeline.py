"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and calls one operator of
tidemark.llm. All but the last return the columns of docs. Tables are written to the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup
from tidemark.llm.common import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules' policy rejects go."""
    return quality_rules.kept_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores under one half go.

    It is fitted on the labelled documents of the whole table: the rules leave next to none of class 0 among docs.
    """
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return simhash.representatives(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that occur again in what is left go, from every place where they stand."""
    return suffix_dedup.without_repeats(docs)


#: A training sequence holds 4096 tokens of 64 documents at most.
SEQUENCE = packing.Capacity(tokens=4096, documents=64, attention=4096 * 4096, weights=(1.0, 0.5, 0.5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, placed in sequences of at most 4096 tokens and 64 documents."""
    return packing.packed(packing.pieces(docs, queries.tokenizer_path("word_bpe_49k.json"), SEQUENCE), SEQUENCE)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", passage_dedup), ("best_fit_packing", packed)]

#: Hashing, model fitting and packing have no SQL form; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
