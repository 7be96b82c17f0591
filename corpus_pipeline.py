"""From raw documents to packed training sequences, in stages that each read what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import ngram_join, packing, quality_rules, substring, weak_labels
from curata.llm.common import documents, materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer accepts."""
    return weak_labels.classify(docs, "doc_id", "text").where("kept").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of their language and source."""
    return quality_rules.apply_rules(docs, "text").where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles of likeness 0.8 or more, the document with the smallest id."""
    groups = ngram_join.near_duplicate_components(docs, "doc_id", "text", 5, 80)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has; a document left without words goes."""
    cut = substring.dedup_substrings(docs, "doc_id", "text", 13, keep_layout=True)
    left = cut.where("n_removed < n_words")
    return left.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages fit a classifier and read a tokenizer, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None
