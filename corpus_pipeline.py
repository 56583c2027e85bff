"""Corpus cleaning: quality filter, near-copy removal, repeated-passage removal, decontamination, tokenizing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontamination, entries, jaccard, quality, substring
from gaugeworks.llm.common import cut, table

#: A document stays if its quality score is this or more and its score for being free of abuse is this or more.
GOOD, CLEAN = 0.7, 0.75
#: Words of a repeated passage; passages of over 50 words are caught even where both ends run into other words.
PASSAGE = 40


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two factorisation machines learned from labels over the stage's own documents: quality, and abuse (labels.toxic)."""
    labels = table(spark, sf_dir, "labels")
    good = quality.train(docs, labels, "quality")
    mild = quality.train(docs, labels.withColumn("mild", 1 - F.col("toxic")), "mild", epochs=12)
    return quality.keep(docs, [(good, GOOD), (mild, CLEAN)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by similarity of 5-word shingles of 0.8 or more."""
    return jaccard.keep_one(docs, 5, 4, 5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(docs, PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32), decoded_sha256."""
    out = bpe.bpe_round_trip(docs, entries.word_bpe())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The learned filter and the tokenizer are not SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
