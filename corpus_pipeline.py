"""A corpus pipeline: quality rules, quality classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm import packing, quality_knn, quality_rules, secrets, simhash
from ledgerfold.llm._common import Scratch, spread, table
from ledgerfold.llm.queries import tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that failed."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled rows of the documents table."""
    space = quality_knn.fit_labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_knn.keep_predicted(docs, space)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets masked."""
    return secrets.mask_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-duplicates", near_duplicates_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the classifier or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents: the places of the pieces of what is left.

    Null and empty texts have too few words and go in the first stage, as an empty table gives an
    empty result. Rows that repeat an id and its text, like near copies, are one document after the third;
    rows without an id take part like others. Texts of any length go through whole, and stages but the last return
    the columns that they are given, by whatever names.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
