"""A corpus from raw documents to packed sequences, in stages that each read what the one before wrote.

Documents that the quality rules reject go, as do failing lines of the others; of near copies (five-word shingles, similarity of
0.8 or more) the one with the smallest doc_id stays; strings of 200 bytes that occur again are cut out; personal data is masked;
what is left is tokenised and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernpath.llm import common, jaccard_join, packing, pii, quality_rules, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without failing lines. Null, empty and short texts go; repeated rows stay or go alike."""
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, told apart by doc_id and text; of rows alike in both one stays. No text is lost otherwise."""
    return jaccard_join.distinct(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of strings that occur elsewhere too; a text may become empty. Null texts stay null."""
    return suffix_dedup.removed(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind. Null texts stay null."""
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document's tokens and its place among the sequences. Null texts are one token, the end."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents`; what the others return is written in between. No documents: no rows."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
