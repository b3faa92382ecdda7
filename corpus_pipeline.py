"""A training corpus from `documents`: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; the last returns the packed pieces. What a stage writes on its way goes as soon as its
result is written; the stages' results, which show what each of them did, go with the application.

Defined cases, for every stage: other columns of docs are carried as they are, whatever their names; an empty table gives an empty one; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontam, packing, quality, secrets, simhash
from fathom.llm._common import cleared, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of docs, accepts. A null or empty text gets the score of padding; without labels all scores are 0.5 and none is accepted."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id, then text hash. Texts without words (null, empty, white space) are one group; of repeated rows one stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts without words, and items without words, match nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars made to fit. Null texts stay null."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in sequences of at most 1024. A null or empty text is its end id alone."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: No SQL expresses a trained network, components or bin packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept: list[str] = []
        with cleared(spark, kept):
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(path)
    return STAGES[-1][1](spark, docs, sf_dir)
