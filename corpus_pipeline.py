"""A corpus from raw documents: language, quality, near duplicates, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import digests
from tessera.llm.classifier import good_documents
from tessera.llm.jaccard import one_of_each_group
from tessera.llm.langid import identified
from tessera.llm.mixing import mixed
from tessera.session import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected go.

    Null, empty and letterless texts are rejected. Repeated rows fare alike; of
    tied languages the first by name counts, and a tie is within the margin, so
    it is rejected. Whole texts of any length count; other columns pass unchanged.
    """
    return identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labels of the documents that are left.

    Null and empty texts are scored as texts without words; without labels all
    score 0.5 and stay. Repeated rows fare alike; a score equal to the threshold
    stays. Other columns pass unchanged.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

    The smallest doc_id stays, a row without doc_id only where no other is in
    its group. Texts without words stand alone and stay. Different texts of one
    doc_id are told apart; of rows with the same doc_id and text one stays.
    """
    return one_of_each_group(docs, k=5, num=4, den=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row each time that a document is taken.

    Null sources are one source, last in order. Texts without words have size 0
    and are not taken. Rows without doc_id and different texts of one doc_id are
    taken as planned. The last document of a source is cut to the words that are
    left of its budget.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, repeated ones too; null texts are empty."""
    return digests(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL has no compression, kernel scores or BPE. The tests hold each stage's rows against a plain version; quality against its operator's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet and read again; an empty table gives no rows."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
