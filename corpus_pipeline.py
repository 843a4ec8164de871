"""The corpus pipeline: language, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame; ``run`` writes every stage's result as Parquet to the shared folder and reads it for the next.
Only the last stage does not return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.llm import language_id, line_dedup, near_dedup, packing, quality_classifier
from tracelake.llm.queries import VOCABULARY, fold
from tracelake.llm.tables import drop, scratch, stored, table

#: No SQL: the trained stages and the packing cannot be expressed in it.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject; ``lang`` stays as it came.

    Every row is judged by its own text, whatever its id: null and empty texts, and ones without a letter, go; repeated rows
    stay repeated. Of an empty table, or without a row to learn from, nothing stays.
    """
    model = language_id.fit(docs.where(fold(5) > 0))
    return docs.where(language_id.accepted(F.col("text"), model))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of documents still here, predicts as good.

    Every row is judged by its own text, whatever its id; null texts are judged as empty ones. Without a
    label of one class the other class's label decides for all, without any label all stay.
    """
    labels = table(spark, sf_dir, "labels").where(fold(5) > 0)
    model = quality_classifier.learn(quality_classifier.with_statistics(docs), labels)
    return docs.where(quality_classifier.accepted(F.col("text"), model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without non-empty lines of any length that repeat an earlier one; ``n_chars`` follows the text.

    Null texts stay null, with null characters; a text of which no line is left is empty. Rows without an id stay as they are.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id.

    Rows with equal ids are one document and stay or go together; null and empty texts, and rows without an id, stay.
    """
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.alias("docs").join(gone.alias("gone").hint("merge"), F.col("docs.doc_id") == F.col("gone.doc_id"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, placed in sequences of at most 4096 tokens.

    Null and empty texts are one piece, their end token; every row is packed, with or without an id of its own.
    """
    return packing.pack(docs, VOCABULARY, room=4096, end_id=1)


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``.

    A stage's scratch tables go when its result is written, and that goes when the next stage's is: the
    shared folder holds two results at a time, and the last one in the end.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as area:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            result = area.pop()
        if before is not None:
            drop(spark, before)
        before = result
    return docs
