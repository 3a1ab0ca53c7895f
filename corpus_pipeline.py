"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
one's ``docs``. All stages but the last return the columns of ``docs``, whatever their names, and rows as they were but for
what a stage changes. All read whole texts, of any length. An empty table stays empty in each stage, and where ``labels`` or
``benchmark`` is empty nothing is rejected. What a stage does with null, empty and repeated rows is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decontam, line_dedup, mixing, ngram_join, quality
from tablewright.llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score what the bias says, and are judged by it; null ids and repeated rows
    are judged like others, each row by its own text."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; documents of which nothing is left go. Null and empty texts stay. A null id
    comes before others, so its text stays whole; rows that repeat id and text are one document, and stay both or go both."""
    return line_dedup.cleaned(docs, Scratch(spark, "pipeline-lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, 80 percent. The one of the smallest id, then the smallest hash of its
    text. Null and empty texts and null ids stay; of rows that repeat id and text one stays."""
    return ngram_join.keep_one(docs, Scratch(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts have none and stay; repeated rows stay both or go both."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-decontam"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, copies, taken. Null and empty texts have no words; they are taken
    at their source's rate like others. A null source is one, the last; rows that repeat an id are documents of their own."""
    return mixing.mix(docs, Scratch(spark, "pipeline-mix")).where("copies > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]
#: SQL can't express the classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table goes once the next one is written."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    last = []
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
