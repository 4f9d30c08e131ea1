"""A corpus pipeline of the operators in docquarry.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last returns token counts and digests.
Each begins with a collection of the executors' garbage, so that the heap that one has grown doesn't stand beside the next one's Python workers.
``run`` writes each stage's rows as a table in the shared folder and hands the next stage that table.

Every stage takes nulls in any column, texts of any length as a whole, and an empty table, which gives an empty one; columns that ``documents`` doesn't
usually have stay as they are, whatever their names (the last stage returns its own columns alone). Repeated rows are told apart by no stage but line dedup, which
takes rows with the same doc_id and text as one document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from docquarry.llm.common import bounded_batches, collected, free, table, written

#: Least mean probability of a document's language; below it the model says little more than that the text is none of its languages.
MIN_LANGUAGE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not those that are null, have no letter, or fit no language. ``lang`` stays as it is given, or is the one told where null.

    Of languages that score the same the first by name is told. Without labelled rows no language is, and no document stays.
    """
    bounded_batches(spark)
    return language_id.told(docs, language_id.fit(docs), MIN_LANGUAGE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those left without any word go. Documents that lose nothing stay as they are, empty ones too.

    Earlier means a smaller doc_id (null first), then hash of the text, then line. ``n_chars`` is that of what is left.
    """
    lost = free("n_dropped", docs.columns)
    kept = line_dedup.dedup_lines(docs, n_dropped=lost).where(f"`{lost}` = 0 or trim(BOTH ' \t\r\n' FROM text) <> ''")
    return kept.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id. Documents without words, or with a null doc_id, are in no group and stay."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; each row is told by its own text, whatever its doc_id. Null and empty texts stay, and all do where there are no items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each document; a null text counts as empty."""
    return bpe.encode_digests(docs)


def _after_collection(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collected(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES = [
    ("language ID", _after_collection(identify_language)),
    ("line dedup", _after_collection(dedup_lines)),
    ("n-gram Jaccard join", _after_collection(one_of_near_copies)),
    ("benchmark decontamination", _after_collection(decontaminate)),
    ("BPE encoding and decoding", _after_collection(encode)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
