"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Toxic documents go; one document of each group of near copies stays; passages that began earlier are cut out; documents
with a benchmark passage go; what is left is encoded. All stages but the last return the columns of ``documents``.
Every stage handles rows, not ids: repeated and null ids lose or multiply nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.decontaminate import without_leaks
from pagequill.llm.ngram_join import one_of_each_group
from pagequill.llm.pieces import encode_texts
from pagequill.llm.queries import TOKENIZERS, table
from pagequill.llm.staging import stage
from pagequill.llm.substring import repeated_windows
from pagequill.llm.toxicity import score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    docs = docs.select(*COLUMNS)
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).where("predicted = 0").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id, and all documents that have none."""
    return one_of_each_group(docs.select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words under windows that started earlier; a text that loses none is as it was."""
    cut = repeated_windows(docs, others=["lang", "source", "n_chars"]).withColumnRenamed("id", "doc_id")
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", size).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document that is left."""
    return encode_texts(docs, f"{TOKENIZERS}/piece_bpe_32k.model").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # no stage but the fourth has a form in SQL; tests compare each with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
