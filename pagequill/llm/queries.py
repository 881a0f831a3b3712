"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequill.llm.chat import format_conversations, read_back, unescape
from pagequill.llm.decontaminate import leaks
from pagequill.llm.digests import deduplicate, new_index
from pagequill.llm.divergence import source_divergence
from pagequill.llm.embeddings import near_vectors
from pagequill.llm.filter_audit import audit_filters
from pagequill.llm.pagetext import extract_text
from pagequill.llm.quality import score_quality
from pagequill.llm.quality import train as train_quality
from pagequill.llm.ngram_join import similar_documents
from pagequill.llm.oracles import ORACLES  # noqa: F401
from pagequill.llm.substring import repeated_windows
from pagequill.llm.pieces import encode_texts
from pagequill.llm.toxicity import score_toxicity
from pagequill.llm.toxicity import train as train_toxicity
from pagequill.llm.urlrules import judge_urls

TOKENIZERS = "/opt/tokenizers"
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    formatted = format_conversations(turns, f"{tokenizers}/byte_bpe_50k.json")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_chat_digests, schema)


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read back from the formatted text alone: its turns, and what lies under the loss mask."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for row in batch.to_pylist():
            turns = read_back(row["formatted"])
            under = [unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"]]
            digest = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            loss = "".join(under)
            values = (row["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"]))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "first_word", "n_words")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_windows(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model")
    return found.withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "component_id", "n_links", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), new_index(spark, f"llm-index-{uuid.uuid4().hex}"))
    return found.withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filters": op6_url_filters,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}
