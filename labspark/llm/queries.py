"""The training-data operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labspark.llm import filter_audit, licenses, line_templates, secrets
from labspark.llm.ann import nearest_neighbours
from labspark.llm.decontamination import leaks
from labspark.llm.minhash import near_duplicates
from labspark.llm.pivot_clusters import exact_clusters
from labspark.llm.pivot_clusters import oracle as clusters_oracle
from labspark.llm.quality import quality_scores
from labspark.llm.sentencepiece_codec import encoded_documents
from labspark.llm.substring import repeated_passages
from labspark.llm.token_files import token_files_of
from labspark.llm.toxicity import toxicity_scores

#: Vocabulary file of the encoder, on every executor.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"), PIECES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_of(table(spark, sf_dir, "documents"), WORDS, END_ID)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_clusters(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


LLM_QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_line_templates": op6_line_templates,
    "op7_decontamination": op7_decontamination,
    "op8_substring": op8_substring,
    "op9_graph_search": op9_graph_search,
    "op10_licenses": op10_licenses,
    "op11_secrets": op11_secrets,
    "op12_pivot_clusters": op12_pivot_clusters,
    "op13_filter_audit": op13_filter_audit,
}
LLM_ORACLE_SQL: dict[str, str] = {
    "op6_line_templates": line_templates.ORACLE,
    "op10_licenses": licenses.ORACLE,
    "op11_secrets": secrets.oracle(),
    "op12_pivot_clusters": clusters_oracle(),
    "op13_filter_audit": filter_audit.ORACLE,
}
