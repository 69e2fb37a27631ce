"""The corpus pipeline: filter documents, drop repeated lines and copies, keep benchmarks out, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm.decontamination import leaks
from labspark.llm.line_templates import drop_recurring_lines
from labspark.llm.minhash import near_duplicates
from labspark.llm.quality import quality_scores
from labspark.llm.sentencepiece_codec import encoded_documents
from labspark.llm.storage import new_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows without doc_id stay."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    rejected = quality_scores(docs, labels).where("predicted = 0").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first; a document left without any word goes too."""
    cut = drop_recurring_lines(docs).where(r"n_dropped = 0 or text rlike '\\S'")
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    copies = near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without doc_id stay."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    leaking = leaks(docs, items).select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every document."""
    return encoded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The quality score, the walks of decontamination and the encoding are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
