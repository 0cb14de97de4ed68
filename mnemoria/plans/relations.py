"""Points, messages and vectors derived from the provided tables, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = [
    "doc_id",
    "concat('doc_', doc_id) AS memory_id",
    "source AS conversation_id",
    "lang AS project",
    "CASE doc_id % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'transcript' WHEN 2 THEN 'chat_export' WHEN 3 THEN 'audio_overview' ELSE 'summary' END AS source_type",
    "concat('File ', doc_id - doc_id % 6, CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN ' copy' ELSE '' END) AS source_title",
    "CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'bot' ELSE 'system' END AS speaker",
    "CASE doc_id % 3 WHEN 0 THEN 'preference' WHEN 1 THEN 'decision' ELSE 'fact' END AS memory_kind",
    "text",
    "substring(text, 1, 180) AS source_quote",
    "substring(text, 1, 220) AS summary",
    "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN doc_id % 7 = 0 THEN 'needs_review' ELSE 'inferred' END AS status",
    "doc_id % 11 = 0 AS canonical",
    "1704067200 + doc_id * 60 AS ts",
]
MESSAGES = [
    "cast(conv_id AS string) AS conversation_id",
    "concat(conv_id, '-', turn) AS message_id",
    "cast(turn AS bigint) AS turn",
    "role AS speaker",
    "text",
    "'chat_export' AS source_type",
    "1704067200 + conv_id * 86400 + turn * 60 AS ts",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").selectExpr(*POINTS)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*MESSAGES)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have a vector."""
    return points(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


POINTS_SQL = f"points AS (SELECT {', '.join(POINTS)} FROM documents LEFT JOIN labels USING (doc_id))"
MESSAGES_SQL = f"messages AS (SELECT {', '.join(MESSAGES)} FROM conversations)"
VECTORS_SQL = f"{POINTS_SQL}, vectors AS (SELECT p.*, e.embedding::DOUBLE[] AS embedding FROM points p JOIN embeddings e ON p.doc_id = e.vec_id)"
