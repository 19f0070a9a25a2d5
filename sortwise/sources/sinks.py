"""Sinks: triage results (S7) and the structured event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the full result row.
RESULT = ["msg_id", "mensagem_completa", "texto_normalizado", "classification", "openaiPayload", "webhook", "bucket"]


def result_rows(df: DataFrame) -> DataFrame:
    """S7 layout of an assembled triage: the message as received, its normalised text,
    the classification, the request payload and where it came from."""
    return df.select("msg_id", F.col("message").alias("mensagem_completa"), F.col("norm").alias("texto_normalizado"),
                     F.struct("bucket", "rule_id", "reasons", "scope").alias("classification"),
                     F.col("payload").alias("openaiPayload"),
                     F.struct(F.col("sender").cast("string").alias("from"), F.col("ts").alias("received_at")).alias("webhook"),
                     "bucket")


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nested result rows partitioned by bucket."""
    df.write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def replace_buckets(df: DataFrame, path: str) -> None:
    """Replaces the buckets that ``df`` has rows of, and leaves the others' files alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_results(spark: SparkSession, path: str, *buckets: str) -> DataFrame:
    """Written results, of the named ``buckets`` only if there are any: the others'
    folders are pruned, their files never opened."""
    df = spark.read.parquet(path)
    return df.where(F.col("bucket").isin(*buckets)) if buckets else df


def event_log(df: DataFrame) -> DataFrame:
    """One record per processed message (bucket, scopes, length, model, and the
    measured latency of each stage: map<string,double> ``latencies`` of the input)."""
    return df.select("msg_id", "ts", F.lit("preprocessing_result").alias("log_type"),
                     F.col("bucket").alias("classification_bucket"),
                     F.col("scope").alias("scope_found"),
                     F.length("message").alias("original_message_length"),
                     F.col("model").alias("model_used"), "latencies")


def write_event_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
