"""Observation logs, drift between runs, flags on stored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGE = 8000
INJECTION = r"(?i)ignore (all )?(previous|prior|above) instructions|<script|system prompt|javascript:"


def append(rows: DataFrame, folder: str, log: str) -> None:
    """Appends rows to one of the logs in a folder; messages are cut at 8,000 characters."""
    out = rows.withColumn("message", F.substring("message", 1, MESSAGE)) if "message" in rows.columns else rows
    out.withColumn("log", F.lit(log)).write.mode("append").partitionBy("log").parquet(folder)


def logs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All logs of a folder, with their names in ``log``; a filter on it reads that log only."""
    return spark.read.schema(f"{schema}, log string").parquet(folder)


def key_rates(rows: DataFrame) -> DataFrame:
    """(key, rate): the share of rows (``keys``: array) that have each key. Counted before the total, one row, is joined."""
    total = rows.agg(F.count("*").alias("total"))
    counts = rows.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("key", (F.col("n") / F.col("total")).alias("rate"))


def drift(before: DataFrame, after: DataFrame, limit: float) -> DataFrame:
    """(key, before, after, drifted): rates of two runs; a key that is missing from one has the rate 0 there."""
    rows = before.withColumnRenamed("rate", "before").hint("merge").join(after.withColumnRenamed("rate", "after"), "key", "full").fillna(0.0, ["before", "after"])
    return rows.withColumn("drifted", F.abs(F.col("before") - F.col("after")) > limit)


def text_flags(text: Column) -> Column:
    """Whether a text holds e-mail addresses, mobile or identity numbers, or words that address a model."""
    return F.struct(text.rlike(T.EMAIL).alias("has_email"), text.rlike(T.MOBILE).alias("has_mobile"), text.rlike(T.IDENTITY).alias("has_identity"), text.rlike(INJECTION).alias("has_injection"))
