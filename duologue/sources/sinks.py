"""Sinks: CSV, Parquet by session, JSON lines and embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_timeline(df: DataFrame, path: str) -> None:
    df.repartition("session_id").write.mode("overwrite").partitionBy("session_id").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def embeddable_json(value: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))
