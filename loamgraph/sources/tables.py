"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ID_EPOCH_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z, the epoch of the 64-bit time-ordered ids


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
