"""What the operators on training texts share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.staging import ship, unwritten, written

__all__ = ["ship", "table", "unwritten", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
