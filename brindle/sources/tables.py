"""Reading the driver's tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a test data folder; only the columns a query names are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc_day(column: str) -> Column:
    """Days since 1970-01-01 (UTC) of a column of epoch seconds, rounded down also before 1970; null stays null."""
    return F.expr(f"`{column}` div 86400 - if(`{column}` % 86400 < 0, 1, 0)")
