"""Reading tables and text files; writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_lines(files: DataFrame, start: str = "start_line", most: int = 50) -> DataFrame:
    """``files`` with code: up to ``most`` lines from the 1-based line in column ``start``; null beyond the end."""
    ls = F.split("text", "\n", -1)
    code = F.array_join(F.slice(ls, F.greatest(F.col(start), F.lit(1)), F.lit(most)), "\n")
    return files.withColumn("code", F.when(F.col(start) <= F.size(ls), code))
