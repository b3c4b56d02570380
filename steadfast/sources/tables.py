"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name` of a folder; only the named columns reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A CSV file with a header and a given schema, so that nothing is inferred."""
    return spark.read.options(header=True, **options).schema(schema).csv(path)


def write_table(df: DataFrame, path: str, *, partition_by=(), mode: str = "errorifexists") -> None:
    """df as Parquet, optionally partitioned by columns."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)
