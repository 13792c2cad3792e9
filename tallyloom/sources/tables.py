"""Stored tables: Parquet, or a relational database through JDBC."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    if not url:
        raise ValueError("Database configuration is incomplete.")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append-only Parquet sink in the declared column order."""
    df.select(*[df[f.name].cast(f.dataType) for f in schema]).write.mode("append").parquet(path)
