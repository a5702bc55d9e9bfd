"""Sinks: JSON, results that are merged by experiment, and images by degradation."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.sources.results import Store


def receipt_json(receipt: Column) -> Column:
    """Pretty, with nulls kept."""
    return F.to_json(receipt, {"pretty": "true", "ignoreNullFields": "false"})


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def merge_results(spark: SparkSession, path: str, new: DataFrame, key: str = "exp") -> DataFrame:
    """The results at path with all rows of new's experiments replaced, and the merged table. See Store: all of it is seen at once, or none if the write fails."""
    store = Store(spark, path, key)
    store.replace(new)
    return store.read()


def write_images(rows: DataFrame, path: str) -> None:
    """Image bytes as Parquet, a folder for each degradation."""
    rows.write.mode("overwrite").partitionBy("degradation").parquet(path)
