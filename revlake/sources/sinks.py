"""Sinks: CSV and JSON of a listing, and star-schema tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(listing: DataFrame, path: str, compression: str = "none") -> None:
    listing.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression).csv(path)


def write_json(listing: DataFrame, path: str, compression: str = "none") -> None:
    listing.write.mode("overwrite").option("ignoreNullFields", False).option("compression", compression).json(path)


def write_table(df: DataFrame, path: str, created: str | None = None) -> None:
    """Parquet, in folders by the month of a creation time: a key's month never changes, so merges rewrite few folders."""
    if created is None:
        df.write.mode("overwrite").parquet(path)
    else:
        df.withColumn("created_month", F.date_format(created, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_month").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int = 64) -> DataFrame:
    """Parquet in buckets of a key, sorted by it, under a table's name: tables with one key and number of buckets are joined
    without an exchange. The files lie under path; the name is dropped by DROP TABLE, the files are not."""
    dealt = df.repartition(buckets, key)  # a task for each bucket writes its one file
    dealt.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
