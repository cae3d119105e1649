"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None, by: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a database, for which the caller brings the driver. by: (column, lower, upper, parts) reads it in parallel; without
    it one task reads all."""
    if by is None:
        return spark.read.jdbc(url, name, properties=properties or {})
    column, lower, upper, parts = by
    return spark.read.jdbc(url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties or {})


def scan(df: DataFrame, columns: list[str] | None = None, predicate: str | None = None, limit: int | None = None, count_star: bool = False) -> DataFrame:
    """The rows of a table, or of some columns, that satisfy a predicate, at most `limit` of them; with count_star their number."""
    if limit is not None and limit < 0:
        raise ValueError("a limit is not negative")
    out = df if predicate is None else df.where(predicate)
    if columns:
        out = out.select(*columns)
    out = out if limit is None else out.limit(limit)
    return out.agg(F.count("*").alias("count")) if count_star else out


def scalar(df: DataFrame) -> object:
    """The first value of the first row; null for no row."""
    row = df.first()
    return row[0] if row is not None and len(row) else None
