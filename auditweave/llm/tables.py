"""Reading the given tables, and names no input column clashes with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def small_batches(rows: DataFrame) -> DataFrame:
    """The same rows, with at most 2,000 rows and some 16 MB in an Arrow batch from now on.

    The default of 10,000 rows lets a batch of long texts, or of sets, take a large part of an executor.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return rows


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def least_hashes(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Rows of ``column`` (a 60-bit hash, distinct) that hold its k least values, or all where there are fewer.

    Values over the k-th by far are left out where they lie, by an estimate of how many there are, so
    what is sorted in one task has about 2 k rows whatever the number of partitions.
    """
    different = rows.agg(F.approx_count_distinct(column)).first()[0]
    edge = min(1.0, (2 * k + 1000) / max(different, 1))
    return rows.where(F.col(column) <= int(edge * (1 << 60))).select(column).distinct().orderBy(column).limit(k)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits, the same in every engine that has md5."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash60(*parts: Column) -> Column:
    """A non-negative 60-bit number, the same in every engine that has md5."""
    digest = F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
