"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of files from which a table that few tasks read is dealt out.
LEAST_BYTES = 8 * 1024 * 1024


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark alone so that any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for row-wise work of some weight: dealt out if a large file of one row group would keep one core busy."""
    return spread(scan(spark, sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt out if it isn't small and is read by fewer tasks than there are cores, as a file of one row group is.

    Small tables, and those that many tasks read, are left alone. Filters and columns still reach the scan.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if size >= LEAST_BYTES and parts > df.rdd.getNumPartitions() else df
