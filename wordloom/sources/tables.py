"""Reading the driver's Parquet tables."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below sf_dir, which may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
