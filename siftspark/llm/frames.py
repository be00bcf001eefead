"""Small helpers for frames whose columns are not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name in taken:
        n += 1
        name = f"_{stem}_{n}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that nothing refers to any more.

    The cleaner learns of them when the driver's JVM collects garbage, which a driver with little to do seldom does.
    """
    spark.sparkContext._jvm.System.gc()
