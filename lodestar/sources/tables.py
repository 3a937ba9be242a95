"""The parquet tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
