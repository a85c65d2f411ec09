"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose size is fixed by their definition, so that they may be broadcast or collected.
FIXED_TABLES = ("region", "nation", "mix_targets", "size_limits", "name_parts")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def limit_amount(spark: SparkSession, folder: str, name: str) -> int:
    """The amount of one row of size_limits."""
    rows = table(spark, folder, "size_limits").where(f"limit_name = '{name}'").select("amount").take(1)
    if not rows:
        raise ValueError(f"size_limits has no {name}")
    return int(rows[0]["amount"])
