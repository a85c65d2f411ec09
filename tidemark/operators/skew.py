"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are split.
SALTS = 16


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with lookup on keys, the rows of each key in salts parts by the column spread; lookup is repeated for each part.

    lookup should be much smaller than rows. A null key meets nothing, as in any join.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
