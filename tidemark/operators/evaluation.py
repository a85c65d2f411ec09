"""Retrieval quality: ranks, recall, reciprocal rank, and samples that are drawn alike everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_ranks(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """query and rank of the first right answer (null if none), of the queries in truth (query, doc)."""
    hit = answers.join(truth, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("rank"))
    return truth.select("query").distinct().join(hit, "query", "left")


def metrics(ranks: DataFrame, at: tuple[int, ...] = (1, 3, 8, 12)) -> DataFrame:
    """n_queries, recall at ranks, mean reciprocal rank, share without right answer."""
    recall = [F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in at]
    return ranks.agg(F.count("*").alias("n_queries"), *recall, F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("rank").isNull(), 1.0).otherwise(0.0)), 6).alias("share_empty"))


def systematic(rows: DataFrame, order: list[str], every: int, skip: int = 0) -> DataFrame:
    """Each every-th row in order, after skip; order must be total. Positions are counted by range partitions, so no task holds the whole."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from tidemark.session import settle

    ranged = settle(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(before), "_part").withColumn("position", F.col("_at") + F.col("_before"))
    return placed.where((F.col("position") >= skip) & ((F.col("position") - skip) % every == 0)).drop("_part", "_at", "_before")
