"""Joins and aggregates on ranges of lines: union, gaps, containment, nearest before and nearest around. All by buckets, none by cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, key: str, apart: int = 1) -> DataFrame:
    """key, from_line, to_line of the union of ranges; neighbours that are at most apart lines from each other become one."""
    order = Window.partitionBy(key).orderBy("from_line", "to_line")
    reach = F.max("to_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.where("from_line <= to_line").withColumn("_new", F.when(F.col("from_line") <= reach + apart, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return islands.groupBy(key, "_island").agg(F.min("from_line").alias("from_line"), F.max("to_line").alias("to_line")).drop("_island")


def gaps(covered: DataFrame, sizes: DataFrame, key: str, least: int) -> DataFrame:
    """key, from_line, to_line of the runs of at least so many lines that no (merged) range covers; sizes has key and lines."""
    order = Window.partitionBy(key).orderBy("from_line")
    clipped = covered.join(sizes, key).select(key, "lines", F.greatest("from_line", F.lit(1)).alias("from_line"), F.least("to_line", "lines").alias("to_line")).where("from_line <= to_line")
    before = clipped.select(key, (F.coalesce(F.lag("to_line").over(order), F.lit(0)) + 1).alias("from_line"), (F.col("from_line") - 1).alias("to_line"))
    after = clipped.groupBy(key).agg((F.max("to_line") + 1).alias("from_line"), F.first("lines").alias("to_line"))
    bare = sizes.join(covered.select(key).distinct(), key, "left_anti").select(key, F.lit(1).cast("long").alias("from_line"), F.col("lines").alias("to_line"))
    as_long = lambda d: d.select(key, F.col("from_line").cast("long").alias("from_line"), F.col("to_line").cast("long").alias("to_line"))
    return as_long(before).union(as_long(after)).union(as_long(bare)).where(F.col("to_line") - F.col("from_line") + 1 >= least)


def within(points: DataFrame, ranges: DataFrame, key: str, point: str = "line_no", width: int = 256) -> DataFrame:
    """points joined with the ranges (from_line, to_line) of the same key that hold them; ranges are cut into buckets of width lines."""
    cut = ranges.where("from_line <= to_line").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from_line") / width), F.floor(F.col("to_line") / width))))
    return points.withColumn("_bucket", F.floor(F.col(point) / width)).join(cut, [key, "_bucket"]).where(F.col(point).between(F.col("from_line"), F.col("to_line"))).drop("_bucket")


def nearest_before(points: DataFrame, marks: DataFrame, key: str, point: str, mark: str, tolerance: int, tie: str) -> DataFrame:
    """Each point that has one with the last mark of the same key at or before it, at most tolerance away; of equal marks the smallest tie.

    Marks are looked up in the point's bucket of tolerance lines and the one before, so a long key is many small joins.
    """
    width = max(1, tolerance)
    near = marks.withColumn("_bucket", F.explode(F.array(F.floor(F.col(mark) / width), F.floor(F.col(mark) / width) + 1)))
    met = points.withColumn("_bucket", F.floor(F.col(point) / width)).join(near, [key, "_bucket"]).where(F.col(mark).between(F.col(point) - tolerance, F.col(point)))
    columns = [c for c in points.columns]
    others = [c for c in marks.columns if c not in columns]
    best = met.groupBy(*columns).agg(F.min_by(F.struct(*others), F.struct(-F.col(mark), F.col(tie))).alias("_best"))
    return best.select(*columns, "_best.*")


def nearest_around(points: DataFrame, marks: DataFrame, key: str, point: str, mark: str, band: int, tie: str) -> DataFrame:
    """Each point that has one with the mark of the same key nearest to it, at most band away on either side; of equally near ones the smaller, then the smallest tie."""
    width = band + 1
    near = marks.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(mark) / width) + d for d in (-1, 0, 1)])))
    met = points.withColumn("_bucket", F.floor(F.col(point) / width)).join(near, [key, "_bucket"]).where(F.abs(F.col(mark) - F.col(point)) <= band)
    columns = [c for c in points.columns]
    others = [c for c in marks.columns if c not in columns]
    best = met.groupBy(*columns).agg(F.min_by(F.struct(*others), F.struct(F.abs(F.col(mark) - F.col(point)), F.col(mark), F.col(tie))).alias("_best"))
    return best.select(*columns, "_best.*")
