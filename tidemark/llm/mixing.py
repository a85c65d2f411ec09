"""Mixing sources to target shares by Poisson replication.

Each source has a repetition rate: its share of the total over its own size. Each document is repeated as often as a Poisson distribution,
inverted at a number hashed from the document, says; the distribution ends at the cap and its mean is set so that the rate is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, token_count
from tidemark.session import settle, spread

#: Sources that a mix may have; its targets are sent to each task.
MOST_SOURCES = 10_000


def _normal(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def capped_cumulative(rate: float, cap: int) -> list[float]:
    """P(count <= k) for k below cap, of a Poisson count that ends at cap and has the mean rate (at most cap)."""
    if rate >= cap:
        return [0.0] * cap
    if rate <= 0:
        return [1.0] * cap

    def cumulative(mean: float) -> list[float]:
        p = math.exp(-mean)
        out, total = [], 0.0
        for k in range(cap):
            total += p
            out.append(min(total, 1.0))
            p *= mean / (k + 1)
        return out

    lo, hi = 0.0, 1.0
    expected = lambda mean: cap - sum(cumulative(mean))
    while expected(hi) < rate and hi < 700:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < rate else (lo, mid)
    return cumulative((lo + hi) / 2)


def mixing_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source of targets: source, key (without case and outer blanks), n_docs, own_size, total_size, rate (mean repetitions wanted), max_repeats, reachable, cumulative.

    sizes has source and tokens. The total is the size of all documents of the listed sources, each once. A source that is listed but has no
    document can't reach any share above 0. Sources that aren't listed, and null ones, have no part. targets must have at most MOST_SOURCES rows.
    """
    listed = targets.select("source", _normal(F.col("source")).alias("key"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanted = listed.limit(MOST_SOURCES + 1).collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError("too many sources")
    # One row a source leaves the aggregation; only listed sources do.
    found = sizes.select(_normal(F.col("source")).alias("key"), "tokens").join(F.broadcast(listed.select("key").distinct()), "key", "left_semi")
    own = {r["key"]: (r["n"], r["size"]) for r in found.groupBy("key").agg(F.count("*").alias("n"), F.sum("tokens").alias("size")).collect()}
    total = sum(size for _, size in own.values())
    rows = []
    for w in wanted:
        n, size = own.get(w["key"], (0, 0))
        cap, need = w["max_repeats"] or 0, (w["target_share"] or 0.0) * total
        rate = need / size if size else (math.inf if need else 0.0)
        rows.append((w["source"], w["key"], n, size, total, w["target_share"], rate if size else None, cap, need <= cap * size, capped_cumulative(rate, cap)))
    schema = "source string, key string, n_docs long, own_size long, total_size long, target_share double, rate double, max_repeats int, reachable boolean, cumulative array<double>"
    return sizes.sparkSession.createDataFrame(rows, schema)


def replicate(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", seed: int = 42) -> DataFrame:
    """The documents of the plan's sources, each as often as it is drawn, with copy_no from 1 and place, by which the whole is in random order.

    docs has id_col, source and whatever else should come along. Rows with a null id are told apart by their other columns. The result is range-partitioned by place, so
    that each partition is a random part of the whole; nothing is grouped by source, and so a source that holds most rows is no hot key.
    """
    rates = F.broadcast(plan.select(F.col("key").alias("_mix_key"), F.col("cumulative").alias("_mix_cumulative")).dropDuplicates(["_mix_key"]))
    same = [F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(*[c for c in docs.columns if c != id_col]))]
    drawn = F.shiftrightunsigned(F.xxhash64(*same, F.lit(seed)), 11) / F.lit(float(1 << 53))
    counted = docs.join(rates, _normal(F.col("source")) == F.col("_mix_key")).withColumn("_mix_draw", drawn)
    count = F.size(F.filter("_mix_cumulative", lambda c: c <= F.col("_mix_draw")))
    copies = counted.withColumn("_mix_count", count).where("_mix_count > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_mix_count"))))
    placed = copies.withColumn("place", F.xxhash64(*same, F.col("copy_no"), F.lit(seed + 1)))
    return placed.drop("_mix_key", "_mix_cumulative", "_mix_draw", "_mix_count").repartitionByRange("place").sortWithinPartitions("place")


def sized_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Id, source and tokens of each document, counted once and written down."""
    return settle(spread(df.select(id_col, "source", text_col)).select(id_col, "source", token_count(F.col(text_col), vocabulary).alias("tokens")))


def mix(df: DataFrame, targets: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix (id, source, tokens, copy_no, place) and the report of its shares."""
    sizes = sized_documents(df, text_col, id_col, vocabulary)
    plan = settle(mixing_plan(sizes, targets))
    mixed = replicate(sizes, plan, id_col, seed)
    return mixed, share_report(mixed, plan)


def share_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """By source: target share, rate, cap, whether the share can be reached, copies and tokens in the mix, the share of the mix and of the total."""
    got = mixed.groupBy(_normal(F.col("source")).alias("key")).agg(F.count("*").alias("copies"), F.sum("tokens").alias("mixed_size"), F.max("copy_no").alias("most_repeats"))
    rows = plan.join(F.broadcast(got), "key", "left").na.fill(0, ["copies", "mixed_size", "most_repeats"])
    whole = F.broadcast(got.agg(F.sum("mixed_size").alias("whole")))
    return rows.join(whole).select(
        "source", "target_share", "n_docs", "own_size", "total_size", "rate", "max_repeats", "reachable", "copies", "most_repeats", "mixed_size",
        F.round(F.try_divide("mixed_size", "whole"), 6).alias("share_of_mix"), F.round(F.try_divide("mixed_size", "total_size"), 6).alias("share_of_total"),
    )


def short_sources(report: DataFrame) -> DataFrame:
    """source of those that the mix holds as often as it may, each document at the cap, and that still fall short of their share of the total."""
    at_cap = F.col("mixed_size") == F.col("max_repeats") * F.col("own_size")
    return report.where(at_cap & (F.col("mixed_size") < F.coalesce("target_share", F.lit(0.0)) * F.col("total_size"))).select("source")
