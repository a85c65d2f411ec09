"""Telemetry of sessions: calls billed once, cost, growth, medians, concentration, simulated ceilings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of input, written cache, read cache and output; context sizes from which on cost is told apart.
WEIGHTS = (1.0, 1.25, 0.1, 5.0)
BANDS = (50_000, 100_000, 200_000, 400_000, 700_000)
EXPIRED_FROM = 50_000
SUMMARY_CONTEXT, SUMMARY_OUTPUT = 15_000, 10_000


def calls(messages: DataFrame) -> DataFrame:
    """session, seq, i, cw, cr, o, k of each API call, billed once: of the rows of one call in a session the first; rows without call id always count."""
    u = F.col("usage")
    rows = messages.where((F.col("type") == "assistant") & u.isNotNull()).select("session", "message_id", F.struct("line_no", "row_id").alias("seq"), u.input_tokens.alias("i"), u.cache_creation_input_tokens.alias("cw"), u.cache_read_input_tokens.alias("cr"), u.output_tokens.alias("o"))
    named = rows.where("message_id IS NOT NULL").groupBy("session", "message_id").agg(F.min_by(F.struct("seq", "i", "cw", "cr", "o"), "seq").alias("c")).select("session", "c.*")
    both = named.unionByName(rows.where("message_id IS NULL").drop("message_id"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("i", "cw", "cr", "o")]
    return both.select("session", F.col("seq.line_no").alias("line_no"), F.col("seq.row_id").alias("row_id"), *zero).withColumn("k", F.col("i") + F.col("cw") + F.col("cr"))


def cost() -> Column:
    wi, ww, wr, wo = WEIGHTS
    return F.col("i") * wi + F.col("cw") * ww + F.col("cr") * wr + F.col("o") * wo


def band() -> Column:
    out = F.when(F.col("k") < BANDS[0], f"<{BANDS[0]}")
    for b in BANDS[1:]:
        out = out.when(F.col("k") < b, f"<{b}")
    return out.otherwise(f">={BANDS[-1]}")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median: of an even number of values the upper of the middle two. Equal values are counted before they are ordered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    return placed.where("upto > floor(n / 2)").groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("median"))


def simulate(billed: DataFrame, ceilings: tuple[int, ...], penalties: tuple[int, ...]) -> DataFrame:
    """session, ceiling, penalty, cost: what the calls of a session would have cost if its context had been summarised above the ceiling.

    A fold over the calls in order with constant state: calls stream through sorted partitions, so a session of any length needs no memory.
    """
    schema = pa.schema({"session": pa.string(), "ceiling": pa.int64(), "penalty": pa.int64(), "cost": pa.float64()})
    params = [(c, r) for c in ceilings for r in penalties]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, states, before = None, [], 0.0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here] * len(params)), pa.array([c for c, _ in params], pa.int64()), pa.array([r for _, r in params], pa.int64()), pa.array([s[1] for s in states], pa.float64())], schema=schema)

        for b in batches:
            for session, i, cw, cr, o, k, base in zip(*(b.column(c).to_pylist() for c in range(7))):
                first = session != here
                if first:
                    if here is not None:
                        yield done()
                    here, states = session, [[float(k), 0.0] for _ in params]
                grown = 0.0 if first else max(0.0, k - before)
                expired = k > EXPIRED_FROM and cw > 0.5 * k
                for (ceiling, penalty), s in zip(params, states):
                    s[0] += grown
                    if s[0] > ceiling:
                        s[1] += s[0] * 0.1 + SUMMARY_OUTPUT * 5
                        s[0] = base + SUMMARY_CONTEXT + penalty
                        s[1] += s[0] * 1.25 + o * 5
                    elif expired:
                        s[1] += s[0] * 1.25 + o * 5
                    else:
                        s[1] += (s[0] - grown) * 0.1 + grown * 1.25 + o * 5
                before = k
        if here is not None:
            yield done()

    firsts = billed.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("line_no", "row_id"))).where("nth <= 3").groupBy("session").agg(F.min("k").alias("base"))
    ordered = billed.join(firsts, "session").select("session", "i", "cw", "cr", "o", "k", "base", "line_no", "row_id").repartition("session").sortWithinPartitions("session", "line_no", "row_id")
    return ordered.mapInArrow(fold, "session string, ceiling long, penalty long, cost double")
