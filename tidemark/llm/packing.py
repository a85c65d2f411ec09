"""Filling containers of fixed capacity.

Items are spread over shards by hash. In each shard the dominance reduction of Martello and Toth fixes containers that some optimal packing has:
the largest item with the set of small ones that dominates every other set that fits beside it. What is left goes to the container that it fits best.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import VOCABULARY, token_count
from tidemark.session import settle, spread

#: Items that are packed together, on average. With so many, what a shard leaves over is small against what it fills.
SHARD_ITEMS = 20_000


class _Sizes:
    """A multiset of sizes: distinct ones in ascending order, with counts."""

    def __init__(self, sizes):
        self.count = Counter(sizes)
        self.keys = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            del self.keys[bisect_left(self.keys, size)]

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(self.count[k], n - len(out))
            if len(out) == n:
                break
        return out

    def largest_within(self, room: int) -> int | None:
        i = bisect_right(self.keys, room)
        return self.keys[i - 1] if i else None

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two sizes of largest sum within room, of these the pair with the larger first."""
        keys = np.array(self.keys)
        keys = keys[: np.searchsorted(keys, room)]
        if not len(keys):
            return None
        at = np.searchsorted(keys, room - keys, side="right") - 1
        at = np.minimum(at, np.arange(len(keys)))  # the second is not larger than the first
        single = np.array([self.count[int(k)] == 1 for k in keys])
        at = np.where((at == np.arange(len(keys))) & single, at - 1, at)
        sums = np.where(at >= 0, keys + keys[np.maximum(at, 0)], -1)
        best = int(sums.max())
        if best < 0:
            return None
        i = int(np.flatnonzero(sums == best)[-1])
        return int(keys[i]), int(keys[at[i]])

    def between(self, low: int, high: int) -> int:
        """Items strictly between two sizes."""
        return sum(self.count[k] for k in self.keys[bisect_right(self.keys, low) : bisect_left(self.keys, high)])


def dominating_set(sizes: _Sizes, item: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside item (which is not in sizes), if one set dominates all others that fit; else None."""
    room = capacity - item
    small = sizes.smallest(3)
    if not small or small[0] > room:
        return ()
    most = sizes.largest_within(room)
    if most == room or len(small) < 2 or small[0] + small[1] > room:
        return (most,)
    if len(small) < 3 or sum(small) > room:
        a, b = sizes.best_pair(room)
        if most >= a + b:
            return (most,)
        if most == a and sizes.between(b, a) <= 1:
            return (a, b)
    return None


def reduce_and_fill(sizes: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Containers as lists of sizes, and how many of them the reduction fixed. Sizes are from 1 to capacity."""
    left, fixed = _Sizes(sizes), []
    changed = True
    while changed and left.keys:
        changed = False
        for item in reversed(left.keys.copy()):
            while left.count.get(item):
                left.take(item)
                beside = dominating_set(left, item, capacity)
                if beside is None:
                    left.count[item] += 1
                    if left.count[item] == 1:
                        insort(left.keys, item)
                    break
                for b in beside:
                    left.take(b)
                fixed.append([item, *beside])
                changed = True
    filled: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # room and number of each open container, ascending
    for item in reversed(left.keys):
        for _ in range(left.count[item]):
            i = bisect_left(rooms, (item, -1))
            if i == len(rooms):
                filled.append([item])
                room, number = capacity - item, len(filled) - 1
            else:
                room, number = rooms.pop(i)
                filled[number].append(item)
                room -= item
            if room:
                insort(rooms, (room, number))
    return fixed + filled, len(fixed)


_PLACED = "item long, part_no int, n_parts int, size long, container string, fixed boolean"


def _packer(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["size", "item", "copy"], kind="stable")
        items, sizes = shard["item"].to_numpy(), shard["size"].to_numpy()
        # What fills a container alone dominates whatever else could be in it: full parts are fixed first, the rests join the others.
        full, n_parts = sizes // capacity, -(-sizes // capacity)
        spread_over = np.repeat(np.arange(len(items)), full)
        part = np.arange(len(spread_over)) - np.repeat(np.cumsum(full) - full, full) + 1
        rests = np.flatnonzero(sizes % capacity)
        containers, n_fixed = reduce_and_fill((sizes[rests] % capacity).tolist(), capacity)
        waiting: dict[int, list[int]] = {}
        for i, s in zip(rests.tolist(), (sizes[rests] % capacity).tolist()):
            waiting.setdefault(s, []).append(i)
        placed = [(waiting[s].pop(), number) for number, inside in enumerate(containers) for s in inside]
        at = np.concatenate([spread_over, np.array([i for i, _ in placed], np.int64)]).astype(np.int64)
        number = np.concatenate([np.arange(len(spread_over)) + len(containers), np.array([n for _, n in placed], np.int64)]).astype(np.int64)
        prefix = int(shard["shard"].iloc[0])
        return pd.DataFrame(
            {
                "item": items[at], "part_no": np.concatenate([part, n_parts[at[len(spread_over) :]]]), "n_parts": n_parts[at],
                "size": np.concatenate([np.full(len(spread_over), capacity), sizes[at[len(spread_over) :]] % capacity]),
                "container": [f"{prefix}-{n}" for n in number], "fixed": (number < n_fixed) | (number >= len(containers)),
            }
        )

    return pack


def pack_sizes(items: DataFrame, capacity: int, item_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """Item, part_no, n_parts, size, container, and whether the reduction fixed it: each item in one container, unless it exceeds the capacity.

    An item that does is cut into full parts, each a container of its own, and a rest that is packed with the others. Items of size 0 or null
    need no room and get no row; an item that occurs twice is packed twice. Ties are settled by item.
    Scale: only numbers are moved; shards hold SHARD_ITEMS items on average, whatever the sizes or keys. Each shard leaves at most one container
    half empty or less that a single instance would have filled, so the loss is bounded by the number of shards.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = settle(items.select(F.col(item_col).cast("long").alias("item"), F.col(size_col).cast("long").alias("size")).where("size > 0").withColumn("copy", F.monotonically_increasing_id()))
    shards = max(1, -(-sized.count() // SHARD_ITEMS))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard").applyInPandas(_packer(capacity), _PLACED)
    return placed.withColumnRenamed("item", item_col)


def pack_texts(df: DataFrame, capacity: int, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY, size: Column | None = None) -> DataFrame:
    """`pack_sizes` of texts, in tokens of the vocabulary."""
    sized = spread(df).select(F.col(id_col), (token_count(F.col(text_col), vocabulary) if size is None else size).alias("tokens"))
    return pack_sizes(sized, capacity, id_col)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """Containers, those fixed by the reduction, the least number that could do, and the share of space left over."""
    each = placed.groupBy("container").agg(F.sum("size").alias("filled"), F.bool_and("fixed").alias("fixed"))
    sums = each.agg(F.count("*").alias("containers"), F.count_if("fixed").alias("fixed_containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
    return sums.withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6))
