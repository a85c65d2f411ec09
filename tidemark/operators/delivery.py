"""Rows delivered more than once: a sorted identifier index by hash prefix.

Identifiers are kept as sorted arrays by hash prefix, in immutable runs on disk. An incoming batch is deduplicated locally, searched in the arrays
by bisection, and what is new becomes another run; runs are merged once there are several. `DeliveryIndex` is that index; `surplus_rows` sends the
batches of a table through one, in order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle, shared_folder

#: Rows of one prefix that a task holds at a time, at most on average.
ROWS_PER_PREFIX = 1_000_000
#: Runs beyond which they are merged.
MERGE_RUNS = 1
#: Batches of a table go through the index in so many groups, in their order.
SLICES = 3
#: Touched prefixes that are named in the filter of a read; beyond that all are read.
MOST_NAMED = 4096

_ENTRY = "prefix int, batch long, ident binary, usable int, amount long, row long"
_ENTRY_ARROW = pa.schema({"prefix": pa.int32(), "batch": pa.int64(), "ident": pa.binary(), "usable": pa.int32(), "amount": pa.int64(), "row": pa.int64()})
_KEY = "S17"  # 16 bytes and a closing 1, so that numpy doesn't strip zero bytes


def identifier(raw: Column) -> Column:
    """The identifier that a spelling denotes, as 16 bytes, or null if it denotes none.

    Case, hyphens, braces, blanks around it and the prefix urn:uuid: don't matter. Empty and all-zero spellings denote none.
    An identifier that isn't 32 hexadecimal digits counts as it stands (without blanks around it); its bytes are the first half of its SHA-256.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(raw, r"^\s+|\s+$", "")), r"^urn:uuid:|[{}\-]", "")
    plain = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return (
        F.when(raw.isNull() | bare.rlike("^0*$"), F.lit(None).cast("binary"))
        .when(bare.rlike("^[0-9a-f]{32}$"), F.unhex(bare))
        .otherwise(F.unhex(F.substring(F.sha2(plain, 256), 1, 32)))
    )


def identifier_text(raw: Column) -> Column:
    """`identifier` as lower-case hexadecimal text."""
    return F.lower(F.hex(identifier(raw)))


def _better(u1, a1, r1, u2, a2, r2):
    """Whether each copy 1 is kept rather than copy 2: usable first, then the larger amount, then the smaller row."""
    return (u1 > u2) | ((u1 == u2) & ((a1 > a2) | ((a1 == a2) & (r1 < r2))))


class PrefixIndex:
    """The identifiers of one hash prefix: immutable sorted arrays with what is known of the copy kept."""

    def __init__(self, merge_runs: int = 6):
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.merge_runs = merge_runs

    def ingest(self, ident: np.ndarray, usable: np.ndarray, amount: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Takes a batch in any order; returns the rows that became surplus, be they of this batch or of earlier ones."""
        order = np.lexsort((row, -amount, -usable, ident))
        ident, usable, amount, row = ident[order], usable[order], amount[order], row[order]
        first = np.ones(len(ident), bool)
        first[1:] = ident[1:] != ident[:-1]
        surplus = [row[~first]]
        ident, usable, amount, row = ident[first], usable[first], amount[first], row[first]
        novel = np.ones(len(ident), bool)
        for keys, u, a, r in reversed(self.runs):
            left = np.flatnonzero(novel)
            if not len(left):
                break
            at = np.minimum(np.searchsorted(keys, ident[left]), len(keys) - 1)
            hit = keys[at] == ident[left]
            left, at = left[hit], at[hit]
            novel[left] = False
            wins = _better(usable[left], amount[left], row[left], u[at], a[at], r[at])
            surplus += [r[at[wins]], row[left[~wins]]]
            u[at[wins]], a[at[wins]], r[at[wins]] = usable[left[wins]], amount[left[wins]], row[left[wins]]
        if novel.any():
            self.runs.append((ident[novel], usable[novel].copy(), amount[novel].copy(), row[novel].copy()))
        if len(self.runs) > self.merge_runs:
            self.merge()
        return np.concatenate(surplus)

    def merge(self) -> None:
        """Makes one run of all; no identifier is in two of them."""
        if len(self.runs) > 1:
            merged = [np.concatenate(x) for x in zip(*self.runs)]
            order = np.argsort(merged[0], kind="stable")
            self.runs = [tuple(x[order] for x in merged)]


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The identifiers (all of 16 bytes, none null) as an array that numpy can sort, straight from the Arrow buffers."""
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(flat):
        return np.empty(0, _KEY)
    ends = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_binary(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.ones((len(flat), 17), np.uint8)
    raw[:, :16] = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, 16)
    return raw.view(_KEY).ravel()


def _numbers(t: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(t.column(c).to_numpy() for c in ("usable", "amount", "row"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of equal identifiers of one batch in one Arrow batch, the best goes on; the others are surplus already.

    So an identifier that a third of all rows carry reaches its prefix a few times only. Surplus rows travel without identifier.
    """
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        ident, (usable, amount, row) = _keys(t.column("ident")), _numbers(t)
        batch = t.column("batch").to_numpy()
        order = np.lexsort((row, -amount, -usable, batch, ident))
        same = np.zeros(len(order), bool)
        same[1:] = (ident[order][1:] == ident[order][:-1]) & (batch[order][1:] == batch[order][:-1])
        kept = np.sort(order[~same])
        if len(kept) < b.num_rows:
            lost = np.sort(order[same])
            columns = (np.full(len(lost), -1, np.int32), batch[lost], pa.nulls(len(lost), pa.binary()), usable[lost], amount[lost], row[lost])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY_ARROW)], schema=_ENTRY_ARROW)
            b = b.take(pa.array(kept))
        yield pa.RecordBatch.from_arrays(b.columns, schema=_ENTRY_ARROW)


def _entries(df: DataFrame, prefixes: int, id_col: str, usage_col: str, amount_field: str, row_col: str, batch_col: str | None) -> DataFrame:
    usage = F.col(usage_col)
    return (
        df.select(
            identifier(F.col(id_col)).alias("ident"),
            F.when(usage.isNotNull(), 1).otherwise(0).alias("usable"),
            F.coalesce(usage[amount_field].cast("long"), F.lit(-1)).alias("amount"),
            F.col(row_col).cast("long").alias("row"),
            (F.coalesce(F.col(batch_col).cast("long"), F.lit(-1)) if batch_col else F.lit(0)).cast("long").alias("batch"),
        )
        .where("ident IS NOT NULL AND row IS NOT NULL")
        .select(F.pmod(F.xxhash64("ident"), F.lit(prefixes)).cast("int").alias("prefix"), "batch", "ident", "usable", "amount", "row")
    )


def prefix_count(spark: SparkSession, rows: int) -> int:
    """Hash prefixes for so many rows, a power of two."""
    least = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_PREFIX))
    return 1 << (least - 1).bit_length()


def surplus_rows(
    df: DataFrame,
    id_col: str = "uuid",
    usage_col: str = "usage",
    amount_field: str = "output_tokens",
    row_col: str = "row_id",
    batch_col: str | None = "batch_id",
    prefixes: int | None = None,
) -> DataFrame:
    """The rows to drop so that each identifier is left once: one column, named as row_col.

    Kept is the copy with usage before one without, then the largest amount (null counts as least), then the smallest row.
    Rows whose identifier is null, empty or all zero are no copies of anything; rows with a null row_col are left alone,
    as nothing could name them. An empty table gives no rows. Other columns are not read, whatever their names.
    The batches go in order, SLICES groups of them, through an index in the shared folder.
    Scale: only five columns are read, once; map-side deduplication before the shuffles; what is shuffled are identifiers and three numbers;
    a task holds one prefix at a time.
    """
    spark = df.sparkSession
    local = settle(_entries(df, 1 << 30, id_col, usage_col, amount_field, row_col, batch_col).mapInArrow(_local, _ENTRY))
    sizes = local.agg(F.count("*"), F.percentile_approx("batch", [i / SLICES for i in range(1, SLICES)])).first()
    cuts = sorted(set(sizes[1] or []))
    index = DeliveryIndex(spark, f"{shared_folder(spark).rstrip('/')}/deliveries-{uuid.uuid4().hex}", prefixes or prefix_count(spark, sizes[0]))
    found = []
    for epoch, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        if epoch > MERGE_RUNS:
            index.merge(epoch - 1)
        here = F.lit(True) if lo is None else F.col("batch") > lo
        found.append(index.take(local.where(here if hi is None else here & (F.col("batch") <= hi)), epoch, all_prefixes=True))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("row").alias(row_col))


def keep_one_copy(df: DataFrame, row_col: str = "row_id", **names: str) -> DataFrame:
    """df without its surplus rows, all columns as they were."""
    surplus = surplus_rows(df, row_col=row_col, **names).select(F.col(row_col).alias("_surplus_row"))
    return df.join(surplus, df[row_col] == F.col("_surplus_row"), "left_anti")


_RUN = "what int, prefix int, ident binary, usable int, amount long, row long"
_RUN_ARROW = pa.schema({"what": pa.int32(), "prefix": pa.int32(), "ident": pa.binary(), "usable": pa.int32(), "amount": pa.int64(), "row": pa.int64()})


class DeliveryIndex:
    """The index on disk: immutable runs, in each the entries of a prefix together, sorted by identifier, and a state that names the runs that count.

    `ingest` takes batches one after another (in a stream: from foreachBatch with the epoch, which makes a repeated epoch harmless); `merge` makes
    one run of several. A run is written under a name of its own and counts from the moment the next state names it, so a failure at any time leaves
    the state before; states are claimed by creating their file, so that of two writers at once the second fails.
    """

    def __init__(self, spark: SparkSession, path: str, prefixes: int = 64):
        self.spark, self.path, self.prefixes = spark, path.rstrip("/"), prefixes

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _states(self) -> dict[int, dict[int, str]]:
        """By version, the names of the runs that count by epoch."""
        path, fs = self._files()
        at = path(f"{self.path}/state")
        out = {}
        for s in fs.listStatus(at) if fs.exists(at) else []:
            stream = fs.open(s.getPath())
            try:
                out[int(s.getPath().getName())] = {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
            except ValueError:
                pass  # not yet written in full
            finally:
                stream.close()
        return out

    def _state(self) -> tuple[int, dict[int, str]]:
        states = self._states()
        last = max(states, default=0)
        return last, states.get(last, {})

    def _commit(self, version: int, runs: dict[int, str]) -> None:
        path, fs = self._files()
        out = fs.create(path(f"{self.path}/state/{version + 1}"), False)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        states = self._states()
        # What neither this state nor the one before names goes; readers of the one before may still be at it.
        for old in [v for v in states if v < version]:
            for name in set(states[old].values()) - set(runs.values()) - set(states.get(version, {}).values()):
                fs.delete(path(f"{self.path}/{name}/what=0"), True)  # the surplus rows stay, as their reader may not have come yet
            fs.delete(path(f"{self.path}/state/{old}"), False)

    def runs(self) -> list[int]:
        """Numbers of the runs that count."""
        return sorted(self._state()[1])

    def _read(self, names: dict[int, str]) -> DataFrame:
        out = self.spark.createDataFrame([], _ENTRY)
        for epoch, name in names.items():
            run = self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}").where("what = 0")
            out = out.unionByName(run.select("prefix", F.lit(epoch).cast("long").alias("batch"), "ident", "usable", "amount", "row"))
        return out

    def ingest(self, batch: DataFrame, run: int, **names: str) -> DataFrame:
        """Writes the batch's novel identifiers, and known ones of which it has a better copy, as another run; returns the surplus rows."""
        names = {"id_col": "uuid", "usage_col": "usage", "amount_field": "output_tokens", "row_col": "row_id"} | names
        found = self.take(settle(_entries(batch, 1 << 30, batch_col=None, **names).mapInArrow(_local, _ENTRY)), run)
        return found.select(F.col("row").alias(names["row_col"]))

    def take(self, local: DataFrame, run: int, all_prefixes: bool = False) -> DataFrame:
        """`ingest` of what was deduplicated locally (and written down); the column row of those that are surplus. all_prefixes: the batch surely touches all."""
        version, state = self._state()
        before = {e: n for e, n in state.items() if e < run}
        # Prefixes are by the last bits of a hash. Surplus rows found locally carry none; they are spread by their row.
        placed = local.withColumn("prefix", F.pmod(F.when(F.col("prefix") < 0, F.xxhash64("row")).otherwise(F.col("prefix")), F.lit(self.prefixes)).cast("int"))
        known = self._read(before)
        if before and not all_prefixes and self.prefixes <= MOST_NAMED:
            known = known.where(F.col("prefix").isin([r[0] for r in placed.select("prefix").distinct().collect()]))
        name = f"run-{run}-{uuid.uuid4().hex}"
        met = placed.groupBy("prefix").cogroup(known.groupBy("prefix")).applyInArrow(_meet, _RUN)
        met.write.partitionBy("what").parquet(f"{self.path}/{name}")
        self._commit(version, {e: n for e, n in state.items() if e != run} | {run: name})
        return self.spark.read.schema(_RUN).parquet(f"{self.path}/{name}").where("what = 1").select("row")

    def merge(self, keep: int) -> None:
        """One run, numbered keep, of all with numbers up to keep; the newest entry of an identifier holds."""
        version, state = self._state()
        old = {e: n for e, n in state.items() if e <= keep}
        if len(old) < 2:
            return
        name = f"run-{keep}-{uuid.uuid4().hex}"
        self._read(old).groupBy("prefix").applyInArrow(_merge, _RUN).write.partitionBy("what").parquet(f"{self.path}/{name}")
        self._commit(version, {e: n for e, n in state.items() if e > keep} | {keep: name})


def _loaded(known: pa.Table) -> list[tuple[np.ndarray, ...]]:
    """The runs of one prefix, the oldest first; the arrays may be written to."""
    out = []
    for run in np.unique(known.column("batch").to_numpy()):
        here = known.filter(pa.array(known.column("batch").to_numpy() == run))
        keys, numbers = _keys(here.column("ident")), [x.copy() for x in _numbers(here)]
        order = np.argsort(keys, kind="stable")  # sorted already as it was written, unless files were read in parts
        out.append((keys[order], *(x[order] for x in numbers)))
    return out


def _run_table(prefix: int, runs: list[tuple[np.ndarray, ...]], surplus: np.ndarray) -> pa.Table:
    keys, usable, amount, row = (np.concatenate(x) if runs else np.empty(0, t) for x, t in zip(zip(*runs) if runs else [()] * 4, (_KEY, np.int32, np.int64, np.int64)))
    order = np.argsort(keys, kind="stable")
    n, m = len(keys), len(surplus)
    raw = np.ascontiguousarray(keys[order]).view(np.uint8).reshape(-1, 17)[:, :16].tobytes()
    idents = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(raw)])
    columns = (
        np.repeat(np.array([0, 1], np.int32), [n, m]), np.full(n + m, prefix, np.int32), pa.concat_arrays([idents, pa.nulls(m, pa.binary())]),
        np.concatenate([usable[order], np.zeros(m, np.int32)]), np.concatenate([amount[order], np.zeros(m, np.int64)]), np.concatenate([row[order], surplus]),
    )
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUN_ARROW)], schema=_RUN_ARROW)


def _meet(new: pa.Table, known: pa.Table) -> pa.Table:
    """The batch's entries of one prefix against the runs of that prefix: what is novel or better, and the rows that became surplus."""
    if not new.num_rows:
        return _RUN_ARROW.empty_table()
    prefix, index = new.column("prefix")[0].as_py(), PrefixIndex(merge_runs=1 << 30)
    index.runs = _loaded(known)
    before = [r[3].copy() for r in index.runs]
    lost = new.column("ident").is_null()
    live, surplus = new.filter(pc.invert(lost)), [new.filter(lost).column("row").to_numpy()]
    numbers = live.column("batch").to_numpy()
    for b in np.unique(numbers):  # batches in their order
        here = live.filter(pa.array(numbers == b))
        surplus.append(index.ingest(_keys(here.column("ident")), *_numbers(here)))
    better = [tuple(x[r[3] != b] for x in r) for r, b in zip(index.runs, before)]
    fresh = [r for r in better + index.runs[len(before) :] if len(r[0])]
    return _run_table(prefix, fresh, np.concatenate(surplus))


def _merge(known: pa.Table) -> pa.Table:
    """The runs of one prefix as one; of an identifier in several the newest entry holds."""
    runs = _loaded(known)
    keys = np.concatenate([r[0] for r in runs])
    age = np.concatenate([np.full(len(r[0]), i) for i, r in enumerate(runs)])
    order = np.lexsort((-age, keys))
    newest = np.ones(len(order), bool)
    newest[1:] = keys[order][1:] != keys[order][:-1]
    picked = order[newest]
    return _run_table(known.column("prefix")[0].as_py(), [(keys[picked], *(np.concatenate(x)[picked] for x in list(zip(*runs))[1:]))], np.empty(0, np.int64))
