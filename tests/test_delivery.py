import random

import numpy as np
import pytest

from tidemark.operators.delivery import DeliveryIndex, PrefixIndex, keep_one_copy, surplus_rows

SCHEMA = "row_id long, batch_id int, uuid string, usage struct<output_tokens:long>, ident string, prefix int, row string"
A = "0a1b2c3d-0000-4000-8000-00000000abcd"


def brute(rows):
    best, out = {}, set()
    for row_id, _, uuid, usage, *_ in rows:
        if row_id is None or uuid is None:
            continue
        key = uuid.strip().lower().replace("-", "").strip("{}").removeprefix("urn:uuid:")
        if not key.strip("0"):
            continue
        rank = (usage is None, -(usage[0] if usage and usage[0] is not None else -1), row_id)
        if key in best:
            out.add(max(best[key], rank)[2])
            best[key] = min(best[key], rank)
        else:
            best[key] = rank
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def test_spellings_ties_and_rows_without_identifier(spark):
    rows = [
        (1, 0, A, None), (2, 0, A.upper(), (5,)), (3, 1, A.replace("-", ""), (9,)), (4, 1, " " + A + " ", (9,)), (5, 2, "{" + A + "}", (None,)), (6, 3, "urn:uuid:" + A, None),
        (7, 0, None, (1,)), (8, 0, None, (1,)), (9, 0, "", None), (10, 0, " ", None), (11, 0, "00000000-0000-0000-0000-000000000000", None), (12, 1, "0", None),
        (13, None, "plain id", None), (14, None, "plain id", None), (15, 0, "Plain id", None),
    ]
    got = {r.row_id for r in surplus_rows(frame(spark, rows)).collect()}
    assert got == {1, 2, 4, 5, 6, 14}
    kept = keep_one_copy(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows) - 6


def test_empty_table(spark):
    assert surplus_rows(frame(spark, [])).count() == 0


def test_one_identifier_on_a_third_of_all_rows_in_many_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(12), A if i % 3 == 0 else f"{rng.randrange(200):032x}", None if rng.random() < 0.3 else (rng.choice([None, 1, 2, 3]),)) for i in range(3000)]
    got = [r.row_id for r in surplus_rows(frame(spark, rows), prefixes=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_index_on_disk_gives_the_same_as_the_whole_table(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, i // 60, f"{rng.randrange(90):032x}", None if rng.random() < 0.3 else (rng.randrange(4),)) for i in range(240)]
    index, gone = DeliveryIndex(spark, f"file://{tmp_path}/index", prefixes=3), []
    for b in range(4):
        batch = frame(spark, [r for r in rows if r[1] == b])
        for _ in range(1 + (b == 2)):  # a repeated epoch does no harm
            found = [r.row_id for r in index.ingest(batch, b).collect()]
        gone += found
        if b == 1:
            index.merge(1)
            assert index.runs() == [1]
    assert sorted(gone) == sorted(brute(rows))


@pytest.mark.parametrize("merge_runs", [1, 3, 100])
def test_prefix_index_is_the_same_however_often_runs_are_merged(merge_runs):
    rng = np.random.default_rng(1)
    index, gone, rows = PrefixIndex(merge_runs), [], []
    for b in range(20):
        n = int(rng.integers(1, 15))
        ids, usable, amount, row = rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(-1, 3, n), np.arange(n) + 100 * b
        rows += [(int(r), b, f"{int(i) + 1:032x}", (int(a),) if u else None) for i, u, a, r in zip(ids, usable, amount, row)]
        amount = np.where(usable == 1, amount, -1)
        gone += index.ingest(np.array([b"%016d\1" % i for i in ids], "S17"), usable, amount, row).tolist()
    assert sorted(gone) == sorted(brute(rows))
