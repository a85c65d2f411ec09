"""Queries answer for all that they are given: no sample, no prefix, no cap."""

import datetime
import random

import __spark_entry__ as entry
from tidemark.operators import nested


def test_map_find_answers_all_queries_and_headings(spark, tmp_path):
    modules = "\n".join(f"- `src/{n}.py` — Does it." for n in ("alpha", "beta", "gamma", "delta", "omega", "sigma"))
    spark.createDataFrame([(1, modules)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    day = datetime.date(2023, 1, 1)
    spark.createDataFrame([("a", day, "On alpha"), ("b", day, "On beta"), ("c", None, "On gamma")], "file string, day date, heading string").write.parquet(f"{tmp_path}/trail.parquet")
    spark.createDataFrame([("delta",), ("delta",), (None,), ("omega",)], "q string").write.parquet(f"{tmp_path}/misses.parquet")
    got = entry.queries()["map_find"](spark, str(tmp_path)).collect()
    assert sorted((r.query, r.rank, r.path) for r in got) == [("On alpha", 1, "src/alpha.py"), ("On beta", 1, "src/beta.py"), ("On gamma", 1, "src/gamma.py"), ("delta", 1, "src/delta.py"), ("omega", 1, "src/omega.py")]


def test_p3_parents_by_truncation_are_those_of_the_plain_walk():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(4) if depth < 7 else 3
        if kind < 2:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 2:
            return {k: value(depth + 1) for k in rng.sample(["a", "b/c", "input", "d"], rng.randrange(4))}
        return rng.choice([1, None, "x", '[{"e": [{}]}]'])

    n = 0
    for _ in range(400):
        root = [value(1) for _ in range(3)]
        got = list(nested.labelled_elements(root, "input"))
        assert sorted(got) == sorted(nested.elements(root, "input"))
        n += sum(parent != "" for _, parent in got)
    assert n > 100
