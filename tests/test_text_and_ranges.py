import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import archive, evaluation, incremental, ranges, retrieval, telemetry


def run(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_redaction_replaces_secrets_and_leaves_the_rest(spark):
    key = "ghp" + "_" + "a1B2" * 6
    long = "x9" * 20
    inputs = [f"{key}.", f"say \\n{key}", "s" + f"k-ant-{long}", "s" + f"k-{long}", "postgres://me:secret99@host/db", "MY_API_KEY" + "='abcd1234efgh'", "Bearer " + long, "TOKEN_LIMIT=500", "commit 9fceb02d0ae598e95dc970b74767f19372d61af8", f"x{key}", "A_TOKEN=process || call()", None]
    got = run(spark, tx.redact, *inputs)
    assert got == ["[redacted:github].", "say \\n[redacted:github]", "[redacted:sk-ant]", "[redacted:openai]", "postgres://me:[redacted:password]@host/db", "MY_API_KEY='[redacted:env]'", "[redacted:bearer]", inputs[7], inputs[8], inputs[9], inputs[10], None]


def test_failure_line_is_redacted_before_it_is_cut(spark):
    key = "ghp" + "_" + "a1B2" * 6
    assert run(spark, tx.failure_line, f"ok\n  Error: {'y' * 140} {key} z\nError: 2", "an error field", None) == [f"Error: {'y' * 140} [redacted:gi", None, None]


def test_leading_blocks_and_segments(spark):
    assert run(spark, tx.without_leading_blocks, "<env a>x</env>\n<b>y</b> do it", "<env>open", "plain") == ["do it", "<env>open", "plain"]
    assert run(spark, tx.segments, "loadHTTPQueue_of-reader")[0] == ["load", "http", "queue", "of", "reader"]
    assert run(spark, tx.fold, "Žiadosť Über é", None) == ["ziadost uber e", None]


def test_bm25_equals_that_of_sqlite(spark):
    docs = ["The cache reader keeps one cache", "queue of readers", "cache", "řeka reading", "other words entirely here", "cached queues", "nothing", ""]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE d USING fts5(t, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("INSERT INTO d(rowid, t) VALUES (?, ?)", list(enumerate(docs)))
    want = {(q, r): round(s, 6) for q, m in (("cache readers", '"cache"* OR "readers"* OR "read"*'), ("of", '"of"')) for r, s in con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (m,))}
    index = retrieval.postings(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "doc_id", {"text": 1.0})
    # An empty row counts among the rows of the full-text table; here it has no postings.
    con.execute("DELETE FROM d WHERE rowid = 7")
    want = {(q, r): round(s, 6) for q, m in (("cache readers", '"cache"* OR "readers"* OR "read"*'), ("of", '"of"')) for r, s in con.execute("SELECT rowid, bm25(d) FROM d WHERE d MATCH ?", (m,))}
    scored = retrieval.bm25(index, retrieval.phrases(spark.createDataFrame([("cache readers",), ("of",), (None,)], "q string")))
    assert {(r.query, r.doc): round(r.score, 6) for r in scored.collect()} == want


def test_chunks_close_at_blank_lines_and_cover_all():
    rng = random.Random(2)
    for _ in range(50):
        text = "\n".join(rng.choice(["", "x" * rng.randrange(1, 300), "word"]) for _ in range(rng.randrange(1, 40)))
        found = archive.chunk_bounds(text)
        assert "\n".join(c for _, _, c in found) == text
        assert [f for f, _, _ in found] == [1, *[t + 1 for _, t, _ in found[:-1]]]


def test_ranges(spark):
    r = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 30), ("a", 25, 26), ("b", 900, 950), ("b", 7, 3)], "session string, from_line long, to_line long")
    union = ranges.merged(r, "session")
    assert sorted(map(tuple, union.collect())) == [("a", 1, 9), ("a", 20, 30), ("b", 900, 950)]
    sizes = spark.createDataFrame([("a", 35), ("b", 920), ("c", 12)], "session string, lines long")
    assert sorted(map(tuple, ranges.gaps(union, sizes, "session", 5).collect())) == [("a", 10, 19), ("a", 31, 35), ("b", 1, 899), ("c", 1, 12)]


def test_nearest_joins_equal_brute_force(spark):
    rng = random.Random(3)
    pts = [("s", rng.randrange(400), i) for i in range(60)]
    marks = [("s", rng.randrange(400), f"m{i}") for i in range(40)]
    p, m = spark.createDataFrame(pts, "k string, at int, id int"), spark.createDataFrame(marks, "k string, mark int, name string")
    before = {(r.id): (r.mark, r.name) for r in ranges.nearest_before(p, m, "k", "at", "mark", 25, "name").collect()}
    around = {(r.id): (r.mark, r.name) for r in ranges.nearest_around(p, m, "k", "at", "mark", 6, "name").collect()}
    for _, at, i in pts:
        b = sorted(((-x, n) for _, x, n in marks if at - 25 <= x <= at))
        a = sorted(((abs(x - at), x, n) for _, x, n in marks if abs(x - at) <= 6))
        assert before.get(i) == ((-b[0][0], b[0][1]) if b else None)
        assert around.get(i) == ((a[0][1], a[0][2]) if a else None)


def test_upper_median_and_sampling(spark):
    rows = spark.createDataFrame([("d", v) for v in (1, 2, 3, 9)] + [("e", 5), ("e", None)], "day string, turns long")
    assert sorted((r.day, r.n, r.median) for r in telemetry.upper_median(rows, ["day"], "turns").collect()) == [("d", 4, 3), ("e", 1, 5)]
    taken = evaluation.systematic(spark.range(100).withColumnRenamed("id", "x"), ["x"], 7, 2).collect()
    assert sorted(r.x for r in taken) == list(range(2, 100, 7))


def test_versions_and_incremental_index(spark, tmp_path):
    old = spark.createDataFrame([(1, "alpha beta"), (2, "gone"), (3, "same words")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "alpha gamma"), (3, "same words"), (4, "fresh")], "doc_id long, text string")
    changed = incremental.changes(incremental.manifest(old), incremental.manifest(new))
    assert sorted(map(tuple, changed.collect())) == [(1, "changed"), (2, "deleted"), (4, "new")]
    t = incremental.VersionedTable(spark, f"file://{tmp_path}/index")
    t.write(incremental.chunk_index(old))
    t.write(incremental.update_index(t.read(), new, changed))
    assert t.version() == 2
    assert sorted(map(str, t.read().collect())) == sorted(map(str, incremental.chunk_index(new).collect()))
