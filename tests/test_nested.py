import json

import pytest

from tidemark.operators.nested import _parse_deep, element_objects, flat_tables, labelled_nodes, parse, write_tables


def brute(v, path="", parent="", in_array=False, key=None):
    if key == "input" and isinstance(v, str):
        try:
            inner = json.loads(v)
            if isinstance(inner, (dict, list)):
                v = inner
        except ValueError:
            pass
    if isinstance(v, dict):
        if in_array:
            yield path, parent
            parent = path
        for k, x in v.items():
            yield from brute(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", parent, False, k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from brute(x, f"{path}/{i}", parent, True)


TEXTS = [
    '[{"type":"tool_use","input":{"edits":[{"old":"a","spans":[{"from":1},null,[{"x":[]}]]},"b"]}}]',
    json.dumps([{"input": json.dumps({"a/b": [{"~": [{}]}]})}, 3, [], [[{}]]]),
    '{"input": [{"k": 1}]}', '"[{}]"', "null", "[", '[{"a":NaN}]', "", None, '[{"input":"not json {"}]', "[{}]" * 2, '[{"a":1,"a":[{}]}]', '["\\ud800", {"\\ud800": [{}]}]',
]


def test_elements_are_those_of_a_recursive_walk(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "row_id long, content string, path string")
    got = sorted((r.row_id, r.path, r.parent_path) for r in element_objects(df).collect())
    want = []
    for i, t in enumerate(TEXTS):
        try:
            v = json.loads(t, parse_constant=lambda _: 1 / 0)
        except (ValueError, TypeError, ZeroDivisionError):
            continue
        want += [(i, p.encode("utf-8", "replace").decode(), q) for p, q in brute(v)]
    assert got == sorted(want)


def test_empty_table(spark):
    assert element_objects(spark.createDataFrame([], "row_id long, content string")).count() == 0


@pytest.mark.parametrize("text", [t for t in TEXTS if t] + ['{"a": {"b": [1, 2.5, "x\\n", true, null]}}', "[1,]", '{"a" 1}', '{"a":1}}', '{1:2}', "[1 2]", " [ ] "])
def test_the_parser_without_recursion_agrees(text):
    try:
        want = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        with pytest.raises(ValueError):
            _parse_deep(text)
        return
    assert _parse_deep(text) == want


def test_very_deep_records(spark):
    deep = "[" * 30_000 + "{}" + "]" * 30_000
    v = parse(deep)
    assert isinstance(v, list)
    got = element_objects(spark.createDataFrame([(1, deep)], "row_id long, content string")).collect()
    assert len(got) == 1 and got[0].parent_path == "" and got[0].path == "/0" * 30_000


def test_children_name_their_parents(spark):
    df = spark.createDataFrame([(1, TEXTS[0])], "row_id long, content string")
    flat = flat_tables(labelled_nodes(df))
    assert [r.path for r in flat["blocks"].collect()] == ["/0"]
    inner = {r.path: r.parent_path for r in flat["input_elements"].collect()}
    assert inner == {"/0/input/edits/0": "/0", "/0/input/edits/0/spans/0": "/0/input/edits/0", "/0/input/edits/0/spans/2/0": "/0/input/edits/0"}
    labels = {r.path: (r.label, r.parent_label) for r in labelled_nodes(df).collect()}
    label, parent = labels["/0/input/edits/0/spans/0"]
    assert label[: len(parent)] == parent == labels["/0/input/edits/0"][0]
    assert flat["rows"].collect()[0].blocks == 1


def test_every_element_is_in_a_table_whatever_its_schema_path(spark, tmp_path):
    text = '[{"type": "a", "source": {"parts": [{"x": 1}, {"y": [{"z": 2}]}]}}, {"meta": [{"k": null}]}]'
    labelled = labelled_nodes(spark.createDataFrame([(1, text)], "row_id long, content string"))
    flat = flat_tables(labelled)
    want = {"/0": "", "/1": "", "/0/source/parts/0": "/0", "/0/source/parts/1": "/0", "/0/source/parts/1/y/0": "/0/source/parts/1", "/1/meta/0": "/1"}
    assert {r.path: r.parent_path for r in flat["elements"].collect()} == want
    assert sum(flat[t].count() for t in ("blocks", "results", "input_elements", "others")) == len(want)
    write_tables(labelled, f"{tmp_path}/tables")
    assert {r.path: r.parent_path for r in spark.read.parquet(f"{tmp_path}/tables").collect()} == want
