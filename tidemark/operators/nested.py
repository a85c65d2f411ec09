"""Nested JSON records as flat tables.

Every node of a record gets a Dewey label: the ordinals on the way to it. A parent's label is a truncation of its
child's, so parent links need no join; nodes of the same schema path (array positions as *) belong to one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

_NODE = "row long, label array<int>, path string, parent_path string, parent_label array<int>, schema_path string, kind string, element boolean, value string"
_ELEMENT = "row long, path string, parent_path string"
#: Nodes that are sent on together.
_CHUNK = 20_000


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_decoder = json.JSONDecoder(parse_constant=_refuse)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^\s\[\]{}:,"]+))', re.S)


def _parse_deep(text: str):
    """JSON of any depth, without recursion; for what the decoder finds too deep."""
    stack: list = []
    out, have, want, at, end = None, False, "value", 0, len(text.rstrip(" \t\n\r"))

    def put(v) -> None:
        nonlocal out, have
        if not stack:
            out, have = v, True
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(v)
        else:
            stack[-1][0][stack[-1][1]] = v

    while at < end:
        m = _TOKEN.match(text, at)
        if not m or (have and not stack):
            raise ValueError("no JSON")
        at = m.end()
        mark, string, word = m.groups()
        if mark in ("]", "}"):
            if not stack or isinstance(stack[-1][0], list) != (mark == "]") or want not in ("next", "first"):
                raise ValueError("no JSON")
            stack.pop()
            want, have = "next", have or not stack
        elif want == "next":
            if mark != ",":
                raise ValueError("no JSON")
            want = "value" if isinstance(stack[-1][0], list) else "key"
        elif want == "colon":
            if mark != ":":
                raise ValueError("no JSON")
            want = "value"
        elif stack and isinstance(stack[-1][0], dict) and want in ("key", "first"):
            if string is None:
                raise ValueError("no JSON")
            stack[-1][1], want = _decoder.decode(string), "colon"
        elif mark in ("[", "{"):
            new = [] if mark == "[" else {}
            put(new)
            stack.append([new, None])
            have, want = False, "first"
        elif mark:
            raise ValueError("no JSON")
        else:
            put(_decoder.decode(string if string is not None else word))
            want = "next"
    if stack or not have:
        raise ValueError("no JSON")
    return out


def parse(text: str):
    """The value of a JSON text of any depth; ValueError if it is none. Of a repeated key the last value holds."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _parse_deep(text)


def decoded(value):
    """The value that a string of JSON encodes, be it encoded several times; the string itself if it encodes no array or object."""
    inner = value
    while isinstance(inner, str):
        try:
            inner = parse(inner)
        except ValueError:
            return value
    return inner if isinstance(inner, (dict, list)) else value


def _escape(key: str) -> str:
    if "~" in key or "/" in key:
        key = key.replace("~", "~0").replace("/", "~1")
    return key if key.isascii() else key.encode("utf-8", "replace").decode()


def elements(root, encoded_key: str) -> Iterator[tuple[str, str]]:
    """Path and parent path of each object that is an element of an array, in document order."""
    stack = [(root, "", "")]
    while stack:
        v, path, parent = stack.pop()
        below = []
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, str) and k == encoded_key:
                    x = decoded(x)
                if isinstance(x, (dict, list)):
                    below.append((x, f"{path}/{_escape(k)}", parent))
        else:
            for i, x in enumerate(v):
                if isinstance(x, dict):
                    yield (p := f"{path}/{i}"), parent
                    below.append((x, p, p))
                elif isinstance(x, list):
                    below.append((x, f"{path}/{i}", parent))
        stack += reversed(below)


def nodes(root, encoded_key: str) -> Iterator[tuple]:
    """Every node of a record: label, path, schema path, kind, whether it is an object in an array, and its scalar value."""
    stack = [(root, (), "", "", False)]
    while stack:
        v, label, path, schema, in_array = stack.pop()
        kind = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        value = None if kind in ("object", "array", "null") else v.encode("utf-8", "replace").decode() if kind == "string" else json.dumps(v)
        yield label, path, schema, kind, in_array and kind == "object", value
        if kind == "object":
            below = [(decoded(x) if k == encoded_key and isinstance(x, str) else x, (*label, i), f"{path}/{_escape(k)}", f"{schema}/{_escape(k)}", False) for i, (k, x) in enumerate(v.items())]
        elif kind == "array":
            below = [(x, (*label, i), f"{path}/{i}", f"{schema}/*", True) for i, x in enumerate(v)]
        else:
            continue
        stack += reversed(below)


def with_parents(labelled: Iterator[tuple]) -> Iterator[tuple]:
    """Each node with the path and label of its parent: the element whose label is the longest truncation of its own ('' and () if none).

    Nodes come in the order of their labels, so the elements on the way to a node are those before it whose label is a truncation of its own.
    """
    above: list[tuple[tuple, str]] = []
    for node in labelled:
        label = node[0]
        while above and label[: len(above[-1][0])] != above[-1][0]:
            above.pop()
        parent_label, parent = above[-1] if above else ((), "")
        yield (*node, parent, parent_label)
        if node[4]:
            above.append((label, node[1]))


def all_nodes(root, encoded_key: str) -> Iterator[tuple]:
    for label, path, schema, kind, element, value, parent, parent_label in with_parents(nodes(root, encoded_key)):
        yield label, path, parent, parent_label, schema, kind, element, value


def labelled_elements(root, encoded_key: str) -> Iterator[tuple[str, str]]:
    """What `elements` gives, by labels."""
    for node in with_parents(nodes(root, encoded_key)):
        if node[4]:
            yield node[1], node[6]


def _walker(walk: Callable, schema: pa.Schema, containers_only: bool, encoded_key: str) -> Callable:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    root = parse(text)
                except ValueError:
                    continue
                if containers_only and not isinstance(root, (dict, list)):
                    continue
                for x in walk(root, encoded_key):
                    out.append((row, *x))
                    if len(out) >= _CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return over


def _arrow(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in spec.split(", "))])


def element_objects(df: DataFrame, json_col: str = "content", row_col: str = "row_id", encoded_key: str = "input") -> DataFrame:
    """Every object that is an element of an array, at any depth: row, its JSON Pointer, and that of the nearest enclosing such object ('' if none).

    Null texts and texts that are no JSON give nothing, nor do scalars, nulls and arrays in arrays, which count in the index. A string under
    encoded_key counts as the array or object that it encodes. Rows that occur twice give their objects twice. Narrow: no shuffle, two columns read.
    """
    # Texts without a brace hold no object; the test spares most plain strings the way to Python.
    needed = df.select(F.col(row_col).cast("long").alias("row"), F.col(json_col).cast("string").alias("text")).where(F.col("text").contains("{") | F.col("text").contains("u007b") | F.col("text").contains("u007B"))
    found = spread(needed).mapInArrow(_walker(labelled_elements, _arrow(_ELEMENT), True, encoded_key), _ELEMENT)
    return found.select(F.col("row").alias(row_col), "path", "parent_path")


def labelled_nodes(df: DataFrame, json_col: str = "content", row_col: str = "row_id", encoded_key: str = "input") -> DataFrame:
    """All nodes of all records with their Dewey labels; texts that are no JSON give none. Narrow, as `element_objects`."""
    needed = df.select(F.col(row_col).cast("long").alias("row"), F.col(json_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = spread(needed).mapInArrow(_walker(all_nodes, _arrow(_NODE), False, encoded_key), _NODE)
    return found.withColumnRenamed("row", row_col)


def flat_tables(labelled: DataFrame, row_col: str = "row_id") -> dict[str, DataFrame]:
    """The tables of message contents, grouped by schema path; each child names its parent by path.

    rows: one a record, with the number of its blocks; elements: every object of an array, at any schema path, with its label and its parent's;
    of these, blocks: objects of the outermost array; results: objects of a block's content; input_elements: objects of arrays within a block's
    input; others: the rest; fields: every scalar with the path of the object that holds it.
    """
    depth1, element, schema = F.col("schema_path") == "/*", F.col("element"), F.col("schema_path")
    of_input, of_results = schema.rlike(r"^/\*(/content/\*)*/input/"), schema.rlike(r"^/\*/content/")
    owner = F.regexp_replace("path", "/[^/]*$", "")
    elements = labelled.where(element).select(row_col, "label", "path", "parent_label", "parent_path", "schema_path", F.element_at("label", -1).alias("position"))
    narrow = elements.drop("label", "parent_label")
    return {
        "rows": labelled.groupBy(row_col).agg(F.count_if(depth1 & element).alias("blocks"), F.max(F.when(F.size("label") == 0, F.col("kind"))).alias("kind")),
        "elements": elements,
        "blocks": narrow.where(depth1),
        "results": narrow.where(of_results & ~of_input),
        "input_elements": narrow.where(of_input),
        "others": narrow.where(~depth1 & ~of_results & ~of_input),
        "fields": labelled.where(F.col("kind").isin("string", "number", "boolean", "null")).select(row_col, "path", owner.alias("owner_path"), "parent_path", "schema_path", "kind", "value"),
    }


def write_tables(labelled: DataFrame, path: str, row_col: str = "row_id") -> None:
    """The elements as one table a schema path under path, in one pass, whatever the schema paths are."""
    flat_tables(labelled, row_col)["elements"].write.mode("overwrite").partitionBy("schema_path").parquet(path)
