import json
from pathlib import Path

import pytest

from tidemark.engine import Engine
from tidemark.operators.delivery import DeliveryIndex
from tidemark.sources import transcripts
from tidemark.streaming.delivery_stream import archive_stream, current_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_engine(spark):
    e = Engine(spark, DATA)
    found = e.search("cache reader", "zzzzqqqq").collect()
    assert found and {r.query for r in found} == {"cache reader"}
    assert 0 < e.read(found[0].file, found[0].from_line, found[0].to_line).count() <= 400
    assert e.map("cache reader builder").columns == ["query", "rank", "path", "score"]
    assert e.status().count() == 1 and e.file_history("src/none.ts").count() == 0


def test_raw_lines(spark, tmp_path):
    row = {"type": "assistant", "uuid": "u", "timestamp": "2023-01-01T10:00:00Z", "message": {"id": "m", "role": "assistant", "content": [{"type": "text", "text": "hi"}], "usage": {"output_tokens": 3}}}
    (tmp_path / "s1.jsonl").write_text(json.dumps(row) + "\n{broken\n\0\0\0\n" + json.dumps({"type": "meta"}) + "\n")
    (tmp_path / "s1" / "subagents").mkdir(parents=True)
    (tmp_path / "s1" / "subagents" / "x.jsonl").write_text(json.dumps(row | {"message": {"role": "user", "content": "plain"}, "type": "user"}))
    good, bad = transcripts.messages(transcripts.json_lines(spark, str(tmp_path), recursive=True))
    got = sorted(good.collect(), key=lambda r: r.type)
    assert [(r.session, r.sub_session, r.role, r.content) for r in got] == [("s1", False, "assistant", '[{"text":"hi","type":"text"}]'), ("s1", True, "user", '"plain"')]
    assert got[0].usage.output_tokens == 3 and [r.raw for r in bad.collect()] == ["{broken"]


def test_stream_keeps_one_copy(spark, tmp_path):
    schema = "row_id long, uuid string, usage struct<output_tokens:long>"
    a, b = f"{1:032x}", f"{2:032x}"
    for i, rows in enumerate(([(1, a, None), (2, b, (1,)), (3, None, None)], [(4, a.upper(), (2,)), (5, b, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    index = DeliveryIndex(spark, f"file://{tmp_path}/index", prefixes=2)
    for i in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        archive_stream(stream, index, f"{tmp_path}/archive", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r.row_id for r in current_rows(spark, f"{tmp_path}/archive").collect()) == [2, 3, 4]
