import json
from datetime import datetime

import pytest

from textloom.sources import readers
from textloom.streaming.counters import new_items, windowed_counts


def test_block_lists(spark, tmp_path):
    for name, content in (("p1", [{"type": "text", "text": "a", "page_idx": 0}, {"type": "odd", "extra": 1}]), ("p2", {"no": "list"})):
        folder = tmp_path / name / "mineru"
        folder.mkdir(parents=True)
        (folder / f"{name}_content_list.json").write_text(json.dumps(content))
    got = {(r.paper, r.block_index): r.type for r in readers.block_lists(spark, str(tmp_path)).collect()}
    assert got[("p1", 0)] == "text" and got[("p1", 1)] == "odd" and len(got) >= 3


def test_json_lines_fail_fast(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "k int").count() == 2
    (tmp_path / "y.jsonl").write_text('{"k": 1}\n{bad\n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "y.jsonl"), "k int").collect()


def test_label_sheets_and_plain_text(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("item_id\tstratum\tmatched_entries\tsentence\tannotator_a\tannotator_b\n1\tP\tx\ts\tP\n")
    row = readers.label_sheets(spark, str(tmp_path / "s.tsv")).first()
    assert row.annotator_a == "P" and row.annotator_b is None
    d = spark.createDataFrame([(1, "a\n\n b\nc \n \n"), (2, None), (3, " ")], "id int, t string")
    assert [tuple(r) for r in readers.plain_text_blocks(d, "id", "t").orderBy("id", "block_index").collect()] == [(1, 0, "a"), (1, 1, "b\nc")]


def test_stream_equals_batch(spark, tmp_path):
    data = [(datetime(2024, 1, 1 + i % 5, i % 24), "k" + str(i % 2), float(i)) for i in range(60)]
    events = spark.createDataFrame(data, "ts timestamp, key string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, build in (("counts", lambda d: windowed_counts(d, "ts", "key", late="30 days")), ("fresh", lambda d: new_items(d, "ts", "key", late="30 days").select("key"))):
        mode = "complete" if name == "counts" else "append"
        q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events, "ts", "key").collect()))
    assert sorted(r.key for r in spark.table("fresh").collect()) == ["k0", "k1"]
