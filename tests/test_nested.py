import json

from textloom.operators.nested import decode, flat_table, label_nodes, list_text, parse_deep, walk
from textloom.plans import registry

RECORD = {
    "marker": {"ok": True, "img_breakdown": {"image": 2, "chart": None}},
    "mineru": None,
    "document": {"blocks": [None, {"type": "list", "list_items": ["a", None, {"text": "b", "list_items": ["c"]}]}, {"image_caption": "lone", "rows": [{"cells": [{"text": "1"}]}, {}]}]},
}
NODES = [
    ("document", "$"),
    ("document.blocks[1]", "document"),
    ("document.blocks[1].list_items[0]", "document.blocks[1]"),
    ("document.blocks[1].list_items[2]", "document.blocks[1]"),
    ("document.blocks[1].list_items[2].list_items[0]", "document.blocks[1].list_items[2]"),
    ("document.blocks[2]", "document"),
    ("document.blocks[2].image_caption[0]", "document.blocks[2]"),
    ("document.blocks[2].rows[0]", "document.blocks[2]"),
    ("document.blocks[2].rows[0].cells[0]", "document.blocks[2].rows[0]"),
    ("document.blocks[2].rows[1]", "document.blocks[2]"),
    ("marker", "$"),
    ("marker.img_breakdown.image", "marker"),
]


def test_nodes_parents_and_labels(spark):
    text = json.dumps(RECORD)
    data = [(1, text, "n1"), (1, text, "n2"), (2, json.dumps(text), "n"), (3, text[:-5], "n"), (4, None, "n"), (5, "", "n"), (6, "[1]", "n"), (None, text, "n"), (7, "{}", "n")]
    nodes = label_nodes(spark.createDataFrame(data, "record_id bigint, payload string, node string"))
    got = {}
    for r in nodes.collect():
        got.setdefault(r.record_id, []).append((r.node, r.parent))
        # a parent's label is a truncation of its child's
        assert r.parent == "$" or any(p.node == r.parent and r.dewey.startswith(p.dewey + ".") for p in nodes.filter(f"record_id <=> {r.record_id or 'null'}").collect()) if r.record_id == 1 else True
    assert got.keys() == {1, 2, None}
    assert all(sorted(v) == sorted(NODES) for v in got.values())


def test_flat_table(spark, rows):
    nodes = label_nodes(spark.createDataFrame([(1, json.dumps(RECORD))], "record_id bigint, payload string"))
    assert rows(flat_table(nodes, "$.document.blocks[]", {"type": "string", "page_idx": "int"})) == [(1, "document.blocks[1]", "document", "list", None), (1, "document.blocks[2]", "document", None, None)]
    assert rows(flat_table(nodes, "$.marker.img_breakdown.*", {"name": "string", "value": "int"})) == [(1, "marker.img_breakdown.image", "marker", "image", 2)]


def test_empty_and_deep(spark):
    assert label_nodes(spark.createDataFrame([], "record_id bigint, payload string")).count() == 0
    assert decode("[" * 100_000) is None
    assert decode('{"a": 1') is None and decode("null") is None


def test_byte_order_mark_many_encodings_and_depth(spark):
    text = json.dumps(RECORD)
    often = text
    for _ in range(10):
        often = json.dumps("\ufeff" + often)
    deep = '{"a":' * 800 + '{"list_items": ["x"]}' + "}" * 800
    lists = '{"document": {"bbox": ' + "[" * 200_000 + "1" + "]" * 200_000 + "}}"
    data = [(1, "\ufeff" + text), (2, often), (3, deep), (4, lists), (5, deep[:-1])]
    nodes = label_nodes(spark.createDataFrame(data, "record_id bigint, payload string"))
    assert {r[0]: r[1] for r in nodes.groupBy("record_id").count().collect()} == {1: len(NODES), 2: len(NODES), 3: 801, 4: 1}
    last = nodes.filter("record_id = 3 AND kind = 'string'").first()
    assert last.node.endswith("a.a.list_items[0]") and last.node == last.parent + ".list_items[0]" and last.dewey == ".".join("1" * 801)
    assert nodes.filter("record_id = 4").first().fields["bbox"] == "[" * 200_000 + "1" + "]" * 200_000


def test_parse_deep_is_json():
    good = ["1", '"a\\"b"', "[]", "{}", '{"a": [1, {"b": null}, "c:,[]"], "d": {}}', " [1 , 2.5e3,true ] ", json.dumps(RECORD), "[[[]]]"]
    assert all(parse_deep(x) == json.loads(x) for x in good)
    for bad in ["", "[", "]", "[1 2]", "[1,]", "{1: 2}", '{"a"}', '{"a":}', '{"a": 1,}', "[1]]", "1 2", '"a', "[nope]", '{"a": 1 "b": 2}', "{,}"]:
        try:
            parse_deep(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert list_text([1, [None, "a", {"b": 1}], []], True) == '[1, [null, "a", null], []]' and list_text([None, [{}]], True) is None


def test_odd_keys(spark):
    got = [(".".join(s), kind) for s, _, _, kind, _ in walk({"": {"a": {}}, "img_breakdown": {"x": {"y": {}}, "z": [1]}, "x_caption": "c"})]
    assert got == [("", "object"), (".a", "object"), ("img_breakdown.z", "entry"), ("img_breakdown.x", "object"), ("img_breakdown.x.y", "object"), ("x_caption[0]", "string")]


def test_a_key_with_several_payloads(spark, rows):
    data = [(1, '{"a": {"v": 1}}'), (1, '{"b": {}, "a": {"v": 1}}'), (None, '{"a": {}}')]
    nodes = label_nodes(spark.createDataFrame(data, "record_id bigint, payload string"))
    assert rows(nodes.select("record_id", "node", "parent")) == [(1, "a", "$"), (1, "b", "$"), (None, "a", "$")]


def test_values_of_every_schema_path(spark, rows, tmp_path):
    record = {"stem": "s", **json.loads(json.dumps(RECORD)), "precheck": {"ok": False, "page_count": 3, "warnings": [{"code": "c", "pages": [1, None]}]}}
    record["document"]["blocks"][1]["bbox"] = [1, 2]
    spark.createDataFrame([(1, json.dumps(record)), (2, "{")], "record_id bigint, payload string").write.parquet(str(tmp_path / "meta_records.parquet"))
    got = rows(registry.QUERIES["p4_nodes"](spark, str(tmp_path)).drop("dewey"))
    fields = {(r[1], r[5], r[6]) for r in got}
    assert {n for n, _, _ in fields} == {n for n, _ in NODES} | {"$", "precheck", "precheck.warnings[0]"}
    for row in [("$", "stem", "s"), ("precheck", "page_count", "3"), ("precheck.warnings[0]", "pages", "[1, null]"), ("document.blocks[1]", "bbox", "[1, 2]"), ("document.blocks[1].list_items[2]", "text", "b"), ("document.blocks[2].image_caption[0]", "value", "lone"), ("document.blocks[2].rows[0].cells[0]", "text", "1"), ("document.blocks[2].rows[1]", None, None)]:
        assert row in fields
    assert rows(registry.QUERIES["p4_precheck"](spark, str(tmp_path)).select("node", "parent", "ok", "page_count", "status")) == [("precheck", "$", False, 3, None)]
    assert rows(registry.QUERIES["p4_img_breakdown"](spark, str(tmp_path))) == [(1, "marker.img_breakdown.image", "marker", "image", 2)]
