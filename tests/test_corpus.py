import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import sqlgate, stats
from textloom.sources import markdown as M
from textloom.sources import writers as W


def values(spark, rows):
    return spark.createDataFrame([(c, d, m, None if v is None else float(v), 100) for c, d, m, v in rows], "corpus string, doc int, metric string, value double, tok int")


def test_profile_contract_and_validation(spark):
    data = [("a", i, "x", v) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, None])] + [("a", i, "y", 2) for i in range(6)] + [("a", 1, "z", None), ("a", 1, "w", 3)] + [(None, 1, "x", 4)]
    v = values(spark, data)
    p = {(r.corpus, r.metric): r for r in C.profile(v, ["corpus", "metric"]).collect()}
    x = p["a", "x"]
    assert (x.n_valid, x.n_missing, x.median, x.p25, x.p75, x.iqr, x.warnings) == (8, 1, 5, 3, 6, 3, "")  # nearest rank, half to even
    assert x.sd == pytest.approx(statistics.stdev(range(1, 9)), abs=1e-6) and x.ci95_high - x.mean == pytest.approx(2.365 * x.sd / math.sqrt(8), abs=1e-5)
    assert p["a", "y"].warnings == "IQR_ZERO" and p["a", "z"].warnings == "NO_VALID_VALUES,N_LT_5,N_VALID_LT_3" and p["a", "w"].sd == 0
    c = C.contract(C.profile(v.filter("corpus = 'a'"), ["corpus", "metric"]), ["corpus", "metric"], gate=True, derived={"w": ["x", "x2"]})
    got = {r.metric: (r.low, r.high, r.level, r.reason, r.warning) for r in c.collect()}
    assert got == {"x": (3, 6, "gate", None, None), "y": (None, None, "warn", "iqr_zero", None), "z": (None, None, "warn", "stats_null", "N_LT_5"), "w": (None, None, "warn", "component_without_target", "N_LT_5")}
    r = {(r.doc, r.metric): (r.status, r.deviation) for r in C.validate(v, c, ["corpus", "metric"], "doc").collect()}
    assert r[0, "x"] == ("fail", 2) and r[2, "x"] == ("pass", 0) and r[8, "x"] == ("skipped", None) and r[1, "y"] == ("skipped", None)
    assert {q.doc: q.exit_code for q in C.verdicts(C.validate(v, c, ["corpus", "metric"], "doc"), "doc").collect()}[0] == 1
    assert C.profile(v.limit(0), ["corpus", "metric"]).count() == 0


def test_ranks_of_a_hot_group(spark):
    d = spark.createDataFrame([("hot", float(i * i % 101)) for i in range(1000)] + [("b", 1.0), ("b", None), (None, 2.0)], "g string, v double")
    got = {(r.g, r.v): (r.times, r.below) for r in stats.ranked(d, ["g"], "v").collect()}
    hot = sorted(float(i * i % 101) for i in range(1000))
    assert all(got["hot", v] == (hot.count(v), sum(x < v for x in hot)) for v in set(hot))
    assert got["b", 1.0] == (1, 0) and got[None, 2.0] == (1, 0) and len(got) == len(set(hot)) + 2


def test_fingerprint_drift_and_top(spark):
    d = spark.createDataFrame([(i % 7, str(i)) for i in range(100)] + [(None, None)], "a int, b string")
    f = C.fingerprint(d, ["b", "a"]).first()
    assert f == C.fingerprint(d.orderBy(F.rand(1)).repartition(3), ["a", "b"]).first() and f.n == 101
    assert f.fingerprint != C.fingerprint(d.unionByName(d.limit(1)), ["a", "b"]).first().fingerprint
    assert C.fingerprint(d.limit(0), ["a"]).first().n == 0
    v = spark.createDataFrame([("s", 1, "m", 2.0), ("t", 1, "m", 3.0), ("s", 2, "m", 0.0), ("t", 2, "m", -4.0), ("s", 3, "m", 1.0)], "src string, k int, metric string, value double")
    assert tuple(C.drift(v, "src", "s", "t", "k").first()) == ("m", 2, -1.5, 2.5, 4.0, 0.5)
    top = C.top_by(spark.createDataFrame([("g", i, i % 3) for i in range(10)], "g string, i int, v int"), ["g"], [-F.col("v"), F.col("i")], ["i"], 3)
    assert sorted((r.place, r.i) for r in top.collect()) == [(1, 2), (2, 5), (3, 8)]


def test_read_only_gate(spark):
    for ok in ("SELECT 1 AS x LIMIT 5 OFFSET 0", "WITH setting AS (SELECT 1 AS x) SELECT * FROM setting WHERE x IN (SELECT 1)", "VALUES (1)"):
        assert sqlgate.is_read_only(spark, ok)
    for bad in ("DROP TABLE x", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM a INSERT INTO t SELECT 1", "SET x = 1", "CACHE TABLE t"):
        assert not sqlgate.is_read_only(spark, bad)


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(2, "x\ty|z", 1.23456789, {"b": 1, "a": 2}), (1, None, float("nan"), None)], "k int, t string, v double, m map<string,int>")
    W.write_json_lines(d, str(tmp_path / "j"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).orderBy("value").collect()] == ['{"k":1,"m":null,"t":null,"v":null}', '{"k":2,"m":{"a":2,"b":1},"t":"x\\ty|z","v":1.234568}']
    W.write_tsv(d.select("k", "t"), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect() if r.value != "k\tt") == ["1\t", "2\tx y|z"]
    one = d.filter("k = 2").select("k", "t", "v")
    assert W.markdown_table(one) == "| k | t | v |\n|---|---|---|\n| 2 | x\ty\\|z | 1.234568 |\n"
    assert W.yaml_document(one) == '-\n  "k": 2\n  "t": "x\\ty|z"\n  "v": 1.234568\n'
    assert '"truncated": true' in W.query_result_json(d.select("k"), "q", 1)
    assert W.yaml_document(d.limit(0)) == "[]\n"


def test_markdown_blocks(spark):
    text = "---\ntitle: T\n---\n# One\nA line\nwraps.\n\n```py\n# no heading\n```\n$$\nx = 1\n$$\nFigure 1. A plot\n\n![alt](a.png)\n\n|a|b|\n|---|---|\n|1|2 \\| 3|\n\nTable 2. Numbers\n\n- i\n- j\n\n#### Deep\nFigure 9. Lost"
    got = M.markdown_blocks(text)
    assert [b[0] for b in got] == ["prose", "heading", "prose", "code", "equation", "figure", "table", "list", "heading", "prose"]
    assert got[2][1] == "A line wraps." and got[3][1] == "# no heading" and got[4][1] == "x = 1" and got[8][2] == 3
    assert got[5][3:] == ("Figure 1. A plot", "a.png")
    assert got[6][1] == "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2 | 3</td></tr></table>" and got[6][3] == "Table 2. Numbers"
    assert M.markdown_blocks("") == [] and M.markdown_blocks("```\nopen") == [("code", "open", None, None, None)]
    d = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (3, " ", "k")], "id int, t string, kind string")
    assert M.read_markdown(d, "id", "t").groupBy("id").count().collect() == [(1, len(got))]


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (900).to_bytes(4) + (70).to_bytes(4)
    gif = b"GIF89a" + (30).to_bytes(2, "little") + (20).to_bytes(2, "little")
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (600).to_bytes(2) + (800).to_bytes(2) + b"\x03"
    assert [M.image_size(x) for x in (png, gif, jpg, png[:20], b"", None, b"nonsense")] == [(900, 70), (30, 20), (800, 600), None, None, None, None]
    d = spark.createDataFrame([("s", png), ("s", gif), ("s", None), ("t", b"x")], "stem string, c binary")
    assert sorted(tuple(r) for r in M.image_resolution(d, "stem", "c").collect()) == [("s", 3, 2, 1, 0.5), ("t", 1, 0, 0, None)]
