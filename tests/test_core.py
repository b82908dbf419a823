import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textloom.functions import lexical as L
from textloom.operators import blocks as B
from textloom.operators import merge as M
from textloom.operators import sqlgate, stats


def test_forward_fill_over_buckets(spark):
    data = [("a", i, i, "h" + str(i) if i % 5000 == 100 else None) for i in range(12000)] + [(None, 1, 1, None), ("b", None, 2, "x"), ("b", 5, 3, None)]
    d = B.forward_fill(spark.createDataFrame(data, "g string, o int, id int, v string"), "g", "o", "v", "out", "id")
    got = {(r.g, r.id): r.out for r in d.collect()}
    assert len(got) == len(data)
    last = None
    for g, _, i, v in data[:12000]:
        last = v or last
        assert got[g, i] == last
    assert got[None, 1] is None and got["b", 3] == "x"


def test_order_statistics(spark):
    rnd = random.Random(3)
    for n in (1, 2, 5, 40):
        xs = sorted(rnd.choice(range(20)) for _ in range(n))
        r = stats.order_statistics(spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, x int"), ["g"], "x").first()
        pos = 0.75 * (n - 1)
        assert r.nearest == xs[round(pos)]
        assert r.ceil_rank == xs[max(1, math.ceil(0.75 * n)) - 1]
        assert r.upper_median == xs[n // 2]
        assert r.true_median == statistics.median(xs)
        assert r.linear == pytest.approx(xs[math.floor(pos)] + (xs[math.ceil(pos)] - xs[math.floor(pos)]) * (pos - math.floor(pos)))


def test_describe_and_missing(spark):
    r = {x.g: x for x in stats.describe(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, x double"), ["g"], "x").collect()}
    assert (r["a"].mean, r["b"].sd, r["c"].mean, r["c"].n_missing) == (2.0, 0.0, None, 1)
    assert r["a"].ci_low == pytest.approx(2 - 12.706 * math.sqrt(2) / math.sqrt(2), abs=1e-6)
    assert "HIGH_MISSING" in r["c"].warnings


def test_correlations_need_variation(spark):
    d = spark.createDataFrame([("a", 1, 2), ("a", 2, 4), ("a", 3, 6), ("b", 1, 1), ("c", 1, 1), ("c", 1, 2), ("c", 1, 3)], "g string, x int, y int")
    r = {x.g: (x.pearson, x.spearman) for x in stats.correlations(d, ["g"], "x", "y").collect()}
    assert r == {"a": (1.0, 1.0), "b": (None, None), "c": (None, None)}


def test_kappa_edges(spark):
    one = lambda data: stats.kappa(spark.createDataFrame(data, "a string, b string"), "a", "b").first().kappa
    assert one([("x", "x"), ("y", "y")]) == 1.0
    assert one([("x", "x")]) == 1.0
    assert one([]) is None
    assert one([("x", "y"), ("y", "x")]) == -1.0


def test_dedup_and_rank(spark):
    w = spark.createDataFrame([("s1", 2.0, 0), ("s2", 1.0, 1)], "source string, weight double, source_order int")
    r = spark.createDataFrame([("k", "s2", 0, 9.0), ("k", "s1", 4, 1.0), ("k", "s2", 1, 3.0), ("m", "zz", 0, None), (None, "s1", 0, 1.0)], "key string, source string, pos int, score double")
    assert [tuple(x) for x in M.dedup_and_rank(r, w, 5).collect()] == [("k", "s1", 2.3, 2), ("m", "zz", 0.0, 0)]


def test_islands_and_agreement(spark, rows):
    assert rows(M.islands(spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 7), ("a", None)], "g string, n int"), ["g"], "n")) == [("a", 1, 2, 2, None), ("a", 7, 7, 1, 4)]
    assert rows(M.agreement(spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 9), (None, 1)], "i string, m int"), "i", "m")) == [("x", "y", 1, 0.333333)]


def test_overlaps_against_all_pairs(spark, rows):
    rnd = random.Random(1)
    boxes = [(1, i, [x := rnd.randrange(600), y := rnd.randrange(800), x + rnd.randrange(-5, 200), y + rnd.randrange(-5, 200)]) for i in range(60)] + [(1, 99, None)]
    good = [(i, b) for _, i, b in boxes if b and b[2] > b[0] and b[3] > b[1]]
    want = sorted(((1, i, j, (min(a[2], b[2]) - max(a[0], b[0])) * (min(a[3], b[3]) - max(a[1], b[1]))) for i, a in good for j, b in good if i < j and a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]), key=repr)
    assert rows(B.overlapping_boxes(spark.createDataFrame(boxes, "page int, id int, box array<int>"), ["page"], "id", "box")) == want


def test_sql_gate(spark):
    assert sqlgate.choose_limit(None) == 200 and sqlgate.choose_limit(0) == 1 and sqlgate.choose_limit(10**9) == 1000
    assert sqlgate.run(spark, "/* c */ with a as (select 1 as x) select * from a;").collect()[0].x == 1
    for bad in ("drop table x", "insert into x values (1)", "with a as (select 1) insert into x select * from a"):
        with pytest.raises(PermissionError):
            sqlgate.run(spark, bad)
    with pytest.raises(ValueError):
        sqlgate.run(spark, " -- nothing\n;")


def test_lexical(spark):
    d = spark.createDataFrame([("May we, however, re-check?",), ("我们 use 方法",), ("12 34",), (None,)], "t string")
    got = [tuple(r) for r in d.select(L.detect_language(F.col("t")), F.size(L.tokens(F.col("t"))), L.hits(L.tokens(F.col("t")), "hedge")).collect()]
    assert got[:3] == [("en", 4, 1), ("zh", 1, 0), ("unknown", 0, 0)]


def test_mtld_fold(spark):
    def reference(tokens):
        def one(ts):
            factors, n, types = 0.0, 0, set()
            for t in ts:
                n, _ = n + 1, types.add(t)
                if len(types) <= 0.72 * n:
                    factors, n, types = factors + 1, 0, set()
            factors += (1 - len(types) / n) / 0.28 if n else 0
            return len(ts) / factors if factors else None

        a, b = one(tokens), one(tokens[::-1])
        return None if len(tokens) < 20 or a is None or b is None else (a + b) / 2

    words = ("the cat sat on the mat and the dog sat on the log while a bird sang to the cat and the mat " * 3).split()
    got = spark.createDataFrame([(words,), (words[:5],)], "t array<string>").select(L.mtld(F.col("t")).alias("m")).collect()
    assert got[0].m == pytest.approx(reference(words), abs=1e-6) and got[1].m is None


def test_entry_survives_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_llm", lambda: None)
    assert "p1_found" in e.queries() and not any(n.startswith(("p2", "p3", "p5", "p6", "p7", "p8", "p9")) for n in e.queries())
    assert e.oracle_sql().keys() <= e.queries().keys()
