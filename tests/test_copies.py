import random
from datetime import datetime

from pyspark.sql import functions as F

from textloom.operators.copies import Field, diff_copies

SCHEMA = "k bigint, part string, v string, loaded timestamp, finding string"
AT = datetime(2024, 1, 1)


def diff(spark, left, right, **more):
    frames = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
    return diff_copies(*frames, keys=["part", "k"], fields=[Field("v", lambda df: F.col("v"))], version="loaded", **more)


def brute(left, right):
    def latest(rows):
        best = {}
        for k, part, v, loaded, _ in rows:
            if (part, k) not in best or loaded > best[part, k][0]:
                best[part, k] = (loaded, v)
        return {key: v for key, (_, v) in best.items()}

    l, r = latest(left), latest(right)
    return sorted(((p, k, "right_only" if (p, k) not in l else "left_only" if (p, k) not in r else "v") for p, k in l.keys() | r.keys() if (p, k) not in l or (p, k) not in r or l[p, k] != r[p, k]), key=repr)


def test_against_brute_force(spark, rows):
    rnd = random.Random(7)
    left = [(k, rnd.choice(["a", "b"]), f"v{k}", AT, "x") for k in range(-40, 9000, 3)]
    right = [(k, p, v if rnd.random() > 0.02 else None, AT, "y") for k, p, v, _, _ in left if rnd.random() > 0.01] + [(10001, "a", "new", AT, "y")]
    left += left[:50]  # exact copies
    right += [(left[5][0], left[5][1], "old", datetime(2020, 1, 1), "y")]  # superseded
    assert rows(diff(spark, left, right)) == brute(left, right)


def test_one_part_holds_most_rows(spark, rows):
    left = [(k, "hot", "same", AT, None) for k in range(6000)] + [(1, "cold", "x", AT, None)]
    right = [(k, "hot", "same" if k != 4321 else "other", AT, None) for k in range(6000)]
    assert rows(diff(spark, left, right)) == [("cold", 1, "left_only"), ("hot", 4321, "v")]


def test_nulls_and_empty_tables(spark, rows):
    left = [(1, None, None, AT, None), (None, "a", "x", None, None), (2, "a", None, AT, None)]
    assert rows(diff(spark, left, left)) == []
    assert rows(diff(spark, left, [])) == sorted([(None, 1, "left_only"), ("a", None, "left_only"), ("a", 2, "left_only")], key=repr)
    assert rows(diff(spark, [], [])) == []
    assert rows(diff(spark, left, [(2, "a", "y", AT, None), *left[:2]])) == [("a", 2, "v")]


def test_chunk_length_does_not_change_the_result(spark, rows):
    left = [(k, "a", str(k), AT, None) for k in range(500)]
    right = [(k, "a", str(k * (k % 97 != 0)), AT, None) for k in range(500) if k % 31]
    results = [rows(diff(spark, left, right, mean_chunk=m)) for m in (1, 4, 1000)]
    assert results[0] == results[1] == results[2] == brute(left, right)
